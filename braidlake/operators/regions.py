"""Hierarchical regions that grow with what walkers explore, and balancing of walkers over them.

A region is known by its path of child numbers from the root. Its tree belongs to one run and changes from cycle to
cycle in the order of walkers, so a run is decided in one task, cycle after cycle; runs are decided in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import copies_allowed, decision_records, merges_allowed

Path = tuple[int, ...]
PLACED = "run_idx long, cycle_idx long, walker_idx long, region string, distances array<double>, branch_level int, decision_id long, target_idxs array<long>"


@dataclass
class RegionTree:
    """Images of regions by parent. sizes: how far a walker may be from its region's image, by level; numbers: children of a node, at most."""

    sizes: tuple[float, ...]
    numbers: tuple[int, ...]
    distance: Callable[[np.ndarray, np.ndarray], float]
    images: dict[Path, list[np.ndarray]] = field(default_factory=dict)

    def plant(self, image: np.ndarray) -> None:
        self.branch((), image)

    def branch(self, parent: Path, image: np.ndarray) -> Path:
        """A new child of parent, and one below it at each further level, all with this image; its leaf."""
        path = parent
        while len(path) < len(self.sizes):
            children = self.images.setdefault(path, [])
            children.append(image)
            path = (*path, len(children) - 1)
        return path

    def find(self, image: np.ndarray) -> tuple[Path, list[float]]:
        """The nearest child at each level, the first of equals, and the distances to their images."""
        path, far = (), []
        for _ in self.sizes:
            d = [self.distance(image, x) for x in self.images[path]]
            k = int(np.argmin(d))
            path, far = (*path, k), [*far, float(d[k])]
        return path, far

    def place(self, image: np.ndarray) -> tuple[Path, list[float], int | None]:
        """Where a walker belongs; at the first level where it is too far away and there is room, a region grows around it."""
        path, far = self.find(image)
        for level, d in enumerate(far):
            if d > self.sizes[level] and len(self.images[path[:level]]) < self.numbers[level]:
                return self.branch(path[:level], image), far, level
        return path, far, None

    def nodes(self, level: int) -> list[Path]:
        return [()] if level == 0 else [(*p, k) for p in self.nodes(level - 1) for k in range(len(self.images.get(p, [])))]

    def leaves(self) -> list[Path]:
        return self.nodes(len(self.sizes))

    def children(self, path: Path) -> list[Path]:
        return [(*path, k) for k in range(len(self.images.get(path, [])))]


def pay(balance: int, give: list[int], take: list[int]) -> list[int]:
    """A parent's balance handed down to its children in order, as far as each can give (balance < 0) or take."""
    if len(give) == 1:
        return [balance]
    out, left = [], abs(balance)
    for g, t in zip(give, take, strict=True):
        part = min(left, max(g, 0) if balance < 0 else t)
        out.append(part if balance > 0 else -part)
        left -= part
    if left:
        raise ValueError("the regions can't settle their parent's balance")
    return out


def even_out(shares: list[int], give: list[int], take: list[int], names: list[Path] | None = None) -> list[int]:
    """Shares after donations between siblings: each time the pair that differs most (of those where anything can be
    given), half the difference rounded down, no more than one can give and the other take; until nothing is given, or
    a single walker is for the second time in a row."""
    shares, give, take = list(shares), list(give), list(take)
    names = names or [(k,) for k in range(len(shares))]
    before = 0
    while True:
        best = (0, 0, (), ())
        pair = None
        for a in range(len(shares)):
            for b in range(a + 1, len(shares)):
                x, y = (a, b) if shares[a] >= shares[b] else (b, a)
                amount = min(math.floor((shares[x] - shares[y]) / 2), give[x], take[y])
                key = (shares[x] - shares[y], amount, names[x], names[y])
                if amount > 0 and key > best:
                    best, pair = key, (x, y)
        if pair is None:
            return shares
        x, y, amount = *pair, best[1]
        shares[x], shares[y] = shares[x] - amount, shares[y] + amount
        give[x], give[y] = give[x] - amount, give[y] + amount
        take[x], take[y] = take[x] + amount, take[y] - amount
        if before == 1 and amount == 1:
            return shares
        before = amount


def leaf_balances(tree: RegionTree, members: dict[Path, list[int]], weights: np.ndarray, pmin: float, pmax: float, most: int, change: int = 0) -> dict[Path, int]:
    """How many walkers each leaf gains or loses, from the root down. members: walkers of each leaf."""
    n, give, take = {}, {}, {}
    for leaf in tree.leaves():
        own = members.get(leaf, [])
        for level in range(len(leaf) + 1):
            node = leaf[:level]
            n[node] = n.get(node, 0) + len(own)
            give[node] = give.get(node, 0) + merges_allowed(weights[own], pmax)
            take[node] = take.get(node, 0) + sum(copies_allowed(weights[k], pmin, most) for k in own)
    balance = {(): change}
    for level in range(len(tree.sizes)):
        for node in tree.nodes(level):
            names = tree.children(node)
            own, g, t = ([x[c] for c in names] for x in (n, give, take))
            handed = pay(balance[node], g, t)
            after = even_out([a + d for a, d in zip(own, handed, strict=True)], [a + d for a, d in zip(g, handed, strict=True)], [a - d for a, d in zip(t, handed, strict=True)], names)
            balance |= {c: a - b for c, a, b in zip(names, after, own, strict=True)}
    return {leaf: balance[leaf] for leaf in tree.leaves()}


def settle(balances: dict[Path, int], members: dict[Path, list[int]], weights: np.ndarray, pmin: float, pmax: float, most: int, draw: Callable[[list[int], np.ndarray], int]) -> tuple[list[list[int]], list[int]]:
    """(merge groups, numbers of clones) by walker that pay the balances: lightest walkers of a leaf merge, into one that
    ``draw`` picks by weight; the copies that stay heaviest are cloned."""
    groups: list[list[int]] = [[] for _ in weights]
    clones = [0] * len(weights)
    for leaf, balance in balances.items():
        own = members.get(leaf, [])
        if balance < 0:
            few = [own[k] for k in np.argsort(weights[own], kind="stable")[: 1 - balance]]
            if len(few) < 1 - balance or weights[few].sum() > pmax:
                raise ValueError("no merge of a region's walkers keeps to the largest weight")
            keep = draw(few, weights[few] / weights[few].sum())
            groups[keep] = [k for k in few if k != keep]
        room = {k: copies_allowed(weights[k], pmin, most) for k in own}
        if balance > sum(room.values()):
            raise ValueError("a region's walkers can't be cloned as often as that")
        for _ in range(max(balance, 0)):
            open_ = [k for k in own if clones[k] < room[k]]
            k = max(reversed(open_), key=lambda k: weights[k] / (clones[k] + 1))
            clones[k] += 1
    return groups, clones


def explore(walkers: DataFrame, sizes: tuple[float, ...], numbers: tuple[int, ...], pmin: float = 1e-12, pmax: float = 0.1, distance: Callable[[np.ndarray, np.ndarray], float] | None = None, seed: int = 0) -> DataFrame:
    """PLACED: each walker's region, whether a region grew around it (branch_level), and what resampling does with it.

    walkers: run_idx, cycle_idx, traj_idx, weight, image (array<double>). A run's first walker plants its tree. The
    number of walkers stays. Images of all regions of a run are in its task's memory: numbers of children bound them.
    """
    distance = distance or (lambda a, b: float(np.abs(a - b).mean()))

    def of(part: pd.DataFrame) -> pd.DataFrame:
        tree, out = RegionTree(sizes, numbers, distance), []
        run = int(part.run_idx.iloc[0])
        for cycle, now in part.sort_values(["cycle_idx", "traj_idx"]).groupby("cycle_idx"):
            rng = np.random.default_rng([seed, run, int(cycle)])
            weights = now.weight.to_numpy(float)
            if not tree.images:
                tree.plant(np.asarray(now.image.iloc[0], float))
            placed = [tree.place(np.asarray(x, float)) for x in now.image]
            members: dict[Path, list[int]] = {}
            for k, (path, _, _) in enumerate(placed):
                members.setdefault(path, []).append(k)
            balances = leaf_balances(tree, members, weights, pmin, pmax, len(weights))
            records = decision_records(*settle(balances, members, weights, pmin, pmax, len(weights), lambda few, p, r=rng: few[int(r.choice(len(few), p=p))]))
            slots = now.traj_idx.to_numpy()
            for k, ((path, far, level), (decision, targets)) in enumerate(zip(placed, records, strict=True)):
                out.append((run, int(cycle), int(slots[k]), "/".join(map(str, path)), far, level, decision, [int(slots[t]) for t in targets]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])
        return frame.astype({"branch_level": "Int32"})

    return walkers.select("run_idx", "cycle_idx", "traj_idx", "weight", "image").groupBy("run_idx").applyInPandas(of, PLACED)


def region_summary(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_idx, level, n_regions) and (run_idx, region, n_children) of the regions that walkers were ever placed in."""
    paths = placed.select("run_idx", F.split("region", "/").alias("p")).distinct()
    nodes = paths.select("run_idx", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.slice("p", F.lit(1), k))).alias("p")).distinct()
    levels = nodes.groupBy("run_idx", F.size("p").cast("long").alias("level")).agg(F.count("*").alias("n_regions"))
    parents = nodes.filter(F.size("p") > 1).groupBy("run_idx", F.array_join(F.expr("slice(p, 1, size(p) - 1)"), "/").alias("region")).agg(F.count("*").alias("n_children"))
    return levels, parents
