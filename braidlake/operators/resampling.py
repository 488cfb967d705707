"""Resampling of weighted ensembles: applying decisions, variation, merge candidates, greedy decisions, regions.

An ensemble is the walkers of one run and cycle: small and independent of others, so all pairs within one are its
size squared and no more; ensembles are dealt out over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_idx", "cycle_idx"]
NOTHING, CLONE, SQUASH, KEEP_MERGE = 1, 2, 3, 4
DECISIONS = {"NOTHING": NOTHING, "CLONE": CLONE, "SQUASH": SQUASH, "KEEP_MERGE": KEEP_MERGE}


def apply_decisions(walkers: DataFrame, resampling: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, slot, source_idx, weight): walkers after cloning, squashing and merging.

    walkers: run_idx, cycle_idx, traj_idx, weight. A clone shares its weight among its targets; a squashed walker's weight
    goes to the slot that it names, whose own walker stays.
    """
    rows = resampling.join(walkers.select(*KEY, F.col("traj_idx").alias("walker_idx"), "weight"), [*KEY, "walker_idx"])
    parts = rows.select(*KEY, "walker_idx", "decision_id", (F.col("weight") / F.size("target_idxs")).alias("w"), F.explode("target_idxs").alias("slot"))
    stays = F.when(F.col("decision_id") != 3, F.col("walker_idx"))
    return parts.groupBy(*KEY, "slot").agg(F.max(stays).alias("source_idx"), F.sum("w").alias("weight"))


def misplaced(walkers: DataFrame, resampling: DataFrame) -> DataFrame:
    """Slots that no walker or several walkers end up in: empty for valid records."""
    ends = resampling.filter("decision_id <> 3").select(*KEY, F.explode("target_idxs").alias("slot")).groupBy(*KEY, "slot").agg(F.count("*").alias("n"))
    slots = walkers.select(*KEY, F.col("traj_idx").alias("slot"))
    return slots.join(ends, [*KEY, "slot"], "full").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")


def out_of_bounds(walkers: DataFrame, pmin: float, pmax: float) -> DataFrame:
    return walkers.filter((F.col("weight") < pmin) | (F.col("weight") > pmax))


def max_clones(weight: Column, pmin: float, most: int) -> Column:
    """The largest number of extra copies so that each still has pmin."""
    return F.greatest(F.least(F.floor(weight / pmin), F.lit(most)) - 1, F.lit(0)).cast("long")


def lightest_to_merge(walkers: DataFrame, balance: int, pmax: float) -> DataFrame:
    """(run_idx, cycle_idx, traj_idx): the balance + 1 lightest walkers of each ensemble, if together at most pmax."""
    w = Window.partitionBy(*KEY).orderBy("weight", "traj_idx")
    few = walkers.select(*KEY, "traj_idx", "weight", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= balance + 1)
    return few.withColumn("total", F.sum("weight").over(Window.partitionBy(*KEY))).filter(F.col("total") <= pmax).select(*KEY, "traj_idx")


def squashable(walkers: DataFrame, pmax: float) -> DataFrame:
    """(run_idx, cycle_idx, n): the largest merge's size less 1; 0 for fewer than two walkers, -1 if even the lightest is too heavy."""
    running = F.sum("weight").over(Window.partitionBy(*KEY).orderBy("weight", "traj_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = walkers.select(*KEY, running.alias("upto"))
    return rows.groupBy(*KEY).agg(F.when(F.count("*") < 2, 0).otherwise(F.count_if(F.col("upto") <= pmax) - 1).cast("long").alias("n"))


def novelty(weight: Column, copies: Column, pmin: float = 1e-12) -> Column:
    """max(0, ln(weight / copies) - ln(pmin / 100)); 0 where weight or copies aren't positive."""
    return F.when((weight > 0) & (copies > 0), F.greatest(F.lit(0.0), F.log(weight / copies) - F.lit(float(np.log(pmin / 100))))).otherwise(0.0)


def distance_pairs(walkers: DataFrame, distance) -> DataFrame:
    """(ensemble ..., i, j, distance) for i < j. walkers: run_idx, cycle_idx, traj_idx, image. distance: (Column, Column) -> Column."""
    a = walkers.select(*KEY, F.col("traj_idx").alias("i"), F.col("image").alias("one"))
    b = walkers.select(*KEY, F.col("traj_idx").alias("j"), F.col("image").alias("two"))
    return a.join(b, KEY).filter("i < j").select(*KEY, "i", "j", distance(F.col("one"), F.col("two")).alias("distance"))


def variation(pairs: DataFrame, walkers: DataFrame, char_dist: float, exponent: float = 4.0, pmin: float = 1e-12) -> DataFrame:
    """(run_idx, cycle_idx, variation): sum over pairs of (d / char_dist) ** exponent * novelty_i * novelty_j * n_i * n_j.

    walkers: run_idx, cycle_idx, traj_idx, weight, copies.
    """
    phi = walkers.select(*KEY, "traj_idx", (novelty(F.col("weight"), F.col("copies"), pmin) * F.col("copies")).alias("phi"))
    side = lambda k: phi.select(*KEY, F.col("traj_idx").alias(k), F.col("phi").alias(f"phi_{k}"))
    rows = pairs.join(side("i"), [*KEY, "i"]).join(side("j"), [*KEY, "j"])
    return rows.groupBy(*KEY).agg(F.sum(F.pow(F.col("distance") / char_dist, F.lit(exponent)) * F.col("phi_i") * F.col("phi_j")).alias("variation"))


def merge_candidates(pairs: DataFrame, walkers: DataFrame, merge_dist: float, pmax: float) -> DataFrame:
    """(run_idx, cycle_idx, i, j, distance): pairs of single-copy walkers, near and together lighter than pmax."""
    one = walkers.filter("copies = 1")
    side = lambda k: one.select(*KEY, F.col("traj_idx").alias(k), F.col("weight").alias(f"w_{k}"))
    rows = pairs.filter(F.col("distance") < merge_dist).join(side("i"), [*KEY, "i"]).join(side("j"), [*KEY, "j"])
    return rows.filter(F.col("w_i") + F.col("w_j") < pmax).select(*KEY, "i", "j", "distance")


def nearest(walkers: DataFrame, regions: DataFrame, distance) -> DataFrame:
    """(run_idx, cycle_idx, traj_idx, region_idx, distance): the nearest region of the walker's run; the first of equals.

    regions: run_idx, region_idx, image (a few for each run).
    """
    rows = walkers.select(*KEY, "traj_idx", "image").join(regions.select("run_idx", "region_idx", F.col("image").alias("centre")), "run_idx")
    best = F.min(F.struct(distance(F.col("image"), F.col("centre")).alias("distance"), "region_idx")).alias("b")
    return rows.groupBy(*KEY, "traj_idx").agg(best).select(*KEY, "traj_idx", "b.region_idx", "b.distance")


def region_rollup(assigned: DataFrame) -> DataFrame:
    """(region, n_walkers, weight) for each region and all regions above it. assigned: region (an array path), weight."""
    above = F.transform(F.sequence(F.lit(1), F.size("region")), lambda k: F.slice("region", F.lit(1), k))
    return assigned.select("weight", F.explode(above).alias("region")).groupBy("region").agg(F.count("*").alias("n_walkers"), F.sum("weight").alias("weight"))


def no_decisions(walkers: DataFrame) -> DataFrame:
    """Resampling records that leave each walker where it is."""
    return walkers.select(*KEY, F.lit(0).cast("long").alias("step_idx"), F.col("traj_idx").alias("walker_idx"), F.lit(NOTHING).cast("long").alias("decision_id"), F.array("traj_idx").alias("target_idxs"))


def record(decision: int | str, targets: list[int]) -> tuple[int, list[int]]:
    """A decision by number or name, and its target slots."""
    value = DECISIONS[decision] if isinstance(decision, str) else decision
    if value not in DECISIONS.values():
        raise ValueError(f"no such decision: {decision}")
    return value, list(targets)


def decision_name(value: int) -> str:
    return next(k for k, v in DECISIONS.items() if v == value)


def walker_limits(n_walkers: int, least=..., most=...) -> tuple[int | None, int | None]:
    """The least and largest number of walkers after resampling: None is no limit, ... the number there is, an int itself."""
    if n_walkers < 1:
        raise ValueError("no walkers to resample")
    given = lambda x: None if x is None else n_walkers if x is ... else int(x)
    low, high = given(least), given(most)
    if low is not None and n_walkers < low or high is not None and n_walkers > high:
        raise ValueError(f"{n_walkers} walkers aren't within {low} and {high}")
    return low, high


def copies_allowed(weight: float, pmin: float, most: int) -> int:
    """``max_clones`` of one weight."""
    return max(min(math.floor(weight / pmin), most) - 1, 0)


def merges_allowed(weights: np.ndarray, pmax: float) -> int:
    """``squashable`` of one ensemble's weights."""
    return 0 if len(weights) < 2 else int((np.cumsum(np.sort(weights)) <= pmax).sum()) - 1


def decision_records(groups: list[list[int]], clones: list[int]) -> list[tuple[int, list[int]]]:
    """(decision, target slots) of each walker. groups: the walkers squashed into each; clones: the extra copies of each.

    Copies take the slots of squashed walkers, the last freed first, and new slots behind the others once those are gone.
    """
    out = [(NOTHING, [k]) for k in range(len(clones))]
    free: list[int] = []
    for k, group in enumerate(groups):
        if group and clones[k]:
            raise ValueError(f"walker {k} can't be cloned and merged into")
        if group:
            free += group
            out[k] = (KEEP_MERGE, [k])
            for x in group:
                out[x] = (SQUASH, [k])
    new = len(clones)
    for k, n in enumerate(clones):
        if n:
            targets = [k]
            for _ in range(n):
                if free:
                    targets.append(free.pop())
                else:
                    targets.append(new)
                    new += 1
            out[k] = (CLONE, targets)
    return out


DECIDED = "run_idx long, cycle_idx long, walker_idx long, decision_id long, target_idxs array<long>, variation double"


class Variation:
    """Variation of an ensemble: sum over pairs of (d / char_dist) ** exponent times both walkers' novelty and copies."""

    def __init__(self, distances: np.ndarray, char_dist: float, exponent: float, pmin: float):
        self.power, self.floor = (distances / char_dist) ** exponent, np.log(pmin / 100)

    def of(self, weights: np.ndarray, copies: np.ndarray) -> tuple[float, np.ndarray]:
        """(the whole, each walker's part)."""
        ok = (weights > 0) & (copies > 0)
        phi = np.zeros(len(weights))
        phi[ok] = np.maximum(0, np.log(weights[ok] / copies[ok]) - self.floor) * copies[ok]
        each = phi * (self.power @ phi - np.diag(self.power) * phi)
        return each.sum() / 2, each


def decide_greedily(weights: np.ndarray, distances: np.ndarray, merge_dist: float, char_dist: float, pmin: float, pmax: float, exponent: float, method: str, draw: Callable[[], float]) -> tuple[list[list[int]], list[int], float]:
    """(merge groups, numbers of clones, variation) of one ensemble.

    A step clones the walker that adds most to the variation and merges two others: "pairs" takes the pair that loses
    least, "greedy" the walker that adds least and its nearest permitted neighbour. The step is tried with both walkers
    as fractional copies, of w_i / (w_i + w_j) each; only if that raises the variation does ``draw`` (uniform in 0 to 1)
    decide which of the two stays.
    """
    if method not in ("pairs", "greedy"):
        raise ValueError(f"no such method: {method}")
    n = len(weights)
    measure = Variation(distances, char_dist, exponent, pmin)
    weights, copies = weights.astype(float).copy(), np.ones(n)
    groups: list[list[int]] = [[] for _ in range(n)]
    clones = [0] * n
    value, each = measure.of(weights, copies)
    result = value
    while True:
        can = [k for k in range(n) if copies[k] >= 1 and weights[k] / (copies[k] + 1) > pmin and not groups[k]]
        if not can:
            break
        top = max(can, key=lambda k: (each[k], k))
        if method == "pairs":
            i, j = np.triu_indices(n, 1)
            ok = (copies[i] == 1) & (copies[j] == 1) & (i != top) & (j != top) & (weights[i] + weights[j] < pmax) & (distances[i, j] < merge_dist)
            if not ok.any():
                break
            i, j = i[ok], j[ok]
            k = int(np.argmin((weights[j] * each[i] + weights[i] * each[j]) / (weights[i] + weights[j])))
            a, b = int(i[k]), int(j[k])
        else:
            low = [k for k in range(n) if copies[k] == 1 and weights[k] < pmax]
            if not low:
                break
            a = min(low, key=lambda k: (each[k], k))
            near = [k for k in range(n) if k not in (a, top) and copies[k] == 1 and weights[k] + weights[a] < pmax and distances[a, k] < merge_dist]
            if a == top or not near:
                break
            b = min(near, key=lambda k: (distances[a, k], k))
        both = weights[a] + weights[b]
        trial = copies.copy()
        trial[a], trial[b], trial[top] = weights[a] / both, weights[b] / both, copies[top] + 1
        new, _ = measure.of(weights, trial)
        if new <= value:
            break
        value = new
        keep, lose = (b, a) if draw() * both < weights[b] else (a, b)
        weights[keep], weights[lose] = both, 0.0
        copies[keep], copies[lose], copies[top] = 1, 0, copies[top] + 1
        groups[keep] += [lose, *groups[lose]]
        groups[lose] = []
        clones[top] += 1
        result, each = measure.of(weights, copies)
    return groups, clones, result


def greedy_decisions(walkers: DataFrame, merge_dist: float, char_dist: float, pmin: float = 1e-12, pmax: float = 0.1, exponent: float = 4.0, seed: int = 0, method: str = "pairs", distance: Callable[[np.ndarray, np.ndarray], float] | None = None) -> DataFrame:
    """Clone-and-merge decisions that raise each ensemble's variation as long as they can (``decide_greedily``).

    walkers: run_idx, cycle_idx, traj_idx, weight, image (array<double>). distance: of two images, by default the mean
    absolute difference. Draws are seeded by ensemble. Sequential within an ensemble, so one task decides one ensemble;
    ensembles run in parallel.
    """

    def decide(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("traj_idx")
        slots = x.traj_idx.to_numpy()
        rng = np.random.default_rng([seed, int(x.run_idx.iloc[0]), int(x.cycle_idx.iloc[0])])
        image = np.stack([np.asarray(v, float) for v in x.image])
        d = np.stack([np.abs(image - v).mean(1) for v in image]) if distance is None else np.array([[distance(a, b) for b in image] for a in image])
        groups, clones, value = decide_greedily(x.weight.to_numpy(), d, merge_dist, char_dist, pmin, pmax, exponent, method, rng.random)
        rows = decision_records(groups, clones)
        return pd.DataFrame({"run_idx": x.run_idx.to_numpy(), "cycle_idx": x.cycle_idx.to_numpy(), "walker_idx": slots, "decision_id": [r[0] for r in rows], "target_idxs": [[int(slots[t]) for t in r[1]] for r in rows], "variation": value})

    return walkers.select(*KEY, "traj_idx", "weight", "image").groupBy(*KEY).applyInPandas(decide, DECIDED)


def balanced_shares(assigned: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, region_idx, n_walkers, shares): walkers given from crowded regions to sparse ones.

    Again and again the fullest region (the first of equals) gives half the difference, rounded down, to the emptiest; a
    region with walkers keeps one. It goes on until nothing can be given. One ensemble in one task.
    """

    def balance(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("region_idx")
        shares = x.n_walkers.to_numpy().copy()
        while True:
            a, b = int(shares.argmax()), int(shares.argmin())
            give = min((shares[a] - shares[b]) // 2, shares[a] - 1)
            if give <= 0:
                break
            shares[a] -= give
            shares[b] += give
        return x.assign(shares=shares)

    counts = assigned.groupBy(*KEY, "region_idx").agg(F.count("*").alias("n_walkers"))
    return counts.groupBy(*KEY).applyInPandas(balance, "run_idx long, cycle_idx long, region_idx long, n_walkers long, shares long")


def warp_walkers(walkers: DataFrame, crossing: Column, initial_weights: list[float], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(walkers, records): walkers that cross get an initial state drawn by its weight, and keep their own weight.

    The draw is a hash of run, cycle, slot and seed, so that it is the same in every attempt of a task. Walkers get
    ``target_idx``, null where they stay.
    """
    edges = np.cumsum(initial_weights) / np.sum(initial_weights)
    u = F.shiftrightunsigned(F.xxhash64(*KEY, "traj_idx", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    pick = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        pick = F.when(u < float(edges[k]), k).otherwise(pick)
    out = walkers.withColumn("target_idx", F.when(crossing, pick.cast("long")))
    records = out.filter("target_idx is not null").select(*KEY, F.col("traj_idx").alias("walker_idx"), "target_idx", "weight")
    return out, records


def merged_survivors(walkers: DataFrame, seed: int = 0) -> DataFrame:
    """(group ..., kept_idx, weight) for walkers (run_idx, cycle_idx, merge_group, traj_idx, weight): one of each group, drawn by weight, keeps the sum.

    The least of -ln(u) / weight, u uniform from a hash, is a draw by weight, and a partial aggregate.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*KEY, "traj_idx", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return walkers.groupBy(*KEY, "merge_group").agg(F.min_by("traj_idx", -F.log(u) / F.col("weight")).alias("kept_idx"), F.sum("weight").alias("weight"))


def random_warps(walkers: DataFrame, seed: int = 0) -> DataFrame:
    """(run_idx, cycle_idx, walker_idx, target_idx, weight): half of the walkers warp, each half of those to target 0 and 1; a test's condition."""
    coin = F.xxhash64(*KEY, "traj_idx", F.lit(seed))
    rows = walkers.filter(coin.bitwiseAND(F.lit(1)) == 1)
    return rows.select(*KEY, F.col("traj_idx").alias("walker_idx"), F.shiftright(coin, 1).bitwiseAND(F.lit(1)).cast("long").alias("target_idx"), "weight")


def random_walk(walkers: DataFrame, steps: int, p: float = 0.25, seed: int = 0, positions: str = "positions") -> DataFrame:
    """walkers after ``steps`` steps: each coordinate goes up with probability p, else down, but not below 0.

    The coins are hashes of run, cycle, slot, step and dimension: the same in every attempt of a task.
    """
    coin = lambda dim, step: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY, "traj_idx", dim, step), 11).cast("double") / F.lit(float(1 << 53))
    walk = lambda x, dim: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x.cast("long"), lambda a, s: F.greatest(a + F.when(coin(dim, s) < p, F.lit(1)).otherwise(F.lit(-1)), F.lit(0)).cast("long"))
    return walkers.withColumn(positions, F.transform(positions, lambda x, i: walk(x, i)) if steps else F.col(positions))
