"""Images, conditions and progress of receptor-ligand and toy systems, as Columns where they can be.

Coordinates are array<array<double>>: atoms of three numbers. Boxes are three edge lengths (rectangular).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import _sum, euclidean, wrapped

FLAT = "array<double>"


def _sub(a: Column, b: Column, box: Column | None = None) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return d if box is None else F.zip_with(d, box, lambda v, length: wrapped(v, length))


def _norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def pick(coords: Column, indexes: list[int]) -> Column:
    return F.array(*(coords[i] for i in indexes))


def pair_distances(coords: Column, pairs: list[tuple[int, int]], box: Column | None = None) -> Column:
    """Distances of atom pairs, to the nearest image in a periodic box: an image of a state."""
    return F.array(*(_norm(_sub(coords[i], coords[j], box)) for i, j in pairs))


def root_mean_square(a: Column, b: Column) -> Column:
    """Of the differences of two such images."""
    return euclidean(a, b) / F.sqrt(F.size(a).cast("double"))


def pair_gap(a: Column, b: Column) -> Column:
    """|d(a0, a1) - d(b0, b1)| of two states of two atoms."""
    return F.abs(_norm(_sub(a[0], a[1])) - _norm(_sub(b[0], b[1])))


def rmsd(a: Column, b: Column) -> Column:
    """Of two lists of atoms, as they lie."""
    squares = F.zip_with(a, b, lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return F.sqrt(_sum(squares) / F.size(a))


def least_distance(coords: Column, ligand: list[int], receptor: list[int], box: Column | None = None) -> Column:
    """Between any ligand and any receptor atom: progress of unbinding."""
    return F.array_min(F.array(*(_norm(_sub(coords[i], coords[j], box)) for i in ligand for j in receptor)))


def unbound(coords: Column, ligand: list[int], receptor: list[int], cutoff: float, box: Column | None = None) -> Column:
    return least_distance(coords, ligand, receptor, box) >= cutoff


def rebound(coords: Column, native: Column, ligand: list[int], cutoff: float) -> Column:
    """Whether the ligand is within an RMSD of where it is in the native state, both states superimposed before."""
    return rmsd(pick(coords, ligand), pick(native, ligand)) <= cutoff


def walked_far(positions: Column, threshold: float) -> Column:
    """Whether a random walk's coordinates add up to a threshold."""
    return _sum(positions) >= threshold


def binding_site(atoms: DataFrame, ligand: list[int], receptor: list[int], cutoff: float, periodic: bool = True) -> DataFrame:
    """(key ..., atom_idx): receptor atoms within a cutoff of any ligand atom.

    atoms: key columns, atom_idx, position (array<double>), box (array<double>; edge lengths). Atoms are dealt into cells
    as wide as the cutoff, and a ligand atom looks into its own cell and the 26 around it only; with a periodic box that is
    narrower than three cells, it looks at each cell once.
    """
    key = [c for c in atoms.columns if c not in ("atom_idx", "position", "box")]
    n = F.transform("box", lambda length: F.greatest(F.floor(length / cutoff), F.lit(1)).cast("long"))
    fold = F.zip_with("position", "box", lambda x, length: x - length * F.floor(x / length)) if periodic else F.col("position")
    rows = atoms.withColumn("position", fold).withColumn("n", n)
    cell = F.zip_with("position", F.zip_with("box", "n", lambda length, k: length / k), lambda x, width: F.floor(x / width).cast("long")) if periodic else F.transform("position", lambda x: F.floor(x / cutoff).cast("long"))
    rows = rows.withColumn("cell", cell)
    shifts = F.array(*(F.array(*(F.lit(v).cast("long") for v in (a, b, c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    around = F.transform(shifts, lambda s: F.zip_with(F.zip_with("cell", s, lambda x, d: x + d), "n", lambda x, k: F.pmod(x, k) if periodic else x))
    one = rows.filter(F.col("atom_idx").isin(*ligand)).select(*key, F.col("position").alias("p"), "box", F.explode(F.array_distinct(around)).alias("cell"))
    two = rows.filter(F.col("atom_idx").isin(*receptor)).select(*key, "atom_idx", F.col("position").alias("q"), "cell")
    near = one.join(two, [*key, "cell"]).filter(_norm(_sub(F.col("p"), F.col("q"), F.col("box") if periodic else None)) <= cutoff)
    return near.select(*key, "atom_idx").distinct()


def superimposed(states: DataFrame, reference: np.ndarray, site: list[int], atoms: list[int], coords: str = "positions", box: str | None = None) -> DataFrame:
    """states with ``image``: the ``atoms`` of each state, flat, after moving the whole so that its ``site`` lies best on the reference's.

    reference: all atoms. With a box, atoms are first brought to the images nearest to the first site atom. A
    decomposition of a 3 x 3 matrix for each state, so Arrow batches and NumPy.
    """
    target = reference[site] - reference[site].mean(0)
    centre = reference[site].mean(0)
    columns = states.columns

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for k in range(len(x)):
                p = np.stack([np.asarray(v, float) for v in x[coords].iloc[k]])
                if box is not None:
                    length = np.asarray(x[box].iloc[k], float)
                    p = p - length * np.round((p - p[site[0]]) / length)
                middle = p[site].mean(0)
                u, _, v = np.linalg.svd((p[site] - middle).T @ target)
                flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v))])
                out.append((((p[atoms] - middle) @ u @ flip @ v) + centre).ravel())
            yield x.assign(image=out)[[*columns, "image"]]

    return states.mapInPandas(move, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in states.schema.fields)}, image {FLAT}")


def walk_target(x: Column, p: float) -> Column:
    """Stationary probability of site x of a walk that steps out with probability p and reflects at 0; 1 if p is above a half."""
    r = p / (1 - p)
    return F.lit(1.0) if r > 1 else F.lit(1 - r) * F.pow(F.lit(r), x)
