"""Places of a resampling tree's slots in a drawing, generation by generation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = "run_idx long, cycle_idx long, walker_idx long, x double, y double"


def spread(wanted: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Places near the wanted ones, in their order, at which no two discs overlap, as a whole centred on them.

    Discs are set down from the left, each as far left as it wants and may; then the row is moved back by its mean shift.
    """
    order = np.lexsort((np.arange(len(wanted)), wanted))
    x = np.empty(len(wanted))
    edge = -np.inf
    for k in order:
        x[k] = max(wanted[k], edge + radius[k])
        edge = x[k] + radius[k]
    return x - (x - wanted).mean()


def forest_layout(parents: DataFrame, radius: float = 0.5, gap: float = 0.5) -> DataFrame:
    """PLACES of all slots; roots are at cycle -1, and a generation's slots lie below their parents, brothers side by side.

    parents: run_idx, cycle_idx, child_idx, parent_idx (without discontinuities). A generation depends on the one above,
    so one run is one task, holding one generation at a time.
    """

    def place(part: pd.DataFrame) -> pd.DataFrame:
        run = int(part.run_idx.iloc[0])
        first = part.cycle_idx.min()
        roots = np.sort(part[part.cycle_idx == first].parent_idx.unique())
        x = dict(zip(roots.tolist(), ((np.arange(len(roots)) - (len(roots) - 1) / 2) * 2 * radius).tolist(), strict=True))
        out, y = [(run, int(first) - 1, int(w), v, 0.0) for w, v in x.items()], 0.0
        for cycle, rows in part.groupby("cycle_idx"):
            rows = rows.sort_values("child_idx")
            brothers = rows.groupby("parent_idx").child_idx
            place_in, size = brothers.rank(method="first").to_numpy() - 1, brothers.transform("size").to_numpy()
            wanted = np.array([x.get(p, 0.0) for p in rows.parent_idx]) + (place_in - (size - 1) / 2) * 2 * radius
            now = spread(wanted, np.full(len(rows), radius))
            y += 2 * radius + gap
            x = dict(zip(rows.child_idx.tolist(), now.tolist(), strict=True))
            out += [(run, int(cycle), int(w), v, y) for w, v in x.items()]
        return pd.DataFrame(out, columns=["run_idx", "cycle_idx", "walker_idx", "x", "y"])

    return parents.select("run_idx", "cycle_idx", F.col("child_idx"), F.col("parent_idx")).groupBy("run_idx").applyInPandas(place, PLACES)
