"""User functions over trajectories, and values attached to frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["run_idx", "traj_idx", "cycle_idx"]


def compute_observable(frames: DataFrame, func: Callable[[pd.DataFrame], pd.Series], fields: list[str], name: str, kind: str = "double", args: tuple = ()) -> DataFrame:
    """(run_idx, traj_idx, cycle_idx, name): func gets a trajectory's fields in cycle order and gives a value for each frame.

    One trajectory in one task. A function of single frames is better written as a Column.
    """

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cycle_idx")
        return part[KEY].assign(**{name: pd.Series(func(part[fields], *args)).to_numpy()})

    return frames.select(*KEY, *fields).groupBy("run_idx", "traj_idx").applyInPandas(of, f"run_idx long, traj_idx long, cycle_idx long, {name} {kind}")


def attach(frames: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """frames with ``observables_<name>``; null where there is no value."""
    return frames.join(values.select(*KEY, F.col(name).alias(f"observables_{name}")), KEY, "left")
