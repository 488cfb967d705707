"""How runs continue one another: run tree, spans, traces.

The tree is kept over runs, which are few; cycles come in by a join at the end. A span is a chain of runs from one
that continues none to one that none continues; chains are put together by pointer doubling, so their length may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def run_table(frames: DataFrame, continuations: DataFrame) -> DataFrame:
    """(run_idx, n_cycles, base_run_idx or null)."""
    return frames.groupBy("run_idx").agg((F.max("cycle_idx") + 1).alias("n_cycles")).join(continuations, "run_idx", "left")


def run_paths(runs: DataFrame) -> DataFrame:
    """(run_idx, n_cycles, base_run_idx, chain): each run's chain of structs (run_idx, n_cycles) from its root run to itself.

    Each round doubles the length of the chains. A run that continues itself, at whatever distance, is an error.
    """
    now = cut(runs.select("run_idx", "n_cycles", "base_run_idx", F.array(F.struct("run_idx", "n_cycles")).alias("chain"), F.col("base_run_idx").alias("next")))
    n = now.count()
    while not now.filter("next is not null").isEmpty():
        above = now.select(F.col("run_idx").alias("next"), F.col("chain").alias("up"), F.col("next").alias("after"))
        now = cut(now.join(above, "next", "left").select("run_idx", "n_cycles", "base_run_idx", F.when(F.col("up").isNull(), F.col("chain")).otherwise(F.concat("up", "chain")).alias("chain"), F.col("after").alias("next")))
        if not now.filter(F.size("chain") > n).isEmpty():
            raise ValueError("runs continue one another in a circle")
    return now.drop("next")


def spans(runs: DataFrame) -> DataFrame:
    """(span_run, pos, run_idx, offset, n_cycles): for each last run, its chain from the root run on; offset: cycles before the run."""
    paths = run_paths(runs)
    heads = paths.join(paths.select(F.col("base_run_idx").alias("run_idx")).distinct(), "run_idx", "left_anti")
    return _chains(heads.select(F.col("run_idx").alias("span_run"), "chain"))


def _chains(heads: DataFrame) -> DataFrame:
    before = F.expr("aggregate(slice(chain, 1, pos), 0L, (a, r) -> a + r.n_cycles)")
    return heads.select("span_run", "chain", F.posexplode("chain").alias("pos", "r")).select("span_run", F.col("pos").cast("long").alias("pos"), F.col("r.run_idx").alias("run_idx"), before.alias("offset"), F.col("r.n_cycles").alias("n_cycles"))


def run_offsets(runs: DataFrame) -> DataFrame:
    """(run_idx, root_run, offset, n_cycles): the subtree that a run is in, by its root run, and the cycles before it on its branch."""
    before = F.expr("aggregate(slice(chain, 1, size(chain) - 1), 0L, (a, r) -> a + r.n_cycles)")
    return run_paths(runs).select("run_idx", F.col("chain")[0]["run_idx"].alias("root_run"), before.alias("offset"), "n_cycles")


def cycle_edges(runs: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, p_run, p_cycle): each cycle and the one before it, across continuations."""
    own = runs.filter("n_cycles > 1").select("run_idx", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_cycles") - 1)).alias("cycle_idx"), F.col("run_idx").alias("p_run")).withColumn("p_cycle", F.col("cycle_idx") - 1)
    base = runs.select(F.col("run_idx").alias("base_run_idx"), (F.col("n_cycles") - 1).alias("p_cycle"))
    glued = runs.filter("base_run_idx is not null").select("run_idx", "base_run_idx").join(base, "base_run_idx").select("run_idx", F.lit(0).cast("long").alias("cycle_idx"), F.col("base_run_idx").alias("p_run"), "p_cycle")
    return own.unionByName(glued)


def tree_roots(runs: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx) of the first cycles of runs that continue none."""
    return runs.filter("base_run_idx is null").select("run_idx", F.lit(0).cast("long").alias("cycle_idx"))


def tree_leaves(runs: DataFrame) -> DataFrame:
    """(root_run, run_idx, cycle_idx) of the last cycles of runs that none continues, by the root of their subtree."""
    rows = run_offsets(runs)
    return rows.join(runs.filter("base_run_idx is not null").select(F.col("base_run_idx").alias("run_idx")).distinct(), "run_idx", "left_anti").select("root_run", "run_idx", (F.col("n_cycles") - 1).alias("cycle_idx"))


def subtrees(runs: DataFrame) -> DataFrame:
    """(root_run, n_runs, n_cycles): connected components of the tree of cycles."""
    return run_offsets(runs).groupBy("root_run").agg(F.count("*").alias("n_runs"), F.sum("n_cycles").alias("n_cycles"))


def subtree_of(runs: DataFrame, run_idx: int) -> DataFrame:
    """(run_idx, cycle_idx) of all cycles in the same component as a run."""
    rows = run_offsets(runs)
    root = rows.filter(F.col("run_idx") == run_idx).select("root_run")
    return rows.join(root, "root_run").select("run_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cycles") - 1)).alias("cycle_idx"))


def branch_trace(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """(end_run, end_cycle, contig_cycle, run_idx, cycle_idx): for each cycle of ends (run_idx, cycle_idx) the branch from its root to it."""
    at = ends.select(F.col("run_idx").alias("end_run"), F.col("cycle_idx").alias("end_cycle")).distinct()
    chains = run_paths(runs).select(F.col("run_idx").alias("span_run"), "chain")
    rows = at.join(_chains(chains), F.col("end_run") == F.col("span_run"))
    upto = F.when(F.col("run_idx") == F.col("end_run"), F.col("end_cycle")).otherwise(F.col("n_cycles") - 1)
    return rows.select("end_run", "end_cycle", "run_idx", "offset", F.explode(F.sequence(F.lit(0).cast("long"), upto)).alias("cycle_idx")).select("end_run", "end_cycle", (F.col("offset") + F.col("cycle_idx")).alias("contig_cycle"), "run_idx", "cycle_idx")


def run_to_contig(trace: DataFrame, runs: DataFrame) -> DataFrame:
    """trace (run_idx, traj_idx, cycle_idx) with contig_cycle: the depth from the root of its branch."""
    return trace.join(run_offsets(runs).select("run_idx", "offset"), "run_idx").withColumn("contig_cycle", F.col("offset") + F.col("cycle_idx")).drop("offset")


def contig_to_run(trace: DataFrame, contig: DataFrame) -> DataFrame:
    """trace (pos, traj_idx, contig_cycle) as frames (pos, run_idx, traj_idx, cycle_idx) of one contig (contig_cycle, run_idx, cycle_idx).

    A contig cycle that isn't there is an error.
    """
    if not trace.join(contig, "contig_cycle", "left_anti").isEmpty():
        raise ValueError("a contig cycle out of range")
    return trace.join(contig.select("contig_cycle", "run_idx", "cycle_idx"), "contig_cycle").select("pos", "run_idx", "traj_idx", "cycle_idx")


def trace_parents(contig: DataFrame, parents: DataFrame) -> DataFrame:
    """(..., contig_cycle, child_idx, parent_idx): the parent table of a contig's cycles; parents as of ``lineage`` (broken or not)."""
    return contig.join(parents, ["run_idx", "cycle_idx"])


def tree_cycle_windows(runs: DataFrame, length: int) -> DataFrame:
    """run_k, cycle_k for k = 0 (oldest) .. length - 1: windows of cycles over the branching tree, shared trunks once."""
    if length < 2:
        raise ValueError("a window has at least two cycles")
    edges = cycle_edges(runs)
    n = length - 1
    out = edges.select(F.col("run_idx").alias(f"run_{n}"), F.col("cycle_idx").alias(f"cycle_{n}"), F.col("p_run").alias(f"run_{n - 1}"), F.col("p_cycle").alias(f"cycle_{n - 1}"))
    for k in range(n - 1, 0, -1):
        step = edges.select(F.col("run_idx").alias(f"run_{k}"), F.col("cycle_idx").alias(f"cycle_{k}"), F.col("p_run").alias(f"run_{k - 1}"), F.col("p_cycle").alias(f"cycle_{k - 1}"))
        out = out.join(step, [f"run_{k}", f"cycle_{k}"])
    return out.select(*(f"{c}_{k}" for k in range(length) for c in ("run", "cycle")))


def contig_fields(frames: DataFrame, contig: DataFrame, fields: list[str]) -> DataFrame:
    """(span_run, contig_cycle, traj_idx, fields ...) of a contig's cycles."""
    return contig.join(frames.select("run_idx", "cycle_idx", "traj_idx", *fields), ["run_idx", "cycle_idx"]).select("span_run", "contig_cycle", "traj_idx", *fields)


def contig_walkers(frames: DataFrame, contig: DataFrame) -> DataFrame:
    """(span_run, contig_cycle, n_walkers)."""
    n = frames.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n_walkers"))
    return contig.join(n, ["run_idx", "cycle_idx"]).select("span_run", "contig_cycle", "n_walkers")


def to_continuations(runs: list[int]) -> list[tuple[int, int]]:
    """(run, run that it continues) for runs in order."""
    return list(zip(runs[1:], runs[:-1], strict=True))


def to_runs(continuations: list[tuple[int, int]]) -> list[int]:
    """Runs in order from continuations in any order; they must make one chain."""
    base = dict(continuations)
    last = [r for r in base if r not in base.values()]
    first = [b for b in base.values() if b not in base]
    if len(base) != len(continuations) or len(last) != 1 or len(first) != 1:
        raise ValueError("the continuations aren't one chain of runs")
    out = [last[0]]
    while out[-1] in base:
        out.append(base[out[-1]])
    if len(out) != len(base) + 1:
        raise ValueError("the continuations aren't one chain of runs")
    return out[::-1]


def contig_trace(span_rows: DataFrame) -> DataFrame:
    """(span_run, contig_cycle, run_idx, cycle_idx): every cycle of every span; shared trunks are in each span."""
    return span_rows.select("span_run", "run_idx", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cycles") - 1)).alias("cycle_idx")).select("span_run", (F.col("offset") + F.col("cycle_idx")).alias("contig_cycle"), "run_idx", "cycle_idx")


def contig_records(records: DataFrame, span_rows: DataFrame) -> DataFrame:
    """Records along spans, with contig_cycle: the cycle plus those of the runs before."""
    return records.join(span_rows.select("span_run", "run_idx", "offset"), "run_idx").withColumn("contig_cycle", F.col("cycle_idx") + F.col("offset")).drop("offset")


def final_trace(frames: DataFrame, span_rows: DataFrame) -> DataFrame:
    """(run_idx, traj_idx, cycle_idx) of all walkers in the last cycle of each span."""
    last = span_rows.filter("run_idx = span_run").select("run_idx", (F.col("n_cycles") - 1).alias("cycle_idx")).distinct()
    return frames.join(last, ["run_idx", "cycle_idx"]).select("run_idx", "traj_idx", "cycle_idx")


def warp_trace(warping: DataFrame) -> DataFrame:
    return warping.select("run_idx", F.col("walker_idx").alias("traj_idx"), "cycle_idx").distinct()


def resampling_trace(resampling: DataFrame, decision_id: int) -> DataFrame:
    return resampling.filter(F.col("decision_id") == decision_id).select("run_idx", F.col("walker_idx").alias("traj_idx"), "cycle_idx").distinct()


def is_contig(continuations: DataFrame, runs: list[int]) -> bool:
    """Whether each run of the list continues the one before it."""
    if len(runs) < 2:
        return True
    pairs = continuations.sparkSession.createDataFrame(list(zip(runs[1:], runs[:-1], strict=True)), "run_idx long, base_run_idx long")
    return pairs.join(continuations, ["run_idx", "base_run_idx"], "left_anti").isEmpty()


def trace_fields(frames: DataFrame, trace: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of the frames of a trace (pos, run_idx, traj_idx, cycle_idx); order and repeats are in pos. Missing frames give nulls."""
    key = ["run_idx", "traj_idx", "cycle_idx"]
    return trace.join(frames.select(*key, *fields), key, "left").select("pos", *key, *fields)


def slice_run(table: DataFrame, run_idx: int, start: int, end: int, new_run_idx: int) -> DataFrame:
    """The rows of cycles [start, end) of a run, under a new index; cycles count from 0 again."""
    rows = table.filter((F.col("run_idx") == run_idx) & (F.col("cycle_idx") >= start) & (F.col("cycle_idx") < end))
    return rows.withColumns({"run_idx": F.lit(new_run_idx).cast("long"), "cycle_idx": F.col("cycle_idx") - start})


def append_runs(one: DataFrame, other: DataFrame, offset: int, columns: tuple[str, ...] = ("run_idx",)) -> DataFrame:
    """The union of two stores' tables, the other's runs shifted by ``offset``."""
    return one.unionByName(other.withColumns({c: F.col(c) + offset for c in columns}), allowMissingColumns=True)
