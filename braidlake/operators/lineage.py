"""Who descends from whom: parents from resampling records, lineages, sliding windows, forests.

The frame of cycle c is a walker before warping and resampling of that cycle, so the parent of frame (c, w) is frame
(c - 1, parent of w in the resampling of cycle c - 1). A warp with a discontinuous target breaks every child of its slot.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

NOTHING, CLONE, SQUASH, KEEP_MERGE = 1, 2, 3, 4
ANCESTORS = (NOTHING, CLONE, KEEP_MERGE)


def resampling_panel(resampling: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, step_idx, walkers): each step's records, in the order of walkers, as an array of structs."""
    rows = F.sort_array(F.collect_list(F.struct("walker_idx", "decision_id", "target_idxs")))
    return resampling.groupBy("run_idx", "cycle_idx", "step_idx").agg(rows.alias("walkers"))


def step_parents(resampling: DataFrame, ancestors: tuple[int, ...] = ANCESTORS) -> DataFrame:
    """(run_idx, cycle_idx, step_idx, child_idx, parent_idx): squashed walkers are nobody's parents."""
    rows = resampling.filter(F.col("decision_id").isin(*ancestors))
    return rows.select("run_idx", "cycle_idx", "step_idx", F.explode("target_idxs").alias("child_idx"), F.col("walker_idx").alias("parent_idx"))


def net_parents(resampling: DataFrame, steps: int = 1, ancestors: tuple[int, ...] = ANCESTORS) -> DataFrame:
    """(run_idx, cycle_idx, child_idx, parent_idx) over all ``steps`` resampling steps of a cycle, composed in order."""
    every = step_parents(resampling, ancestors)
    key = ["run_idx", "cycle_idx"]
    out = every.filter(F.col("step_idx") == steps - 1).drop("step_idx")
    for k in range(steps - 2, -1, -1):
        before = every.filter(F.col("step_idx") == k).select(*key, F.col("child_idx").alias("parent_idx"), F.col("parent_idx").alias("grand_idx"))
        out = out.join(before, [*key, "parent_idx"]).select(*key, "child_idx", F.col("grand_idx").alias("parent_idx"))
    return out


def discontinuous(targets: tuple[int, ...] | str | None) -> Column:
    """Rule over warp records: "all", None (never) or the target indexes that break a lineage."""
    return F.lit(True) if targets == "all" else F.lit(False) if targets is None else F.col("target_idx").isin(*targets)


def broken(parents: DataFrame, warping: DataFrame, targets: tuple[int, ...] | str | None) -> DataFrame:
    """parents with parent_idx -1 where the parent's slot warped discontinuously in that cycle."""
    key = ["run_idx", "cycle_idx", "parent_idx"]
    cut = warping.filter(discontinuous(targets)).select("run_idx", "cycle_idx", F.col("walker_idx").alias("parent_idx")).distinct().withColumn("cut", F.lit(True))
    return parents.join(cut, key, "left").select("run_idx", "cycle_idx", "child_idx", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("parent_idx")).cast("long").alias("parent_idx"))


def frame_edges(parents: DataFrame, n_cycles: DataFrame | None = None, continuations: DataFrame | None = None) -> DataFrame:
    """(run_idx, cycle_idx, traj_idx, p_run, p_cycle, p_traj): each frame's parent frame, where there is one.

    With continuations (run_idx, base_run_idx) and n_cycles (run_idx, n_cycles) the first frames of a run descend from
    the last resampling of the run it continues.
    """
    live = parents.filter("parent_idx >= 0")
    own = live.select("run_idx", (F.col("cycle_idx") + 1).alias("cycle_idx"), F.col("child_idx").alias("traj_idx"), F.col("run_idx").alias("p_run"), F.col("cycle_idx").alias("p_cycle"), F.col("parent_idx").alias("p_traj"))
    if continuations is None:
        return own
    last = n_cycles.select(F.col("run_idx").alias("p_run"), (F.col("n_cycles") - 1).alias("p_cycle"))
    inner = own.join(last.select(F.col("p_run").alias("run_idx"), (F.col("p_cycle") + 1).alias("cycle_idx")), ["run_idx", "cycle_idx"], "left_anti")
    ends = live.select(F.col("run_idx").alias("p_run"), F.col("cycle_idx").alias("p_cycle"), F.col("child_idx").alias("traj_idx"), F.col("parent_idx").alias("p_traj")).join(last, ["p_run", "p_cycle"])
    glued = ends.join(continuations.withColumnRenamed("base_run_idx", "p_run"), "p_run").select("run_idx", F.lit(0).cast("long").alias("cycle_idx"), "traj_idx", "p_run", "p_cycle", "p_traj")
    return inner.unionByName(glued)


def sliding_windows(edges: DataFrame, length: int) -> DataFrame:
    """A row for each frame with length - 1 unbroken ancestors: run_k, cycle_k, traj_k for k = 0 (oldest) .. length - 1.

    A tree window: each end frame once, however many branches share its past. length - 1 equi-joins.
    """
    if length < 2:
        raise ValueError("a window has at least two frames")
    n = length - 1
    out = edges.select(*(F.col(c).alias(f"{c.split('_')[0]}_{n}") for c in ("run_idx", "cycle_idx", "traj_idx")), *(F.col(f"p_{c}").alias(f"{c}_{n - 1}") for c in ("run", "cycle", "traj")))
    for k in range(n - 1, 0, -1):
        step = edges.select(*(F.col(f"{c}_idx").alias(f"{c}_{k}") for c in ("run", "cycle", "traj")), *(F.col(f"p_{c}").alias(f"{c}_{k - 1}") for c in ("run", "cycle", "traj")))
        out = out.join(step, [f"run_{k}", f"cycle_{k}", f"traj_{k}"])
    return out.select(*(f"{c}_{k}" for k in range(length) for c in ("run", "cycle", "traj")))


FRAME = ("run_idx", "cycle_idx", "traj_idx")
PATHS = "run_idx long, cycle_idx long, traj_idx long, a_run long, a_cycle long, a_traj long, x_run long, x_cycle long, x_traj long"


def _paths(edges: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """PATHS: each start's ancestors within its block of cycles (itself included); the oldest one's row has its parent
    frame outside, if there is one. A task holds a block's edges: ``block`` cycles times the walkers of one run."""

    def walk(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        up = {(c, w): p for c, w, *p in zip(part.cycle_idx, part.traj_idx, part.p_run, part.p_cycle, part.p_traj, strict=True)}
        out = []
        for run, c0, w0 in zip(own.s_run, own.s_cycle, own.s_traj, strict=True):
            c, w = c0, w0
            while True:
                p = up.get((c, w))
                inside = p is not None and p[0] == run and p[1] // block == c0 // block
                out.append((run, c0, w0, run, c, w, *((None, None, None) if p is None or inside else p)))
                if not inside:
                    break
                _, c, w = p
        return pd.DataFrame(out, columns=[x.split()[0] for x in PATHS.split(", ")], dtype="object")

    left = edges.withColumn("block", F.floor(F.col("cycle_idx") / block)).groupBy("run_idx", "block")
    right = starts.select(F.col("run_idx").alias("s_run"), F.col("cycle_idx").alias("s_cycle"), F.col("traj_idx").alias("s_traj")).withColumn("s_block", F.floor(F.col("s_cycle") / block)).groupBy("s_run", "s_block")
    return left.cogroup(right).applyInPandas(walk, PATHS)


def tree_lineages(edges: DataFrame, trace: DataFrame, block: int = 4096, length: int | None = None) -> DataFrame:
    """(end_run, end_cycle, end_traj, run_idx, cycle_idx, traj_idx): each frame of trace and all its ancestors, across continued runs.

    edges: of ``frame_edges``. length: the number of cycles of the longest chain of runs, if it is known; lineages that
    stay within a block of a run are then found in one step. Blocks are walked in parallel, one task each; where lineages
    cross blocks, the frames at which blocks are entered are chained by pointer doubling, so the number of joins is the
    logarithm of the number of blocks.
    """
    ends = trace.select(*FRAME).distinct()
    last = ("end_run", "end_cycle", "end_traj")
    if length is not None and length <= block:
        return _paths(edges, ends, block).select(*(F.col(c).alias(e) for c, e in zip(FRAME, last, strict=True)), *(F.col(a).alias(c) for a, c in zip(("a_run", "a_cycle", "a_traj"), FRAME, strict=True)))
    crossing = edges.filter((F.col("run_idx") != F.col("p_run")) | (F.floor(F.col("cycle_idx") / block) != F.floor(F.col("p_cycle") / block)))
    entries = crossing.select(*(F.col(p).alias(c) for p, c in zip(("p_run", "p_cycle", "p_traj"), FRAME, strict=True)))
    paths = cut(_paths(edges, ends.unionByName(entries).distinct(), block))
    jump = paths.filter("x_run is not null").select(*FRAME, "x_run", "x_cycle", "x_traj")
    seen = ends.select(*(F.col(c).alias(e) for c, e in zip(FRAME, last, strict=True)), *FRAME)
    while not jump.isEmpty():
        jump = cut(jump)
        more = seen.join(jump, list(FRAME)).select(*last, *(F.col(x).alias(c) for x, c in zip(("x_run", "x_cycle", "x_traj"), FRAME, strict=True)))
        seen = cut(seen.unionByName(more))
        far = jump.select(*(F.col(c).alias(x) for c, x in zip(FRAME, ("x_run", "x_cycle", "x_traj"), strict=True)), *(F.col(x).alias(y) for x, y in zip(("x_run", "x_cycle", "x_traj"), ("y_run", "y_cycle", "y_traj"), strict=True)))
        jump = jump.join(far, ["x_run", "x_cycle", "x_traj"]).select(*FRAME, *(F.col(y).alias(x) for y, x in zip(("y_run", "y_cycle", "y_traj"), ("x_run", "x_cycle", "x_traj"), strict=True)))
    rows = seen.join(paths, list(FRAME))
    return rows.select(*last, *(F.col(a).alias(c) for a, c in zip(("a_run", "a_cycle", "a_traj"), FRAME, strict=True)))


def ancestors(parents: DataFrame, trace: DataFrame, block: int = 4096) -> DataFrame:
    """(run_idx, end_cycle, end_traj, cycle_idx, traj_idx): lineages of the frames of trace within their runs.

    A lineage ends where a parent is -1 or missing.
    """
    n = parents.agg(F.max("cycle_idx")).first()[0]
    line = tree_lineages(frame_edges(parents), trace, block, None if n is None else n + 2)
    return line.select("run_idx", "end_cycle", "end_traj", "cycle_idx", "traj_idx")


def roots_of(parents: DataFrame, trace: DataFrame, block: int = 4096) -> DataFrame:
    """(run_idx, end_cycle, end_traj, root_cycle, root_traj): where each lineage begins.

    Within a block the root is a walk; across blocks only the frames at which lineages leave them are followed.
    """
    n = parents.agg(F.max("cycle_idx")).first()[0]
    edges, ends = frame_edges(parents), trace.select(*FRAME).distinct()
    if n is not None and n + 2 > block:
        crossing = edges.filter(F.floor(F.col("cycle_idx") / block) != F.floor(F.col("p_cycle") / block))
        starts = ends.unionByName(crossing.select(F.col("p_run").alias("run_idx"), F.col("p_cycle").alias("cycle_idx"), F.col("p_traj").alias("traj_idx"))).distinct()
    else:
        starts = ends
    # of each start the last row of its path: the root, or where it goes on
    last = F.min(F.struct("a_cycle", "a_traj", "x_cycle", "x_traj")).alias("p")
    step = _paths(edges, starts, block).groupBy(*FRAME).agg(last).select(*FRAME, "p.*")
    at = ends.select("run_idx", F.col("cycle_idx").alias("end_cycle"), F.col("traj_idx").alias("end_traj"))
    if starts is ends:
        return step.select("run_idx", F.col("cycle_idx").alias("end_cycle"), F.col("traj_idx").alias("end_traj"), F.col("a_cycle").alias("root_cycle"), F.col("a_traj").alias("root_traj"))
    step = cut(step)
    while not step.filter("x_cycle is not null").isEmpty():
        far = step.select("run_idx", F.col("cycle_idx").alias("x_cycle"), F.col("traj_idx").alias("x_traj"), *(F.col(c).alias(f"f_{c}") for c in ("a_cycle", "a_traj", "x_cycle", "x_traj")))
        joined = step.join(far, ["run_idx", "x_cycle", "x_traj"], "left")
        go = F.col("f_a_cycle").isNotNull()
        step = cut(joined.select(*FRAME, *(F.when(go, F.col(f"f_{c}")).otherwise(F.col(c) if c[0] == "a" else F.lit(None)).alias(c) for c in ("a_cycle", "a_traj", "x_cycle", "x_traj"))))
    found = step.select("run_idx", F.col("cycle_idx").alias("end_cycle"), F.col("traj_idx").alias("end_traj"), F.col("a_cycle").alias("root_cycle"), F.col("a_traj").alias("root_traj"))
    return at.join(found, ["run_idx", "end_cycle", "end_traj"])


def forest(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the forest of slots after each cycle's resampling; roots are the slots at cycle -1.

    Nodes: run_idx, cycle_idx, walker_idx. Edges: parent node -> child node, with a ``discontinuity`` flag. parents holds
    plain_idx (the parent) and parent_idx (-1 if discontinuous).
    """
    edges = parents.select("run_idx", (F.col("cycle_idx") - 1).alias("from_cycle"), F.col("plain_idx").alias("from_walker"), F.col("cycle_idx").alias("to_cycle"), F.col("child_idx").alias("to_walker"), (F.col("parent_idx") < 0).alias("discontinuity"))
    nodes = edges.select("run_idx", F.col("to_cycle").alias("cycle_idx"), F.col("to_walker").alias("walker_idx")).unionByName(edges.select("run_idx", F.col("from_cycle").alias("cycle_idx"), F.col("from_walker").alias("walker_idx"))).distinct()
    return nodes, edges


def level_sizes(parents: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, n_parents, n_broken): how many slots have children in each cycle, and how many children are cut off."""
    return parents.groupBy("run_idx", "cycle_idx").agg(F.countDistinct(F.when(F.col("parent_idx") >= 0, F.col("parent_idx"))).alias("n_parents"), F.count_if(F.col("parent_idx") < 0).alias("n_broken"))


def previous_cycle(df: DataFrame, column: str) -> DataFrame:
    """The value of a column one cycle before in the same slot (not the ancestor's)."""
    return df.withColumn(f"{column}_before", F.lag(column).over(Window.partitionBy("run_idx", "traj_idx").orderBy("cycle_idx")))


def tree_of(parents: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, walker_idx, tree): the root slot (at cycle -1) of each node of the forest of ``forest``.

    parents: run_idx, cycle_idx, child_idx, parent_idx (without discontinuities). Pointer doubling over nodes: as many
    joins as the logarithm of the number of cycles.
    """
    up = parents.select("run_idx", "cycle_idx", F.col("child_idx").alias("walker_idx"), (F.col("cycle_idx") - 1).alias("u_cycle"), F.col("parent_idx").alias("u_walker"))
    while True:
        up = cut(up)
        if up.filter("u_cycle >= 0").isEmpty():
            break
        far = up.select("run_idx", F.col("cycle_idx").alias("u_cycle"), F.col("walker_idx").alias("u_walker"), F.col("u_cycle").alias("f_cycle"), F.col("u_walker").alias("f_walker"))
        up = up.join(far, ["run_idx", "u_cycle", "u_walker"], "left").select("run_idx", "cycle_idx", "walker_idx", F.coalesce("f_cycle", "u_cycle").alias("u_cycle"), F.coalesce("f_walker", "u_walker").alias("u_walker"))
    roots = up.select("run_idx", F.lit(-1).cast("long").alias("cycle_idx"), F.col("u_walker").alias("walker_idx")).distinct()
    return up.select("run_idx", "cycle_idx", "walker_idx", F.col("u_walker").alias("tree")).unionByName(roots.withColumn("tree", F.col("walker_idx")))


def forest_steps(nodes: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, walkers): the slots of each level; -1 holds the roots."""
    return nodes.groupBy("run_idx", "cycle_idx").agg(F.sort_array(F.collect_list("walker_idx")).alias("walkers"))


def with_node_attributes(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """nodes with an attribute from (run_idx, cycle_idx, walker_idx, name); null where there is no value."""
    key = ["run_idx", "cycle_idx", "walker_idx"]
    return nodes.join(values.select(*key, name), key, "left")


def with_node_arrays(nodes: DataFrame, levels: DataFrame, name: str) -> DataFrame:
    """The same from an array for each level, (run_idx, cycle_idx, name: values by slot)."""
    values = levels.select("run_idx", "cycle_idx", F.posexplode(name).alias("walker_idx", name)).withColumn("walker_idx", F.col("walker_idx").cast("long"))
    return with_node_attributes(nodes, values, name)


def forest_layout_nodes(nodes: DataFrame, frames: DataFrame, broken_slots: DataFrame, progress: str = "progress") -> DataFrame:
    """Nodes with weight, free energy (-ln weight), progress, and ``shape``: "square" for slots that a discontinuity ends, "disc" for others.

    Node (cycle c, walker w) is the slot after the resampling of c, so its frame is (c + 1, w). broken_slots: (run_idx, cycle_idx, walker_idx).
    """
    key = ["run_idx", "cycle_idx", "walker_idx"]
    values = frames.select("run_idx", (F.col("cycle_idx") - 1).alias("cycle_idx"), F.col("traj_idx").alias("walker_idx"), "weight", (-F.log("weight")).alias("free_energy"), F.col(progress).alias("progress"))
    marked = broken_slots.select(*key).distinct().withColumn("square", F.lit(True))
    return nodes.join(values, key, "left").join(marked, key, "left").withColumn("shape", F.when(F.col("square"), "square").otherwise("disc")).drop("square")
