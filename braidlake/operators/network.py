"""Networks between macrostates: weighted transitions over ancestor-respecting windows, matrices, nodes."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

FRAME = ["run_idx", "cycle_idx", "traj_idx"]


def transition_edges(frames: DataFrame, windows: DataFrame, length: int, state: str = "state") -> DataFrame:
    """(source, target, unweighted_counts, weighted_counts): a window counts with its first frame's weight."""
    ends = windows.select(*(F.col(f"{c.split('_')[0]}_{k}").alias(f"{c}_{k}") for k in (0, length - 1) for c in FRAME))
    start = frames.select(*(F.col(c).alias(f"{c}_0") for c in FRAME), F.col(state).alias("source"), "weight")
    end = frames.select(*(F.col(c).alias(f"{c}_{length - 1}") for c in FRAME), F.col(state).alias("target"))
    rows = ends.join(start, [f"{c}_0" for c in FRAME]).join(end, [f"{c}_{length - 1}" for c in FRAME])
    return rows.groupBy("source", "target").agg(F.count("*").alias("unweighted_counts"), F.sum("weight").alias("weighted_counts"))


def edge_weights(frames: DataFrame, windows: DataFrame, length: int, state: str = "state") -> DataFrame:
    """(source, target, weight): the start weight of each window, a row each; what the counts of an edge are made of."""
    ends = windows.select(*(F.col(f"{c.split('_')[0]}_{k}").alias(f"{c}_{k}") for k in (0, length - 1) for c in FRAME))
    start = frames.select(*(F.col(c).alias(f"{c}_0") for c in FRAME), F.col(state).alias("source"), "weight")
    end = frames.select(*(F.col(c).alias(f"{c}_{length - 1}") for c in FRAME), F.col(state).alias("target"))
    return ends.join(start, [f"{c}_0" for c in FRAME]).join(end, [f"{c}_{length - 1}" for c in FRAME]).select("source", "target", "weight")


def assigned(frames: DataFrame, assignments: DataFrame) -> DataFrame:
    """frames with ``state`` from explicit assignments (run_idx, traj_idx, cycle_idx, state); frames without one are an error."""
    if not frames.join(assignments, FRAME, "left_anti").isEmpty():
        raise ValueError("frames without an assignment")
    return frames.drop("state").join(assignments.select(*FRAME, "state"), FRAME)


def checked_lag(lag: int) -> int:
    if lag < 2:
        raise ValueError("a lag time has at least two cycles")
    return lag


def nodes(frames: DataFrame, state: str = "state") -> DataFrame:
    """(node_id, node_idx, num_samples, total_weight); node_idx in the order in which states first appear (run, slot, cycle).

    States are sorted by ranges, and numbered by the sizes of the ranges before: no task sees all of them.
    """
    first = frames.groupBy(F.col(state).alias("node_id")).agg(F.min(F.struct("run_idx", "traj_idx", "cycle_idx")).alias("first"), F.count("*").alias("num_samples"), F.sum("weight").alias("total_weight"))
    parts = cut(first.repartitionByRange("first").withColumn("part", F.spark_partition_id()))
    size = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    before, total = {}, 0
    for k in sorted(size):
        before[k], total = total, total + size[k]
    offset = F.create_map(*(F.lit(x) for k, v in before.items() for x in (k, v)))[F.col("part")] if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    return parts.withColumn("node_idx", (rank + offset).cast("long")).drop("first", "part")


#: Cells of a dense matrix, at most.
DENSE = 1 << 24


def cells(edges: DataFrame, node_rows: DataFrame, value: str) -> DataFrame:
    """(i, j, value) by node_idx, of the edges there are."""
    one = node_rows.select(F.col("node_id").alias("source"), F.col("node_idx").alias("i"))
    two = node_rows.select(F.col("node_id").alias("target"), F.col("node_idx").alias("j"))
    return edges.join(one, "source").join(two, "target").select("i", "j", F.col(value).cast("double").alias("value"))


def matrix(edges: DataFrame, node_rows: DataFrame, value: str, fill: float | None = 0.0) -> DataFrame:
    """(i, j, value) for all pairs of nodes, by node_idx. A matrix of more than DENSE cells is refused: use ``cells``."""
    n = node_rows.count()
    if n * n > DENSE:
        raise ValueError(f"{n} nodes make a matrix of more than {DENSE} cells; use cells()")
    return dense(cells(edges, node_rows, value), n, fill)


def dense(sparse: DataFrame, n: int, fill: float | None = 0.0) -> DataFrame:
    """All n * n cells (i, j, value), in parallel by rows; ``fill`` where sparse has none."""
    grid = sparse.sparkSession.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))).cast("array<long>")).alias("j"))
    out = grid.join(sparse, ["i", "j"], "left")
    return out.select("i", "j", F.coalesce("value", F.lit(fill)).alias("value") if fill is not None else F.col("value"))


def counts_matrix(counts: DataFrame, value: str = "n") -> DataFrame:
    """(i, j, value): a square matrix over 0 .. the largest state, from counts (source, target: ints, n); zero elsewhere."""
    largest = counts.agg(F.max(F.greatest("source", "target"))).first()[0]
    n = 0 if largest is None else int(largest) + 1
    if n * n > DENSE:
        raise ValueError(f"states up to {largest} make a matrix of more than {DENSE} cells")
    return dense(counts.select(F.col("source").cast("long").alias("i"), F.col("target").cast("long").alias("j"), F.col(value).cast("double").alias("value")), n)


def run_counts(assigned: DataFrame, transitions: DataFrame, run_idx: int) -> DataFrame:
    """(source, target, n) in one run. assigned: run_idx, traj_idx, cycle_idx, state; transitions: run_idx, s_traj, s_cycle, t_traj, t_cycle."""
    own = assigned.filter(F.col("run_idx") == run_idx)
    s = own.select("run_idx", F.col("traj_idx").alias("s_traj"), F.col("cycle_idx").alias("s_cycle"), F.col("state").alias("source"))
    t = own.select("run_idx", F.col("traj_idx").alias("t_traj"), F.col("cycle_idx").alias("t_cycle"), F.col("state").alias("target"))
    rows = transitions.filter(F.col("run_idx") == run_idx).join(s, ["run_idx", "s_traj", "s_cycle"]).join(t, ["run_idx", "t_traj", "t_cycle"])
    return rows.groupBy("source", "target").agg(F.count("*").alias("n"))


def normalized(cells: DataFrame, by: str = "column") -> DataFrame:
    """Each entry over its column's (end state's) or row's sum; a column or row of zeros gets 1 on the diagonal."""
    key = "j" if by == "column" else "i"
    total = F.sum("value").over(Window.partitionBy(key))
    return cells.select("i", "j", F.when(total != 0, F.col("value") / total).when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("value"))


def with_group(node_rows: DataFrame, name: str, ids: list) -> DataFrame:
    return node_rows.withColumn(f"group_{name}", F.col("node_id").isin(*ids) if ids else F.lit(False))


def node_frames(frames: DataFrame, ids: list, fields: list[str], state: str = "state") -> DataFrame:
    """Fields of the frames in some states."""
    return frames.filter(F.col(state).isin(*ids)).select(F.col(state).alias("node_id"), *FRAME, *fields)


def with_observable(node_rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """node_rows with ``observable_<name>`` from values (node_id, value)."""
    return node_rows.join(values.select("node_id", F.col("value").alias(f"observable_{name}")), "node_id", "left")


def with_layout(node_rows: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """node_rows with ``layout_<name>`` from values (node_id, value: an array of coordinates)."""
    return node_rows.join(values.select("node_id", F.col("value").alias(f"layout_{name}")), "node_id", "left")


def named(node_rows: DataFrame, kind: str) -> list[str]:
    """Names of the groups, observables or layouts ("group", "observable", "layout") that nodes have."""
    return [c[len(kind) + 1 :] for c in node_rows.columns if c.startswith(f"{kind}_")]


def attributes_of(rows: DataFrame, key: dict, attribute: str | None = None) -> DataFrame:
    """All attributes, or one, of a node ({"node_id": ...}) or an edge ({"source": ..., "target": ...})."""
    for c, v in key.items():
        rows = rows.filter(F.col(c) == v)
    return rows.select(*key, attribute) if attribute else rows


def node_map(frames: DataFrame, func: Callable[[str, pd.DataFrame], dict], fields: list[str], schema: str, state: str = "state") -> DataFrame:
    """(node_id, ...): func gets a state's name and the fields of its frames (in frame order) and gives a row's values.

    One state in one task; a function that adds up is better written as an aggregate over ``node_frames``.
    """

    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(FRAME, ignore_index=True)
        return pd.DataFrame([{"node_id": key[0], **func(key[0], part[fields])}])

    return frames.select(F.col(state).alias("node_id"), *FRAME, *fields).groupBy("node_id").applyInPandas(of, f"node_id {dict(frames.dtypes)[state]}, {schema}")


def write_gexf(node_rows: DataFrame, edges: DataFrame, path: str) -> None:
    """A GEXF file of a network, below path, written by Spark's text writer as one part."""
    n, e = [c for c in node_rows.columns if c != "node_id"], [c for c in edges.columns if c not in ("source", "target")]
    kind = {"bigint": "long", "int": "integer", "double": "double", "boolean": "boolean"}
    declared = lambda df, names: "".join(f'<attribute id="{i}" title={quoteattr(c)} type="{kind.get(dict(df.dtypes)[c], "string")}"/>' for i, c in enumerate(names))

    def quoted(c: Column) -> Column:
        c = c.cast("string")
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(char), F.lit(name))
        return F.concat(F.lit('"'), c, F.lit('"'))

    values = lambda names: F.concat_ws("", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<attvalue for="{i}" value='), quoted(F.col(c)), F.lit("/>"))) for i, c in enumerate(names)))
    head = '<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed">'
    head += f'<attributes class="node">{declared(node_rows, n)}</attributes><attributes class="edge">{declared(edges, e)}</attributes><nodes>'
    line = lambda place, order, text: (F.lit(place).alias("place"), order.alias("at"), text.alias("value"))
    spark = node_rows.sparkSession
    fixed = spark.createDataFrame([(0, "", head), (2, "", "</nodes><edges>"), (4, "", "</edges></graph></gexf>")], "place int, at string, value string")
    of_nodes = node_rows.select(*line(1, F.lpad(F.col("node_idx").cast("string"), 20, "0"), F.concat(F.lit("<node id="), quoted(F.col("node_id")), F.lit(" label="), quoted(F.col("node_id")), F.lit("><attvalues>"), values(n), F.lit("</attvalues></node>"))))
    key = F.concat_ws("\t", "source", "target")
    of_edges = edges.select(*line(3, key, F.concat(F.lit("<edge id="), quoted(key), F.lit(" source="), quoted(F.col("source")), F.lit(" target="), quoted(F.col("target")), F.lit("><attvalues>"), values(e), F.lit("</attvalues></edge>"))))
    fixed.unionByName(of_nodes).unionByName(of_edges).repartition(1).sortWithinPartitions("place", "at").select("value").write.mode("overwrite").text(path)


def hex_color(rgba: list[int]) -> str:
    """"#rrggbb" or "#rrggbbaa" of 3 or 4 numbers from 0 to 255."""
    if len(rgba) not in (3, 4) or any(not 0 <= v <= 255 for v in rgba):
        raise ValueError("a colour is 3 or 4 numbers from 0 to 255")
    return "#" + "".join(f"{v:02x}" for v in rgba)


def viz_position(coordinates: list[float]) -> dict[str, float]:
    return dict(zip("xyz", [*map(float, coordinates), 0.0, 0.0][:3], strict=True))


def viz_color(rgba: list[int]) -> dict[str, float]:
    hex_color(rgba)
    return dict(zip("rgb", rgba, strict=False)) | ({"a": rgba[3] / 255} if len(rgba) == 4 else {})
