"""Sinks that take cycles as they come: a store's tables, rotating snapshots of walkers, tree files, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lineage, network
from ..sources.store import Store


class CycleReport:
    """Writes cycles to a store: chosen fields of walkers, some of them only every n cycles, and records of each group.

    What one call gets is one commit. ``each_batch`` is for ``foreachBatch``: a batch that comes again after a failure is
    known by its number and not written twice.
    """

    def __init__(self, store: Store, fields: list[str], every: dict[str, int] | None = None):
        self.store, self.fields, self.every = store, fields, every or {}

    def begin(self, run_idx: int, init_walkers: DataFrame | None = None, continues: int | None = None, **metadata: str) -> None:
        self.store.new_run(run_idx, init_walkers, continues, **metadata)

    def report(self, walkers: DataFrame, records: dict[str, DataFrame] | None = None) -> None:
        """walkers: run_idx, traj_idx, cycle_idx and fields, of any number of cycles."""
        thin = {f: F.when(F.col("cycle_idx") % n == 0, F.col(f)) for f, n in self.every.items() if f in self.fields}
        with self.store.transaction():
            self.store.append("frames", walkers.select("run_idx", "traj_idx", "cycle_idx", *self.fields).withColumns(thin))
            for group, rows in (records or {}).items():
                self.store.append(group, rows)

    def each_batch(self, batch: DataFrame, number: int) -> None:
        self.store.refresh()
        done = self.store.table("batches").agg(F.max("number")).first()[0] if self.store.has("batches") else None
        if done is None or number > done:
            with self.store.transaction():
                self.report(batch)
                self.store._write("batches", batch.sparkSession.createDataFrame([(number,)], "number long"))


def run_report(frames: DataFrame, report: CycleReport, checkpoint: str) -> StreamingQuery:
    """A stream of frames into a store, until what there is has been read."""
    return frames.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(report.each_batch).start()


class WalkerSnapshots:
    """All walkers of every n-th cycle; only the newest few cycles are kept."""

    def __init__(self, store: Store, every: int = 1, keep: int = 2):
        self.store, self.every, self.keep = store, every, keep

    def report(self, cycle_idx: int, walkers: DataFrame) -> None:
        if cycle_idx % self.every:
            return
        new = walkers.withColumn("cycle_idx", F.lit(cycle_idx).cast("long"))
        oldest = cycle_idx - self.every * (self.keep - 1)
        rows = self.store.table("walkers").filter(F.col("cycle_idx") >= oldest).unionByName(new) if self.store.has("walkers") else new
        self.store._write("walkers", rows, replace=True)

    def walkers(self) -> DataFrame:
        return self.store.table("walkers")


def write_resampling_tree(parents: DataFrame, frames: DataFrame, broken_slots: DataFrame, path: str) -> None:
    """The forest of slots as GEXF: nodes with weight, free energy, progress and shape, edges from parents to children.

    parents: run_idx, cycle_idx, child_idx, parent_idx without discontinuities.
    """
    nodes, edges = lineage.forest(parents.withColumn("plain_idx", F.col("parent_idx")))
    name = lambda c, w: F.concat_ws("/", F.col("run_idx"), F.col(c), F.col(w))
    full = lineage.forest_layout_nodes(nodes, frames, broken_slots)
    rank = F.col("run_idx") * 1_000_000_000_000 + (F.col("cycle_idx") + 1) * 1_000_000 + F.col("walker_idx")
    named = full.select(name("cycle_idx", "walker_idx").alias("node_id"), rank.alias("node_idx"), "weight", "free_energy", "progress", "shape")
    network.write_gexf(named, edges.select(name("from_cycle", "from_walker").alias("source"), name("to_cycle", "to_walker").alias("target")), path)


def metrics(frames: DataFrame, field: str) -> DataFrame:
    """(run_idx, metric, value): cycles, segments and the total of a field of each run, as a monitor would show them."""
    rows = frames.groupBy("run_idx").agg((F.max("cycle_idx") + 1).cast("double").alias("cycles"), F.count("*").cast("double").alias("segments"), F.sum(field).cast("double").alias("total"))
    return rows.unpivot("run_idx", ["cycles", "segments", "total"], "metric", "value")


def exposition(rows: DataFrame, prefix: str = "ensemble") -> str:
    """The text that a Prometheus server reads, of ``metrics`` (three rows for each run)."""
    found = rows.orderBy("metric", "run_idx").collect()
    out = []
    for m in sorted({r.metric for r in found}):
        out.append(f"# TYPE {prefix}_{m} gauge")
        out += [f'{prefix}_{m}{{run="{r.run_idx}"}} {r.value:g}' for r in found if r.metric == m]
    return "\n".join(out) + "\n"
