"""The weighted-ensemble tables over the driver's ``events``: 2000 events a run, 20 walkers, 100 cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WALKERS, PER_RUN = 20, 2000
ENSEMBLE = ["run_idx", "cycle_idx"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_idx, traj_idx, cycle_idx, w_int, weight, state, progress); weights add up to 1 in each run and cycle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    total = F.sum("w_int").over(Window.partitionBy(*ENSEMBLE))
    return e.select(
        F.floor(F.col("event_id") / PER_RUN).cast("long").alias("run_idx"),
        (F.col("event_id") % WALKERS).alias("traj_idx"),
        F.floor((F.col("event_id") % PER_RUN) / WALKERS).cast("long").alias("cycle_idx"),
        (F.round(F.col("value") * 100).cast("long") + 1).alias("w_int"),
        F.col("event_type").alias("state"),
        F.col("value").alias("progress"),
        (F.col("event_id") % 2).alias("warp_target"),
    ).withColumn("weight", F.col("w_int").cast("double") / total.cast("double"))


def resampling(f: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, step_idx, walker_idx, decision_id, target_idxs): the heaviest walker clones into the slot of
    the lightest, which is squashed into the second lightest."""
    w = Window.partitionBy(*ENSEMBLE)
    rank = F.row_number().over(w.orderBy(F.desc("w_int"), "traj_idx"))
    r = f.select(*ENSEMBLE, "traj_idx", rank.alias("rk"), F.count("*").over(w).alias("n"))
    who = lambda k: F.max(F.when(F.col("rk") == k, F.col("traj_idx"))).over(w)
    r = r.withColumns({"src": who(F.lit(1)), "keep": who(F.col("n") - 1), "out": who(F.col("n"))})
    me = F.col("traj_idx")
    decision = F.when(me == F.col("src"), 2).when(me == F.col("out"), 3).when(me == F.col("keep"), 4).otherwise(1).cast("long")
    targets = F.when(me == F.col("src"), F.array(me, F.col("out"))).when(me == F.col("out"), F.array("keep")).otherwise(F.array(me))
    return r.select(*ENSEMBLE, F.lit(0).cast("long").alias("step_idx"), me.alias("walker_idx"), decision.alias("decision_id"), targets.alias("target_idxs"))


def warping(f: DataFrame) -> DataFrame:
    """(run_idx, cycle_idx, walker_idx, target_idx, weight)."""
    return f.filter("state = 'error' AND progress >= 60.0").select(*ENSEMBLE, F.col("traj_idx").alias("walker_idx"), F.col("warp_target").alias("target_idx"), "weight")


def continuations(f: DataFrame) -> DataFrame:
    """(run_idx, base_run_idx): runs 1 and 2 continue run 0, 4 and 5 run 3, and so on."""
    return f.filter("run_idx % 3 <> 0").select("run_idx", (F.col("run_idx") - F.col("run_idx") % 3).alias("base_run_idx")).distinct()


#: The same tables in SQL.
CTE = """
frames0 AS (SELECT event_id, CAST(floor(event_id / 2000.0) AS BIGINT) AS run_idx, event_id % 20 AS traj_idx,
  CAST(floor((event_id % 2000) / 20.0) AS BIGINT) AS cycle_idx, CAST(round(value * 100) AS BIGINT) + 1 AS w_int, event_type AS state, value AS progress FROM events),
frames AS (SELECT f.*, CAST(w_int AS DOUBLE) / CAST(sum(w_int) OVER (PARTITION BY run_idx, cycle_idx) AS DOUBLE) AS weight FROM frames0 f),
roles AS (SELECT run_idx, cycle_idx, max(CASE WHEN rk = 1 THEN traj_idx END) AS clone_src, max(CASE WHEN rk = n - 1 THEN traj_idx END) AS keep_idx, max(CASE WHEN rk = n THEN traj_idx END) AS squash_idx
  FROM (SELECT run_idx, cycle_idx, traj_idx, row_number() OVER (PARTITION BY run_idx, cycle_idx ORDER BY w_int DESC, traj_idx) AS rk, count(*) OVER (PARTITION BY run_idx, cycle_idx) AS n FROM frames) t GROUP BY run_idx, cycle_idx),
res AS (SELECT f.run_idx, f.cycle_idx, CAST(0 AS BIGINT) AS step_idx, f.traj_idx AS walker_idx,
    CAST(CASE WHEN f.traj_idx = r.clone_src THEN 2 WHEN f.traj_idx = r.squash_idx THEN 3 WHEN f.traj_idx = r.keep_idx THEN 4 ELSE 1 END AS BIGINT) AS decision_id,
    CASE WHEN f.traj_idx = r.squash_idx THEN r.keep_idx ELSE f.traj_idx END AS target_idx
  FROM frames f JOIN roles r ON f.run_idx = r.run_idx AND f.cycle_idx = r.cycle_idx
  UNION ALL SELECT run_idx, cycle_idx, CAST(0 AS BIGINT), clone_src, CAST(2 AS BIGINT), squash_idx FROM roles),
warping AS (SELECT run_idx, cycle_idx, traj_idx AS walker_idx, event_id % 2 AS target_idx, weight FROM frames WHERE state = 'error' AND progress >= 60.0),
parents AS (SELECT p.run_idx, p.cycle_idx, p.target_idx AS child_idx, p.walker_idx AS plain_idx, CASE WHEN w.walker_idx IS NULL THEN p.walker_idx ELSE -1 END AS parent_idx
  FROM res p LEFT JOIN (SELECT DISTINCT run_idx, cycle_idx, walker_idx FROM warping WHERE target_idx = 0) w ON w.run_idx = p.run_idx AND w.cycle_idx = p.cycle_idx AND w.walker_idx = p.walker_idx
  WHERE p.decision_id IN (1, 2, 4)),
conts AS (SELECT DISTINCT run_idx, run_idx - run_idx % 3 AS base_run_idx FROM frames WHERE run_idx % 3 <> 0),
runs AS (SELECT r.run_idx, r.n_cycles, c.base_run_idx FROM (SELECT run_idx, max(cycle_idx) + 1 AS n_cycles FROM frames GROUP BY run_idx) r LEFT JOIN conts c ON r.run_idx = c.run_idx)
"""
