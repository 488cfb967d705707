"""Queries that write stores and catalogs and read them back, and those over systems and resampling functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, nested, systems, topology
from ..operators import network, profiles, regions, resampling
from ..sources import catalog, scratch
from ..sources.catalog import Catalog, KeyValues
from ..sources.store import Store
from ..streaming import reports
from .registry import CATALOG, IMAGES, ORACLES, Tables, _catalog, _edges, _pairs, _r, query


def _new(t: Tables, **settings) -> Store:
    return Store(t.spark, scratch.temporary(t.spark, "store"), "x", **settings)


def _fields(t: Tables) -> DataFrame:
    return t.frames.select("run_idx", "traj_idx", "cycle_idx", "state", "progress", "weight")


def _filled(t: Tables, **settings) -> Store:
    """A store with all runs, frames, records and continuations, in one commit."""
    s = _new(t, **settings)
    with s.transaction():
        runs = t.runs.select("run_idx")
        s._write("runs", runs.select("run_idx", F.create_map(F.lit("note"), F.concat(F.lit("r"), F.col("run_idx").cast("string"))).alias("metadata"), F.lit(None).cast("string").alias("start_hash"), F.lit(None).cast("string").alias("end_hash")))
        s._write("continuations", t.continuations.select("run_idx", "base_run_idx"))
        s._write("frames", _fields(t))
        s._write("resampling", t.resampling)
        s._write("warping", t.warping)
        s._write("init_walkers", _fields(t).filter("cycle_idx = 0").drop("cycle_idx"))
    return s


@query(" SELECT run_idx, traj_idx, cycle_idx, state, progress, round(weight, 6) AS weight FROM frames")
def store_roundtrip(t: Tables) -> DataFrame:
    return _r(Store(t.spark, _filled(t).path).frames(), "weight")


@query(" SELECT CAST(0 AS BIGINT) AS run_idx, CASE WHEN traj_idx = 2 THEN 0 ELSE 1 END AS traj_idx, cycle_idx, progress, CASE WHEN traj_idx = 2 THEN 1.0 ELSE round(weight, 6) END AS weight, CASE WHEN traj_idx = 2 AND cycle_idx IN (3, 7) THEN state END AS state FROM frames WHERE run_idx = 0 AND traj_idx IN (2, 5) AND cycle_idx < 20")
def store_add_traj(t: Tables) -> DataFrame:
    s = _new(t, sparse=("state",))
    s.new_run(0)
    one = _fields(t).filter("run_idx = 0 AND traj_idx = 2 AND cycle_idx < 20").select("cycle_idx", "state", "progress")
    two = _fields(t).filter("run_idx = 0 AND traj_idx = 5 AND cycle_idx < 20").select("cycle_idx", "progress", "weight")
    s.add_traj(0, one, sparse={"state": [3, 7]})
    k = s.add_traj(0, two.filter("cycle_idx < 12"))
    s.extend_traj(0, k, two.filter("cycle_idx >= 12"))
    return _r(s.frames(), "weight").select("run_idx", F.col("traj_idx").cast("int").alias("traj_idx"), "cycle_idx", "progress", "weight", "state")


@query(" SELECT cycle_idx, CASE WHEN cycle_idx % 4 = 0 THEN progress END AS observables_p FROM frames WHERE run_idx = 0 AND traj_idx = 1 AND cycle_idx < 16")
def store_sparse_observable(t: Tables) -> DataFrame:
    s = _new(t)
    s.new_run(0)
    rows = _fields(t).filter("run_idx = 0 AND traj_idx = 1").select("cycle_idx", "weight", "progress")
    k = s.add_traj(0, rows.filter("cycle_idx < 8").select("cycle_idx", "weight", F.when(F.col("cycle_idx") % 4 == 0, F.col("progress")).alias("observables_p")))
    s.extend_traj(0, k, rows.filter("cycle_idx BETWEEN 8 AND 15").select("cycle_idx", "weight", F.when(F.col("cycle_idx") % 4 == 0, F.col("progress")).alias("observables_p")))
    if s.observables() != ["p"] or s.sparse_fields() != ["observables_p"]:
        raise ValueError("the observable isn't known")
    return s.field(0, k, "observables_p")


@query(" SELECT cycle_idx FROM frames WHERE run_idx = 0 AND traj_idx = 1 AND cycle_idx % 4 = 0")
def store_field_cycles(t: Tables) -> DataFrame:
    s = _new(t)
    s.append("frames", _fields(t).withColumn("observables_p", F.when(F.col("cycle_idx") % 4 == 0, F.col("progress"))))
    return s.field_cycles(0, 1, "observables_p")


@query(" SELECT cycle_idx, progress FROM frames WHERE run_idx = 0 AND traj_idx = 4 AND cycle_idx IN (0, 9, 17)")
def store_traj_field(t: Tables) -> DataFrame:
    return _filled(t).field(0, 4, "progress", [0, 9, 17])


@query(" SELECT run_idx, traj_idx, count(*) AS n, round(sum(progress), 4) AS total FROM frames WHERE (run_idx, traj_idx) IN ((0, 1), (0, 6)) GROUP BY 1, 2")
def store_selected_trajs(t: Tables) -> DataFrame:
    chosen = t.spark.createDataFrame([(0, 1), (0, 6)], "run_idx long, traj_idx long")
    rows = _filled(t).frames(fields=["progress"], trajs=chosen)
    return _r(rows.groupBy("run_idx", "traj_idx").agg(F.count("*").alias("n"), F.sum("progress").alias("total")), "total", to=4)


@query(" SELECT traj_idx, state, progress FROM frames WHERE run_idx = 0 AND cycle_idx = 0 AND traj_idx IN (0, 2)")
def store_init_walkers(t: Tables) -> DataFrame:
    s = _new(t)
    s.new_run(0, init_walkers=_fields(t).filter("run_idx = 0 AND cycle_idx = 0").select("traj_idx", "state", "progress", "weight"))
    return s.init_walkers(0, ["state", "progress"], [0, 2])


@query(" SELECT run_idx, count(DISTINCT traj_idx) AS n_trajs, max(cycle_idx) + 1 AS n_cycles, count(*) AS n_frames FROM frames GROUP BY 1")
def store_counts(t: Tables) -> DataFrame:
    return _filled(t).counts()


@query(" SELECT run_idx, cycle_idx, walker_idx, target_idx, round(weight, 6) AS weight FROM warping WHERE run_idx = 0 AND cycle_idx < 20")
def store_extend_records(t: Tables) -> DataFrame:
    s = _new(t)
    s.init_record_fields("warping", ["walker_idx", "target_idx", "weight"])
    rows = t.warping.filter("run_idx = 0 AND cycle_idx < 20").select("cycle_idx", "walker_idx", "target_idx", "weight")
    with s.transaction():
        for c in sorted(r.cycle_idx for r in rows.select("cycle_idx").distinct().collect()):
            s.extend_records("warping", 0, c, rows.filter(F.col("cycle_idx") == c).drop("cycle_idx"))
    return _r(s.records("warping", 0).select("run_idx", "cycle_idx", "walker_idx", "target_idx", "weight"), "weight")


@query(" SELECT i AS cycle_idx, i * 2 AS value FROM (SELECT unnest(range(5)) AS i)")
def store_continual_records(t: Tables) -> DataFrame:
    s = _new(t)
    s.init_record_fields("progress", ["value"])
    with s.transaction():
        for c in range(5):
            s.extend_records("progress", 0, c, t.spark.createDataFrame([([c * 2],)], "value array<long>"))
    return s.records("progress", 0, flat=True).select("cycle_idx", "value")


@query(" SELECT w.run_idx, w.cycle_idx, w.walker_idx, w.cycle_idx + CASE WHEN w.run_idx = 0 THEN 0 ELSE (SELECT max(cycle_idx) + 1 FROM frames WHERE run_idx = 0) END AS contig_cycle FROM warping w WHERE w.run_idx IN (0, 1)")
def store_contig_records(t: Tables) -> DataFrame:
    return _filled(t).contig_records("warping", [0, 1]).select("run_idx", "cycle_idx", "walker_idx", "contig_cycle")


@query(" SELECT run_idx, step_idx, count(*) AS n FROM (SELECT DISTINCT run_idx, cycle_idx, step_idx, walker_idx FROM res) WHERE run_idx = 0 GROUP BY ALL")
def store_run_records(t: Tables) -> DataFrame:
    return _filled(t).records("resampling", 0).groupBy("run_idx", "step_idx").agg(F.count("*").alias("n"))


@query()
def store_decision_enum(t: Tables) -> DataFrame:
    s = _new(t)
    s.set_decisions(0, resampling.DECISIONS)
    return t.spark.createDataFrame(list(s.decisions(0).items()), "name string, value long")


ORACLES["store_decision_enum"] = "SELECT * FROM (VALUES ('NOTHING', 1::BIGINT), ('CLONE', 2), ('SQUASH', 3), ('KEEP_MERGE', 4)) v(name, value)"


@query()
def store_settings(t: Tables) -> DataFrame:
    s = _new(t, n_dims=3, units={"positions": "nm"}, alt_reps={"site": [1, 2]}, sparse=("velocities",), shapes={"positions": [3, 3]}, dtypes={"positions": "double"})
    s.add_metadata("by", "test")
    copy = s.clone(scratch.temporary(t.spark, "clone"))
    own = copy.settings()
    return t.spark.createDataFrame([("n_dims", str(own["n_dims"])), ("unit", own["units"]["positions"]), ("rep", copy.rep_path("site")), ("sparse", ",".join(copy.sparse_fields())), ("by", copy.metadata()["by"]), ("runs", str(copy.has("runs")))], "key string, value string")


ORACLES["store_settings"] = "SELECT * FROM (VALUES ('n_dims', '3'), ('unit', 'nm'), ('rep', 'alt_reps_site'), ('sparse', 'velocities'), ('by', 'test'), ('runs', 'False')) v(key, value)"


@query(" SELECT CAST(0 AS BIGINT) AS run_idx, count(*) AS n_frames, max(cycle_idx) - 10 AS last_cycle, round(sum(progress), 4) AS total FROM frames WHERE run_idx = 0 AND cycle_idx >= 10 AND cycle_idx < 30 ")
def store_extract_run(t: Tables) -> DataFrame:
    target = _new(t)
    target.extract_run(_filled(t), 0, cycles=(10, 30))
    rows = target.frames()
    return _r(rows.groupBy("run_idx").agg(F.count("*").alias("n_frames"), F.max("cycle_idx").alias("last_cycle"), F.sum("progress").alias("total")), "total", to=4)


@query(" SELECT r.run_idx + 1 AS run_idx, r.base_run_idx + 1 AS base_run_idx, 'r' || CAST(r.run_idx AS VARCHAR) AS note, n.n AS n_records FROM runs r JOIN (SELECT run_idx, count(DISTINCT (cycle_idx, walker_idx)) AS n FROM res GROUP BY 1) n ON n.run_idx = r.run_idx")
def store_extract_file_runs(t: Tables) -> DataFrame:
    target = _new(t)
    target.new_run(0)
    target.extract_runs(_filled(t))
    n = target.table("resampling").groupBy("run_idx").agg(F.count("*").alias("n_records"))
    base = target.table("continuations") if target.has("continuations") else t.spark.createDataFrame([], "run_idx long, base_run_idx long")
    return target.table("runs").filter("run_idx > 0").select("run_idx", F.col("metadata")["note"].alias("note")).join(base, "run_idx", "left").join(n, "run_idx")


@query(" SELECT run_idx, count(*) AS n, min(cycle_idx) AS first FROM frames GROUP BY 1 UNION ALL SELECT run_idx + (SELECT max(run_idx) + 1 FROM frames), count(*), min(cycle_idx) FROM frames GROUP BY run_idx")
def store_link_runs(t: Tables) -> DataFrame:
    s = _filled(t)
    return s.link_runs(s).table("frames").groupBy("run_idx").agg(F.count("*").alias("n"), F.min("cycle_idx").alias("first"))


@query(" SELECT CAST(7 AS BIGINT) AS run_idx, cycle_idx - 5 AS cycle_idx, walker_idx, target_idx FROM warping WHERE run_idx = 0 AND cycle_idx >= 5 AND cycle_idx < 15")
def store_copy_slice(t: Tables) -> DataFrame:
    target = _new(t)
    _filled(t).copy_slice(target, 0, 5, 15, 7)
    return target.table("warping").select("run_idx", "cycle_idx", "walker_idx", "target_idx")


@query(" SELECT count(*) AS n, round(sum(progress), 4) AS total FROM frames WHERE cycle_idx >= 10")
def store_changes(t: Tables) -> DataFrame:
    """What a reader sees that follows a writer: rows of commits after the version that it has."""
    s = _new(t)
    s.append("frames", _fields(t).filter("cycle_idx < 10"))
    reader = Store(t.spark, s.path)
    seen = reader.version
    s.append("frames", _fields(t).filter("cycle_idx >= 10"))
    reader.refresh()
    return _r(reader.changes("frames", seen).agg(F.count("*").alias("n"), F.sum("progress").alias("total")), "total", to=4)


@query(" SELECT run_idx, md5('start') AS start_hash, CAST(NULL AS VARCHAR) AS end_hash FROM runs WHERE run_idx = 0")
def store_snapshot_hash(t: Tables) -> DataFrame:
    s = _filled(t)
    s.set_snapshot_hash(0, "start", catalog.hash_of("start"))
    return s.table("runs").filter("run_idx = 0").select("run_idx", "start_hash", "end_hash")


# reports


@query(" SELECT run_idx, cycle_idx, count(*) AS n, count(*) FILTER (cycle_idx % 5 = 0) AS n_state FROM frames WHERE run_idx = 0 AND cycle_idx < 12 GROUP BY 1, 2")
def report_cycles(t: Tables) -> DataFrame:
    s = _new(t)
    writer = reports.CycleReport(s, fields=["progress", "weight", "state"], every={"state": 5})
    writer.begin(0, _fields(t).filter("run_idx = 0 AND cycle_idx = 0").drop("run_idx", "cycle_idx"))
    rows = _fields(t).filter("run_idx = 0 AND cycle_idx < 12")
    for low in (0, 6):
        writer.report(rows.filter((F.col("cycle_idx") >= low) & (F.col("cycle_idx") < low + 6)), {"warping": t.warping.filter((F.col("run_idx") == 0) & (F.col("cycle_idx") >= low) & (F.col("cycle_idx") < low + 6))})
    return s.frames().groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n"), F.count("state").alias("n_state"))


@query(" SELECT CAST(9 AS BIGINT) AS cycle_idx, count(*) AS n FROM frames WHERE run_idx = 0 AND cycle_idx = 9 UNION ALL SELECT 6, count(*) FROM frames WHERE run_idx = 0 AND cycle_idx = 6")
def report_walker_snapshots(t: Tables) -> DataFrame:
    keeper = reports.WalkerSnapshots(_new(t), every=3, keep=2)
    for c in range(12):
        keeper.report(c, _fields(t).filter((F.col("run_idx") == 0) & (F.col("cycle_idx") == c)))
    return keeper.walkers().groupBy("cycle_idx").agg(F.count("*").alias("n"))


@query(" SELECT count(*) AS n FROM (SELECT run_idx, cycle_idx, child_idx AS w FROM parents WHERE run_idx = 0 UNION SELECT run_idx, cycle_idx - 1, plain_idx FROM parents WHERE run_idx = 0)")
def report_resampling_tree(t: Tables) -> DataFrame:
    path = scratch.temporary(t.spark, "tree")
    reports.write_resampling_tree(t.plain.filter("run_idx = 0"), t.frames.filter("run_idx = 0"), t.warping.filter("run_idx = 0 AND target_idx = 0"), path)
    return t.spark.read.text(path).filter("value LIKE '<node %'").agg(F.count("*").alias("n"))


@query(" SELECT (SELECT count(DISTINCT state) FROM frames) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT f.state, g.state FROM parents p JOIN frames f ON f.run_idx = p.run_idx AND f.cycle_idx = p.cycle_idx AND f.traj_idx = p.parent_idx JOIN frames g ON g.run_idx = p.run_idx AND g.cycle_idx = p.cycle_idx + 1 AND g.traj_idx = p.child_idx WHERE p.parent_idx >= 0)) AS edges")
def network_gexf(t: Tables) -> DataFrame:
    path = scratch.temporary(t.spark, "gexf")
    network.write_gexf(network.nodes(t.frames), _edges(t, 2), path)
    return t.spark.read.text(path).agg(F.count_if(F.col("value").startswith("<node ")).alias("nodes"), F.count_if(F.col("value").startswith("<edge ")).alias("edges"))


@query(" SELECT run_idx, max(cycle_idx) + 1 AS cycles, count(*) AS segments, round(sum(progress), 4) AS total FROM frames GROUP BY 1")
def cycle_metrics(t: Tables) -> DataFrame:
    rows = reports.metrics(t.frames, "progress")
    wide = rows.groupBy("run_idx").pivot("metric", ["cycles", "segments", "total"]).agg(F.first("value"))
    return _r(wide.select("run_idx", F.col("cycles").cast("long").alias("cycles"), F.col("segments").cast("long").alias("segments"), "total"), "total", to=4)


# catalog


def _made(t: Tables) -> tuple[Catalog, dict[int, str]]:
    """Four snapshots, and runs 0 -> 1 -> 2 and 1 -> 3."""
    c = Catalog(t.spark, scratch.temporary(t.spark, "catalog"))
    snaps = {i: c.add_snapshot({"state": i}) for i in range(4)}
    config = c.add_configuration({"workers": 2})
    for a, b, last in ((0, 1, 9), (1, 2, 19), (1, 3, 29)):
        c.register_run(snaps[a], snaps[b], config, last)
    return c, snaps


@query()
def catalog_run_records(t: Tables) -> DataFrame:
    c, snaps = _made(t)
    c.update_run(snaps[1], snaps[2], c.add_configuration({"workers": 3}), 24)
    c.delete_run(snaps[0], snaps[1])
    names = {v: k for k, v in snaps.items()}
    return t.spark.createDataFrame([(names[r.start_hash], names[r.end_hash], c.get("configurations", r.config_hash)["workers"], r.last_cycle_idx) for r in c.runs.collect()], "a long, b long, workers long, last long")


ORACLES["catalog_run_records"] = "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 3::BIGINT, 24::BIGINT), (1, 3, 2, 29)) v(a, b, workers, last)"


@query()
def catalog_snapshots(t: Tables) -> DataFrame:
    c, snaps = _made(t)
    c.add_snapshot({"state": 2})
    rows = c.snapshots.collect()
    return t.spark.createDataFrame([(c.get("snapshots", r.hash)["state"], r.hash == catalog.hash_of(r.content)) for r in rows], "state long, named boolean")


ORACLES["catalog_snapshots"] = "SELECT i AS state, true AS named FROM (SELECT unnest(range(4)) AS i)"


@query()
def catalog_checkpoint(t: Tables) -> DataFrame:
    c, snaps = _made(t)
    config = c.add_configuration({"workers": 9})
    for cycle in (4, 9):
        c.checkpoint(snaps[3], {"state": 100 + cycle}, config, cycle)
    rows = c.runs.filter(F.col("start_hash") == snaps[3]).collect()
    return t.spark.createDataFrame([(c.get("snapshots", r.end_hash)["state"], r.last_cycle_idx) for r in rows], "state long, last long")


ORACLES["catalog_checkpoint"] = "SELECT 109::BIGINT AS state, 9::BIGINT AS last"


@query()
def catalog_merge(t: Tables) -> DataFrame:
    c, snaps = _made(t)
    other = Catalog(t.spark, scratch.temporary(t.spark, "catalog"))
    new, config = other.add_snapshot({"state": 50}), other.add_configuration({"workers": 2})
    other.add_snapshot({"state": 3})
    other.register_run(snaps[3], new, config, 5)
    c.merge(other)
    base = c.continues(snaps[3], new)
    return t.spark.createDataFrame([(c.snapshots.count(), c.configurations.count(), c.runs.count(), base == (snaps[1], snaps[3]))], "snapshots long, configurations long, runs long, chained boolean")


ORACLES["catalog_merge"] = "SELECT 5::BIGINT AS snapshots, 1::BIGINT AS configurations, 4::BIGINT AS runs, true AS chained"


@query(" SELECT 0 AS run, least(10, count(DISTINCT cycle_idx)) AS n_cycles, CAST(NULL AS INT) AS base FROM frames WHERE run_idx = 0 UNION ALL SELECT 1, least(20, count(DISTINCT cycle_idx)), 0 FROM frames WHERE run_idx = 0 UNION ALL SELECT 2, least(30, count(DISTINCT cycle_idx)), 0 FROM frames WHERE run_idx = 0")
def catalog_combine(t: Tables) -> DataFrame:
    """Three runs of a catalog, cut at their last cycles, in one store, with what they continue: here all three from the same frames."""
    c, snaps = _made(t)
    source, target = _filled(t), _new(t)
    pairs = {(0, 1): 0, (1, 2): 1, (1, 3): 2}
    to = catalog.combined(c, target, {(snaps[a], snaps[b]): (source, 0) for a, b in pairs})
    name = {to[snaps[a], snaps[b]]: k for (a, b), k in pairs.items()}
    n = target.frames().groupBy("run_idx").agg(F.countDistinct("cycle_idx").alias("n")).collect()
    base = {r.run_idx: r.base_run_idx for r in target.table("continuations").collect()}
    if target.snapshot_hash(to[snaps[0], snaps[1]], "end") != snaps[1]:
        raise ValueError("a run's hash is missing")
    return t.spark.createDataFrame([(name[r.run_idx], r.n, name[base[r.run_idx]] if r.run_idx in base else None) for r in n], "run int, n_cycles long, base int")


@query()
def catalog_key_values(t: Tables) -> DataFrame:
    kv = KeyValues(t.spark, scratch.temporary(t.spark, "kv"))
    kv.update({"a": "1", None: "0", "b": "2"})
    kv["a"] = "3"
    del kv["b"]
    return kv.rows().select("key", "value", F.lit(len(kv)).cast("long").alias("n"))


ORACLES["catalog_key_values"] = "SELECT * FROM (VALUES ('a', '3', 2::BIGINT), (NULL, '0', 2)) v(key, value, n)"


@query(f"{CATALOG} SELECT start_hash, end_hash, config_hash, CASE WHEN last_cycle_idx % 2 = 1 THEN 5 ELSE last_cycle_idx END AS last_cycle_idx FROM cat WHERE substr(end_hash, 1, 1) <> '0'")
def catalog_update_delete(t: Tables) -> DataFrame:
    c = _catalog(t)
    return catalog.without_runs(catalog.updated_runs(c, c.filter("last_cycle_idx % 2 = 1").withColumn("last_cycle_idx", F.lit(5).cast("long"))), c.filter("substr(end_hash, 1, 1) = '0'"))


# resampling


@query(" SELECT DISTINCT run_idx, cycle_idx, CAST(0 AS BIGINT) AS step_idx, traj_idx AS walker_idx, CAST(1 AS BIGINT) AS decision_id, [traj_idx] AS target_idxs FROM frames")
def no_decisions(t: Tables) -> DataFrame:
    return resampling.no_decisions(t.frames)


@query(" SELECT run_idx, cycle_idx, traj_idx % 4 AS merge_group, round(sum(weight), 6) AS weight, true AS inside FROM frames GROUP BY 1, 2, 3")
def merged_survivors(t: Tables) -> DataFrame:
    rows = resampling.merged_survivors(t.frames.withColumn("merge_group", F.col("traj_idx") % 4))
    return _r(rows.select("run_idx", "cycle_idx", "merge_group", "weight", (F.col("kept_idx") % 4 == F.col("merge_group")).alias("inside")), "weight")


@query(" SELECT run_idx, cycle_idx, slot FROM (SELECT run_idx, cycle_idx, target_idx AS slot, count(*) FILTER (decision_id <> 3) AS n FROM res GROUP BY ALL) WHERE n <> 1")
def misplaced_walkers(t: Tables) -> DataFrame:
    return resampling.misplaced(t.frames, t.resampling).select("run_idx", "cycle_idx", "slot")


@query(" SELECT run_idx, cycle_idx, traj_idx FROM frames WHERE weight < 0.001 OR weight > 0.09")
def weights_out_of_bounds(t: Tables) -> DataFrame:
    return resampling.out_of_bounds(t.frames, 0.001, 0.09).select("run_idx", "cycle_idx", "traj_idx")


@query(" SELECT run_idx, cycle_idx, traj_idx, CAST(greatest(least(floor(weight / 0.01), 5) - 1, 0) AS BIGINT) AS n FROM frames")
def clone_limits(t: Tables) -> DataFrame:
    return t.frames.select("run_idx", "cycle_idx", "traj_idx", resampling.max_clones(F.col("weight"), 0.01, 5).alias("n"))


@query()
def clone_assignment(t: Tables) -> DataFrame:
    rows = resampling.decision_records([[], [4, 5], [], [], [], []], [2, 0, 0, 1, 0, 0])
    return t.spark.createDataFrame([(k, d, ",".join(map(str, targets))) for k, (d, targets) in enumerate(rows)], "walker_idx long, decision_id long, targets string")


ORACLES["clone_assignment"] = "SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT, '0,5,4'), (1, 4, '1'), (2, 1, '2'), (3, 2, '3,6'), (4, 3, '1'), (5, 3, '1')) v(walker_idx, decision_id, targets)"


@query()
def revo_greedy(t: Tables) -> DataFrame:
    return _r(resampling.greedy_decisions(t.images, 10.0, 1.0, method="greedy"), "variation", to=3)


@query()
def revo_decide_conserves(t: Tables) -> DataFrame:
    """Of each ensemble's decisions, by fixed draws: weight after applying them, and slots filled once."""
    rows = resampling.greedy_decisions(t.images, 10.0, 1.0)
    after = resampling.apply_decisions(t.images.select("run_idx", "cycle_idx", "traj_idx", "weight"), rows)
    return _r(after.groupBy("run_idx", "cycle_idx").agg(F.count("source_idx").alias("n"), F.sum("weight").alias("weight")), "weight")


ORACLES["revo_decide_conserves"] = f"{IMAGES} SELECT run_idx, cycle_idx, count(*) AS n, round(sum(weight), 6) AS weight FROM im GROUP BY 1, 2"


@query()
def wexplore_regions(t: Tables) -> DataFrame:
    return regions.explore(t.images, (0.9, 0.6), (3, 3), pmin=1e-4, pmax=0.5).select("run_idx", "cycle_idx", "walker_idx", "region", "decision_id", "target_idxs")


@query()
def wexplore_conserves(t: Tables) -> DataFrame:
    rows = regions.explore(t.images, (0.9, 0.6), (3, 3), pmin=1e-4, pmax=0.5)
    after = resampling.apply_decisions(t.images.select("run_idx", "cycle_idx", "traj_idx", "weight"), rows)
    return _r(after.groupBy("run_idx", "cycle_idx").agg(F.count("source_idx").alias("n"), F.sum("weight").alias("weight")), "weight")


ORACLES["wexplore_conserves"] = ORACLES["revo_decide_conserves"]


@query()
def distance_summary(t: Tables) -> DataFrame:
    return _r(profiles.distance_summary(_pairs(t)), "mean", "least", "most", to=4)


ORACLES["distance_summary"] = f"{IMAGES} SELECT run_idx, cycle_idx, round(avg(distance), 4) AS mean, round(min(distance), 4) AS least, round(max(distance), 4) AS most FROM pairs WHERE distance > 0 GROUP BY 1, 2"


@query()
def mean_absolute_distance(t: Tables) -> DataFrame:
    return _r(resampling.distance_pairs(t.images, geometry.mean_absolute).filter("i = 0"), "distance", to=5)


ORACLES["mean_absolute_distance"] = f"{IMAGES} SELECT a.run_idx, a.cycle_idx, a.traj_idx AS i, b.traj_idx AS j, round(list_avg(list_transform(list_zip(a.image, b.image), lambda p: abs(p[1] - p[2]))), 5) AS distance FROM im a JOIN im b ON a.run_idx = b.run_idx AND a.traj_idx < b.traj_idx WHERE a.traj_idx = 0"


@query(" SELECT run_idx, cycle_idx, count(*) AS n, true AS some FROM frames WHERE cycle_idx = 3 GROUP BY 1, 2")
def random_walk_segment(t: Tables) -> DataFrame:
    rows = resampling.random_walk(t.frames.filter("cycle_idx = 3").withColumn("positions", F.array(F.lit(0).cast("long"), F.lit(5).cast("long"))), 4)
    ok = F.expr("positions[0] BETWEEN 0 AND 4 AND positions[1] BETWEEN 1 AND 9")
    return rows.groupBy("run_idx", "cycle_idx").agg(F.count("*").alias("n"), F.bool_and(ok).alias("some"))


@query(" SELECT run_idx, cycle_idx, traj_idx AS walker_idx, CAST(NULL AS BIGINT) AS target_idx, round(weight, 6) AS weight FROM frames WHERE false")
def null_boundary(t: Tables) -> DataFrame:
    return _r(resampling.warp_walkers(t.frames, F.lit(False), [1.0])[1], "weight")


# systems

ATOMS = ", atoms AS (SELECT vec_id // 100 AS state, vec_id % 100 AS atom_idx, [(vec_id % 10) * 0.31, (vec_id // 10 % 10) * 0.29, (vec_id % 7) * 0.43] AS p FROM embeddings)"
_WITH_ATOMS = f"WITH {ATOMS[2:]}"
BOX = (3.1, 2.9, 3.01)


def _atoms(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    e = t.spark.read.parquet(f"{t.dir}/embeddings.parquet")
    p = F.array((v % 10) * 0.31, (F.floor(v / 10) % 10) * 0.29, (v % 7) * 0.43)
    return e.select(F.floor(v / 100).cast("long").alias("state"), (v % 100).alias("atom_idx"), p.cast("array<double>").alias("position"), F.array(*map(F.lit, BOX)).alias("box"))


@query()
def binding_site(t: Tables) -> DataFrame:
    return systems.binding_site(_atoms(t), list(range(5)), list(range(20, 100)), 0.7)


_FOLD = " + ".join(f"pow(abs(a.p[{k}] - b.p[{k}]) - {v} * round(abs(a.p[{k}] - b.p[{k}]) / {v}), 2)" for k, v in enumerate(BOX, 1))
ORACLES["binding_site"] = f"{_WITH_ATOMS} SELECT DISTINCT b.state, b.atom_idx FROM atoms a JOIN atoms b ON a.state = b.state WHERE a.atom_idx < 5 AND b.atom_idx >= 20 AND sqrt({_FOLD}) <= 0.7"


def _states(t: Tables) -> DataFrame:
    rows = _atoms(t).groupBy("state").agg(F.sort_array(F.collect_list(F.struct("atom_idx", "position"))).alias("a"))
    return rows.filter(F.size("a") == 100).select("state", F.transform("a", lambda x: x.position).alias("positions"), F.array(*map(F.lit, BOX)).alias("box"))


@query()
def unbinding_progress(t: Tables) -> DataFrame:
    least = systems.least_distance(F.col("positions"), [0, 1], [50, 51, 52], F.col("box"))
    return _r(_states(t).select("state", least.alias("least"), systems.unbound(F.col("positions"), [0, 1], [50, 51, 52], 0.5, F.col("box")).alias("unbound")), "least")


ORACLES["unbinding_progress"] = f"{_WITH_ATOMS}, d AS (SELECT a.state, min(sqrt({_FOLD})) AS d FROM atoms a JOIN atoms b ON a.state = b.state WHERE a.atom_idx < 2 AND b.atom_idx BETWEEN 50 AND 52 AND a.state IN (SELECT state FROM atoms GROUP BY state HAVING count(*) = 100) GROUP BY 1) SELECT state, round(d, 6) AS least, d >= 0.5 AS unbound FROM d"


@query()
def ligand_rmsd(t: Tables) -> DataFrame:
    native = F.array(*(F.array(*(F.lit(0.1 * (i + k)) for k in range(3))) for i in range(3)))
    mine = systems.pick(F.col("positions"), [0, 1, 2])
    return _r(_states(t).select("state", systems.rmsd(mine, native).alias("rmsd"), systems.rebound(F.col("positions"), native, [0, 1, 2], 0.4).alias("rebound"), geometry.reciprocal_gap(systems.rmsd(mine, native), F.lit(0.5)).alias("gap")), "rmsd", "gap")


ORACLES["ligand_rmsd"] = f"{_WITH_ATOMS}, r AS (SELECT state, sqrt(sum(pow(p[1] - 0.1 * atom_idx, 2) + pow(p[2] - 0.1 * (atom_idx + 1), 2) + pow(p[3] - 0.1 * (atom_idx + 2), 2)) / 3) AS r FROM atoms WHERE atom_idx < 3 AND state IN (SELECT state FROM atoms GROUP BY state HAVING count(*) = 100) GROUP BY 1) SELECT state, round(r, 6) AS rmsd, r <= 0.4 AS rebound, round(abs(1 / r - 1 / 0.5), 6) AS gap FROM r"


@query()
def pair_distance_images(t: Tables) -> DataFrame:
    d = systems.pair_distances(F.col("positions"), [(0, 9), (3, 40)], F.col("box"))
    rows = _states(t).select("state", d.alias("d"))
    return _r(rows.select("state", F.col("d")[0].alias("d0"), F.col("d")[1].alias("d1"), systems.root_mean_square(F.col("d"), F.array(F.lit(0.0), F.lit(0.0))).alias("size")), "d0", "d1", "size")


ORACLES["pair_distance_images"] = f"{_WITH_ATOMS}, d AS (SELECT a.state, max(CASE WHEN a.atom_idx = 0 THEN sqrt({_FOLD}) END) AS d0, max(CASE WHEN a.atom_idx = 3 THEN sqrt({_FOLD}) END) AS d1 FROM atoms a JOIN atoms b ON a.state = b.state AND (a.atom_idx, b.atom_idx) IN ((0, 9), (3, 40)) WHERE a.state IN (SELECT state FROM atoms GROUP BY state HAVING count(*) = 100) GROUP BY 1) SELECT state, round(d0, 6) AS d0, round(d1, 6) AS d1, round(sqrt((d0 * d0 + d1 * d1) / 2), 6) AS size FROM d"


@query()
def superimposed_images(t: Tables) -> DataFrame:
    """States moved onto a turned copy of themselves come to lie on it: the greatest distance that is left."""
    import numpy as np

    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    base = np.array([[0.31 * (i % 10), 0.29 * (i // 10 % 10), 0.43 * (i % 7)] for i in range(100)])
    states = t.spark.range(3).select(F.col("id").alias("state"), F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in base[:20])).alias("positions"))
    reference = base[:20] @ turn + 1.0
    out = systems.superimposed(states, reference, list(range(10)), [12, 15])
    want = F.array(*(F.lit(float(v)) for v in reference[[12, 15]].ravel()))
    return _r(out.select("state", geometry.euclidean(F.col("image"), want).alias("left")), "left")


ORACLES["superimposed_images"] = "SELECT i AS state, 0.0::DOUBLE AS left FROM (SELECT unnest(range(3)) AS i)"


@query()
def two_atom_gap(t: Tables) -> DataFrame:
    a, b = systems.pick(F.col("positions"), [0, 1]), systems.pick(F.col("positions"), [5, 9])
    return _r(_states(t).select("state", systems.pair_gap(a, b).alias("gap")), "gap")


ORACLES["two_atom_gap"] = f"{_WITH_ATOMS}, w AS (SELECT state, list(p ORDER BY atom_idx) AS p FROM atoms WHERE atom_idx IN (0, 1, 5, 9) AND state IN (SELECT state FROM atoms GROUP BY state HAVING count(*) = 100) GROUP BY 1) SELECT state, round(abs(list_distance(p[1], p[2]) - list_distance(p[3], p[4])), 6) AS gap FROM w"


@query(" SELECT run_idx, traj_idx, cycle_idx, progress + cycle_idx >= 100 AS far FROM frames WHERE cycle_idx % 10 = 0")
def walk_progress(t: Tables) -> DataFrame:
    rows = t.frames.filter("cycle_idx % 10 = 0")
    return rows.select("run_idx", "traj_idx", "cycle_idx", systems.walked_far(F.array("progress", F.col("cycle_idx").cast("double")), 100.0).alias("far"))


# topologies and names


def _json(t: Tables) -> str:
    return topology.from_atoms([(0, 0, "R", 1, "A0", "C"), (0, 0, "R", 1, "A1", "N"), (0, 1, "Q", 2, "A2", "O"), (1, 2, "S", 1, "A3", "H")], [(0, 1), (1, 2), (2, 3)])


@query()
def topology_subset(t: Tables) -> DataFrame:
    s = _new(t, topology=_json(t), main_rep=[3, 1, 2])
    one = t.spark.createDataFrame([(s.topology("positions"),)], "topology string")
    return topology.atoms(one)


ORACLES["topology_subset"] = "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT, 'A3', 'H'), (1, 1, 1, 'A1', 'N'), (1, 2, 2, 'A2', 'O')) v(chain_idx, residue_idx, atom_idx, atom_name, element)"


@query()
def topology_residues(t: Tables) -> DataFrame:
    one = t.spark.createDataFrame([(_json(t),)], "topology string")
    rows = topology.residues(one)
    return rows.select("chain_idx", "residue_idx", "residue_name", "res_seq", F.size("atoms").cast("long").alias("n_atoms"))


ORACLES["topology_residues"] = "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'R', 1::BIGINT, 2::BIGINT), (0, 1, 'Q', 2, 1), (1, 2, 'S', 1, 1)) v(chain_idx, residue_idx, residue_name, res_seq, n_atoms)"


@query()
def topology_chains(t: Tables) -> DataFrame:
    one = t.spark.createDataFrame([(_json(t),)], "topology string")
    return topology.chains(one).crossJoin(one.select(topology.atom_count(F.col("topology")).alias("n_atoms"))).select("chain_idx", F.col("n_residues").cast("long").alias("n_residues"), "n_atoms")


ORACLES["topology_chains"] = "SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT, 4::BIGINT), (1, 1, 4)) v(chain_idx, n_residues, n_atoms)"


@query(" SELECT run_idx, traj_idx, cycle_idx, progress AS \"state/progress\", round(weight, 6) AS \"state/box/weight\" FROM frames WHERE cycle_idx = 0")
def nested_fields(t: Tables) -> DataFrame:
    rows = t.frames.filter("cycle_idx = 0").select("run_idx", "traj_idx", "cycle_idx", F.struct("progress", F.struct(F.round("weight", 6).alias("weight")).alias("box")).alias("state"))
    return nested.flattened(rows)


@query(" SELECT cycle_idx, count(*) AS n, CAST(1 AS BIGINT) AS heights, CAST(0 AS BIGINT) AS overlaps FROM parents WHERE run_idx = 0 AND cycle_idx < 10 GROUP BY 1 UNION ALL SELECT -1, count(DISTINCT plain_idx), 1, 0 FROM parents WHERE run_idx = 0 AND cycle_idx = 0")
def forest_layout(t: Tables) -> DataFrame:
    """Places of slots in a tree drawing: within a generation none overlap, and generations lie one above another."""
    from ..operators.layout import forest_layout as place

    rows = place(t.plain.filter("run_idx = 0 AND cycle_idx < 10"), radius=0.5, gap=0.25)
    near = rows.alias("a").join(rows.alias("b"), F.expr("a.run_idx = b.run_idx AND a.cycle_idx = b.cycle_idx AND a.walker_idx < b.walker_idx AND abs(a.x - b.x) < 0.999"))
    return rows.groupBy("cycle_idx").agg(F.count("*").alias("n"), F.countDistinct("y").alias("heights")).crossJoin(near.agg(F.count("*").alias("overlaps")))

