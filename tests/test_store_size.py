"""Stores of many runs: what a write costs must not grow with the number of runs."""

import pytest
from pyspark.sql import functions as F

from braidlake.sources.catalog import SCHEMA, Catalog, combined
from braidlake.sources.store import Store


def filled(spark, path, runs, **fields):
    """runs runs of 2 walkers and 3 cycles; each third one begins a chain that the next two continue."""
    s = Store(spark, str(path), "x")
    ids = spark.range(runs).withColumnRenamed("id", "run_idx")
    frames = ids.crossJoin(spark.range(2).toDF("traj_idx")).crossJoin(spark.range(3).toDF("cycle_idx")).withColumns({"x": F.col("run_idx") * 100 + F.col("traj_idx") * 10 + F.col("cycle_idx"), **fields})
    with s.transaction():
        s._write("runs", ids.select("run_idx", F.create_map(F.lit("note"), F.col("run_idx").cast("string")).alias("metadata"), F.lit(None).cast("string").alias("start_hash"), F.lit(None).cast("string").alias("end_hash")))
        s._write("continuations", ids.filter("run_idx % 3 <> 0").select("run_idx", (F.col("run_idx") - F.col("run_idx") % 3).alias("base_run_idx")))
        s._write("frames", frames)
        s._write("warping", frames.filter("traj_idx = 1").select("run_idx", "cycle_idx", F.col("traj_idx").alias("walker_idx")))
    return s


def jobs(spark, work):
    """Spark jobs that work() takes."""
    spark.sparkContext.setJobGroup(name := f"count {id(work)}", "")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_all_runs_are_copied_by_as_many_jobs_as_one(spark, tmp_path):
    took = []
    for n in (2, 9):
        source, target = filled(spark, tmp_path / f"source{n}", n), Store(spark, str(tmp_path / f"target{n}"), "x")
        target.new_run(0)
        took.append(jobs(spark, lambda s=source, t=target: t.extract_runs(s, {1: (1, 3)})))
    assert took[1] <= took[0]
    assert sorted(map(tuple, target.table("continuations").select("run_idx", "base_run_idx").collect())) == [(2, 1), (3, 1), (5, 4), (6, 4), (8, 7), (9, 7)]
    assert {r.run_idx: r.metadata for r in target.table("runs").collect()} == {0: {}} | {k + 1: {"note": str(k)} for k in range(9)}
    got = sorted(map(tuple, target.frames(fields=["x"]).collect()))
    assert got == sorted((k + 1, w, c - (k == 1), k * 100 + w * 10 + c) for k in range(9) for w in range(2) for c in range(k == 1, 3))
    assert target.table("warping").filter("run_idx = 2").count() == 2 and target.table("warping").count() == 26


def test_copied_runs_follow_what_they_continue(spark, tmp_path):
    source = filled(spark, tmp_path / "source", 4)
    source._write("continuations", spark.createDataFrame([(0, 3), (2, 1)], "run_idx long, base_run_idx long"), replace=True)
    target = Store(spark, str(tmp_path / "target"), "x")
    assert target.extract_runs(source) == {1: 0, 2: 1, 3: 2, 0: 3}
    source._write("continuations", spark.createDataFrame([(0, 3), (3, 0)], "run_idx long, base_run_idx long"), replace=True)
    version = target.version
    with pytest.raises(ValueError, match="circle"):
        target.extract_runs(source)
    with pytest.raises(ValueError, match="no run 7"):
        target.extract_run(source, 7)
    with pytest.raises(ValueError, match="to continue"):
        target.extract_run(source, 1, continues=50)
    assert target.refresh() == version


def test_files_do_not_grow_with_runs(spark, tmp_path):
    s = filled(spark, tmp_path / "s", 40)
    for name in ("frames", "warping"):
        files = list((tmp_path / "s" / "data" / name).rglob("*.parquet"))
        assert len(files) <= s.table(name).rdd.getNumPartitions() * 4 < 40
        assert all("run_idx=" not in str(f) for f in files)
    assert s.frames().count() == 240 and s.frames(7).count() == 6 and s.link_runs(s).table("frames").count() == 480


def test_files_are_sorted_by_run_and_cycle(spark, tmp_path):
    import pyarrow.parquet as pq

    s = Store(spark, str(tmp_path / "s"), "x")
    s.append("frames", spark.range(3000).selectExpr("id * 7 % 50 AS run_idx", "id % 3 AS traj_idx", "id * 11 % 60 AS cycle_idx").repartition(3))
    found = [pq.ParquetFile(f).read(columns=["run_idx", "cycle_idx"]).to_pylist() for f in (tmp_path / "s" / "data" / "frames").rglob("*.parquet")]
    keys = [[(r["run_idx"], r["cycle_idx"]) for r in rows] for rows in found]
    assert sum(map(len, keys)) == 3000 and all(k == sorted(k) for k in keys)


def test_parts_of_older_stores_are_read(spark, tmp_path):
    """A folder for each run, as stores were written before, beside new parts of another schema."""
    import json

    path = tmp_path / "s"
    s = Store(spark, str(path), "x")
    rows = spark.createDataFrame([(r, 0, c, r + c / 10) for r in range(3) for c in range(2)], "run_idx long, traj_idx long, cycle_idx long, weight double")
    rows.write.partitionBy("run_idx").parquet(f"{path}/data/frames/store_part=0a")
    log = f"{path}/log/{s.version + 1:020d}.json"
    with open(log, "w") as f:
        json.dump([{"table": "frames", "part": "data/frames/store_part=0a", "schema": rows.schema.jsonValue(), "replace": False}], f)
    s.refresh()
    seen = s.version
    assert sorted(map(tuple, s.frames(1).collect())) == [(1, 0, 0, 1.0), (1, 0, 1, 1.1)]
    s.append("frames", spark.createDataFrame([(1, 0, 2, 5.0, 0.5)], "run_idx long, traj_idx long, cycle_idx long, weight double, observables_o double"))
    assert sorted(map(tuple, s.frames(1).collect()), key=lambda r: r[2]) == [(1, 0, 0, 1.0, None), (1, 0, 1, 1.1, None), (1, 0, 2, 5.0, 0.5)]
    assert s.frames().count() == 7 and s.changes("frames", seen).count() == 1


def test_hashes_are_set_without_the_driver(spark, tmp_path, monkeypatch):
    s = filled(spark, tmp_path / "s", 30)
    kind, got = type(s.table("runs")), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    s.set_snapshot_hash(4, "end", "h")
    assert max(map(len, got)) <= 1
    assert s.snapshot_hash(4, "end") == "h" and s.snapshot_hash(5, "end") is None and s.table("runs").count() == 30


def test_runs_of_a_catalog_are_combined_by_as_many_jobs_as_one(spark, tmp_path):
    took = []
    for n in (2, 7):
        source, target = filled(spark, tmp_path / f"source{n}", n), Store(spark, str(tmp_path / f"target{n}"), "x")
        c = Catalog(spark, str(tmp_path / f"catalog{n}"))
        keys = [(f"h{k}", f"h{k + 1}") for k in range(n)]  # a chain, the last run first in the store
        c.store._write("catalog_runs", spark.createDataFrame([(*k, "c", i % 3) for i, k in enumerate(keys)], SCHEMA))
        stores = {k: (source, n - 1 - i) for i, k in enumerate(keys)}
        to = {}
        took.append(jobs(spark, lambda c=c, t=target, s=stores, to=to: to.update(combined(c, t, s))))
        assert to == {k: i for i, k in enumerate(keys)}
    assert took[1] <= took[0]
    assert sorted((r.run_idx, r.start_hash, r.end_hash) for r in target.table("runs").collect()) == [(i, *k) for i, k in enumerate(keys)]
    assert sorted(map(tuple, target.table("continuations").collect())) == [(i, i - 1) for i in range(1, 7)]
    assert {(r.run_idx, r.cycle_idx) for r in target.frames().collect()} == {(i, c) for i in range(7) for c in range(i % 3 + 1)}
    assert {r.x // 100 for r in target.frames(2).collect()} == {4}
    assert combined(c, target, {keys[3]: (source, 0), keys[1]: (source, 0)}, [keys[3], keys[1], keys[3]]) == {keys[3]: 7, keys[1]: 8}
    with pytest.raises(KeyError):
        combined(c, target, {}, [("h0", "h9")])
    c.store._write("catalog_runs", spark.createDataFrame([("a", "b", "c", 1), ("b", "a", "c", 1)], SCHEMA), replace=True)
    with pytest.raises(ValueError, match="circle"):
        combined(c, target, {})
