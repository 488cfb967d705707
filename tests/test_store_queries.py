"""Queries that fill a store leave no folder for each run behind them, and files that don't grow with runs."""

import os

import pytest

from braidlake.plans import registry
from braidlake.sources import scratch

NAMES = ["store_extract_file_runs", "store_link_runs", "store_selected_trajs", "store_counts", "store_roundtrip", "store_run_records", "store_snapshot_hash", "store_contig_records", "store_traj_field", "store_copy_slice", "catalog_combine", "store_extract_run", "store_changes"]


@pytest.fixture(scope="module")
def many_runs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.range(24000).selectExpr("id AS event_id", "element_at(array('view', 'error'), CAST(id % 2 + 1 AS INT)) AS event_type", "CAST(id * 37 % 101 AS DOUBLE) AS value").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_files(spark, many_runs, name):
    folder = scratch.shared_folder(spark)
    before = set(os.listdir(folder))
    registry.queries()[name](spark, many_runs)
    made = [(at, f) for new in set(os.listdir(folder)) - before for at, _, files in os.walk(f"{folder}/{new}") for f in files if f.endswith(".parquet")]
    assert made and not [at for at, _ in made if "run_idx=" in at]
