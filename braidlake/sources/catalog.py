"""Run catalog: runs between content-addressed snapshots, as tables."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Folder, Store

RUNS = ["start_hash", "end_hash", "config_hash", "last_cycle_idx"]
SCHEMA = "start_hash string, end_hash string, config_hash string, last_cycle_idx long"


def serialized(content: dict) -> str:
    """A snapshot or configuration (what JSON can hold) as compressed text; equal contents give equal texts."""
    return base64.b64encode(zlib.compress(json.dumps(content, sort_keys=True).encode(), 9)).decode()


def deserialized(text: str) -> dict:
    return json.loads(zlib.decompress(base64.b64decode(text)))


def hash_of(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()  # noqa: S324  a name, not a secret


def with_hash(items: DataFrame, content: str = "content") -> DataFrame:
    return items.withColumn("hash", F.md5(content))


def insert_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows of new whose key it lacks; of new rows with one key, one."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def register_runs(runs: DataFrame, new: DataFrame, snapshots: DataFrame, configurations: DataFrame) -> DataFrame:
    """The catalog with new runs; their three hashes must exist, and (start, end) must be new."""
    known = lambda df, c: df.select(F.col("hash").alias(c))
    for c, df in (("start_hash", snapshots), ("end_hash", snapshots), ("config_hash", configurations)):
        if not new.join(known(df, c), c, "left_anti").isEmpty():
            raise ValueError(f"{c} without an entry")
    if not new.join(runs, ["start_hash", "end_hash"], "left_semi").isEmpty():
        raise ValueError("the run is there already")
    return runs.unionByName(new.select(*RUNS))


def updated_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with the configuration and last cycle that new has for their key (start_hash, end_hash); others stay."""
    n = new.select("start_hash", "end_hash", F.col("config_hash").alias("c"), F.col("last_cycle_idx").alias("l"))
    return runs.join(n, ["start_hash", "end_hash"], "left").select("start_hash", "end_hash", F.coalesce("c", "config_hash").alias("config_hash"), F.coalesce("l", "last_cycle_idx").alias("last_cycle_idx"))


def without_runs(runs: DataFrame, keys: DataFrame) -> DataFrame:
    return runs.join(keys.select("start_hash", "end_hash"), ["start_hash", "end_hash"], "left_anti").select(*RUNS)


def run_continues(runs: DataFrame) -> DataFrame:
    """(start_hash, end_hash, base_start, base_end): the run that each run continues (it ends where this one starts; the first of several)."""
    base = runs.select(F.col("start_hash").alias("base_start"), F.col("end_hash").alias("base_end")).withColumn("k", F.row_number().over(Window.partitionBy("base_end").orderBy("base_start"))).filter("k = 1").drop("k")
    return runs.select("start_hash", "end_hash").join(base, F.col("start_hash") == F.col("base_end"))


def reconcile(host: DataFrame, other: DataFrame) -> DataFrame:
    """The host's runs and those of the other catalog that it lacks."""
    return host.select(*RUNS).unionByName(other.select(*RUNS).subtract(host.select(*RUNS)))


def _key_is(value: str | None) -> Column:
    return F.col("key").eqNullSafe(F.lit(value))


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows (key, value): new values replace old ones; a null key is a key."""
    old = table.join(new.select(F.col("key").alias("k")).distinct(), F.col("key").eqNullSafe(F.col("k")), "left_anti")
    return old.unionByName(new.select("key", "value"))


class KeyValues:
    """A table of keys and values in a folder; each change is one commit of the store below."""

    SCHEMA = "key string, value string"

    def __init__(self, spark: SparkSession, path: str, mode: str = "a", append_only: bool = False):
        self.store, self.append_only = Store(spark, path, mode), append_only

    def rows(self) -> DataFrame:
        return self.store.table("kv") if self.store.has("kv") else self.store.spark.createDataFrame([], self.SCHEMA)

    def __getitem__(self, key: str | None) -> str:
        row = self.rows().filter(_key_is(key)).first()
        if row is None:
            raise KeyError(key)
        return row.value

    def __setitem__(self, key: str | None, value: str) -> None:
        self.update({key: value})

    def update(self, values: dict) -> None:
        """Set several values in one commit."""
        new = self.store.spark.createDataFrame(list(values.items()), self.SCHEMA)
        if self.append_only and not new.join(self.rows().select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_semi").isEmpty():
            raise PermissionError("the table is for appending only")
        self.store._write("kv", upsert(self.rows(), new), replace=True)

    def __delitem__(self, key: str | None) -> None:
        if self.append_only:
            raise PermissionError("the table is for appending only")
        self[key]
        self.store._write("kv", self.rows().filter(~_key_is(key)), replace=True)

    def __len__(self) -> int:
        return self.rows().count()

    def __iter__(self):
        return (r.key for r in self.rows().select("key").orderBy("key").toLocalIterator())


class Catalog:
    """Snapshots, configurations and runs in a folder: what is run, from where, with what."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "a"):
        self.spark, self.store = spark, Store(spark, path, mode)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.table(name) if self.store.has(name) else self.spark.createDataFrame([], schema)

    @property
    def snapshots(self) -> DataFrame:
        return self._table("snapshots", "hash string, content string")

    @property
    def configurations(self) -> DataFrame:
        return self._table("configurations", "hash string, content string")

    @property
    def runs(self) -> DataFrame:
        return self._table("catalog_runs", SCHEMA)

    def _add(self, name: str, text: str) -> str:
        key = hash_of(text)
        if getattr(self, name).filter(F.col("hash") == key).isEmpty():
            self.store._write(name, self.spark.createDataFrame([(key, text)], "hash string, content string"))
        return key

    def add_snapshot(self, content: dict | str) -> str:
        """Its hash; one that is there already stays as it is."""
        return self._add("snapshots", content if isinstance(content, str) else serialized(content))

    def add_configuration(self, content: dict | str) -> str:
        return self._add("configurations", content if isinstance(content, str) else serialized(content))

    def get(self, name: str, key: str) -> dict:
        """A snapshot ("snapshots") or configuration ("configurations") by its hash."""
        row = getattr(self, name).filter(F.col("hash") == key).first()
        if row is None:
            raise KeyError(key)
        return deserialized(row.content)

    def register_run(self, start: str, end: str, config: str, last_cycle: int) -> None:
        new = self.spark.createDataFrame([(start, end, config, last_cycle)], SCHEMA)
        register_runs(self.runs, new, self.snapshots, self.configurations)
        self.store._write("catalog_runs", new)

    def run(self, start: str, end: str):
        """(config_hash, last_cycle_idx) of a run."""
        row = self.runs.filter((F.col("start_hash") == start) & (F.col("end_hash") == end)).select("config_hash", "last_cycle_idx").first()
        if row is None:
            raise KeyError((start, end))
        return row

    def update_run(self, start: str, end: str, config: str, last_cycle: int) -> None:
        self.run(start, end)
        new = self.spark.createDataFrame([(start, end, config, last_cycle)], SCHEMA)
        self.store._write("catalog_runs", updated_runs(self.runs, new), replace=True)

    def delete_run(self, start: str, end: str) -> None:
        self.run(start, end)
        self.store._write("catalog_runs", without_runs(self.runs, self.spark.createDataFrame([(start, end)], "start_hash string, end_hash string")), replace=True)

    def checkpoint(self, start: str, snapshot: dict | str, config: str, last_cycle: int) -> str:
        """A run's newest state in place of its last checkpoint, in one commit: another end snapshot and last cycle."""
        with self.store.transaction():
            end = self.add_snapshot(snapshot)
            others = self.runs.filter(~((F.col("start_hash") == start) & (F.col("config_hash") == config)))
            new = self.spark.createDataFrame([(start, end, config, last_cycle)], SCHEMA)
            self.store._write("catalog_runs", others.unionByName(new), replace=True)
        return end

    def continues(self, start: str, end: str):
        """(start, end) of the run that a run continues, or None."""
        self.run(start, end)
        row = self.runs.filter(F.col("end_hash") == start).orderBy("start_hash").first()
        return None if row is None else (row.start_hash, row.end_hash)

    def merge(self, *others: Catalog) -> None:
        """Take in what other catalogs have and this one lacks, in one commit."""
        for other in others:
            with self.store.transaction():
                for name in ("snapshots", "configurations"):
                    new = getattr(other, name).join(getattr(self, name).select("hash"), "hash", "left_anti")
                    self.store._write(name, new.select("hash", "content"))
                self.store._write("catalog_runs", other.runs.select(*RUNS).subtract(self.runs.select(*RUNS)))


def combined(catalog: Catalog, target: Store, stores: dict[tuple[str, str], tuple[Store, int]], runs: list[tuple[str, str]] | None = None) -> dict[tuple[str, str], int]:
    """One store of several runs of a catalog: each up to its last cycle, with its hashes and what it continues, in one commit.

    stores: (start, end) -> (store, run index there). The new index of each run.
    """
    last = {(r.start_hash, r.end_hash): r.last_cycle_idx for r in catalog.runs.collect()}  # a row for each run, as in stores
    ends: dict[str, tuple[str, str]] = {}
    for key in sorted(last):
        ends.setdefault(key[1], key)
    wanted = {r: k for k, r in enumerate(dict.fromkeys(runs or sorted(last)))}
    ready, after = [], {}
    for r in wanted:
        last[r]  # a run that the catalog lacks is an error
        base = ends.get(r[0])
        (ready if base == r or base not in wanted else after.setdefault(base, [])).append(r)
    to: dict[tuple[str, str], int] = {}
    new, plans = target._next_run(), {}
    while ready:
        for r in ready:
            store, run_idx = stores[r]
            base = ends.get(r[0])
            plan = (run_idx, new + len(to), to.get(base), (0, last[r] + 1), *r)
            plans.setdefault(id(store), (store, []))[1].append(plan)
            to[r] = plan[1]
        ready = sorted((n for r in ready for n in after.get(r, [])), key=wanted.__getitem__)
    if len(to) < len(wanted):
        raise ValueError("runs continue one another in a circle")
    with target.transaction():
        for store, plan in plans.values():
            target._copy(store, plan)
    return to


def output_paths(folder: str, config: str, narration: str, names: dict[str, str]) -> dict[str, str]:
    """Files of a run's reports: <folder>/<config>_<name>[.<narration>].<extension>. names: name -> extension."""
    return {n: f"{folder.rstrip('/')}/{config}_{n}{'.' + narration if narration else ''}.{ext}" for n, ext in names.items()}


def checked_paths(spark: SparkSession, paths: dict[str, str], modes: dict[str, str]) -> dict[str, str]:
    """Modes to open each path with: one that must be new (x, w-) is an error if it is there, and is rewritten (w) from then on."""
    if paths.keys() != modes.keys():
        raise ValueError("as many modes as paths are needed")
    for n, path in paths.items():
        if modes[n] in ("x", "w-") and Folder(spark, path).exists():
            raise FileExistsError(path)
    return {n: "w" if m in ("x", "w-") else m for n, m in modes.items()}
