"""A trajectory store: tables of Parquet files under a log of commits.

Layout: ``data/<table>/store_part=<id>`` holds what one write added, ``log/<n>.json`` says which of these folders a commit adds to or
removes from which table, with each table's schema. A folder counts only once a log file names it, and a log file is
created at one stroke and never twice under one number. So readers see whole commits, a failed task or transaction
leaves nothing, and of two writers the later one commits on top of the earlier one. A reader keeps the version that it
opened until ``refresh``.

Tables: frames, init_walkers, one for each record group, runs, continuations, decision_enum, record_fields, registry,
settings, metadata. Files of frame and record tables are sorted by run and cycle, so that a run's scan skips the pages of
others; a write makes a file for each task, however many runs it holds. (Parts of older stores have a folder for each run
and are read as before.) A sparse field is null where it has no value. Appending a field that isn't registered is an error unless its name begins
with ``observables_``.
"""

from __future__ import annotations

import contextlib
import heapq
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

RECORDS = ("resampling", "resampler", "warping", "progress", "boundary_conditions")
#: Groups with a record in each cycle; the others have any number of records in a cycle.
CONTINUAL = ("progress",)
SORTED = ("frames", "init_walkers", *RECORDS)
FREE = "observables_"
PART = "store_part"
INDEX = ("run_idx", "traj_idx", "cycle_idx")
MODES = ("r", "r+", "x", "w-", "w", "a")


class Folder:
    """Files of a folder, wherever Spark's paths reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one of this name."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001  the file system says so in its own class
            if self.exists(name):
                return False
            raise OSError(str(e)) from e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Store:
    def __init__(self, spark: SparkSession, path: str, mode: str = "r", version: int | None = None, **settings):
        """mode: r (read), r+ (read and append), x or w- (create, must not exist), w (create anew), a (append or create).

        settings of a new store: topology (JSON), n_dims, units (field -> unit), alt_reps (name -> atom indexes), main_rep
        (atom indexes), sparse (fields), shapes, dtypes (by field). version: read as of that commit.
        """
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        self.files = Folder(spark, self.path)
        there = self.files.exists()
        if mode in ("x", "w-") and there:
            raise FileExistsError(path)
        if mode in ("r", "r+") and not there:
            raise FileNotFoundError(path)
        if mode == "w" and there:
            self.files.delete()
        self._pinned, self._parts, self._schemas, self._open = version, {}, {}, None
        self._by_folder: set[str] = set()  # parts of older stores: a folder for each run
        self.version = -1
        self.refresh()
        if self.version < 0 and mode != "r":
            self._create(settings)

    def _create(self, settings: dict) -> None:
        sparse, shapes, dtypes = settings.pop("sparse", ()), settings.pop("shapes", {}), settings.pop("dtypes", {})
        with self.transaction():
            self._write("settings", self._rows([(k, json.dumps(v)) for k, v in settings.items()], "key string, value string"))
            if fields := sorted({*sparse, *shapes, *dtypes}):
                self._write("registry", self._rows([(f, json.dumps(shapes[f]) if f in shapes else None, dtypes.get(f), f in sparse) for f in fields], "field string, shape string, dtype string, sparse boolean"))

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # the log

    def refresh(self) -> int:
        """Read on in the log, to its end or the pinned version; the version read."""
        for name in self.files.names("log"):
            n = int(name.split(".")[0])
            if n <= self.version or self._pinned is not None and n > self._pinned:
                continue
            for entry in json.loads(self.files.read(f"log/{name}")):
                table = entry["table"]
                if entry.get("replace"):
                    self._parts[table] = []
                self._parts.setdefault(table, []).append((n, entry["part"]))
                self._schemas[table] = entry["schema"]
                if table in SORTED and not entry.get("sorted"):
                    self._by_folder.add(entry["part"])
            self.version = n
        return self.version

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes meanwhile become one commit, or none if the body fails."""
        self._writable()
        if self._open is not None:
            yield
            return
        self._open = []
        try:
            yield
            entries = self._open
        except BaseException:
            for entry in self._open:
                self.files.delete(entry["part"])
            raise
        finally:
            self._open = None
        while not self.files.create(f"log/{self.version + 1:020d}.json", json.dumps(entries)):
            self.refresh()  # another writer was first
        self.refresh()

    def _writable(self) -> None:
        if self.mode == "r" or self._pinned is not None:
            raise PermissionError("the store is open for reading only")

    def _write(self, name: str, rows: DataFrame, replace: bool = False) -> None:
        with self.transaction():
            part = f"data/{name}/{PART}={uuid.uuid4().hex}"
            old = [] if replace or name not in self._schemas else StructType.fromJson(self._schemas[name]).fields
            schema = {f.name: f for f in old} | {f.name: f for f in rows.schema.fields if f.name not in {o.name for o in old}}
            if name in SORTED:
                rows = rows.sortWithinPartitions(*(c for c in ("run_idx", "cycle_idx") if c in rows.columns))
            rows.write.parquet(f"{self.path}/{part}")
            self._open.append({"table": name, "part": part, "schema": StructType(list(schema.values())).jsonValue(), "replace": replace, "sorted": name in SORTED})

    def vacuum(self) -> list[str]:
        """Delete folders that no commit names: of failed writes, and of tables since replaced. No other writer may be at work."""
        self._writable()
        self.refresh()
        named = {p for parts in self._parts.values() for _, p in parts}
        gone = [part for t in self.files.names("data") for x in self.files.names(f"data/{t}") if (part := f"data/{t}/{x}") not in named]
        for part in gone:
            self.files.delete(part)
        return gone

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        pass

    def set_mode(self, mode: str) -> None:
        if mode not in ("r", "r+", "a"):
            raise ValueError(f"an open store can't get the mode {mode}")
        self.mode = mode

    # tables

    def has(self, name: str) -> bool:
        return bool(self._parts.get(name))

    def table(self, name: str) -> DataFrame:
        if not self.has(name):
            raise KeyError(name)
        return self._read(name, [p for _, p in self._parts[name]])

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        schema = StructType.fromJson(self._schemas[name])
        old = [p for p in parts if p in self._by_folder]
        found = [self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{name}").parquet(*(f"{self.path}/{p}" for p in some)).select(*(f"`{c}`" for c in schema.names)) for some in (old, [p for p in parts if p not in self._by_folder]) if some]
        return found[0] if len(found) == 1 else found[0].unionAll(found[1])

    def changes(self, name: str, since: int) -> DataFrame | None:
        """Rows that commits after version ``since`` added: what a reader that follows the writer has not seen."""
        parts = [p for n, p in self._parts.get(name, []) if n > since]
        return self._read(name, parts) if parts else None

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table; fields that frames don't know are refused, unless they are observables, which become sparse fields."""
        self._writable()
        if name == "frames":
            known = {f.name for f in StructType.fromJson(self._schemas[name]).fields} if self.has(name) else set(rows.columns)
            known |= {r.field for r in self._registry()} | {*INDEX, "weight"}
            other = [c for c in rows.columns if c not in known and not c.startswith(FREE)]
            if other:
                raise ValueError(f"fields that aren't registered: {other}")
        if name in RECORDS and (fields := self.record_fields(name)) and (other := [c for c in rows.columns if c not in fields and c not in ("run_idx", "cycle_idx")]):
            raise ValueError(f"records of {name} have no fields {other}")
        with self.transaction():
            self._write(name, rows)
            if name == "frames":
                known = {r.field for r in self._registry()}
                for c in rows.columns:
                    if c.startswith(FREE) and c not in known:
                        self._write("registry", self._rows([(c, None, dict(rows.dtypes)[c], True)], "field string, shape string, dtype string, sparse boolean"))

    # runs

    def _run_rows(self, *runs: int) -> int:
        return self.table("runs").filter(F.col("run_idx").isin(*runs)).count() if self.has("runs") else 0

    def new_run(self, run_idx: int, init_walkers: DataFrame | None = None, continues: int | None = None, **metadata: str) -> None:
        if self._run_rows(run_idx):
            raise ValueError(f"run {run_idx} is there already")
        with self.transaction():
            self._write("runs", self._rows([(run_idx, metadata, None, None)], "run_idx long, metadata map<string,string>, start_hash string, end_hash string"))
            if continues is not None:
                self.add_continuation(run_idx, continues, new=True)
            if init_walkers is not None:
                self._write("init_walkers", init_walkers.withColumn("run_idx", F.lit(run_idx).cast("long")))

    def add_continuation(self, run_idx: int, base_run_idx: int, new: bool = False) -> None:
        if not self._run_rows(base_run_idx) or not new and not self._run_rows(run_idx):
            raise ValueError(f"no run {base_run_idx} to continue")
        self._write("continuations", self._rows([(run_idx, base_run_idx)], "run_idx long, base_run_idx long"))

    def init_walkers(self, run_idx: int, fields: list[str], walkers: list[int] | None = None) -> DataFrame:
        """(traj_idx, fields ...) of the states that a run began with."""
        rows = self.table("init_walkers").filter(F.col("run_idx") == run_idx)
        return (rows if walkers is None else rows.filter(F.col("traj_idx").isin(*walkers))).select("traj_idx", *fields)

    def add_traj(self, run_idx: int, rows: DataFrame, sparse: dict[str, list[int]] | None = None) -> int:
        """A new trajectory of a run, in the order of cycle_idx; its index. rows: cycle_idx and fields; without ``weight`` it is 1.

        sparse: the cycles in which a sparse field has values; elsewhere it is null. Registered shapes are checked.
        """
        if not self._run_rows(run_idx):
            raise ValueError(f"no run {run_idx}")
        last = self.frames(run_idx).agg(F.max("traj_idx")).first()[0] if self.has("frames") else None
        traj_idx = 0 if last is None else last + 1
        self._add_frames(run_idx, traj_idx, rows, sparse or {}, rows.columns)
        return traj_idx

    def extend_traj(self, run_idx: int, traj_idx: int, rows: DataFrame) -> None:
        """More frames of a trajectory; their cycles follow its last one. Unknown fields are refused but for observables."""
        last = self.frames(run_idx).filter(F.col("traj_idx") == traj_idx).agg(F.max("cycle_idx")).first()[0] if self.has("frames") else None
        if last is None:
            raise ValueError(f"no trajectory {traj_idx} in run {run_idx}")
        first = rows.agg(F.min("cycle_idx")).first()[0]
        if first is not None and first <= last:
            raise ValueError(f"cycle {first} isn't behind the trajectory's last, {last}")
        self._add_frames(run_idx, traj_idx, rows, {}, self.table("frames").columns)

    def _add_frames(self, run_idx: int, traj_idx: int, rows: DataFrame, sparse: dict[str, list[int]], known: list[str]) -> None:
        rows = rows.withColumns({"run_idx": F.lit(run_idx).cast("long"), "traj_idx": F.lit(traj_idx).cast("long")})
        if "weight" not in rows.columns:
            rows = rows.withColumn("weight", F.lit(1.0))
        for c, cycles in sparse.items():
            rows = rows.withColumn(c, F.when(F.col("cycle_idx").isin(*cycles), F.col(c)))
        for r in self._registry():
            if r.field in rows.columns and r.shape and isinstance(rows.schema[r.field].dataType, ArrayType):
                shape, item = json.loads(r.shape), F.col(r.field)
                bad = F.lit(False)
                for k, n in enumerate(shape):
                    bad = bad | (F.size(item) != n)
                    item = item[0] if k < len(shape) - 1 else item
                if not rows.filter(F.col(r.field).isNotNull() & bad).isEmpty():
                    raise ValueError(f"{r.field} isn't of the shape {shape}")
        self.append("frames", rows)

    # records

    def init_record_fields(self, group: str, fields: list[str]) -> None:
        """Declare a record group's fields; it can be done once."""
        if self.record_fields(group):
            raise ValueError(f"the fields of {group} are set already")
        self._write("record_fields", self._rows([(group, f, group in CONTINUAL) for f in fields], "record_group string, field string, continual boolean"))

    def record_fields(self, group: str) -> list[str]:
        return [r.field for r in self.table("record_fields").filter(F.col("record_group") == group).collect()] if self.has("record_fields") else []

    def extend_records(self, group: str, run_idx: int, cycle_idx: int, rows: DataFrame) -> None:
        """One cycle's records of a group. A continual group gets one for each cycle."""
        if group in CONTINUAL and rows.count() != 1:
            raise ValueError(f"{group} has one record for each cycle")
        self.append(group, rows.withColumns({"run_idx": F.lit(run_idx).cast("long"), "cycle_idx": F.lit(cycle_idx).cast("long")}))

    def records(self, group: str, run_idx: int | None = None, flat: bool = False) -> DataFrame:
        """Records of a group. flat: vectors of one number are numbers; a vector of vectors is an error."""
        df = self.table(group)
        df = df if run_idx is None else df.filter(F.col("run_idx") == run_idx)
        if flat:
            for f in df.schema.fields:
                if isinstance(f.dataType, ArrayType):
                    if isinstance(f.dataType.elementType, ArrayType):
                        raise TypeError(f"{f.name} has more than one dimension")
                    if f.name != "target_idxs" and (df.agg(F.max(F.size(f.name))).first()[0] or 0) <= 1:
                        df = df.withColumn(f.name, F.col(f.name)[0])
        return df

    def contig_records(self, group: str, runs: list[int]) -> DataFrame:
        """Records along runs that continue one another, with contig_cycle; no rows for a group without records."""
        if not self.has(group):
            return self._rows([], "run_idx long, cycle_idx long, contig_cycle long")
        sizes = {r.run_idx: r.n for r in self.frames().filter(F.col("run_idx").isin(*runs)).groupBy("run_idx").agg((F.max("cycle_idx") + 1).alias("n")).collect()}
        offset, before = {}, 0
        for r in runs:
            offset[r], before = before, before + sizes.get(r, 0)
        at = self._rows(list(offset.items()), "run_idx long, before long")
        return self.table(group).join(F.broadcast(at), "run_idx").withColumn("contig_cycle", F.col("cycle_idx") + F.col("before")).drop("before")

    def set_decisions(self, run_idx: int, names: dict[str, int]) -> None:
        self._write("decision_enum", self._rows([(run_idx, k, v) for k, v in names.items()], "run_idx long, name string, value long"))

    def decisions(self, run_idx: int) -> dict[str, int]:
        return {r.name: r.value for r in self.table("decision_enum").filter(F.col("run_idx") == run_idx).collect()}

    # settings

    def add_metadata(self, key: str, value: str) -> None:
        if key in self.metadata():
            raise ValueError(f"{key} is set already")
        self._write("metadata", self._rows([(key, value)], "key string, value string"))

    def metadata(self) -> dict[str, str]:
        return {r.key: r.value for r in self.table("metadata").collect()} if self.has("metadata") else {}

    def settings(self) -> dict:
        return {r.key: json.loads(r.value) for r in self.table("settings").collect()} if self.has("settings") else {}

    def _registry(self) -> list:
        if not self.has("registry"):
            return []
        merged = self.table("registry").groupBy("field").agg(F.max("shape").alias("shape"), F.max("dtype").alias("dtype"), F.max("sparse").alias("sparse"))
        return merged.collect()

    def register(self, field: str, shape: str | None = None, dtype: str | None = None, sparse: bool = False) -> None:
        """Shape and dtype can be set once; setting a known one anew is an error."""
        for r in self._registry():
            if r.field == field and (shape and r.shape or dtype and r.dtype):
                raise AttributeError(f"{field} is known already")
        self._write("registry", self._rows([(field, shape, dtype, sparse)], "field string, shape string, dtype string, sparse boolean"))

    def sparse_fields(self) -> list[str]:
        return sorted(r.field for r in self._registry() if r.sparse)

    def rep_path(self, rep: str) -> str:
        """The field that holds a representation: positions, or alt_reps_<name>."""
        if rep == "positions":
            return rep
        if rep not in self.settings().get("alt_reps", {}):
            raise ValueError(f"no representation {rep}")
        return f"alt_reps_{rep}"

    def topology(self, rep: str | None = None) -> str:
        """The topology's JSON: whole, or the atoms of a representation (positions: of the main one, if that is a part)."""
        from ..functions.topology import subset_json

        own = self.settings()
        if rep is None or rep == "positions" and not own.get("main_rep"):
            return own["topology"]
        return subset_json(own["topology"], own["main_rep"] if rep == "positions" else own["alt_reps"][rep])

    def set_snapshot_hash(self, run_idx: int, which: str, value: str) -> None:
        """which: start or end. It can be set once."""
        c = f"{which}_hash"
        known = self.snapshot_hash(run_idx, which)
        if known is not None:
            raise AttributeError(f"the {which} hash of run {run_idx} is set already")
        rows = self.table("runs").withColumn(c, F.when(F.col("run_idx") == run_idx, F.lit(value)).otherwise(F.col(c)))
        self._write("runs", rows, replace=True)

    def snapshot_hash(self, run_idx: int, which: str) -> str | None:
        row = self.table("runs").filter(F.col("run_idx") == run_idx).select(f"{which}_hash").first()
        if row is None:
            raise ValueError(f"no run {run_idx}")
        return row[0]

    # reading

    def frames(self, run_idx: int | None = None, fields: list[str] | None = None, trajs: DataFrame | None = None) -> DataFrame:
        """Frames of all runs or one; of some trajectories (run_idx, traj_idx) only; fields that aren't there are null."""
        df = self.table("frames")
        df = df if run_idx is None else df.filter(F.col("run_idx") == run_idx)
        df = df if trajs is None else df.join(trajs.select("run_idx", "traj_idx"), ["run_idx", "traj_idx"], "left_semi")
        return df.select(*INDEX, *(F.col(f) if f in df.columns else F.lit(None).alias(f) for f in fields)) if fields else df

    def field(self, run_idx: int, traj_idx: int, field: str, cycles: list[int] | None = None) -> DataFrame:
        """(cycle_idx, field) of a trajectory, or of some of its cycles; null where a sparse field has no value."""
        df = self.frames(run_idx, [field]).filter(F.col("traj_idx") == traj_idx)
        return (df if cycles is None else df.filter(F.col("cycle_idx").isin(*cycles))).select("cycle_idx", field)

    def field_cycles(self, run_idx: int, traj_idx: int, field: str) -> DataFrame:
        """Cycles in which a (sparse) field has a value."""
        return self.frames(run_idx).filter((F.col("traj_idx") == traj_idx) & F.col(field).isNotNull()).select("cycle_idx")

    def observables(self) -> list[str]:
        """Names of observables that every trajectory has values of; one that only some have is an error."""
        names = [c[len(FREE) :] for c in self.table("frames").columns if c.startswith(FREE)]
        if other := self.inconsistent([FREE + n for n in names]):
            raise TypeError(f"not in all trajectories: {other}")
        return names

    def inconsistent(self, fields: list[str]) -> list[str]:
        """Fields that some trajectories have values of and others have not."""
        counts = self.frames().groupBy("run_idx", "traj_idx").agg(*(F.count(f).alias(f) for f in fields))
        row = counts.agg(*(F.min(f).alias(f) for f in fields)).first()
        return [f for f in fields if row[f] == 0]

    def counts(self) -> DataFrame:
        """(run_idx, n_trajs, n_cycles, n_frames) of each run."""
        return self.frames().groupBy("run_idx").agg(F.countDistinct("traj_idx").alias("n_trajs"), (F.max("cycle_idx") + 1).alias("n_cycles"), F.count("*").alias("n_frames"))

    # from store to store

    def clone(self, path: str, mode: str = "x") -> Store:
        """A store with this one's settings, registry and record fields, without runs."""
        out = Store(self.spark, path, mode)
        with out.transaction():
            for name in ("settings", "registry", "record_fields", "metadata"):
                if self.has(name):
                    out._write(name, self.table(name), replace=True)
        return out

    def _next_run(self) -> int:
        last = self.table("runs").agg(F.max("run_idx")).first()[0] if self.has("runs") else None
        return 0 if last is None else last + 1

    def _copy(self, other: Store, plan: list[tuple]) -> None:
        """Copy runs of another store, in one commit and by one write for each table.

        plan: (run_idx, new run_idx, the new index of what it continues or None, (start, end) or None, start hash, end hash)
        for each copy; a run may be copied more than once.
        """
        if not plan:
            return
        low, high = min(p[0] for p in plan), max(p[0] for p in plan)
        at = self._rows([(p[0], (p[1], p[2], *(p[3] or (0, None)), *p[4:])) for p in plan], "run_idx long, store_copy struct<run: long, base: long, start: long, end: long, start_hash: string, end_hash: string>")
        own = lambda name: other.table(name).filter(F.col("run_idx").between(low, high))
        lacking = at.join(own("runs"), "run_idx", "left_anti").first()
        if lacking is not None:
            raise ValueError(f"no run {lacking.run_idx}")
        at = F.broadcast(at)  # a row for each run
        to = F.col("store_copy.run").alias("run_idx")
        with self.transaction():
            metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata")
            self._write("runs", own("runs").select("run_idx", "metadata").join(at, "run_idx").select(to, metadata, "store_copy.start_hash", "store_copy.end_hash"))
            if any(p[2] is not None for p in plan):
                self._write("continuations", self._rows([(p[1], p[2]) for p in plan if p[2] is not None], "run_idx long, base_run_idx long"))
            for name in ("frames", *RECORDS, "init_walkers", "decision_enum"):
                if other.has(name):
                    rows = own(name)
                    fields = {c: to if c == "run_idx" else F.col(c) for c in rows.columns}
                    kept = rows.join(at, "run_idx")
                    if "cycle_idx" in fields:
                        c = F.col("cycle_idx")
                        kept = kept.filter(F.col("store_copy.end").isNull() | (c >= F.col("store_copy.start")) & (c < F.col("store_copy.end")))
                        fields["cycle_idx"] = (c - F.col("store_copy.start")).cast(rows.schema["cycle_idx"].dataType).alias("cycle_idx")
                    self._write(name, kept.select(*fields.values()))

    def extract_run(self, other: Store, run_idx: int, continues: int | None = None, cycles: tuple[int, int] | None = None) -> int:
        """Copy a run of another store, or its cycles [start, end), as a new run of this one; its index.

        Frames, records, initial walkers and metadata come along, in one commit. Cycles count from 0 again.
        """
        if continues is not None and not self._run_rows(continues):
            raise ValueError(f"no run {continues} to continue")
        new = self._next_run()
        self._copy(other, [(run_idx, new, continues, cycles, None, None)])
        return new

    def extract_runs(self, other: Store, cycles: dict[int, tuple[int, int]] | None = None) -> dict[int, int]:
        """Copy all runs of another store, with its continuations, in one commit; old index -> new index. cycles: [start, end) by run."""
        base = {r.run_idx: r.base_run_idx for r in other.table("continuations").collect()} if other.has("continuations") else {}
        runs = {r.run_idx for r in other.table("runs").select("run_idx").collect()}
        ready, after, to = [], {}, {}
        for r in sorted(runs):
            (after.setdefault(base[r], []) if base.get(r) in runs else ready).append(r)
        new = self._next_run()
        while ready:  # a run after the one that it continues
            r = heapq.heappop(ready)
            to[r] = new + len(to)
            for n in after.get(r, []):
                heapq.heappush(ready, n)
        if len(to) < len(runs):
            raise ValueError("runs continue one another in a circle")
        self._copy(other, [(r, n, to.get(base.get(r)), (cycles or {}).get(r), None, None) for r, n in to.items()])
        return to

    def copy_slice(self, target: Store, run_idx: int, start: int, end: int, new_run_idx: int) -> None:
        """Copy cycles [start, end) of a run to another store, in one commit; cycles count from 0 there."""
        row = self.table("runs").filter(F.col("run_idx") == run_idx).first() if self.has("runs") else None
        with target.transaction():
            target.new_run(new_run_idx, **((row.metadata or {}) if row else {}))
            for name in ("frames", *RECORDS, "init_walkers"):
                if self.has(name):
                    rows = self.table(name).filter(F.col("run_idx") == run_idx)
                    if "cycle_idx" in rows.columns:
                        rows = rows.filter((F.col("cycle_idx") >= start) & (F.col("cycle_idx") < end)).withColumn("cycle_idx", F.col("cycle_idx") - start)
                    target._write(name, rows.withColumn("run_idx", F.lit(new_run_idx).cast("long")))

    def union(self, other: Store, name: str, offset: int) -> DataFrame:
        """A view of both stores' table, the other's runs shifted; nothing is copied."""
        shift = {c: F.col(c) + offset for c in ("run_idx", "base_run_idx") if c in other.table(name).columns}
        return self.table(name).unionByName(other.table(name).withColumns(shift), allowMissingColumns=True)

    def link_runs(self, other: Store) -> Linked:
        """This store and another one's runs behind its own, read as one; nothing is copied."""
        return Linked(self, other, self._next_run())


class Linked:
    """Two stores read as one: the other's runs, and what they continue, are shifted by ``offset``."""

    def __init__(self, one: Store, other: Store, offset: int):
        self.one, self.other, self.offset = one, other, offset

    def table(self, name: str) -> DataFrame:
        if not self.other.has(name):
            return self.one.table(name)
        if not self.one.has(name):
            rows = self.other.table(name)
            return rows.withColumns({c: F.col(c) + self.offset for c in ("run_idx", "base_run_idx") if c in rows.columns})
        return self.one.union(self.other, name, self.offset)
