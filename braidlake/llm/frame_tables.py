"""Spark tables of frames (see ``frames``) and the steps that the two exact-repeat operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Ranges, byte_codes, text_blocks, word_codes, words
from .frames import anchors, blocks, single, suffixes

#: A document row is known by its id and its text's hash, so that two rows with one id and other texts stay apart.
KEY = ("doc_id", "text_key")
FRAMES = "doc_id long, text_key long, q long, lo int, hi int, h long, r1 long, r2 long"
BLOCKS = "doc_id long, text_key long, q long, weight long, j int, vlo int, vhi int, s0 long, s1 long, s2 long, s3 long, d1 long, d2 long"
SINGLES = "doc_id long, text_key long, q long, weight long, rank long, o int, w1 long, w2 long"
SUFFIXES = "doc_id long, text_key long, q long, o int, p0 long, p1 long, p2 long"
CONTENT = "doc_id long, text_key long, q long, lo int, hi int, h long, codes binary"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text) of all rows; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))


def sequence(unit: str, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token codes and row offsets of a block: its bytes, or its words."""
    if unit == "byte":
        return byte_codes(flat), offsets
    starts, ends, off = words(flat, offsets)
    return word_codes(flat, starts, ends), off


def batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def frame_table(docs: DataFrame, window: int, k: int, unit: str) -> DataFrame:
    """All frames of all rows with an id; no window crosses a row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, keys = (x.column(i).to_numpy() for i in (0, 1))
            for first, _, flat, offsets in text_blocks(x.column(2)):
                tokens, off = sequence(unit, flat, offsets)
                row, q, a, b, h, r1, r2 = anchors(tokens, off, window, k)
                if len(row):
                    yield batch(FRAMES, [ids[first + row], keys[first + row], q, q - b, q - a, h, r1, r2])

    return docs.filter("doc_id is not null").select("doc_id", "text_key", "text").mapInArrow(make, FRAMES)


def attach(docs: DataFrame, items: DataFrame, *names: str) -> DataFrame:
    """The rows of docs that have items, with the list of them (as long as a text at most)."""
    lists = items.groupBy(*KEY).agg(F.collect_list(F.struct(*names)).alias("items"))
    return docs.join(lists, list(KEY))


def _per_row(batches: Iterator[pa.RecordBatch], unit: str):
    """(id, key, tokens' range names, tokens, items as columns) for each row of attached documents."""
    for x in batches:
        at = {n: i for i, n in enumerate(x.schema.names)}
        ids, keys = (x.column(at[n]).to_numpy() for n in KEY)
        lists = x.column(at["items"])
        cut, inner = lists.offsets.to_numpy(), lists.values
        fields = {inner.type.field(i).name: inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(inner.type.num_fields)}
        for first, end, flat, offsets in text_blocks(x.column(at["text"])):
            tokens, off = sequence(unit, flat, offsets)
            names = Ranges(tokens)
            for i in range(first, end):
                yield ids[i], keys[i], names, tokens, int(off[i - first]), {n: v[cut[i] : cut[i + 1]] for n, v in fields.items()}


class _Out:
    """Gathers columns into batches of a bounded number of rows."""

    def __init__(self, schema: str, rows: int = 1 << 16):
        self.schema, self.rows, self.parts, self.n = schema, rows, [], 0

    def add(self, columns: list) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.n += len(columns[-1])
        if self.n >= self.rows:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            joined = [np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.array([z for y in x for z in y], pa.binary()) for x in zip(*self.parts, strict=True)]
            self.parts, self.n = [], 0
            yield batch(self.schema, joined)


def block_table(attached: DataFrame, window: int, unit: str) -> DataFrame:
    """Blocks of offsets of frames; items: q, lo, hi, weight."""

    def make(batches):
        out = _Out(BLOCKS)
        for i, key, names, _, base, f in _per_row(batches, unit):
            frame, j, vlo, vhi, parts, hood = blocks(names, f["q"] + base, f["lo"], f["hi"], window)
            n = len(frame)
            yield from out.add([np.full(n, i), np.full(n, key), f["q"][frame], f["weight"][frame], j, vlo, vhi, *parts, *hood])
        yield from out.end()

    return attached.mapInArrow(make, BLOCKS)


def single_table(attached: DataFrame, window: int, unit: str) -> DataFrame:
    """Single windows of blocks; items: q, lo, hi, weight, rank (of the block's core)."""

    def make(batches):
        out = _Out(SINGLES)
        for i, key, names, _, base, f in _per_row(batches, unit):
            frame, o, pair = single(names, f["q"] + base, f["lo"], f["hi"], window)
            n = len(frame)
            yield from out.add([np.full(n, i), np.full(n, key), f["q"][frame], f["weight"][frame], f["rank"][frame], o, *pair])
        yield from out.end()

    return attached.mapInArrow(make, SINGLES)


def suffix_table(attached: DataFrame, window: int, unit: str) -> DataFrame:
    """Suffixes at the window starts of frames, by the names of their prefixes; items: q, lo, hi."""

    def make(batches):
        out = _Out(SUFFIXES)
        for i, key, names, _, base, f in _per_row(batches, unit):
            frame, o, prefix = suffixes(names, f["q"] + base, f["lo"], f["hi"], window)
            n = len(frame)
            yield from out.add([np.full(n, i), np.full(n, key), f["q"][frame], o, *prefix])
        yield from out.end()

    return attached.mapInArrow(make, SUFFIXES)


def content_table(attached: DataFrame, window: int, unit: str) -> DataFrame:
    """The token codes of each frame's hood; items: q, lo, hi, h."""

    def make(batches):
        out = _Out(CONTENT, 1 << 12)
        for i, key, _, tokens, base, f in _per_row(batches, unit):
            n = len(f["q"])
            codes = [tokens[base + q - hi : base + q - lo + window].tobytes() for q, lo, hi in zip(f["q"], f["lo"], f["hi"], strict=True)]
            yield from out.add([np.full(n, i), np.full(n, key), f["q"], f["lo"], f["hi"], f["h"], codes])
        yield from out.end()

    return attached.mapInArrow(make, CONTENT)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of docs with its spans (start, end), or null. Rows without an id match nothing."""
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("items"))
    return docs.join(lists, list(KEY), "left")
