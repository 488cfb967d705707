"""Near-duplicate documents: SetSketch registers, banded, estimated jointly by likelihood, then verified.

1. Each text becomes the set of its word shingles' hashes, its size, two order-free fingerprints and m registers.
2. Equal sets are one class with its least id; nothing after this sees a group of copies, however large.
3. Bands of r registers deal classes into buckets. With 32 bands of 4, a pair at similarity 0.8 shares no bucket
   with probability 5e-8.
4. Each class is verified against one leader, the least that it shares a bucket with; links make components.
   A group of n near copies costs n pairs here, not n * n.
5. In buckets that still hold more than one component, sketches of all 512 registers are compared, across
   components only, and the joint likelihood estimate decides: a pair is verified unless it is five standard
   deviations below the threshold. Pairs of one component need no look: they can't change the components. Only
   pairs that pass become rows. No bucket is capped; a large one is dealt out in pairs of blocks.
6. Verified links of both rounds make the components.

Verification compares full sets. Sets travel only for classes that are in a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .components import components
from .flat import LOWER, Ranges, byte_codes, mix, text_blocks, words
from .frame_tables import KEY, batch, keyed
from .shared import drop, fresh, owned, written

SKETCH = "doc_id long, text_key long, n_shingles long, f1 long, f2 long, registers binary"
BANDS = "doc_id long, text_key long, key long"
PAIRS = "a long, ak long, b long, bk long"
SETS = "doc_id long, text_key long, elements binary"


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row: A-Z lowered, words free of white space, short rows as one shingle."""
    starts, ends, off = words(flat, offsets)
    names = Ranges(Ranges(byte_codes(LOWER[flat])).of(starts, ends))
    grams = names.every(shingle)
    short = np.flatnonzero((np.diff(off) < shingle) & (np.diff(off) > 0))
    whole = dict(zip(short, names.of(off[short], off[short + 1]), strict=True))
    out = []
    for i in range(len(off) - 1):
        a, b = off[i], off[i + 1] - shingle + 1
        out.append(np.unique(grams[a:b]) if b > a else np.array([whole[i]]) if i in whole else np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, shingle: int, m: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(2), 1 << 18):
                sets = shingle_sets(flat, offsets, shingle)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                f1, f2, blobs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), [None] * len(sets)
                if len(full):
                    elements = np.concatenate([sets[i] for i in full])
                    at = np.cumsum(size[full]) - size[full]
                    f1[full] = np.add.reduceat(elements, at).view(np.int64)
                    f2[full] = np.add.reduceat(mix(elements ^ np.uint64(0xA0761D6478BD642F)), at).view(np.int64)
                    for i, r in zip(full, setsketch.registers(elements, at, m), strict=True):
                        blobs[i] = r.tobytes()
                yield batch(SKETCH, [x.column(0).slice(first, last - first), x.column(1).slice(first, last - first), size, f1, f2, blobs])

    return docs.select(*KEY, "text").mapInArrow(make, SKETCH)


def band_keys(regs: np.ndarray, r: int) -> np.ndarray:
    n, m = regs.shape
    salt = np.arange(m // r, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    regs = regs.reshape(n, m // r, r).astype(np.uint64)
    key = np.repeat(salt[None], n, 0)
    for i in range(r):
        key = mix(key ^ regs[:, :, i]) + salt
    return key


def band_of(regs: np.ndarray, key: int, banded: int, r: int) -> int:
    return int(np.flatnonzero(band_keys(regs[None, :banded], r)[0].view(np.int64) == key)[0])


def band_table(classes: DataFrame, m: int, r: int) -> DataFrame:
    """(doc_id, text_key, key): a row for each class and band."""

    def make(batches):
        for x in batches:
            if x.num_rows:
                key = band_keys(np.stack([np.frombuffer(v.as_buffer(), np.uint16)[:m] for v in x.column(2)]), r)
                yield batch(BANDS, [np.repeat(x.column(0).to_numpy(), m // r), np.repeat(x.column(1).to_numpy(), m // r), key.ravel().view(np.int64)])

    return classes.select(*KEY, "registers").mapInArrow(make, BANDS)


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    def make(batches):
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(2)):
                sets = shingle_sets(flat, offsets, shingle)
                yield batch(SETS, [x.column(0).slice(first, last - first), x.column(1).slice(first, last - first), [s.tobytes() for s in sets]])

    return docs.select(*KEY, "text").mapInArrow(make, SETS)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, ak, b, bk) whose full sets have 100 * intersection >= percent * union, as (a, b)."""
    ids = pairs.select(F.col("a").alias("doc_id"), F.col("ak").alias("text_key")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.col("bk").alias("text_key"))).distinct()
    texts = docs.join(ids.hint("merge"), list(KEY))
    sets = written(set_table(texts, shingle), "op10-sets")
    side = lambda p: sets.select(F.col("doc_id").alias(p), F.col("text_key").alias(p + "k"), F.col("elements").alias(p + "s"))

    def make(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column(2), x.column(3), strict=True):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = written(pairs.join(side("a"), ["a", "ak"]).join(side("b"), ["b", "bk"]).select("a", "b", "as", "bs").mapInArrow(make, "a long, b long"), "op10-links")
    drop(sets)
    return out


def plausible(rows: DataFrame, m: int, banded: int, r: int, percent: int, block: int = 2048) -> DataFrame:
    """Pairs of classes that share a bucket, are of different components, and whose estimate is near the threshold or above.

    rows: key, size (of the bucket), doc_id, text_key, c (component), n_shingles, registers. A bucket of more than
    ``block`` rows is dealt out in pairs of blocks, so that a task holds two blocks at a time. Registers estimate a
    pair's similarity by joint likelihood; pairs five standard deviations below the threshold go no further. A pair
    is given in the first of its shared buckets only.
    """
    t = percent / 100
    least = t - 5 * (t * (1 - t) / m) ** 0.5
    blocks = F.ceil(F.col("size") / block)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", "text_key"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *KEY, "c", "n_shingles", "registers")

    def compare(group: list[pa.RecordBatch]):
        x = pa.Table.from_batches(group).combine_chunks()
        own, doc, key, c, n = (x.column(i).to_numpy() for i in ("own", *KEY, "c", "n_shingles"))
        one = x.column("low")[0] == x.column("high")[0]
        regs = np.frombuffer(b"".join(v.as_py() for v in x.column("registers")), np.uint16).reshape(len(doc), m)
        for i in range(len(doc)):
            other = (c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            other &= (np.arange(len(doc)) > i) if one else (own > own[i])
            j = np.flatnonzero(other)
            j = j[(regs[j] == regs[i]).sum(1) >= (least - 0.05) * m]
            if len(j):
                j = j[setsketch.likely_similarity(regs[j], np.repeat(regs[i][None], len(j), 0), n[j], np.repeat(n[i], len(j))) >= least]
            if len(j):
                shared = (regs[j, :banded] == regs[i, :banded]).reshape(len(j), banded // r, r).all(2)
                j = j[shared.argmax(1) == band_of(regs[i], x.column("key")[0].as_py(), banded, r)]
                yield np.repeat(doc[i], len(j)), np.repeat(key[i], len(j)), doc[j], key[j]

    def make(batches):
        open_, value = [], None
        for x in batches:
            mark = np.stack([x.column(k).to_numpy().astype(np.int64) for k in ("key", "low", "high")], 1)
            cut = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]).any(1))) if len(mark) else []
            for a, b in zip(cut, np.append(cut[1:], len(mark)), strict=True):
                if open_ and tuple(mark[a]) != value:
                    for found in compare(open_):
                        yield batch(PAIRS, list(found))
                    open_ = []
                value = tuple(mark[a])
                open_.append(x.slice(a, b - a))
        if open_:
            for found in compare(open_):
                yield batch(PAIRS, list(found))

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(make, PAIRS)


@owned
def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = 512, banded: int = 128, r: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Returns a row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept
    (doc_id = component_id).

    Whole texts are used. A text with fewer words than a shingle is one shingle; a null, empty or blank text has an
    empty set, is its own component and kept. A row whose id is null is linked with nothing, has a null component and
    is kept. Rows with one id are one document with several texts. Other columns are ignored. No rows in, none out.
    """
    docs = keyed(docs, id_col, text_col)
    rows = written(sketches(docs, shingle, m), "op10-sketches")
    same = ["n_shingles", "f1", "f2"]
    linked = rows.filter("doc_id is not null and n_shingles > 0")
    classes = written(linked.groupBy(*same).agg(F.min(F.struct(*KEY, "registers")).alias("at")).select(*same, "at.*"), "op10-classes")
    slim = written(rows.drop("registers"), "op10-rows")
    drop(rows)
    rows, linked = slim, slim.filter("doc_id is not null and n_shingles > 0")
    bands = written(band_table(classes, banded, r), "op10-bands")
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("lead")).filter("n > 1").drop("n")
    shared = written(bands.join(buckets, "key"), "op10-buckets")
    drop(bands)
    first = shared.filter("struct(doc_id, text_key) <> lead").groupBy(*KEY).agg(F.min("lead").alias("lead"))
    first = written(first.select(F.col("doc_id").alias("a"), F.col("text_key").alias("ak"), F.col("lead.doc_id").alias("b"), F.col("lead.text_key").alias("bk")), "op10-first")
    texts = docs.filter("doc_id is not null")
    links = verified(first, texts, shingle, percent)
    parts = written(components(links), "op10-parts")
    known = shared.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", *KEY, F.coalesce("component", "doc_id").alias("c"))
    known = written(known, "op10-known")
    drop(shared)
    mixed = known.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).filter("x < y").select("key", "size")
    mixed = known.join(mixed, "key").join(classes.select(*KEY, "n_shingles", "registers"), list(KEY))
    pairs = written(plausible(mixed, m, banded, r, percent), "op10-second")
    links2 = verified(pairs, texts, shingle, percent)
    # rows of one id in several classes hold those together
    of_class = classes.select(*same, F.col("doc_id").alias("rep"))
    member = written(linked.select("doc_id", *same).join(of_class, same).select("doc_id", "rep", "n_shingles"), "op10-members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("doc_id")
    several = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = links2.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(several)
    final = written(components(joined), "op10-components")
    out = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    drop(classes, first, links, parts, known, pairs, links2)
    return out.unionByName(rest).withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


@owned
def without_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose document is the least of its component; rows without an id stay."""
    found = near_components(docs, shingle, percent, id_col=id_col, text_col=text_col)
    (name,) = fresh(docs, "gone")
    gone = written(found.filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "op10-gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
