"""Removal of long byte strings that occur more than once: distributed prefix doubling.

Method. Positions have ranks by the text's next n bytes. Spark sorts the pairs of a position's rank and of what stands at
offset n, positions whose pair is unique leave, equal pairs get one rank in the order of pairs, and the next round goes
on at twice the length, until positions are unique or the length reaches the threshold.

Two things differ from the textbook, and neither changes the result. What stands at the offset is known by a 64-bit
name, the fingerprint of its bytes, and not by the rank of another position, so only positions that are still in play
have rows. And positions go through the rounds together while they share the text in question:

1. frames (``frames``) are runs of window starts that all hold an anchor of k bytes; a frame whose anchor is unique
   leaves; an equal hood (all that its windows cover) elsewhere settles a frame, all its windows repeat;
2. frames still open are dealt into blocks of 32 starts. The text that all windows of a block share (its core, threshold
   - 31 bytes) is ranked by doubling: pairs of its first two eighths, of that rank and the second quarter, of that rank
   and the second half. A block whose pair is unique leaves;
3. blocks with equal cores and hoods are settled; those left open become single positions, ranked by their core's rank
   and what they have on either side of it: the threshold is reached.

Ranking every byte position by itself would shuffle more than 12 bytes for each byte of text in each round.

Scale. Round 1 shuffles one short row for each 150 or so bytes, with partial counts, so that a passage that a
third of all documents holds is a few rows in each map task; joins back are shuffled joins that adaptive
execution can split. Later rounds only see text near differing copies. Nothing is collected or broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import text_blocks
from .frame_tables import KEY, attach, batch, block_table, frame_table, keyed, single_table, with_spans
from .frames import merged
from .shared import drop, owned, written

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def repeated_spans(docs: DataFrame, threshold: int = 400, k: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, end): spans whose union is each byte that lies in a repeated string of ``threshold`` bytes.

    docs: the output of ``keyed``. Spans overlap. Equal rows (same id, same text) count as two occurrences.
    """
    k = k or max(1, threshold // 6)
    span = lambda hi, lo: (F.expr(f"q - {hi}").alias("start"), F.expr(f"q - {lo} + {threshold}L").alias("end"))
    all_frames = written(frame_table(docs, threshold, k, "byte"), "op7-frames")
    # a table of its own: an aggregate in the join's stage would keep adaptive execution from splitting a hot anchor
    twice = written(all_frames.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "op7-twice")
    frames = written(all_frames.join(twice, "h", "left_semi"), "op7-open")
    drop(all_frames, twice)
    hood = ["r1", "r2", "lo", "hi", "h"]
    classes = written(frames.groupBy(*hood).agg(F.count("*").alias("weight"), F.min(F.struct(*KEY, "q")).alias("at")), "op7-classes")
    settled = frames.join(classes.filter("weight > 1").select(*hood), hood, "left_semi").select(*KEY, *span("hi", "lo"))
    several = classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = classes.join(several, "h", "left_semi").select("at.*", "lo", "hi", "weight")
    texts = written(attach(docs, ranked, "q", "lo", "hi", "weight"), "op7-texts")
    blocks = written(block_table(texts, threshold, "byte"), "op7-blocks")
    open_ = blocks.withColumnRenamed("s0", "rank")
    for part in ("s1", "s2", "s3"):
        open_ = reranked(open_, part)
    outer = ["rank", "j", "d1", "d2", "vlo", "vhi"]
    inner = written(open_.groupBy(*outer).agg(F.sum("weight").alias("n"), F.min(F.struct(*KEY, "q")).alias("at")), "op7-inner")
    block_spans = open_.filter("weight = 1").join(inner.filter("n > 1").select(*outer), outer, "left_semi").select(*KEY, *span("vhi", "vlo"))
    mixed = inner.groupBy("rank", "j").agg(F.count("*").alias("m")).filter("m > 1")
    left = inner.join(mixed, ["rank", "j"], "left_semi").select("at.*", F.col("vlo").alias("lo"), F.col("vhi").alias("hi"), F.col("n").alias("weight"), "rank")
    texts2 = texts.drop("items")
    singles = written(single_table(attach(texts2, left, "q", "lo", "hi", "weight", "rank"), threshold, "byte"), "op7-singles")
    whole = ["rank", "w1", "w2", "o"]
    same = singles.groupBy(*whole).agg(F.count("*").alias("m")).filter("m > 1")
    single_spans = singles.filter("weight = 1").join(same, whole, "left_semi").select(*KEY, *span("o", "o"))
    spans = written(settled.unionByName(block_spans).unionByName(single_spans), "op7-spans")
    drop(frames, classes, texts, blocks, open_, inner, singles)
    return spans


def reranked(rows: DataFrame, part: str) -> DataFrame:
    """One round of doubling: rows whose pair (rank, part) occurs more than once, with the pair's place among such pairs as rank.

    Blocks of other numbers (j) stand elsewhere in their windows and are other positions. Different pairs are sorted by
    ranges, so ids that grow from range to range are in the order of pairs, and no task holds more than a range. The rows
    of the round before are deleted.
    """
    pairs = rows.groupBy("j", "rank", part).agg(F.count("*").alias("n")).filter("n > 1")
    ordered = pairs.repartitionByRange("j", "rank", part).sortWithinPartitions("j", "rank", part).select("j", "rank", part, F.monotonically_increasing_id().alias("next"))
    ranks = written(ordered, "op7-ranks")
    out = written(rows.join(ranks, ["j", "rank", part]).drop("rank", part).withColumnRenamed("next", "rank"), "op7-round")
    drop(ranks)
    if "_braidlake_path" in vars(rows):
        drop(rows)
    return out


@owned
def remove_repeats(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """Remove from each text the bytes that lie in a string of ``threshold`` bytes that also starts anywhere else.

    Returns a row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    kept (the remaining bytes; binary, since a cut may fall within a character).

    Texts are taken as UTF-8, whole. Strings are judged on the input. Null and empty texts have no bytes and lose
    nothing. A row whose id is null keeps all its bytes and makes no other row lose any. Equal rows are copies of
    each other; rows with one id and other texts are judged apart. Other columns are ignored. No rows in, none out.
    """
    docs = keyed(docs, id_col, text_col)
    return with_spans(docs, repeated_spans(docs, threshold, k)).select("doc_id", "text", "items").mapInArrow(_cut, KEPT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ids, lists = x.column(0), x.column(2)
        cut = lists.offsets.to_numpy()
        start, end = (lists.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1))
        for first, last, flat, offsets in text_blocks(x.column(1)):
            rows = []
            for i in range(first, last):
                text = flat[offsets[i - first] : offsets[i - first + 1]]
                s, e = merged(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]])
                if len(s):
                    bound = np.stack([np.append(0, e), np.append(s, len(text))], 1)
                    kept = b"".join(text[a:b].tobytes() for a, b in bound)
                else:
                    kept = text.tobytes()
                rows.append((len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
            yield batch(KEPT, [ids.slice(first, last - first), *(list(c) for c in zip(*rows, strict=True))])
