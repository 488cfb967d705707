"""Removal of word passages seen in an earlier document: prefix-partitioned suffix trees.

Method. Suffixes (starting at each word) are dealt out by prefixes of variable length into groups that fit memory; each
group's suffixes make a suffix tree, whose deep internal nodes (depth of the passage length or more) are the repeats;
a suffix goes if a deep node above it holds a smaller document.

The first prefix by which suffixes are dealt runs to the end of their rarest-ranked k-word gram (``frames``), so that
suffixes with equal passages share it, and suffixes of one text with the same gram travel as one row. A gram that only
one document has needs no tree. Frames with equal hoods are one class with its least document. Where a gram has more
than ``group_limit`` classes, prefixes grow: its suffixes are dealt out one by one, by their first quarter of the passage
length, then half, then all of it. At each length suffixes whose prefix only one document has leave, and groups that
fit get their tree. Suffixes that agree in the whole passage length are one deep node, however many they are: its
subtrees, one in each map task, give their least documents, and the least of these is the node's (a partial aggregate).
So no task holds more than group_limit rows of one group, and no row is left out.

Scale. One short row per 20 or so words is shuffled, then only text near passages that differ nearby.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import text_blocks
from .frame_tables import KEY, attach, batch, content_table, frame_table, keyed, suffix_table, with_spans
from .frames import merged
from .shared import drop, owned, written

KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
FOUND = "doc_id long, text_key long, q long, lo int, hi int"


class SuffixTree:
    """The tree of suffixes given as rows of token codes, each ``size`` long (codes behind that don't count, equal ends differ).

    ``order``: the leaves in tree order. ``common``: of each leaf with the one before it, the length of the common prefix.
    ``nodes``: (depth, first leaf, last leaf) of every internal node of at least ``depth`` tokens, children before parents:
    a node is a maximal interval of leaves that agree in its depth.
    """

    def __init__(self, rows: np.ndarray, size: np.ndarray, depth: int):
        width = rows.shape[1]
        ends = np.arange(width) >= size[:, None]
        rows = np.where(ends, np.uint64(0), rows)
        self.order = np.argsort(np.ascontiguousarray(rows.astype(">u8")).view(f"V{8 * width}").ravel(), kind="stable")
        ordered = rows[self.order]
        differ = ordered[1:] != ordered[:-1]
        whole = np.minimum(size[self.order][1:], size[self.order][:-1])
        self.common = np.append(0, np.minimum(np.where(differ.any(1), differ.argmax(1), width), whole))
        self.nodes: list[tuple[int, int, int]] = []
        open_: list[tuple[int, int]] = []
        for i in np.append(np.flatnonzero(self.common >= depth), -1) if len(rows) else ():
            if open_ and (i < 0 or i != last + 1):  # leaves between that agree with nothing close what is open
                self._close(open_, 0, last)
            if i < 0:
                break
            first, c = i - 1, int(self.common[i])
            if open_ and open_[-1][0] > c:
                first = self._close(open_, c, i - 1)
            if not open_ or open_[-1][0] < c:
                open_.append((c, int(first)))
            last = i

    def _close(self, open_: list[tuple[int, int]], depth: int, last: int) -> int:
        first = last
        while open_ and open_[-1][0] > depth:
            d, first = open_.pop()
            self.nodes.append((d, first, int(last)))
        return first

    def maximal_repeats(self, before: np.ndarray) -> list[tuple[int, int, int]]:
        """The nodes whose leaves don't all have the same token before them (``before``: by row; 0 at the start of a text)."""
        b = before[self.order]
        return [(d, x, y) for d, x, y in self.nodes if (b[x : y + 1] != b[x]).any() or b[x] == 0]

    def least_above(self, doc: np.ndarray) -> np.ndarray:
        """Of each row the least document in the deep nodes above it; its own without one. The topmost node decides."""
        own = doc[self.order]
        out = own.copy()
        for _, x, y in self.nodes:  # parents come last
            out[x : y + 1] = own[x : y + 1].min()
        back = np.empty(len(doc), doc.dtype)
        back[self.order] = out
        return back


def group_passages(doc, q, lo, hi, codes, window: int):
    """Rows (index, first and last offset) whose passage also starts in a smaller document of the group."""
    width = hi - lo + 1
    row = np.repeat(np.arange(len(doc)), width)
    step = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    length = np.array([len(c) for c in codes])
    base = np.cumsum(length) - length
    flat = np.append(np.concatenate(codes), np.zeros(int(length.max()), np.uint64))
    size = length[row] - step  # to the end of what the row brings along: the passage, or more
    rows = flat[(base[row] + step)[:, None] + np.arange(int(size.max()))]
    gone = SuffixTree(rows, size, window).least_above(doc[row]) < doc[row]
    at = np.flatnonzero(gone)
    offset = hi[row[at]] - step[at]
    # neighbouring offsets of a row become one range
    new = np.append(True, (row[at][1:] != row[at][:-1]) | (offset[1:] != offset[:-1] - 1)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[at][first], offset[last], offset[first]


def _trees(window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for x in _groups(batches):
            doc, key, q, lo, hi = (np.concatenate([c[i] for c in x]) for i in range(5))
            codes = [c for part in x for c in part[5]]
            row, low, high = group_passages(doc, q, lo, hi, codes, window)
            if len(row):
                held.append((doc[row], key[row], q[row], low, high))
            if sum(len(h[0]) for h in held) > 1 << 16:
                yield batch(FOUND, [np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
        if held:
            yield batch(FOUND, [np.concatenate(c) for c in zip(*held, strict=True)])

    return make


def _groups(batches):
    """Runs of rows with one h; the partition is sorted by h."""
    open_, value = [], None
    for x in batches:
        h = x.column("h").to_numpy()
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else []
        columns = [x.column(n).to_numpy().astype(np.int64) for n in (*KEY, "q", "lo", "hi")]
        blobs = x.column("codes")
        for a, b in zip(cut, np.append(cut[1:], len(h)), strict=True):
            if open_ and h[a] != value:
                yield open_
                open_ = []
            value = h[a]
            open_.append([*(c[a:b] for c in columns), [np.frombuffer(v.as_buffer(), np.uint64) for v in blobs.slice(a, b - a)]])
    if open_:
        yield open_


def earlier_passages(docs: DataFrame, window: int = 50, k: int | None = None, group_limit: int = 2048) -> DataFrame:
    """(doc_id, text_key, start, end) in words: passages of ``window`` words that also start in a document with a smaller id."""
    k = k or max(1, window // 6)
    all_frames = written(frame_table(docs, window, k, "word"), "op3-frames")
    # a table of its own: an aggregate in the join's stage would keep adaptive execution from splitting a hot gram
    shared = written(all_frames.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h"), "op3-shared")
    frames = written(all_frames.join(shared, "h", "left_semi"), "op3-open")
    drop(all_frames, shared)
    hood = ["r1", "r2", "lo", "hi", "h"]
    classes = written(frames.groupBy(*hood).agg(F.min(F.struct(*KEY, "q")).alias("at")), "op3-classes")
    members = frames.join(classes, hood)
    settled = members.filter("doc_id > at.doc_id").select(*KEY, F.expr("q - hi").alias("start"), F.expr(f"q - lo + {window}L").alias("end"))
    several = classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = classes.join(several, "h").select("at.*", "lo", "hi", "h", "n")
    texts = written(attach(docs, ranked, "q", "lo", "hi", "h", "n"), "op3-texts")
    small = texts.withColumn("items", F.filter("items", lambda x: x.n <= group_limit))
    large = texts.withColumn("items", F.filter("items", lambda x: x.n > group_limit))
    content = content_table(small, window, "word")
    large = large.filter(F.size("items") > 0)
    suffixes = written(suffix_table(large, window, "word"), "op3-suffixes")
    left, levels = suffixes, [suffixes]
    for p in ("p0", "p1"):  # longer and longer prefixes
        groups = left.groupBy(p).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select(p, "n")
        left = written(left.join(groups, p), "op3-level")
        levels.append(left)
        fit = left.filter(F.col("n") <= group_limit).select(*KEY, "q", F.col("o").alias("lo"), F.col("o").alias("hi"), F.col(p).alias("h"))
        content = content.unionByName(content_table(attach(large.drop("items"), fit, "q", "lo", "hi", "h"), window, "word"))
        left = left.filter(F.col("n") > group_limit).drop("n")
    found = content.repartition("h").sortWithinPartitions("h").mapInArrow(_trees(window), FOUND)
    nodes = left.groupBy("p2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    found2 = left.join(nodes, "p2").filter("doc_id > a").select(*KEY, "q", F.col("o").alias("lo"), F.col("o").alias("hi"))
    found = written(found.unionByName(found2), "op3-found")
    drop(*levels)
    # what holds for a class's first frame holds for its others in the same document
    of_class = members.filter("doc_id = at.doc_id").select(*KEY, "q", "lo", "hi", F.col("at.text_key").alias("tk"), F.col("at.q").alias("aq"))
    rest = found.select("doc_id", F.col("text_key").alias("tk"), F.col("q").alias("aq"), F.col("lo").alias("o1"), F.col("hi").alias("o2")).join(of_class, ["doc_id", "tk", "aq"]).filter("lo <= o1 and o2 <= hi")
    rest = rest.select(*KEY, F.expr("q - o2").alias("start"), F.expr(f"q - o1 + {window}L").alias("end"))
    spans = written(settled.unionByName(rest), "op3-spans")
    drop(frames, classes, texts, found)
    return spans


@owned
def remove_earlier_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, group_limit: int = 2048) -> DataFrame:
    """Remove each word covered by ``window`` consecutive words that also start in a document with a smaller id.

    Returns a row for each row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by a space).

    Words are the runs free of U+0020 and U+0009..U+000D, unchanged, of whole texts. Passages are judged on the
    input and never cross a row. Null and empty texts have no words. A row whose id is null keeps all words and makes
    no other lose any; rows with equal ids do not make each other lose any. Other columns are ignored. No rows in,
    none out.
    """
    docs = keyed(docs, id_col, text_col)
    return with_spans(docs, earlier_passages(docs, window, k, group_limit)).select("doc_id", "text", "items").mapInArrow(_cut, KEPT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        ids, lists = x.column(0), x.column(2)
        cut = lists.offsets.to_numpy()
        start, end = (lists.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1))
        for first, last, flat, offsets in text_blocks(x.column(1)):
            rows = []
            for i in range(first, last):
                text = flat[offsets[i - first] : offsets[i - first + 1]].tobytes().split()
                n = len(text)
                s, e = merged(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]])
                if len(s):
                    text = [w for a, b in zip(np.append(0, e), np.append(s, n), strict=True) for w in text[a:b]]
                kept = b" ".join(text)
                rows.append((n, n - len(text), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield batch(KEPT, [ids.slice(first, last - first), *(list(c) for c in zip(*rows, strict=True))])
