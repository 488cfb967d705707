"""Quality by ordinal regression: shared weights over hashed text, ordered thresholds between grades.

Cumulative link: P(grade <= k) = sigmoid(threshold_k - score), with one score for all thresholds, a mean over the
words (and PRIOR_WORDS neutral ones) of hashed weights. A word adds three features: itself (lower-cased), its shape (upper case, digits, signs, size)
and whether it repeats one of the two words before. So shouting, symbols, tables and loops are seen in any language.

The model is fitted on a bounded sample of rated rows (``bound``) on the driver, where a row is a vector of DIM floats.
Scoring is one pass over all whole texts with the weights (DIM floats) in the task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import SEPARATOR, text_blocks, word_codes, words
from .frame_tables import batch
from .sample import labelled_sample
from .shared import drop

DIM = 2048
#: A text's means are taken as if it had this many more words without features, so that a short text's few words weigh little.
PRIOR_WORDS = 16
FIELDS = "doc_id long, score double, expected_grade double, p_tail double, kept boolean"
_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?"]] = True


def features(flat: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """((words, 3) feature indexes, row offsets in words)."""
    starts, ends, off = words(flat, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), off
    codes = word_codes(flat, starts, ends, lower=True)
    size = ends - starts
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[np.stack([starts, ends], 1)], axis=1)[:, 0]
    upper, digit, sign = total(_UPPER[flat]), total(_DIGIT[flat]), total(_SIGN[flat])
    shape = np.minimum(upper, 3) + 4 * np.minimum(digit, 3) + 16 * np.minimum(sign, 3) + 64 * (2 * upper > size) + 128 * np.minimum(size // 8, 3) + 512 * (sign == size)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    again = np.zeros(len(codes), np.int64)
    for k in (2, 1):
        if len(codes) > k:
            again[k:][(codes[k:] == codes[:-k]) & (row[k:] == row[:-k])] = k
    half = dim // 2
    return np.stack([(codes % np.uint64(half)).astype(np.int64), half + shape * 2654435761 % (half - 3), dim - 1 - again], 1), off


def dense(flat: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(rows, dim) shares of the words with each feature."""
    at, off = features(flat, offsets, dim)
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    out = np.bincount((row[:, None] * dim + at).ravel(), minlength=len(n) * dim).reshape(len(n), dim)
    return (out / (n + PRIOR_WORDS)[:, None]).astype(np.float32)


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades)."""
        below = _sigmoid(self.thresholds[None] - score[:, None])
        edge = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1)
        return np.diff(edge, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 1e-4, rounds: int = 300, rate: float = 0.1) -> CumulativeLink:
    """Maximum likelihood with a ridge penalty, by Adam. Thresholds are a first one and positive steps, so they stay ordered."""
    n, dim = x.shape
    w = np.zeros(dim)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(n, 1), 0.01, 0.99)
    cut = np.log(share / (1 - share))
    par = np.append(cut[0], np.log(np.maximum(np.diff(cut), 0.05)))
    scale = 1 / (x.std(0) + 1e-2)
    scale[: dim // 2] *= 0.2  # single words get less freedom than shapes
    m = [np.zeros(dim), np.zeros(len(par))]
    v = [np.zeros(dim), np.zeros(len(par))]
    for t in range(1, rounds + 1):
        theta = np.append(par[0], par[0] + np.cumsum(np.exp(par[1:])))
        s = x @ (w * scale).astype(np.float32)
        upper = np.where(grade < grades - 1, _sigmoid(np.append(theta, 0)[np.minimum(grade, grades - 1)] - s), 1.0)
        lower = np.where(grade > 0, _sigmoid(theta[np.maximum(grade, 1) - 1] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = (du - dl) / n
        gw = scale * (gs.astype(np.float32) @ x) + penalty * w
        gt = np.array([(dl[grade == k + 1].sum() - du[grade == k].sum()) / n for k in range(grades - 1)])
        back = np.cumsum(gt[::-1])[::-1]
        gp = np.append(back[0], back[1:] * np.exp(par[1:]))
        for j, (value, g) in enumerate(((w, gw), (par, gp))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            value -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return CumulativeLink((w * scale).astype(np.float64), np.append(par[0], par[0] + np.cumsum(np.exp(par[1:]))))


def fit_quality(docs: DataFrame, labels: DataFrame, grade: str, grades: int, bound: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink | None:
    """A model of grades 0 .. grades - 1 (``grade``: SQL over labels), or None if no row with words is rated."""
    sample = labelled_sample(docs, labels, {"grade": grade}, bound, "op9", id_col, text_col)

    def make(batches):
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(2)):
                rows = dense(flat, offsets)
                keep = rows.any(1)
                ids, own = (x.column(i).slice(first, last - first).to_numpy()[keep] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array([r.tobytes() for r in rows[keep]], pa.binary())], names=["doc_id", "grade", "x"])

    rows = sorted(sample.select("doc_id", "grade", "text").mapInArrow(make, "doc_id long, grade int, x binary").collect())
    drop(sample)
    rows = [r for r in rows if 0 <= r.grade < grades]
    if not rows:
        return None
    return fit(np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), -1), np.array([r.grade for r in rows]), grades)


def scored(docs: DataFrame, model: CumulativeLink | None, tail: int = 1, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, expected_grade, p_tail, kept) for each row of docs; kept: P(grade >= tail) >= least.

    Null, empty and blank texts have no words and score 0, so the thresholds alone decide. Without a model (no rated row)
    score, grade and probability are null and every row is kept. Ids may be null or repeat; equal texts get equal
    values; other columns are ignored. No rows in, none out.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(1)):
                yield batch(FIELDS, [x.column(0).slice(first, last - first), *verdicts(model, flat, offsets, tail, least)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("score"), none.alias("expected_grade"), none.alias("p_tail"), F.lit(True).alias("kept"))
    return rows.mapInArrow(make, FIELDS)


def verdicts(model: CumulativeLink, flat: np.ndarray, offsets: np.ndarray, tail: int, least: float) -> list[np.ndarray]:
    """Columns score, expected grade, tail probability and verdict of a block of texts."""
    at, off = features(flat, offsets)
    own = np.append(model.weights[at].sum(1), 0.0)
    n = np.diff(off)
    score = np.where(n > 0, np.add.reduceat(own, np.minimum(off[:-1], len(own) - 1)) / (n + PRIOR_WORDS), 0.0)
    p = model.probabilities(score)
    over = p[:, tail:].sum(1)
    return [score.round(9), (p * np.arange(p.shape[1])).sum(1).round(9), over.round(9), over >= least]


def selected(docs: DataFrame, model: CumulativeLink | None, tail: int = 1, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that ``scored`` keeps."""
    if model is None:
        return docs
    at = docs.columns.index(text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(at)):
                yield x.slice(first, last - first).filter(pa.array(verdicts(model, flat, offsets, tail, least)[3]))

    return docs.mapInArrow(make, docs.schema)
