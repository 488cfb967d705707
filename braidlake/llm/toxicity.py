"""Toxicity by a classifier chain: linear models in sequence, each fed the earlier categories' probabilities.

Features are words and word beginnings (lower-cased): a text has a feature if it holds it at all. They are the ``vocabulary``
whose presence tells most about the last category in the sample, found by an aggregate; 64-bit word hashes stand
for them, so words outside the vocabulary never share a weight with one inside.

Model j sees the words and the probabilities of categories 1 .. j - 1. In training these are out-of-fold predictions,
made by models that haven't seen the row, so that a later model learns how far an earlier one can be trusted. The
final models are fitted on all rows of the sample (``bound`` rows by ``vocabulary`` words, on the driver).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, text_blocks, word_codes
from .frame_tables import batch
from .sample import labelled_sample
from .shared import drop, owned, written

FOLDS = 5
#: Bytes of a word's beginning that are a feature too, for families of compounds and inflections.
HEAD = 6
_HEAD_SALT = np.uint64(0x5851F42D4C957F2D)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), *range(48, 58)]] = True


def letter_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row offsets in codes): two for each run of letters and digits, the lower-cased word and its first HEAD bytes."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    low = LOWER[flat]
    whole, head = word_codes(low, starts, ends), word_codes(low, starts, np.minimum(ends, starts + HEAD)) ^ _HEAD_SALT
    return np.stack([whole, head], 1).ravel(), 2 * np.searchsorted(starts, offsets)


def presence(codes: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """(rows, words of the vocabulary) 0 or 1. vocabulary: sorted."""
    n, size = len(off) - 1, len(vocabulary)
    out = np.zeros(n * size, np.float32)
    if size and len(codes):
        at = np.minimum(np.searchsorted(vocabulary, codes), size - 1)
        hit = np.flatnonzero(vocabulary[at] == codes)
        row = np.searchsorted(off, hit, "right") - 1
        out[row * size + at[hit]] = 1
    return out.reshape(n, size)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 150, rate: float = 0.2) -> np.ndarray:
    """Weights, and an intercept at the end, of a ridge-penalised logistic regression, by Adam."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = np.clip(y.mean(), 0.001, 0.999)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -60, 60)))
        g = ((p - y) / len(y)).astype(np.float32) @ x + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -60, 60)))


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: np.ndarray
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, categories), one after the other."""
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.concatenate([out, predict(np.concatenate([x, out], 1), w).astype(np.float32)[:, None]], 1)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, columns: list[np.ndarray], categories: tuple[str, ...], vocabulary: np.ndarray) -> Chain:
    """y: (rows, categories) of 0 and 1, in the chain's order; fold: each row's, from 0; x: (rows, all words).

    columns: the words that a model may see: of fold k's unseen rows at k, those chosen without them; of the final
    models at the end (``vocabulary`` names those). Out-of-fold predictions come from models that have seen neither the
    rows nor words chosen by them, and earlier categories enter them as out-of-fold predictions too.
    """
    weights, earlier = [], np.zeros((len(x), 0), np.float32)
    for j in range(len(categories)):
        weights.append(fit_logistic(np.concatenate([x[:, columns[-1]], earlier], 1), y[:, j]))
        if j < len(categories) - 1:
            unseen = np.zeros((len(x), 1), np.float32)
            for k in range(len(columns) - 1):
                train, test = fold != k, fold == k
                own = np.concatenate([x[:, columns[k]], earlier], 1)
                if test.any():
                    unseen[test, 0] = predict(own[test], fit_logistic(own[train], y[train, j])) if train.any() else y[:, j].mean()
            earlier = np.concatenate([earlier, unseen], 1)
    return Chain(categories, vocabulary, weights)


@owned
def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], bound: int = 4096, vocabulary: int = 384, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """categories: name -> SQL over labels that is 0 or 1, in the chain's order. None if no row is labelled.

    Folds go by text, so that copies are on one side. The vocabulary tells most about the last category; it is chosen
    once from all rows of the sample, for the final models, and once without each fold.
    """
    names = tuple(categories)
    stored = labelled_sample(docs, labels, categories, bound, "op8", id_col, text_col)
    sample = stored.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))

    def words(batches):
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(2)):
                codes, off = letter_words(flat, offsets)
                row = np.repeat(np.arange(last - first), np.diff(off))
                both = np.unique(np.stack([row.astype(np.uint64), codes], 1), axis=0) if len(codes) else np.zeros((0, 2), np.uint64)
                fold, y = (x.column(i).slice(first, last - first).to_numpy()[both[:, 0].astype(np.int64)] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1].view(np.int64) if len(both) else np.zeros(0, np.int64)), pa.array(fold, pa.int32()), pa.array(y, pa.int32())], names=["word", "fold", "y"])

    of_fold = [F.col("fold") == k for k in range(FOLDS)]
    sums = [F.sum(F.when(c, F.col("y")).otherwise(0)).alias(f"a{k}") for k, c in enumerate(of_fold)] + [F.count_if(c).alias(f"n{k}") for k, c in enumerate(of_fold)]
    counts = written(sample.select("fold", names[-1], "text").mapInArrow(words, "word long, fold int, y int").groupBy("word").agg(*sums), "op8-words")
    sizes = {r.fold: r for r in sample.groupBy("fold").agg(F.sum(names[-1]).alias("a"), F.count("*").alias("n")).collect()}
    if not sizes:
        drop(stored, counts)
        return None
    chosen = []
    for left_out in (*range(FOLDS), None):
        ks = [k for k in range(FOLDS) if k != left_out]
        total = sum(sizes[k].n for k in ks if k in sizes)
        share = sum(sizes[k].a for k in ks if k in sizes) / max(total, 1)
        n, a = sum(F.col(f"n{k}") for k in ks), sum(F.col(f"a{k}") for k in ks)
        # how far a word's share of the category is from the sample's, in standard deviations; words of one text tell nothing
        tells = F.abs(a - n * F.lit(share)) / F.sqrt(n * F.lit(max(share * (1 - share), 1e-6)) + 1)
        top = counts.filter(n > 1).orderBy(tells.desc(), "word").select("word").limit(vocabulary).collect()
        chosen.append(np.sort(np.array([r.word for r in top], np.int64).view(np.uint64)))
    every = np.unique(np.concatenate(chosen))

    def vectors(batches):
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(2)):
                hit = presence(*letter_words(flat, offsets), every) > 0
                yield pa.RecordBatch.from_arrays([x.column(i).slice(first, last - first) for i in (0, 1)] + [pa.array([np.packbits(r).tobytes() for r in hit], pa.binary()), *(x.column(3 + j).slice(first, last - first) for j in range(len(names)))], names=["doc_id", "fold", "x", *names])

    schema = "doc_id long, fold int, x binary, " + ", ".join(f"{n} int" for n in names)
    rows = sorted(tuple(r) for r in sample.select("doc_id", "fold", "text", *names).mapInArrow(vectors, schema).collect())
    drop(stored, counts)
    x = np.unpackbits(np.array([np.frombuffer(r[2], np.uint8) for r in rows]).reshape(len(rows), -1), axis=1)[:, : len(every)].astype(np.float32)
    columns = [np.searchsorted(every, c) for c in chosen]
    return fit_chain(x, np.array([r[3:] for r in rows], np.float64), np.array([r[1] for r in rows]), columns, names, chosen[-1])


def toxicity(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> ..., <category> ...) for each row of docs: probabilities, and whether each is at least ``least``.

    The last category's model is fed the probabilities of all others. Whole texts are read, however long. Null and empty texts have no words, so their probabilities are the chain's intercepts'.
    Without a chain (no labelled row) probabilities are null and no row is in a category. Ids may be null or repeat; equal texts
    get equal values; other columns are ignored. No rows in, none out. The vocabulary and the weights go with the
    task; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if chain is None:
        return rows.select("doc_id", *(F.lit(None).cast("double").alias(f"p_{c}") for c in categories), *(F.lit(False).alias(c) for c in categories))
    schema = "doc_id long, " + ", ".join([*(f"p_{c} double" for c in categories), *(f"{c} boolean" for c in categories)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(1)):
                p = chain.probabilities(presence(*letter_words(flat, offsets), chain.vocabulary)).astype(np.float64)
                yield batch(schema, [x.column(0).slice(first, last - first), *p.T.round(6), *(p.T >= least)])

    return rows.mapInArrow(make, schema)
