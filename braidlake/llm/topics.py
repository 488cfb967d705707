"""A topic model from word co-occurrence: vocabulary words are clustered by the words they share documents with.

1. One pass counts, over all documents, how many hold a word of each of 2^16 hash classes. The ``vocabulary`` is the
   classes found in most documents, of those in at most ``common`` of them (so without stop words).
2. A second pass counts documents by pairs of vocabulary words: a table of fixed size, whatever the corpus.
3. On the driver the table's positive pointwise mutual information is cut to its leading eigenvectors, and words are
   clustered by direction (seeds farthest from each other, so there is no chance in it).

A document is about the topic whose words in it weigh most, a word weighing the log of its rarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import text_blocks, word_codes, words
from .shared import drop, written

CLASSES = 16
NO_TOPIC = -1


@dataclass
class Topics:
    #: Hash classes in order, the topic and the weight of each.
    classes: np.ndarray
    topic: np.ndarray
    weight: np.ndarray
    n: int

    def of(self, row: np.ndarray, found: np.ndarray, rows: int) -> np.ndarray:
        """The topic of each row; (row, found): different classes of rows. NO_TOPIC without a vocabulary word; the first of equals."""
        if not len(self.classes):
            return np.full(rows, NO_TOPIC)
        at = np.minimum(np.searchsorted(self.classes, found), len(self.classes) - 1)
        hit = self.classes[at] == found
        score = np.bincount(row[hit] * self.n + self.topic[at[hit]], self.weight[at[hit]], minlength=rows * self.n).reshape(rows, self.n)
        return np.where(score.any(1), score.argmax(1), NO_TOPIC)


def word_classes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each row, rows, classes): each class that a row holds, once."""
    starts, ends, off = words(flat, offsets)
    n = np.diff(off)
    if not len(starts):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    both = np.unique((row << CLASSES) | (word_codes(flat, starts, ends, lower=True) >> np.uint64(64 - CLASSES)).astype(np.int64))
    return n, both >> CLASSES, both & ((1 << CLASSES) - 1)


def _counts(texts: DataFrame, count) -> DataFrame:
    """Sums by key over all texts of what count(row, class, rows) adds up in an array for a whole task."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(0)):
                _, row, found = word_classes(flat, offsets)
                own = count(row, found, last - first)
                total = own if total is None else total + own
        if total is not None:
            key = np.flatnonzero(total)
            for at in range(0, len(key), 1 << 16):
                some = key[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

    return texts.mapInArrow(make, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit_topics(docs: DataFrame, n: int = 8, vocabulary: int = 256, common: float = 0.1, text_col: str = "text") -> Topics:
    """A model of ``n`` topics. Null texts don't count; no documents, or no word in two of them, give a model without vocabulary."""
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    count = lambda row, found, rows: np.append(np.bincount(found, minlength=1 << CLASSES), rows)
    seen = written(_counts(texts, count), "op1-words")
    # the number of documents stands behind the classes; the rest is at most 2^16 rows
    held = {r.key: r.n for r in seen.filter((F.col("key") == 1 << CLASSES)).collect()}
    total = held.get(1 << CLASSES, 0)
    few = seen.filter((F.col("key") < 1 << CLASSES) & (F.col("n") > 1) & (F.col("n") <= max(2.0, common * total)))
    top = few.orderBy(F.col("n").desc(), "key").limit(vocabulary).collect()
    drop(seen)
    classes = np.sort(np.array([r.key for r in top], np.int64))
    v = len(classes)
    if not v:
        return Topics(classes, classes, classes.astype(float), n)
    df = np.array([{r.key: r.n for r in top}[c] for c in classes], float)

    def together(row, found, rows):
        at = np.minimum(np.searchsorted(classes, found), v - 1)
        hit = classes[at] == found
        x = np.zeros((rows, v), np.float32)
        x[row[hit], at[hit]] = 1
        return np.rint(x.T @ x).astype(np.int64).ravel()

    pairs = np.zeros(v * v)
    for r in _counts(texts, together).collect():  # vocabulary ** 2 rows at most
        pairs[r.key] = r.n
    pairs = pairs.reshape(v, v)
    with np.errstate(divide="ignore"):
        pmi = np.maximum(0, np.log(pairs * total / np.outer(df, df)))
    np.fill_diagonal(pmi, 0)
    value, vector = np.linalg.eigh(pmi)
    lead = np.argsort(-np.abs(value), kind="stable")[: min(n, v)]
    place = vector[:, lead] * np.sqrt(np.abs(value[lead]))
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12)
    seeds = [int(df.argmax())]
    while len(seeds) < min(n, v):
        near = (place @ place[seeds].T).max(1)
        near[seeds] = np.inf
        seeds.append(int(near.argmin()))
    centre = place[seeds]
    for _ in range(50):
        topic = (place @ centre.T).argmax(1)
        then = np.stack([place[topic == k].sum(0) if (topic == k).any() else centre[k] for k in range(len(centre))])
        then /= np.maximum(np.linalg.norm(then, axis=1, keepdims=True), 1e-12)
        if np.allclose(then, centre):
            break
        centre = then
    return Topics(classes, topic, np.log(1 + total / df), n)
