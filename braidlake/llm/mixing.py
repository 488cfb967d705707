"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

1. One pass gives each document its number of words (tokens) and its topic (a column, or ``topics``); tokens are summed
   by source, language and topic. Only these sums are fitted, not documents.
2. Raking: a factor for each source, language and topic so that the weighted tokens have the target shares in all
   three margins. A sweep updates sources, then languages, then topics. Source factors stay in a table with a row for
   each source (they may be many); languages by topics is a table of at most GRID cells, which is summed for the driver.
3. A document's weight is the product of its three factors. It is kept with probability min(1, rate * weight); the rate
   makes the expected tokens ``fraction`` of all. Whether it is kept is decided by a hash of id and text.

A sweep is one job over the source table. Factors return to documents by a join that Spark broadcasts only while the
table is under its threshold, and splits where a source is hot otherwise. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import text_blocks
from .frame_tables import batch
from .shared import drop, fresh, owned, written
from .topics import Topics, fit_topics, word_classes

NONE = "(none)"
MARGINS = ("source", "lang", "topic")
#: Powers that shares are raised to for a margin without given targets. Below 1, large categories give to small ones.
TEMPERED = {"source": 0.7, "lang": 0.7, "topic": 0.5}
#: Languages times topics, at most.
GRID = 1 << 16
TOLERANCE = 1e-6
FIELDS = "doc_id long, source string, lang string, topic string, n_tokens long, u double"
_UNIT = 2.0**-53
Targets = Mapping[str, Mapping[str, float]]


def _name(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NONE))


def _chance(id_col: str, text_col: str) -> Column:
    """In [0, 1), from id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), 11).cast("double") * F.lit(_UNIT)


def described(docs: DataFrame, topics: Topics | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, u): a row for each row of docs. Null names become "(none)"; topics are
    those of ``topic_col``, or the model's numbers."""
    given = _name(topic_col) if topic_col else F.lit("")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(3)):
                n, row, found = word_classes(flat, offsets)
                part = x.slice(first, last - first)
                topic = part.column(5) if topics is None else [str(t) for t in topics.of(row, found, last - first)]
                yield batch(FIELDS, [part.column(0), part.column(1), part.column(2), topic, n, part.column(4)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _name(source_col).alias("source"), _name(lang_col).alias("lang"), F.col(text_col).alias("text"), _chance(id_col, text_col).alias("u"), given.alias("topic")).mapInArrow(make, FIELDS)


def checked(targets: Targets | None) -> Targets:
    """The targets, if margins are known and each one's shares are positive and sum to 1."""
    targets = targets or {}
    for margin, shares in targets.items():
        if margin not in MARGINS:
            raise ValueError(f"no margin is called {margin}; there are {', '.join(MARGINS)}")
        if any(not s >= 0 for s in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
            raise ValueError(f"the target shares of {margin} must be 0 or more and sum to 1")
    return targets


def _wanted(margin: str, mass: dict[str, float], targets: Targets) -> np.ndarray:
    """Target shares of the categories of mass, in its order."""
    if margin not in targets:
        x = np.array(list(mass.values())) ** TEMPERED[margin]
        return x / x.sum()
    if missing := [k for k, s in targets[margin].items() if s > 0 and k not in mass]:
        raise ValueError(f"no tokens of {margin} {', '.join(sorted(missing))}")
    return np.array([targets[margin].get(k, 0.0) for k in mass])


@dataclass
class Fit:
    """Factors of a raking and how near it came: residual has each margin's largest difference between a share and its target."""

    sources: DataFrame
    langs: dict[str, float]
    topics: dict[str, float]
    sweeps: int
    residual: dict[str, float]

    @property
    def converged(self) -> bool:
        return max(self.residual.values(), default=0.0) <= TOLERANCE


def rake(cells: DataFrame, targets: Targets | None = None, stalled: int = 25) -> Fit:
    """Factors for cells (source, lang, topic, tokens), scaled so that the weighted tokens are as many as the tokens.

    Margins without targets get their shares, tempered. Categories without tokens have no cell and get factor 0; so do
    those that given targets don't name. Sweeps go on until all margins are within TOLERANCE of their targets. Where
    empty cells make targets contradict each other there is no exact fit: sweeps end when ``stalled`` of them have not
    halved the largest residual, topics then have their shares, and the fit says that it has not converged.
    """
    targets = checked(targets)
    cells = cells.filter("tokens > 0")
    per_source = written(cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"), F.sum("tokens").alias("mass")), "op1-sources")
    some = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).limit(GRID + 1).collect()
    if len(some) > GRID:
        raise ValueError(f"more than {GRID} pairs of a language and a topic: name fewer")
    if not some:
        return Fit(per_source.select("source", F.lit(0.0).alias("a")), {}, {}, 0, {})
    langs, tops = sorted({g.lang for g in some}), sorted({g.topic for g in some})
    li, ti = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(tops)}
    n = np.zeros((len(langs), len(tops)))
    for g in some:
        n[li[g.lang], ti[g.topic]] = g.n
    total = n.sum()
    want_lang, want_topic = _wanted("lang", dict(zip(langs, n.sum(1), strict=True)), targets), _wanted("topic", dict(zip(tops, n.sum(0), strict=True)), targets)
    if "source" in targets:
        shares = cells.sparkSession.createDataFrame(sorted(targets["source"].items()), "source string, share double")
        if missing := [r.source for r in shares.filter("share > 0").join(per_source, "source", "left_anti").collect()]:
            raise ValueError(f"no tokens of source {', '.join(sorted(missing))}")
        with_target = written(per_source.join(shares, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0))), "op1-targets")
    else:
        norm = per_source.agg(F.sum(F.pow("mass", F.lit(TEMPERED["source"])))).first()[0]
        with_target = written(per_source.withColumn("share", F.pow("mass", F.lit(TEMPERED["source"])) / F.lit(float(norm))), "op1-targets")
    drop(per_source)
    b, c, sweeps, best, since = np.ones(len(langs)), np.ones(len(tops)), 0, np.inf, 0

    def factor() -> DataFrame:
        weight = lambda keys, values: F.create_map(*(F.lit(x) for k, v in zip(keys, values, strict=True) for x in (k, float(v))))
        by_lang, by_topic = weight(langs, b), weight(tops, c)
        weighted = F.aggregate(F.transform("cells", lambda x: x.tokens * by_lang[x.lang] * by_topic[x.topic]), F.lit(0.0), lambda s, x: s + x)
        a = F.when((F.col("share") > 0) & (weighted > 0), F.col("share") / weighted).otherwise(F.lit(0.0))
        return with_target.select("source", "cells", a.alias("a"))

    while True:
        sweeps += 1
        rows = factor().select("a", F.explode("cells").alias("x")).groupBy("x.lang", "x.topic").agg(F.sum(F.col("x.tokens") * F.col("a")).alias("m")).collect()
        m = np.zeros_like(n)
        for r in rows:
            m[li[r.lang], ti[r.topic]] = r.m
        got_lang, got_topic = b * (m @ c), c * (b @ m)  # sources have their shares here
        # a source whose cells all have factor 0 can't have its share
        residual = {"source": float(1 - got_lang.sum()), "lang": float(np.abs(got_lang - want_lang).max()), "topic": float(np.abs(got_topic - want_topic).max())}
        worst = max(residual.values())
        if worst < best / 2:
            best, since = worst, 0
        since += 1
        if worst <= TOLERANCE or since > stalled:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(200):  # languages and topics fit one another before sources are summed again
                before = b
                b = np.where(want_lang > 0, np.nan_to_num(want_lang / (m @ c), posinf=0.0), 0.0)
                c = np.where(want_topic > 0, np.nan_to_num(want_topic / (b @ m), posinf=0.0), 0.0)
                if np.allclose(b, before, rtol=1e-9):
                    break
    sources = written(factor().select("source", (F.col("a") * F.lit(float(total))).alias("a")), "op1-factors")
    drop(with_target)
    return Fit(sources, dict(zip(langs, map(float, b), strict=True)), dict(zip(tops, map(float, c), strict=True)), sweeps, residual)


def rate_for(cells: DataFrame, fraction: float) -> float:
    """The rate at which sum(tokens * min(1, rate * weight)) is this fraction of all tokens. cells: tokens, weight.

    By bisection over sums; each job tries 15 rates. 0 if there are no tokens.
    """
    total = cells.agg(F.sum("tokens"), F.min(F.expr("CASE WHEN weight > 0 THEN weight END"))).first()
    if not total[0] or total[1] is None:
        return 0.0
    low, high = 0.0, 1 / total[1]
    for _ in range(9):
        tries = np.linspace(low, high, 17)[1:-1]
        sums = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(r)) * F.col("weight"))).alias(f"s{i}") for i, r in enumerate(tries))).first()
        k = sum(s < fraction * total[0] for s in sums)
        low, high = (tries[k - 1] if k else low), (tries[k] if k < len(tries) else high)
    return float(high)


def _look(m: dict[str, float], c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[c], F.lit(0.0)) if m else F.lit(0.0)


def _weights(rows: DataFrame, fit: Fit) -> DataFrame:
    joined = rows.join(fit.sources, "source", "left")
    return joined.withColumn("weight", F.coalesce("a", F.lit(0.0)) * _look(fit.langs, F.col("lang")) * _look(fit.topics, F.col("topic"))).drop("a")


def _fitted(docs: DataFrame, fraction: float, targets: Targets | None, n_topics: int, names: dict) -> tuple[DataFrame, Topics | None, Fit, float]:
    topics = None if names.get("topic_col") else fit_topics(docs, n_topics, text_col=names.get("text_col", "text"))
    rows = described(docs, topics, **names)
    sums = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "op1-cells")
    fit = rake(sums, targets)
    rate = rate_for(_weights(sums, fit).select("tokens", "weight"), fraction)
    drop(sums)
    return rows, topics, fit, rate


@owned
def mixed(docs: DataFrame, fraction: float = 0.7, targets: Targets | None = None, n_topics: int = 8, **columns: str) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, kept, residual, converged) for each row of docs.

    targets: margin ("source", "lang", "topic") -> category -> share; shares of a margin sum to 1. A category that a
    given margin doesn't name gets weight 0. Margins without targets get tempered shares (share ** TEMPERED, scaled to
    1). residual: the largest difference between a share that the weights give and its target; converged: it is within
    TOLERANCE. ``fraction``: expected kept tokens; if targets leave fewer tokens, those with a weight are all kept.

    ``topic_col``: a column with topics; without one, ``n_topics`` are fitted. Null source, language and topic are a
    category of their own. Whole texts are read, however long. Null, empty and blank texts have no tokens; they count
    for no margin, get weight 0 and are not kept. Rows are judged one by one: ids may be null or repeat; equal rows (id
    and text) are kept or dropped together. A row is kept if its hash is below its probability, so not if they are
    equal. Other columns, whatever their names, are ignored. No rows in, none out.
    """
    rows, _, fit, rate = _fitted(docs, fraction, targets, n_topics, columns)
    out = _weights(rows, fit)
    out = out.withColumn("weight", F.when(F.col("n_tokens") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    out = out.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))).withColumn("kept", F.col("u") < F.col("probability")).drop("u")
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "kept").withColumns({"residual": F.lit(max(fit.residual.values(), default=0.0)), "converged": F.lit(fit.converged)})


@owned
def sampled(docs: DataFrame, fraction: float = 0.7, targets: Targets | None = None, n_topics: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """The rows of docs, with their columns, that ``mixed`` keeps."""
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "lang_col": lang_col, "topic_col": topic_col}
    _, topics, fit, rate = _fitted(docs, fraction, targets, n_topics, names)
    source, a, share, u = fresh(docs, "source", "a", "share", "u")
    factors = fit.sources.select(F.col("source").alias(source), F.col("a").alias(a))
    joined = docs.join(factors, _name(source_col) == F.col(source), "left")
    by_topic = _look(fit.topics, _name(topic_col)) if topic_col else F.lit(1.0)
    joined = joined.withColumn(share, F.lit(rate) * F.coalesce(a, F.lit(0.0)) * _look(fit.langs, _name(lang_col)) * by_topic).withColumn(u, _chance(id_col, text_col)).drop(source, a)
    at, own = joined.columns.index(text_col), list(docs.columns)
    width = len(own)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, last, flat, offsets in text_blocks(x.column(at)):
                n, row, found = word_classes(flat, offsets)
                part = x.slice(first, last - first)
                p = part.column(width).to_numpy()
                if topics is not None:
                    p = p * np.array([fit_topic.get(str(t), 0.0) for t in topics.of(row, found, last - first)])
                kept = pa.array(part.column(width + 1).to_numpy() < np.minimum(1.0, p) * (n > 0))
                yield part.select(range(width)).filter(kept)

    fit_topic = fit.topics
    return joined.mapInArrow(make, docs.schema)
