"""Bounded samples of labelled rows, the only thing that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: dict[str, str], bound: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, targets as ints) of at most ``bound`` labelled ids, those whose hashes are smallest.

    targets: name -> SQL over labels. Which rows are taken depends on ids alone. Rows without an id, a text or a target don't count; if labels repeat an
    id, its greatest label row counts. The ids (at most ``bound`` rows of a few longs) are broadcast to the documents.
    The rows are written to the shared folder.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(F.expr(c).cast("int").alias(n) for n, c in targets.items())).na.drop()
    best = known.groupBy("doc_id").agg(F.max(F.struct(*targets)).alias("t"))
    few = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", "t.*")
    few = written(few, f"{name}-labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    one = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", *targets).agg(F.min("text").alias("text"))
    out = written(one.select("doc_id", "text", *targets), f"{name}-sample")
    drop(few)
    return out
