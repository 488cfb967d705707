"""Corpus pipeline: five stages, each over all that the stage before kept, with Parquet tables between them.

Documents rejected by the quality classifier go; then lines seen before (and documents of such lines only); then all
but one document of each group of near copies; then documents are sampled to the target mix; those left become ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidlake.llm.line_dedup import without_repeated_lines
from braidlake.llm.mixing import sampled
from braidlake.llm.near_dedup import without_near_copies
from braidlake.llm.pieces import encoded
from braidlake.llm.quality_classifier import fit_quality, selected
from braidlake.llm.queries import GRADE, GRADES
from braidlake.llm import shared
from braidlake.llm.shared import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return selected(docs, fit_quality(docs, table(spark, sf_dir, "labels"), GRADE, GRADES))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled(docs)


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, keep=("ids", "ids_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("ids", ids)]

#: SQL can express neither the fitted classifier nor the piece search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents.

    Each stage's result is a written table, which goes once the next one is written; a stage's own tables go with it.
    Null, empty and very long texts, ties, repeated rows, an empty table and other columns: as each stage's operator
    says. All stages but the last return the columns that documents has, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    with shared.run(spark):
        for name, stage in STAGES[:-1]:
            with shared.run(spark, whole=True):
                kept = shared.keep(shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            if before is not None:
                shared.drop(before)
            docs = before = kept
        return STAGES[-1][1](spark, docs, sf_dir)
