"""Queries opN_<name> over the corpus tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import dedup_lines
from .media import media_table
from .mixing import mixed
from .near_dedup import near_components
from .oracles import OP3_SQL, OP7_SQL, OP10_SQL
from .pieces import encoded
from .quality_classifier import fit_quality, scored
from .quality_rules import ABLATIONS_SQL, BASE, MILD, OP2_SQL, STRICT, ablations, apply_policy, ledger
from .shared import run, table, written
from .substring_dedup import remove_earlier_passages
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, toxicity

#: Grades of a document from its labels: poor, good but toxic, good.
GRADE = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END"
GRADES = 3
#: Categories in the chain's order: toxicity in fluent texts, that in junk, and any, whose model is fed the other two.
CATEGORIES = {"toxic_fluent": "int(toxic = 1 AND quality = 1)", "toxic_junk": "int(toxic = 1 AND quality = 0)", "toxic": "toxic"}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep=("ids_sha256", "decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), CATEGORIES), tuple(CATEGORIES))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_quality(docs, table(spark, sf_dir, "labels"), GRADE, GRADES))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), BASE, "base_ok")
    rows = apply_policy(rows, STRICT).withColumn("base_failed", ~F.col("base_ok")).drop("base_ok")
    return rows.withColumns({"policy": F.lit(STRICT.name), "policy_version": F.lit(STRICT.version)})


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two versions of a policy rejects, and rejects alone, from a stored ledger."""
    with run(spark):
        rows = written(ledger(table(spark, sf_dir, "documents")), "op2-ledger")
    named = [ablations(rows, p).withColumns({"policy": F.lit(p.name), "policy_version": F.lit(p.version)}) for p in (MILD, STRICT)]
    return named[0].unionByName(named[1])


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(table(spark, sf_dir, "documents")).drop("media")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier_passages(table(spark, sf_dir, "documents"), window=50).drop("kept_text")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), threshold=400).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_substring_dedup, op4_sentencepiece, op5_line_dedup, op6_media_columns, op7_suffix_array_dedup, op8_toxicity, op9_quality_classifier, op10_minhash_near_dedup, rule_ablations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "rule_ablations": ABLATIONS_SQL, "op3_substring_dedup": OP3_SQL, "op7_suffix_array_dedup": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL}
