"""Queries p2 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, read_table
from . import defects, subjects


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    prompts = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "text", "lang")
    return defects.defective_answers(read_table(spark, base, "expansions"), prompts)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _assigned(spark, base).select("doc_id", "subject_area")


def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    return subjects.composition(cut_lineage(_assigned(spark, base)), read_table(spark, base, "documents").select("doc_id"))


def _assigned(spark: SparkSession, base: str) -> DataFrame:
    documents = read_table(spark, base, "documents").select("doc_id", "text")
    return subjects.fit_and_assign(documents, read_table(spark, base, "subject_labels"), read_table(spark, base, "subject_areas"))


QUERIES = {"p2_found": p2_found, "p10_found": p10_found, "p10_composition": p10_composition}
ORACLE: dict[str, str] = {}
