"""Queries p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize, read_table
from . import mix, pack
from .tokens import count_tokens, source_name


def _p8_targets(spark: SparkSession, base: str) -> dict[str, float]:
    rows = read_table(spark, base, "mix_targets").select(source_name("source").alias("s"), "target_share").where("s is not null and target_share > 0")
    sums = rows.groupBy("s").agg(F.sum("target_share").alias("w")).collect()  # a table of fixed size
    total = sum(r["w"] for r in sums)
    return {r["s"]: r["w"] / total for r in sums}


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    """Every document text in containers of 2,048 tokens, windows mixed to the shares of ``mix_targets``."""
    targets = _p8_targets(spark, base)
    sizes = materialize(count_tokens(read_table(spark, base, "documents")))
    return pack.pack_items(sizes, sorted(targets), targets=targets).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Space and mixture of both settings: the stated shares and the sources' own."""
    targets = _p8_targets(spark, base)
    sizes = materialize(count_tokens(read_table(spark, base, "documents")))
    stated = pack.packing_report(pack.pack_items(sizes, sorted(targets), targets=targets), targets=targets)
    own = pack.packing_report(materialize(pack.pack_items(sizes, sorted(targets))))
    return stated.select(F.lit("targets").alias("setting"), "*").unionByName(own.select(F.lit("own").alias("setting"), "*"))


def p8_invariants(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of any packing: every text placed, no container over its capacity, no small text in two."""
    packed = materialize(p8_containers(spark, base))
    fullest = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.coalesce(F.max("used"), F.lit(0)).alias("fullest"))
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.countDistinct("container_id").alias("k"))
    placed = per.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") <= pack.CAPACITY) & (F.col("k") > 1)).alias("n_torn"))
    return placed.join(fullest).select("n_documents", "n_torn", (F.col("fullest") <= pack.CAPACITY).alias("within"))  # one row beside one row


def p9_invariants(spark: SparkSession, base: str) -> DataFrame:
    """What must hold of any mix: per source, no document of it repeated beyond its cap, no document listed twice."""
    targets = read_table(spark, base, "mix_targets").select(source_name("source").alias("source"), "max_repeats")
    chosen = p9_mix(spark, base).groupBy("source").agg(F.max("copies").alias("most"), (F.count(F.lit(1)) == F.countDistinct("doc_id")).alias("listed_once"))
    both = targets.join(chosen, "source", "left")
    return both.select("source", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within"), F.coalesce("listed_once", F.lit(True)).alias("listed_once"))


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """Half of all tokens, mixed to the target shares."""
    mixed = mix.mix_sources(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))
    return mixed.select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"))


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    targets = read_table(spark, base, "mix_targets")
    return mix.mix_report(cut_lineage(mix.mix_sources(read_table(spark, base, "documents"), targets)), targets)


QUERIES = {
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_invariants": p8_invariants,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p9_invariants": p9_invariants,
}
ORACLE = {
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS n_torn, true AS within FROM documents WHERE text IS NOT NULL",
    "p9_invariants": "SELECT regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') AS source, true AS within, true AS listed_once FROM mix_targets",
}
