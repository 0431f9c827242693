"""Queries p2 to p10: each applies its operator to the whole intended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, read_table
from . import canon, split, topn


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return canon.identical_looking_pairs(cut_lineage(canon.visual_keys(_p5_records(spark, base), "rec", "body")))


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    return canon.identical_looking_groups(cut_lineage(canon.visual_keys(_p5_records(spark, base), "rec", "body")))


def p5_canonical(spark: SparkSession, base: str) -> DataFrame:
    return canon.canonical_text(_p5_records(spark, base), "rec", "body")


def _p5_records(spark: SparkSession, base: str) -> DataFrame:
    corpus = read_table(spark, base, "corpus").select(
        F.concat(F.lit("corpus:"), "_id").alias("rec"), F.col("text").alias("body")
    )
    after = read_table(spark, base, "article_pairs").select(
        F.concat(F.lit("article_pairs:"), "pair_id").alias("rec"), F.col("text_after").alias("body")
    )
    return corpus.unionByName(after)


def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split.split_items(read_table(spark, base, "corpus"), "_id", "text")


def p6_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """Every split article put together again from its pieces, and whether all pieces keep the limit."""
    pieces = p6_pieces(spark, base).select("_id", "piece_no", "piece")
    # the first 200 characters of a piece are those of the one before
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", split.OVERLAP + 1, split.LIMIT))
    parts = pieces.select("_id", "piece_no", own.alias("own"), (F.char_length("piece") <= split.LIMIT).alias("fits"))
    whole = parts.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("l"), F.bool_and("fits").alias("fits"))  # one article a row
    return whole.select("_id", F.md5(F.array_join(F.transform("l", lambda x: x["own"]), "")).alias("text_md5"), "fits")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_pieces(spark, base).where("piece_no = 0").select("_id")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    merged = topn.merge_shard_lists(read_table(spark, base, "dense_runs"), read_table(spark, base, "top100_builds"))
    return merged.select("model_key", "qid", "doc_id")


QUERIES = {
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_canonical": p5_canonical,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_rebuilt": p6_rebuilt,
    "p7_found": p7_found,
}

ORACLE = {
    "p6_found": "SELECT _id FROM corpus WHERE length(text) > 4000",
    "p6_rebuilt": "SELECT _id, md5(text) AS text_md5, true AS fits FROM corpus WHERE length(text) > 4000",
    "p7_found": """
WITH long AS (
  SELECT model_key, qid, unnest(ranked) AS doc_id, unnest(scores) AS score FROM dense_runs
), best AS (
  SELECT model_key, qid, doc_id, max(score) AS score FROM long
  WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND (qid IS NULL OR doc_id <> qid)
  GROUP BY ALL
), placed AS (
  SELECT b.*, row_number() OVER (PARTITION BY model_key, qid ORDER BY score DESC, doc_id DESC) AS place FROM best b
)
SELECT p.model_key, p.qid, p.doc_id FROM placed p JOIN top100_builds t ON p.model_key = t.model_key WHERE place <= top_k""",
}
