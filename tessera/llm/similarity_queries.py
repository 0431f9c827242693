"""Queries p3 and p4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import similarity
from .shingles import ShingleRule

#: TESTDATA.md's measure: three words (five characters for ja), 0.6 of the union.
RULE, THRESHOLD = ShingleRule(word_n=3, char_n=5), 0.6


def _amended(spark: SparkSession, base: str) -> DataFrame:
    pairs = read_table(spark, base, "article_pairs")
    return pairs.select(
        F.col("pair_id").alias("rec"),
        F.lit("article_pairs").alias("space"),
        "lang",
        F.explode(F.array("text_before", "text_after")).alias("text"),
    )


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    members, links = similarity.near_duplicates(_amended(spark, base), THRESHOLD, RULE)
    return similarity.record_pairs(members, links).select(F.col("rec_a").alias("pair_a"), F.col("rec_b").alias("pair_b"))


def p3_groups(spark: SparkSession, base: str) -> DataFrame:
    members, links = similarity.near_duplicates(_amended(spark, base), THRESHOLD, RULE)
    return similarity.connected_groups(members, links).withColumnRenamed("rec", "pair_id")


def _split_texts(spark: SparkSession, base: str) -> DataFrame:
    queries = read_table(spark, base, "queries").select(
        F.col("_id").alias("rec"), F.lit("queries").alias("space"), "lang", "text", "split"
    )
    before = read_table(spark, base, "article_pairs").select(
        F.col("pair_id").alias("rec"), F.lit("article_pairs").alias("space"), "lang", F.col("text_before").alias("text"), "split"
    )
    return reduce(DataFrame.unionByName, [queries, before])


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = similarity.cross_split_pairs(_split_texts(spark, base), "train", THRESHOLD, RULE)
    return pairs.select(
        F.col("space").alias("src_table"),
        F.least("rec_train", "rec_eval").alias("id_a"),
        F.greatest("rec_train", "rec_eval").alias("id_b"),
    )


def p4_report(spark: SparkSession, base: str) -> DataFrame:
    """Per evaluation split and table: overlapping pairs and the rows on either side that take part."""
    pairs = similarity.cross_split_pairs(_split_texts(spark, base), "train", THRESHOLD, RULE)
    return pairs.groupBy(F.col("space").alias("src_table"), "split").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.countDistinct("rec_eval").alias("n_eval_rows"),
        F.countDistinct("rec_train").alias("n_train_rows"),
        F.sum((F.col("similarity") == 1.0).cast("long")).alias("n_equal_sets"),
    )


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_report": p4_report}


def _similar_sql(texts: str) -> str:
    """CTEs up to ``alike`` (a, b, common, size_a, size_b): pairs of text numbers of one space and language that share at
    least 0.6 of their shingles; ``texts`` gives (rec, space, lang, split, text)."""

    def grams(n: int, joined: str) -> str:
        slices = ", ".join(f"parts[{i + 1}:greatest(len(parts) - {n - 1}, 0) + {i}]" for i in range(n))
        return f"list_transform(list_zip({slices}), lambda x: {joined})"

    return f"""texts AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({texts}) WHERE text IS NOT NULL AND lang IS NOT NULL AND rec IS NOT NULL
), words AS (
  SELECT id, space, lang, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM texts
), parted AS (
  SELECT id, space, lang, CASE WHEN lang = 'ja' THEN list_filter(string_split(array_to_string(w, ''), ''), lambda x: x <> '') ELSE w END AS parts FROM words
), grams AS (
  SELECT DISTINCT id, space, lang, unnest(CASE WHEN lang = 'ja' THEN {grams(5, "x[1] || x[2] || x[3] || x[4] || x[5]")}
    ELSE {grams(3, "x[1] || ' ' || x[2] || ' ' || x[3]")} END) AS gram FROM parted
), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id
), alike AS (
  SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(x.n) AS size_a, any_value(y.n) AS size_b
  FROM grams a JOIN grams b ON a.space = b.space AND a.lang = b.lang AND a.gram = b.gram AND a.id < b.id JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
  GROUP BY a.id, b.id HAVING count(*) >= 0.6 * (any_value(x.n) + any_value(y.n) - count(*))
)"""


_P3 = "SELECT pair_id AS rec, 'p' AS space, lang, NULL AS split, unnest([text_before, text_after]) AS text FROM article_pairs"
_P4 = """SELECT _id AS rec, 'queries' AS space, lang, split, text FROM queries WHERE split IS NOT NULL
  UNION ALL SELECT pair_id, 'article_pairs', lang, split, text_before FROM article_pairs WHERE split IS NOT NULL"""
_P4_PAIRS = f"""WITH {_similar_sql(_P4)}, crossed AS (
  SELECT x.space, CASE WHEN x.split = 'train' THEN y.split ELSE x.split END AS split, CASE WHEN x.split = 'train' THEN x.rec ELSE y.rec END AS rec_train,
    CASE WHEN x.split = 'train' THEN y.rec ELSE x.rec END AS rec_eval, max(common / (size_a + size_b - common)) AS similarity
  FROM alike JOIN texts x ON x.id = a JOIN texts y ON y.id = b WHERE (x.split = 'train') <> (y.split = 'train') GROUP BY ALL)"""
ORACLE = {
    "p3_found": f"""WITH {_similar_sql(_P3)}
SELECT DISTINCT least(x.rec, y.rec) AS pair_a, greatest(x.rec, y.rec) AS pair_b FROM alike JOIN texts x ON x.id = a JOIN texts y ON y.id = b WHERE x.rec <> y.rec""",
    "p4_found": f"{_P4_PAIRS} SELECT space AS src_table, least(rec_train, rec_eval) AS id_a, greatest(rec_train, rec_eval) AS id_b FROM crossed",
    "p4_report": f"""{_P4_PAIRS} SELECT space AS src_table, split, count(*) AS n_pairs, count(DISTINCT rec_eval) AS n_eval_rows, count(DISTINCT rec_train) AS n_train_rows,
  count(*) FILTER (similarity = 1) AS n_equal_sets FROM crossed GROUP BY ALL""",
}
