"""Hard-negative mining and training triples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positives whose draws may come from one random stream on the driver.
MOST_REPLAYED = 2_000_000


def candidates(run: DataFrame, judgments: DataFrame, drop_self: bool) -> DataFrame:
    """(qid, doc_id, place): ranked documents, first occurrence kept, without positives and self matches."""
    first = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    if drop_self:
        first = first.where(F.col("qid") != F.col("doc_id"))
    negatives = first.join(judgments.where("rel > 0").select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    w = Window.partitionBy("qid").orderBy("rank", "doc_id")
    return negatives.select("qid", "doc_id", (F.row_number().over(w) - 1).alias("place"))


def mine_hashed(run: DataFrame, judgments: DataFrame, drop_self: bool, seed: int = 13) -> DataFrame:
    """(qid, positive_doc_id, hard_negative_doc_id): one negative per (query, positive), chosen by a hash
    of seed, query and positive, so that the choice needs no global order."""
    pool = candidates(run, judgments, drop_self)
    sizes = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    positives = judgments.where("rel > 0").select("qid", F.col("doc_id").alias("positive_doc_id"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", "positive_doc_id")), 1, 8), 16, 10).cast("long")
    picked = positives.join(sizes, "qid").withColumn("place", (draw % F.col("n")).cast("int"))
    return picked.join(pool, ["qid", "place"]).select("qid", "positive_doc_id", F.col("doc_id").alias("hard_negative_doc_id"))


def mine_replayed(run: DataFrame, judgments: DataFrame, drop_self: bool, seed: int = 13) -> DataFrame:
    """Like ``mine_hashed`` but with the draws of one ``random.Random(seed)`` over queries and positives
    in sorted order.  The stream is sequential by definition, so the list lengths (one small row per
    judged query) come to the driver; queries without candidates draw nothing.  A small mode: more than
    ``MOST_REPLAYED`` positives raise, ``mine_hashed`` has no such bound."""
    n = judgments.where("rel > 0").count()
    if n > MOST_REPLAYED:
        raise ValueError(f"{n} positives are too many for one random stream; use mine_hashed")
    pool = candidates(run, judgments, drop_self)
    lengths = (
        judgments.where("rel > 0").groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("positives"))
        .join(pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid")
        .orderBy("qid")
    )
    rng, rows = random.Random(seed), []
    for r in lengths.toLocalIterator():
        for positive in r["positives"]:
            rows.append((r["qid"], positive, rng.choice(range(r["n"]))))
    drawn = run.sparkSession.createDataFrame(rows, "qid string, positive_doc_id string, place int")
    return drawn.join(pool, ["qid", "place"]).select("qid", "positive_doc_id", F.col("doc_id").alias("hard_negative_doc_id"))


def mining_counters(run: DataFrame, judgments: DataFrame, drop_self: bool) -> DataFrame:
    """One row: judged queries, missing from the run, without candidates, examples and so on."""
    pool = candidates(run, judgments, drop_self).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    positives = judgments.where("rel > 0").groupBy("qid").agg(F.count(F.lit(1)).alias("n_pos"))
    present = run.select("qid").distinct().withColumn("there", F.lit(1))
    each = positives.join(present, "qid", "left").join(pool, "qid", "left")
    return each.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count_if(F.col("there").isNull()).alias("n_missing"),
        F.count_if(F.col("there").isNotNull() & F.col("n").isNull()).alias("n_without_candidates"),
        F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("n_pos"))), F.lit(0)).alias("n_examples"),
        F.coalesce(F.sum("n_pos"), F.lit(0)).alias("n_positives"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"),
    )


def text_triples(triples: DataFrame, queries: DataFrame, corpus: DataFrame, judgments: DataFrame) -> DataFrame:
    """Triples with their texts and all positives of the query; rows with a missing text are left out
    (``incomplete_triples`` lists them)."""
    all_pos = judgments.where("rel > 0").groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("qrel_positive_doc_ids"))
    doc = lambda i, t: corpus.select(F.col("doc_id").alias(i), F.col("text").alias(t))
    return (
        triples.join(queries.select("qid", F.col("text").alias("query_text")), "qid")
        .join(doc("positive_doc_id", "positive_text"), "positive_doc_id")
        .join(doc("hard_negative_doc_id", "negative_text"), "hard_negative_doc_id")
        .join(all_pos, "qid", "left")
    )


def incomplete_triples(triples: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(missing_kind, missing_id, n) of every query or document a triple names but no table has."""
    ids = triples.select(
        F.explode(
            F.array(
                F.struct(F.lit("query").alias("missing_kind"), F.col("qid").alias("missing_id")),
                F.struct(F.lit("document").alias("missing_kind"), F.col("positive_doc_id").alias("missing_id")),
                F.struct(F.lit("document").alias("missing_kind"), F.col("hard_negative_doc_id").alias("missing_id")),
            )
        ).alias("e")
    ).select("e.*").where("missing_id is not null")
    known = queries.select(F.lit("query").alias("missing_kind"), F.col("qid").alias("missing_id")).unionByName(
        corpus.select(F.lit("document").alias("missing_kind"), F.col("doc_id").alias("missing_id"))
    )
    return ids.join(known, ["missing_kind", "missing_id"], "left_anti").groupBy("missing_kind", "missing_id").agg(F.count(F.lit(1)).alias("n"))


def hash_order(*columns: Column | str) -> Column:
    """A stable pseudo-random order that any engine with MD5 reproduces."""
    return F.md5(F.concat_ws("|", *columns))
