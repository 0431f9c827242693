"""Ranking metrics: Recall, nDCG and average precision in one pass, with audit counters.

A run is long form (qid, doc_id, score or rank); judgments are (qid, doc_id, rel), the last written
row of a (qid, doc_id) wins, a null rel counts 0.  ``by`` names columns that separate runs (such as a
model).  Recall and AP count rel >= 1, nDCG has linear gain and log2(rank + 1) discount over all
judged documents.  A judged query without a relevant document scores 0 and is counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_width

CUTS = (10, 100, 1000)
#: aggregate name -> per-query name (fixed values)
NAMES = {
    **{f"recall_{k}": f"R@{k}" for k in CUTS},
    **{f"ndcg_{k}": f"nDCG@{k}" for k in CUTS},
    "map": "AP",
}
DIGITS = 6
#: Runs that one call scores side by side under the policy ``zero``.
MOST_RUNS = 4096


def last_wins(judgments: DataFrame, order: Sequence[str]) -> DataFrame:
    """(qid, doc_id, rel): the row that comes last by ``order`` decides; keys must not be null."""
    latest = F.max_by(F.coalesce("rel", F.lit(0)), F.struct(*order))
    return judgments.where("qid is not null and doc_id is not null").groupBy("qid", "doc_id").agg(
        latest.cast("int").alias("rel")
    )


def drop_self_matches(run: DataFrame) -> DataFrame:
    return run.where(F.col("doc_id") != F.col("qid"))


def ranked(run: DataFrame, by: Sequence[str] = (), score: Column | None = None) -> DataFrame:
    """Adds ``rank`` by (score, doc id as string), both descending; a repeated document keeps its best.

    Every rank is exact and no query meets in one task: rows are range-partitioned and sorted by (by, qid,
    score, doc id) and numbered in that order.  A row's rank is its distance from the query's first row
    in its part plus the query's rows in the parts before, from a table of one row per query and part."""
    keys = [*by, "qid"]
    score = F.col("score") if score is None else score
    best = run.groupBy(*keys, "doc_id").agg(F.max(score).alias("score"))
    order = [*keys, F.col("score").desc(), F.col("doc_id").desc()]
    sorted_rows = best.repartitionByRange(shuffle_width(run.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    spans = placed.groupBy(*keys, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1)
    spans = spans.select(*[F.col(c).alias(f"span_{c}") for c in (*keys, "part")], "shift")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"span_{c}")) for c in (*keys, "part")])
    return placed.join(spans, same).select(*keys, "doc_id", "score", (F.col("at") + F.col("shift")).cast("int").alias("rank"))


def per_query(run: DataFrame, judgments: DataFrame, by: Sequence[str] = (), policy: str = "zero", cells: DataFrame | None = None) -> DataFrame:
    """One row per (by, judged query) with the seven metrics.

    ``policy``: ``zero`` scores judged queries without results 0, ``skip`` leaves them out.
    ``cells``: the distinct ``by`` values (taken from the run if not given).
    """
    if policy not in ("zero", "skip"):
        raise ValueError("policy is 'zero' or 'skip'")
    by = list(by)
    ideal_order = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("doc_id"))
    gain = lambda rank: F.col("rel") / F.log2(F.col(rank) + 1.0)
    judged = judgments.withColumn("place", F.row_number().over(ideal_order))
    ideal = judged.groupBy("qid").agg(
        F.sum((F.col("rel") >= 1).cast("int")).alias("n_rel"),
        *[F.sum(F.when(F.col("place") <= k, gain("place"))).alias(f"ideal_{k}") for k in CUTS],
    )
    hits = run.select(*by, "qid", "doc_id", "rank").join(judgments.where("rel > 0"), ["qid", "doc_id"])
    order = Window.partitionBy(*by, "qid").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(order))
    found = hits.groupBy(*by, "qid").agg(
        *[F.sum((F.col("rank") <= k).cast("int")).alias(f"hits_{k}") for k in CUTS],
        *[F.sum(F.when(F.col("rank") <= k, gain("rank"))).alias(f"dcg_{k}") for k in CUTS],
        F.sum(F.col("nth") / F.col("rank")).alias("precisions"),
    )
    if policy == "skip":
        universe = run.select(*by, "qid").distinct().join(ideal, "qid")
    elif by:
        # every run is scored on every judged query: the runs are few and listed in every row, no join
        universe = ideal.withColumn("cell", F.explode(_few(run.select(*by).distinct() if cells is None else cells)))
        universe = universe.select("cell.*", *ideal.columns)
    else:
        universe = ideal
    scored = universe.join(found, [*by, "qid"], "left")
    over = lambda top, bottom: F.when(F.col(bottom) > 0, F.coalesce(F.col(top), F.lit(0)) / F.col(bottom)).otherwise(F.lit(0.0))
    return scored.select(
        *by,
        "qid",
        *[over(f"hits_{k}", "n_rel").alias(f"recall_{k}") for k in CUTS],
        *[over(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}") for k in CUTS],
        over("precisions", "n_rel").alias("map"),
    )


def _few(cells: DataFrame, most: int = MOST_RUNS) -> Column:
    """The rows of a table of at most ``most`` rows as an array of structs."""
    rows = cells.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} runs at once; evaluate them in parts")
    fields = cells.schema.fields
    return F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in rows]) if rows else F.array().cast(
        f"array<{cells.schema.simpleString()}>"
    )


def mean_metrics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over all rows of ``per_query`` and the number of queries."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(m), DIGITS).alias(m) for m in NAMES]
    )


def long_metrics(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, qid, metric, value) with the per-query metric names."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(m).alias("value")) for m, n in NAMES.items()])
    return scores.select(*by, "qid", F.explode(pairs).alias("e")).select(*by, "qid", "e.metric", "e.value")


def prepare_lists(lists: DataFrame, max_docs: int | None = 1000, filter_self: bool = False) -> DataFrame:
    """(…, qid, ranked, plus counters): de-duplicated, then truncated, then freed of self matches."""
    if max_docs is not None and max_docs < 0:
        raise ValueError("max_docs must not be negative")
    distinct = lists.withColumn("n_given", F.size("ranked")).withColumn("ranked", F.array_distinct("ranked"))
    out = distinct.withColumn("n_distinct", F.size("ranked"))
    out = out.withColumn("n_duplicates", F.col("n_given") - F.col("n_distinct"))
    if max_docs:
        out = out.withColumn("is_truncated", F.col("n_distinct") > max_docs).withColumn("ranked", F.slice("ranked", 1, max_docs))
    else:
        out = out.withColumn("is_truncated", F.lit(False))
    has_self = F.array_contains("ranked", F.col("qid"))
    out = out.withColumn("has_self", F.coalesce(has_self, F.lit(False)))
    if filter_self:
        out = out.withColumn("ranked", F.filter("ranked", lambda d: d != F.col("qid")))
    return out


def lists_to_run(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form; a list that is empty after filtering counts as missing."""
    return prepared.select(*by, "qid", F.posexplode("ranked").alias("pos", "doc_id")).select(
        *by, "qid", "doc_id", (F.col("pos") + 1).alias("rank")
    )


def audit(prepared: DataFrame, judgments: DataFrame, filter_self: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Counters per ``by`` (one row without): lists, duplicates, truncated, self matches, missing, extra.

    A query may have several lists; it is present if one of them is not empty."""
    judged = judgments.select("qid").distinct().withColumn("judged", F.lit(True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per_qid = prepared.groupBy(*by, "qid").agg(
        F.count(F.lit(1)).alias("n_lists"),
        F.sum("n_duplicates").alias("n_duplicates"),
        F.sum(F.col("is_truncated").cast("int")).alias("n_truncated"),
        F.sum(F.col("has_self").cast("int")).alias("n_self_matches"),
        F.max(F.size("ranked") > 0).alias("present"),
    )
    counters = per_qid.join(judged, "qid", "left").groupBy(*by).agg(
        *[total(c).alias(c) for c in ("n_lists", "n_duplicates", "n_truncated", "n_self_matches")],
        F.count_if(F.col("present") & F.col("judged").isNull()).alias("n_extra"),
        F.count_if(F.col("present") & F.col("judged").isNotNull()).alias("n_scored"),
    )
    # a one-row table beside the counters
    n_judged = judged.agg(F.count(F.lit(1)).alias("n_judged"))
    return counters.join(F.broadcast(n_judged)).select(
        *by, "n_lists", "n_duplicates", "n_truncated", "n_self_matches", (F.col("n_judged") - F.col("n_scored")).alias("n_missing"), "n_extra", "n_scored"
    )


def require_overlap(run: DataFrame, judgments: DataFrame) -> None:
    """Raises if the run and the judgments share no query."""
    if run.join(judgments, "qid", "left_semi").isEmpty():
        raise ValueError("no query of the run is judged")
