"""Paired t-tests against baselines and Holm correction.

Scores are long form (model, task, lang, qid, metric, value).  One grouped query tests every cell
and metric; pairs are formed by an equi-join on (task, lang, metric, qid), not by a wide pivot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tdist import two_sided_p

CELL = ("task", "lang", "metric")


def paired_t(pairs: DataFrame, by: Sequence[str], method: Column | str = "method_value", baseline: Column | str = "baseline_value") -> DataFrame:
    """(by, n_queries, meandiff, t_stat): groups of fewer than two pairs are left out; a constant
    difference gives t = 0 (and p = 1)."""
    d = (F.col(method) if isinstance(method, str) else method) - (F.col(baseline) if isinstance(baseline, str) else baseline)
    sums = pairs.groupBy(*by).agg(
        F.count(d).alias("n_queries"), F.avg(d).alias("meandiff"), F.stddev_samp(d).alias("sd"), F.min(d).alias("lo"), F.max(d).alias("hi")
    )
    constant = (F.col("lo") == F.col("hi")) | (F.col("sd") == 0)
    t = F.when(constant, F.lit(0.0)).otherwise(F.col("meandiff") / (F.col("sd") / F.sqrt("n_queries")))
    return sums.where("n_queries >= 2").select(*by, "n_queries", "meandiff", t.alias("t_stat"), constant.alias("constant"))


def with_p(tests: DataFrame) -> DataFrame:
    p = F.when(F.col("constant"), F.lit(1.0)).otherwise(two_sided_p("t_stat", (F.col("n_queries") - 1).cast("double")))
    return tests.withColumn("p_raw", p).drop("constant")


def holm(tests: DataFrame, family: Sequence[str], tie: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds ``p_adj_holm`` and ``reject``; the family is named by columns, its members by the rows given."""
    w = Window.partitionBy(*family).orderBy("p_raw", *tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = (size - F.row_number().over(w) + 1) * F.col("p_raw")
    adjusted = tests.withColumn("step", step)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        adjusted.withColumn("p_adj_holm", F.least(F.lit(1.0), F.max("step").over(upto)))
        .withColumn("reject", F.col("p_adj_holm") < alpha)
        .drop("step")
    )


def compare_to_baseline(scores: DataFrame, baseline: str) -> DataFrame:
    """Every other model against one baseline in every (task, lang, metric)."""
    base = scores.where(F.col("model") == baseline).select(*CELL, "qid", F.col("value").alias("baseline_value"))
    rest = scores.where(F.col("model") != baseline).select(*CELL, "qid", F.col("model").alias("method"), F.col("value").alias("method_value"))
    tests = with_p(paired_t(rest.join(base, [*CELL, "qid"]), [*CELL, "method"]))
    return holm(tests.withColumn("baseline", F.lit(baseline)), CELL, ["method"])


def compare_adapted(scores: DataFrame, pairs: DataFrame, metrics: Sequence[str] = ("R@100", "nDCG@10")) -> DataFrame:
    """Adapted models against their own base; ``pairs`` is (method, baseline).  Keyed by cell and alias,
    so an alias evaluated on several cells keeps one row for each."""
    wanted = scores.where(F.col("metric").isin(*metrics))
    adapted = wanted.select(*CELL, "qid", F.col("model").alias("method"), F.col("value").alias("method_value")).join(pairs, "method")
    base = wanted.select(*CELL, "qid", F.col("model").alias("baseline"), F.col("value").alias("baseline_value"))
    tests = with_p(paired_t(adapted.join(base, [*CELL, "qid", "baseline"]), [*CELL, "method", "baseline"]))
    return holm(tests, CELL, ["method"])


def significant_gain() -> Column:
    return F.col("reject") & (F.col("meandiff") > 0)
