"""Costs, reshaping and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: USD per million tokens for a model without a listed price (fixed values).
DEFAULT_INPUT_PRICE, DEFAULT_OUTPUT_PRICE = 0.40, 1.60


def ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n_calls, input_tokens, output_tokens, cost_usd) of ``calls`` (model, qid, input_tokens,
    output_tokens); an unlisted model costs nothing."""
    sums = calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    cost = (F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))) / 1e6
    return sums.join(prices, "model", "left").withColumn("cost_usd", F.round(cost, 4)).drop("input_price", "output_price")


def calls_per_query(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model", "qid").agg(F.count(F.lit(1)).alias("n_calls"))


def cost_estimate(cells: DataFrame, prices: DataFrame, calls_per_query: int, input_tokens: int, output_tokens: int) -> DataFrame:
    """(cell, n_queries, cost_usd) with a ``__total__`` row, for ``cells`` (cell, model, n_queries)."""
    priced = cells.join(prices, "model", "left")
    n = F.col("n_queries") * calls_per_query
    cost = (
        n * input_tokens * F.coalesce("input_price", F.lit(DEFAULT_INPUT_PRICE))
        + n * output_tokens * F.coalesce("output_price", F.lit(DEFAULT_OUTPUT_PRICE))
    ) / 1e6
    rolled = priced.withColumn("cost", cost).rollup("cell").agg(F.sum("n_queries").alias("n_queries"), F.sum("cost").alias("cost"))
    return rolled.select(F.coalesce("cell", F.lit("__total__")).alias("cell"), "n_queries", F.round("cost", 6).alias("cost_usd"))


def pivot_cells(metrics: DataFrame, metric: str, cells: list[str]) -> DataFrame:
    """One row per model, one column per ``task-lang`` cell."""
    wide = metrics.withColumn("cell", F.concat_ws("-", "task", "lang"))
    return wide.groupBy("model").pivot("cell", cells).agg(F.first(metric))


def nested_cells(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(model, cells): a map from cell to a map of its metrics."""
    each = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    pairs = F.collect_list(F.struct(F.concat_ws("-", "task", "lang").alias("k"), each.alias("v")))
    return metrics.groupBy("model").agg(F.map_from_entries(pairs).alias("cells"))


def deltas(adapted: DataFrame, base: DataFrame, names: list[str]) -> DataFrame:
    """Adapted cells beside their base (left join on base_model, task, lang) with a delta per metric."""
    b = base.select(F.col("model").alias("base_model"), "task", "lang", *[F.col(n).alias(f"base_{n}") for n in names])
    return adapted.join(b, ["base_model", "task", "lang"], "left").select(
        "*", *[F.round(F.col(n) - F.col(f"base_{n}"), 6).alias(f"delta_{n}") for n in names]
    )


def attach_configs(aliases: DataFrame, configs: DataFrame) -> DataFrame:
    """Train configs by ``output_alias``; without one, the only config of the same (model, task, lang)."""
    direct = aliases.join(configs.withColumnRenamed("output_alias", "alias").withColumn("how", F.lit("alias")), "alias", "left")
    keys = ["model", "task", "lang"]
    alone = configs.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("k = 1").drop("k", "output_alias")
    found = direct.where("how is not null")
    rest = direct.where("how is null").select("alias", F.col("base_model").alias("model"), F.col("train_task").alias("task"), F.col("train_lang").alias("lang"))
    fallback = rest.join(alone, keys).withColumn("how", F.lit("fallback"))
    columns = ["alias", "model", "task", "lang", "tuning_method", "how"]
    return found.select(*columns).unionByName(fallback.select(*columns))


def training_progress(epochs: DataFrame) -> DataFrame:
    """(alias, last, best): the last epoch row and the last one marked best."""
    row = F.struct("epoch", "step", "train_loss", "val_loss")
    return epochs.groupBy("alias").agg(
        F.max_by(row, "line_no").alias("last"), F.max_by(F.when(F.col("best"), row), F.when(F.col("best"), F.col("line_no"))).alias("best")
    )


def markdown_table(table: DataFrame, metric: str, digits: int = 3) -> str:
    """A report of (model, value, delta, reject), significant gains marked; a report is small."""
    lines = [f"| model | {metric} | delta |", "|---|---|---|"]
    for r in table.orderBy("model").collect():
        mark = "†" if r["reject"] and (r["delta"] or 0) > 0 else ""
        delta = "" if r["delta"] is None else f"{r['delta']:+.{digits}f}{mark}"
        lines.append(f"| {r['model']} | {r['value']:.{digits}f} | {delta} |")
    return "\n".join(lines)
