"""The dataflow part of contrastive training: logits, masks, loss, schedules, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MASKED = -1e30


def batch_logits(batch: DataFrame, queries: DataFrame, documents: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(row, col, cand_id, is_label, logit): all queries of one batch against [positives; negatives].

    ``batch`` (row, qid, positive_doc_id, hard_negative_doc_id), rows 0..B-1; ``queries`` and
    ``documents`` hold vectors.  The batch is a training batch, hence small; columns B.. are negatives.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    sized = batch.withColumn("n", n)
    cands = sized.select(
        F.explode(
            F.array(
                F.struct(F.col("row").alias("col"), F.col("positive_doc_id").alias("cand_id")),
                F.struct((F.col("row") + F.col("n")).alias("col"), F.col("hard_negative_doc_id").alias("cand_id")),
            )
        ).alias("c")
    ).select("c.*")
    q = batch.select("row", "qid").join(queries, "qid").select("row", F.col("embedding").alias("q"))
    d = cands.join(documents.select(F.col("doc_id").alias("cand_id"), F.col("embedding").alias("d")), "cand_id")
    dot = F.aggregate(F.zip_with("q", "d", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    # B queries against their 2B in-batch candidates, B being the batch size
    return q.join(F.broadcast(d)).select(
        "row", "col", "cand_id", (F.col("col") == F.col("row")).alias("is_label"), (dot / temperature).alias("logit")
    )


def mask_known_positives(logits: DataFrame, positives: DataFrame) -> DataFrame:
    """Other known positives of the row's query become ``MASKED``; the label always stays."""
    joined = logits.join(positives.select("row", "qrel_positive_doc_ids"), "row", "left")
    known = F.coalesce(F.array_contains("qrel_positive_doc_ids", F.col("cand_id")), F.lit(False))
    return joined.withColumn("masked", known & ~F.col("is_label")).withColumn(
        "logit", F.when(F.col("masked"), F.lit(MASKED)).otherwise(F.col("logit"))
    ).drop("qrel_positive_doc_ids")


def row_losses(logits: DataFrame) -> DataFrame:
    """(row, loss): cross entropy with the label, stable by subtracting the row's maximum."""
    top = logits.groupBy("row").agg(F.max("logit").alias("top"), F.max(F.when(F.col("is_label"), F.col("logit"))).alias("label"))
    sums = logits.join(top, "row").groupBy("row", "top", "label").agg(F.sum(F.exp(F.col("logit") - F.col("top"))).alias("z"))
    return sums.select("row", (F.col("top") + F.log("z") - F.col("label")).alias("loss"))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


def weighted_mean_loss(parts: DataFrame) -> DataFrame:
    """Mean of batch losses weighted by batch size (loss, n)."""
    return parts.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def learning_rate(steps: DataFrame, base: float, warmup: int, total: int) -> DataFrame:
    """Linear warm-up, then linear decay to zero, as a function of ``step``."""
    s = F.col("step")
    up = s / F.lit(max(1, warmup))
    down = F.greatest(F.lit(0.0), (F.lit(total) - s) / F.lit(max(1, total - warmup)))
    return steps.withColumn("lr", F.lit(base) * F.when(s < warmup, up).otherwise(down))


def early_stopping(epochs: DataFrame, patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """Adds ``best``, ``bad_epochs`` and ``stop`` to (epoch, val_loss).

    An epoch improves when its loss is below the best so far minus ``min_delta``.  The fold needs every
    epoch in order; epochs of one training are few, hence one ordered array.
    """
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "val_loss")))
    start = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(False).alias("done"),
        F.array().cast("array<struct<epoch:bigint,val_loss:double,best:boolean,bad_epochs:int,stop:boolean>>").alias("rows"),
    )

    def step(acc, x):
        better = x["val_loss"] < acc["best"] - F.lit(min_delta)
        bad = F.when(better, F.lit(0)).otherwise(acc["bad"] + 1)
        row = F.struct(
            x["epoch"].cast("bigint").alias("epoch"), x["val_loss"].cast("double").alias("val_loss"), better.alias("best"),
            bad.alias("bad_epochs"), (bad >= patience).alias("stop"),
        )
        new = F.struct(
            F.when(better, x["val_loss"]).otherwise(acc["best"]).alias("best"), bad.alias("bad"),
            (acc["done"] | (bad >= patience)).alias("done"), F.concat(acc["rows"], F.array(row)).alias("rows"),
        )
        return F.when(acc["done"], acc).otherwise(new)

    folded = epochs.agg(F.aggregate(ordered, start, step, lambda a: a["rows"]).alias("rows"))
    return folded.select(F.explode("rows").alias("r")).select("r.*")


def collate(examples: DataFrame, batch_size: int) -> DataFrame:
    """(batch, rows): examples in their given order ``ord`` grouped into batches."""
    return examples.withColumn("batch", F.floor(F.col("ord") / batch_size)).groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct("ord", "qid", "positive_doc_id", "hard_negative_doc_id"))).alias("rows")
    )
