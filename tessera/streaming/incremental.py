"""Evaluation of shard lists as they arrive.

The stream reads list files; every micro-batch is reduced to the hits it brings, and the hits are
appended to a written table keyed by batch, so a batch that is repeated after a failure replaces
itself.  The answer at any time is one aggregation over that table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def recall_from_stream(spark: SparkSession, path: str, judgments: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """(model_key, n_relevant_found, n_judged): distinct relevant documents any shard returned."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a stream watches folders: a table that is one file is matched by name in its folder
    folder, name = path.rsplit("/", 1)
    lists = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    stream = lists.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else lists.parquet(path)
    relevant = judgments.where("rel > 0").select("qid", "doc_id")

    def absorb(batch: DataFrame, number: int) -> None:
        rows = batch.select("model_key", "qid", F.explode("ranked").alias("doc_id"))
        hits = rows.join(relevant, ["qid", "doc_id"]).select("model_key", "qid", "doc_id").distinct()
        hits.write.mode("overwrite").parquet(f"{root}/hits/batch={number}")

    (
        stream.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", f"{root}/log")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    hits = spark.read.schema("model_key string, qid string, doc_id string").parquet(f"{root}/hits/*")
    judged = relevant.agg(F.count(F.lit(1)).alias("n_judged"))
    found = hits.distinct().groupBy("model_key").agg(F.count(F.lit(1)).alias("n_relevant_found"))
    return found.join(F.broadcast(judged))  # one row


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
