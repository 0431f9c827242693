"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def build_session(app: str = "tessera", cpus: int | None = None, shuffle_partitions: int = 16) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 2
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.  Where none is configured, a temporary one, but only for a local
    master: executors on other machines would not see it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once to the shared folder, so lost executors do not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tables_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: cuts lineage, survives lost executors, keeps column pruning.

    Tables stay as long as frames may read them; ``drop_tables`` removes them."""
    path = f"{tables_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; call it once their results are written."""
    if spark.sparkContext.getCheckpointDir():
        remove_folder(spark, tables_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Removes intermediate tables at the end of a block that writes its results inside it."""
    try:
        yield
    finally:
        drop_tables(spark)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows over all tasks (by columns, for a join by them) if the input comes in far fewer parts; otherwise as
    it is.  For scans only: of a frame with a shuffle, counting its parts would run it."""
    width = shuffle_width(df.sparkSession)
    return df.repartition(width, *by) if input_partitions(df) < width // 2 else df
