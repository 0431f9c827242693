"""Readers of retrieval experiment files; every reader states its schema and returns long tables.

JSON lines may be gzip-compressed (by extension); blank lines are skipped.  Ids are strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


@dataclass
class Bundle:
    """One (task, lang, split): corpus, queries restricted to judged ones, judgments."""

    task: str
    lang: str
    split: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.CORPUS).select(F.col("_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of non-blank lines; a large file is read in splits.

    Lines keep their order inside a split and a split is read by one task, so a line's number is its distance
    from the split's first line plus the lines of the splits before; only these counts, one row per
    split, are aggregated.  Blank lines count."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = lines.join(splits, ["path", "start"]).withColumn("line_no", F.col("at") - F.col("first") + F.col("before") + 1)
    return numbered.where(F.trim("value") != "").select("path", "line_no", "value")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, ord): ``ord`` keeps the file order."""
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", schemas.QUERIES))
    return parsed.select(F.col("r._id").alias("qid"), F.coalesce("r.text", F.lit("")).alias("text"), F.col("line_no").cast("long").alias("ord"))


def load_bundle(spark: SparkSession, corpus_path: str, queries_path: str, qrels_path: str, task: str, lang: str, split: str = "test") -> Bundle:
    """Validates the names and keeps the queries that are judged in the split."""
    for value, allowed in ((task, schemas.TASKS), (lang, schemas.LANGS), (split, schemas.SPLITS)):
        if value not in allowed:
            raise ValueError(f"{value!r} is not one of {allowed}")
    judged = qrels(spark, qrels_path)
    kept = queries(spark, queries_path).join(judged.select("qid").distinct(), "qid", "left_semi")
    return Bundle(task, lang, split, corpus(spark, corpus_path), kept, judged)


def first_queries(q: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queries of the file (a sampling option of the command line)."""
    return q.orderBy("ord").limit(n)


def scored_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, score, rank); a later line of the same query replaces an earlier one."""
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", schemas.SCORED_RUN))
    last = parsed.groupBy(F.col("r.qid").alias("qid")).agg(F.max_by("r.results", F.struct("path", "line_no")).alias("results"))
    return last.select("qid", F.posexplode("results").alias("pos", "pair")).select(
        "qid", F.col("pair")[0].alias("doc_id"), F.col("pair")[1].cast("double").alias("score"), (F.col("pos") + 1).alias("rank")
    )


class RankedListError(ValueError):
    """A ranked-list file breaks its contract."""


def _parse_ranked(line: str) -> tuple[str | None, list[str] | None, str | None]:
    try:
        record = json.loads(line)
    except ValueError:
        return None, None, "invalid JSON"
    if not isinstance(record, dict) or "qid" not in record or "ranked" not in record:
        return None, None, "qid and ranked are required"
    if not isinstance(record["ranked"], list):
        return None, None, "ranked must be a list"
    out = []
    for item in record["ranked"]:
        pair = isinstance(item, list) and len(item) == 2 and isinstance(item[1], (int, float)) and not isinstance(item[1], bool)
        doc = item[0] if pair else item
        if not isinstance(doc, str):
            return None, None, "ranked must hold document-ID strings"
        out.append(doc)
    return str(record["qid"]), out, None


def ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ranked): strict.  Spark's own JSON reader would turn numbers into strings silently, so
    lines are parsed in Arrow batches and the first broken one (file, line) is raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_parse_ranked(v) for v in pdf["value"]]
            yield pdf[["path", "line_no"]].assign(qid=[r[0] for r in rows], ranked=[r[1] for r in rows], error=[r[2] for r in rows])

    parsed = numbered_lines(spark, path).mapInPandas(
        run, "path string, line_no bigint, qid string, ranked array<string>, error string"
    )
    again = F.row_number().over(Window.partitionBy("qid").orderBy("path", "line_no"))
    parsed = parsed.withColumn(
        "error", F.when(F.col("error").isNull() & (again > 1), F.concat(F.lit("duplicate qid "), "qid")).otherwise(F.col("error"))
    )
    bad = parsed.where("error is not null").orderBy("path", "line_no").limit(1).collect()
    if bad:
        raise RankedListError(f"{bad[0]['path']}:{bad[0]['line_no']}: {bad[0]['error']}")
    return parsed.select("qid", "ranked")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of JSON lines or four blank-separated columns, decided line by line; the last
    line of a (qid, doc_id) wins; a missing score counts 0."""
    lines = numbered_lines(spark, path)
    is_json = F.ltrim("value").startswith("{")
    r, parts = F.from_json("value", schemas.QRELS), F.split(F.trim("value"), r"\s+")
    wide = F.when(is_json | (F.size(parts) == 4), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line_no"), F.lit(": expected JSON or four columns"))).cast("boolean")
    )
    rows = lines.where(wide).select(
        F.when(is_json, r["query-id"]).otherwise(parts[0]).alias("qid"),
        F.when(is_json, r["corpus-id"]).otherwise(parts[2]).alias("doc_id"),
        F.when(is_json, F.coalesce(r["score"], F.lit(0))).otherwise(parts[3].cast("int")).alias("rel"),
        "path",
        "line_no",
    )
    return rows.groupBy("qid", "doc_id").agg(F.max_by("rel", F.struct("path", "line_no")).alias("rel"))


def expansions(spark: SparkSession, path: str) -> DataFrame:
    """(qid, expansion, error): last record per query, records without a query skipped, null is ''."""
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", schemas.EXPANSION)).where("r.qid is not null")
    last = parsed.groupBy(F.col("r.qid").alias("qid")).agg(F.max_by("r", F.struct("path", "line_no")).alias("r"))
    return last.select("qid", F.coalesce("r.expansion", F.lit("")).alias("expansion"), F.col("r.error").alias("error"))


def augmentations(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.AUGMENTATION).select(F.col("id").alias("doc_id"), F.col("contents"))


def article_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(article_id_before, text_before, text_after): last record per article, null texts are ''."""
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", schemas.ARTICLE_PAIRS))
    parsed = parsed.where("r.article_id_before is not null and r.article_id_before <> ''")
    last = parsed.groupBy("r.article_id_before").agg(F.max_by("r", F.struct("path", "line_no")).alias("r"))
    return last.select("article_id_before", F.coalesce("r.text_before", F.lit("")).alias("text_before"), F.coalesce("r.text_after", F.lit("")).alias("text_after"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.TRIPLES)


def metric_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell file that has metrics; ledger files lack them and drop out."""
    read = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return read.schema(schemas.CELL).json(path).withColumn("file", F.input_file_name()).where(
        ~F.col("file").endswith(".api_ledger.json") & F.col("metrics").isNotNull()
    )


def per_query_scores(cells: DataFrame) -> DataFrame:
    """(model, task, lang, qid, metric, value) of the cells' per-query maps."""
    once = cells.where("per_query is not null").select("model", "task", "lang", F.explode("per_query").alias("qid", "m"))
    return once.select("model", "task", "lang", "qid", F.explode("m").alias("metric", "value"))


def complete_cells(cells: DataFrame, names: list[str]) -> DataFrame:
    """(file, complete): all metrics are there and finite."""
    ok = F.lit(True)
    for n in names:
        v = F.col("metrics")[n]
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return cells.select("file", F.coalesce(ok, F.lit(False)).alias("complete"))


def train_configs(spark: SparkSession, path: str) -> DataFrame:
    """One config per output alias; on a clash the one whose folder is named like its model."""
    read = spark.read.option("multiLine", True).schema(schemas.TRAIN_CONFIG).json(path).withColumn("file", F.input_file_name())
    folder = F.element_at(F.split("file", "/"), -2)
    w = Window.partitionBy("output_alias").orderBy((folder == F.col("model")).desc(), "file")
    return read.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "file")


def epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", schemas.EPOCHS))
    return parsed.select("line_no", "r.*")


def first_stage_run(spark: SparkSession, root: str, key: str, task: str, lang: str, k: int | None = None) -> DataFrame:
    """The first-stage run that a second stage starts from; says which file is missing if there is none."""
    path = first_stage_path(root, key, task, lang)
    if not exists(spark, path):
        raise FileNotFoundError(f"no first-stage run at {path}: search with {key} first")
    run = scored_run(spark, path)
    return run.where(F.col("rank") <= k) if k else run


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_stage_path(root: str, key: str, task: str, lang: str) -> str:
    """Where the first 100 of a first-stage run lie."""
    if key == "bm25":
        return f"{root}/bm25_top100/{task}_{lang}.jsonl"
    return f"{root}/dense_top100/{task}_{lang}_{key}.jsonl"
