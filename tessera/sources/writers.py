"""Sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder


def run_lines(run: DataFrame, top_k: int | None = None) -> DataFrame:
    """(qid, value): one JSON line per query with its ``[[doc, score], …]``, best first.

    Arrays of mixed types are assembled as text because a JSON writer's arrays hold one type.
    """
    kept = run.where(F.col("rank") <= top_k) if top_k else run
    pair = F.concat(F.lit("["), F.to_json(F.struct(F.col("doc_id").alias("d"))), F.lit(", "), F.col("score").cast("string"), F.lit("]"))
    pair = F.regexp_replace(pair, r'^\[\{"d":(.*)\}, ', r"[$1, ")
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", pair.alias("pair")))).alias("l"))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("qid").alias("q"))), r'^\{"q":(.*)\}$', "$1")
    body = F.array_join(F.transform("l", lambda x: x["pair"]), ", ")
    return lists.select("qid", F.concat(F.lit('{"qid": '), quoted, F.lit(', "results": ['), body, F.lit("]}")).alias("value"))


def write_run(path: str, run: DataFrame, top_k: int | None = None) -> None:
    run_lines(run, top_k).orderBy("qid").select("value").write.mode("overwrite").text(path)


def write_triples(path: str, triples: DataFrame) -> None:
    triples.select("qid", "positive_doc_id", "hard_negative_doc_id").write.mode("overwrite").json(path)


def top_path(root: str, task: str, lang: str, model: str, split: str) -> str:
    """Where the first documents of a dense run lie: training splits in folders of their own, test beside them."""
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown split {split!r}")
    return f"{root}/dense_top100/{'' if split == 'test' else split + '/'}{task}_{lang}_{model}.jsonl"


def write_top(root: str, run: DataFrame, task: str, lang: str, model: str, k: int = 100) -> dict[str, str]:
    """Writes the first ``k`` of every query of ``run`` (split, qid, doc_id, score, rank), one file per split.

    Returns split -> path.  Rows without a split or of an unknown one raise: nothing is dropped."""
    if not run.where("split is null or split not in ('train', 'validation', 'test')").isEmpty():
        raise ValueError("a row of the run has no known split")
    out = {r["split"]: top_path(root, task, lang, model, r["split"]) for r in run.select("split").distinct().collect()}  # at most three
    for split, path in sorted(out.items()):
        write_run(path, run.where(F.col("split") == split), k)
    return out


def write_index_corpus(path: str, corpus: DataFrame) -> None:
    """``{"id", "contents"}`` lines, kept if they exist."""
    corpus.select(F.col("doc_id").alias("id"), F.col("text").alias("contents")).write.mode("ignore").json(path)


def write_table(path: str, df: DataFrame, partition_by: list[str] | None = None, mode: str = "ignore") -> None:
    """Indexes, vectors and other artefacts; kept if they exist unless told otherwise."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def content_path(root: str, name: str, df: DataFrame) -> str:
    """A path that names its content: an artefact of other data never passes for this one."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{root}/{name}-{row['n']}-{abs(int(row['h'] or 0)):x}"


def upsert_expansions(spark, path: str, new: DataFrame) -> None:
    """Overlays existing records by query (new replaces old), sorted, through a staging folder.

    A query that is new several times keeps one record, a non-empty answer before an empty one.  The old
    folder is moved aside, the new one moved in, then the old one deleted: one of the two is always
    there, and a leftover of a crash between the moves is moved back first."""
    from . import readers

    recover(spark, path)
    record = F.struct((F.coalesce("expansion", F.lit("")) != "").alias("answered"), "expansion", "error")
    merged = new.groupBy("qid").agg(F.max(record).alias("r")).select("qid", "r.expansion", "r.error")
    if readers.exists(spark, path):
        merged = readers.expansions(spark, path).join(new.select("qid"), "qid", "left_anti").unionByName(merged)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    merged.orderBy("qid").write.json(staging)
    swap_in(spark, staging, path)


def _move(spark, source: str, target: str) -> None:
    a, b = spark._jvm.org.apache.hadoop.fs.Path(source), spark._jvm.org.apache.hadoop.fs.Path(target)
    if not a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"could not move {source} to {target}")


def swap_in(spark, staging: str, path: str) -> None:
    """Puts a written folder in the place of another."""
    from .readers import exists

    if exists(spark, path):
        _move(spark, path, f"{path}.old")
    _move(spark, staging, path)
    remove_folder(spark, f"{path}.old")


def recover(spark, path: str) -> None:
    """Ends a swap that was interrupted: without a folder at ``path`` the old one moves back."""
    from .readers import exists

    if exists(spark, f"{path}.old"):
        if exists(spark, path):
            remove_folder(spark, f"{path}.old")
        else:
            _move(spark, f"{path}.old", path)


def not_done(queries: DataFrame, existing: DataFrame) -> DataFrame:
    """Queries without a non-empty expansion yet."""
    return queries.join(existing.where("expansion is not null and expansion <> ''"), "qid", "left_anti")


def append_log(path: str, rows: DataFrame) -> None:
    rows.write.mode("append").json(path)


def write_csv(path: str, table: DataFrame) -> None:
    """One CSV file with a header; reports are small."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, table: DataFrame) -> None:
    table.coalesce(1).write.mode("overwrite").json(path)
