"""Queries of the file formats: tables are written in a format by the sinks and read again by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report
from ..session import read_table, tables_folder
from ..sources import readers, writers
from . import retrieval as R

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    return f"{tables_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, zipped: bool = False) -> str:
    w = df.write.option("ignoreNullFields", False)
    (w.option("compression", "gzip") if zipped else w).json(path)
    return path


@query("SELECT _id AS doc_id, md5(coalesce(text, '')) AS text_md5 FROM corpus")
def file_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Corpus as gzip-compressed JSON lines."""
    path = _lines(read_table(spark, base, "corpus").select("_id", "text"), f"{_folder(spark)}/corpus", True)
    return readers.corpus(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT _id AS id, md5(coalesce(text, '')) AS contents_md5 FROM corpus")
def file_index_corpus(spark: SparkSession, base: str) -> DataFrame:
    path = f"{_folder(spark)}/index"
    writers.write_index_corpus(path, read_table(spark, base, "corpus").select(F.col("_id").alias("doc_id"), T.text_or_empty("text").alias("text")))
    return readers.augmentations(spark, path).select(F.col("doc_id").alias("id"), F.md5("contents").alias("contents_md5"))


_CELL = "task = 'rat2rev' AND lang = 'en' AND split = 'test'"


@query(f"""WITH j AS (SELECT query_id AS qid, corpus_id AS doc_id, coalesce(score, 0) AS rel, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY qrel_id DESC) AS n
  FROM qrels WHERE {_CELL} AND query_id IS NOT NULL AND corpus_id IS NOT NULL)
SELECT q._id AS qid, md5(coalesce(q.text, '')) AS text_md5, count(*) AS n_judged, CAST(sum(rel) AS BIGINT) AS sum_rel FROM queries q JOIN j ON j.qid = q._id AND j.n = 1 GROUP BY q._id, q.text""")
def file_bundle(spark: SparkSession, base: str) -> DataFrame:
    """One (task, lang, split): queries restricted to judged ones, judgments as JSON lines."""
    root = _folder(spark)
    corpus = _lines(read_table(spark, base, "corpus").where("lang = 'en'").select("_id", "text"), f"{root}/corpus")
    queries = _lines(read_table(spark, base, "queries").select("_id", "text"), f"{root}/queries")
    j = read_table(spark, base, "qrels").where(_CELL).where("query_id is not null and corpus_id is not null").orderBy("qrel_id")
    qrels = _lines(j.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score"), f"{root}/qrels")
    b = readers.load_bundle(spark, corpus, queries, qrels, "rat2rev", "en", "test")
    both = b.queries.join(b.qrels, "qid").groupBy("qid", "text").agg(F.count(F.lit(1)).alias("n_judged"), F.sum("rel").alias("sum_rel"))
    return both.select("qid", F.md5("text").alias("text_md5"), "n_judged", "sum_rel")


@query(f"WITH {R._JUDGED} SELECT trim(qid) AS qid, trim(doc_id) AS doc_id, max(rel) AS rel FROM judged GROUP BY ALL")
def file_qrels_columns(spark: SparkSession, base: str) -> DataFrame:
    """Judgments as four blank-separated columns, a format whose ids have no blanks at their ends."""
    path = f"{_folder(spark)}/qrels"
    judged = R._judged(spark, base).groupBy(F.trim("qid").alias("qid"), F.trim("doc_id").alias("doc_id")).agg(F.max("rel").alias("rel"))
    judged.select(F.concat_ws(" ", "qid", F.lit("0"), "doc_id", F.col("rel").cast("string"))).write.text(path)
    return readers.qrels(spark, path)


@query(f"WITH {R._FIRST.split(', pool AS')[0]} SELECT f.qid, f.doc_id, s.score, f.rank FROM first f JOIN (SELECT qid, doc_id, max(score) AS score FROM (SELECT qid, unnest(ranked) AS doc_id, unnest(scores) AS score FROM dense_runs) WHERE NOT isnan(score) GROUP BY ALL) s ON s.qid = f.qid AND s.doc_id = f.doc_id WHERE f.rank <= 20")
def file_run(spark: SparkSession, base: str) -> DataFrame:
    """A scored run, cut to 20 when written."""
    path = f"{_folder(spark)}/run"
    writers.write_run(path, R._first_hundred(spark, base), 20)
    return readers.scored_run(spark, path)


@query("""WITH l AS (SELECT qid, ranked FROM (SELECT qid, ranked, row_number() OVER (PARTITION BY qid ORDER BY model_key, shard, encoded_at, array_to_string(ranked, ',')) AS n
  FROM dense_runs WHERE ranked IS NOT NULL AND qid IS NOT NULL) WHERE n = 1)
SELECT qid, len(ranked) AS n_ranked, md5(array_to_string(ranked, ',')) AS ranked_md5 FROM l""")
def file_ranked_lists(spark: SparkSession, base: str) -> DataFrame:
    """The first list of every query through the strict reader."""
    rows = read_table(spark, base, "dense_runs").where("ranked is not null and qid is not null")
    first = rows.groupBy("qid").agg(F.min_by("ranked", F.struct("model_key", "shard", "encoded_at", F.array_join("ranked", ","))).alias("ranked"))
    lists = readers.ranked_lists(spark, _lines(first, f"{_folder(spark)}/lists"))
    return lists.select("qid", F.size("ranked").cast("long").alias("n_ranked"), F.md5(F.array_join("ranked", ",")).alias("ranked_md5"))


@query("""WITH last AS (SELECT qid, family, coalesce(expansion, '') AS e, row_number() OVER (PARTITION BY qid, family ORDER BY exp_id DESC) AS n FROM expansions WHERE qid IS NOT NULL),
a AS (SELECT qid, e FROM last WHERE n = 1 AND family = 'q2d_zs'), b AS (SELECT qid, e FROM last WHERE n = 1 AND family = 'q2e_zs')
SELECT coalesce(a.qid, b.qid) AS qid, md5(coalesce(b.e, a.e)) AS text_md5, coalesce(b.e, a.e) <> '' AS done FROM a FULL JOIN b ON a.qid = b.qid""")
def file_expansions(spark: SparkSession, base: str) -> DataFrame:
    """Answers of one family, overlaid by those of another."""
    path = f"{_folder(spark)}/expansions"
    for family in ("q2d_zs", "q2e_zs"):
        writers.upsert_expansions(spark, path, R._last_expansion(spark, base, family).withColumn("error", F.lit(None).cast("string")))
    there = readers.expansions(spark, path)
    open_ = writers.not_done(there.select("qid"), there).withColumn("open", F.lit(True))
    return there.join(open_, "qid", "left").select("qid", F.md5("expansion").alias("text_md5"), F.col("open").isNull().alias("done"))


@query("""SELECT article_id_before, md5(coalesce(text_before, '')) AS before_md5, md5(coalesce(text_after, '')) AS after_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id_before ORDER BY pair_id DESC) AS n FROM article_pairs WHERE coalesce(article_id_before, '') <> '') WHERE n = 1""")
def file_article_pairs(spark: SparkSession, base: str) -> DataFrame:
    """The last record of every article, in the order of the file."""
    ordered = read_table(spark, base, "article_pairs").orderBy("pair_id").select("article_id_before", "text_before", "text_after")
    pairs = readers.article_pairs(spark, _lines(ordered, f"{_folder(spark)}/pairs"))
    return pairs.select("article_id_before", F.md5("text_before").alias("before_md5"), F.md5("text_after").alias("after_md5"))


@query("SELECT qid, positive_doc_id, hard_negative_doc_id, count(*) AS n FROM training_examples GROUP BY ALL")
def file_triples(spark: SparkSession, base: str) -> DataFrame:
    path = f"{_folder(spark)}/triples"
    writers.write_triples(path, read_table(spark, base, "training_examples"))
    return readers.triples(spark, path).groupBy("qid", "positive_doc_id", "hard_negative_doc_id").agg(F.count(F.lit(1)).alias("n"))


def _cells(spark: SparkSession, base: str, path: str) -> DataFrame:
    """One JSON object per (model, task, lang) with its metrics and per-query metrics, read again."""
    long = R._long(spark, base).groupBy("model", "task", "lang", "qid").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    cells = long.groupBy("model", "task", "lang").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.create_map(F.lit("recall_100"), F.avg(F.col("m")["R@100"]), F.lit("ndcg_10"), F.avg(F.col("m")["nDCG@10"])).alias("metrics"),
        F.map_from_entries(F.collect_list(F.struct("qid", "m"))).alias("per_query"),
    )
    cells.withColumn("split", F.lit("test")).write.option("maxRecordsPerFile", 1).json(path)
    return readers.metric_cells(spark, path)


@query(f"""WITH {R._PER_QUERY} SELECT p.model_key AS model, q.task, q.lang, count(*) AS n_queries, round(avg(recall_100), 6) AS recall_100, round(avg(ndcg_10), 6) AS ndcg_10,
  count(*) * 7 AS n_values, true AS complete FROM per_query p JOIN queries q ON q._id = p.qid GROUP BY ALL""")
def file_metric_cells(spark: SparkSession, base: str) -> DataFrame:
    cells = _cells(spark, base, f"{_folder(spark)}/cells")
    values = readers.per_query_scores(cells).groupBy("model", "task", "lang").agg(F.count(F.lit(1)).alias("n_values"))
    complete = readers.complete_cells(cells, ["recall_100", "ndcg_10"])
    both = cells.join(complete, "file").join(values, ["model", "task", "lang"])
    metric = lambda m: F.round(F.col("metrics")[m], 6).alias(m)
    return both.select("model", "task", "lang", "n_queries", metric("recall_100"), metric("ndcg_10"), "n_values", "complete")


@query(f"""WITH {R._PER_QUERY}, c AS (SELECT p.model_key AS model, q.task || '-' || q.lang AS cell, round(avg(recall_100), 6) AS v FROM per_query p JOIN queries q ON q._id = p.qid GROUP BY ALL)
SELECT model, string_agg(cell || '=' || CAST(v AS DECIMAL(9, 6)), ';' ORDER BY cell) AS cells FROM c GROUP BY model""")
def file_aggregate(spark: SparkSession, base: str) -> DataFrame:
    """The aggregate of all cells by model, as a map of cells."""
    from . import verbs

    table = verbs.aggregate(_cells(spark, base, f"{_folder(spark)}/cells"))
    entry = F.transform(
        F.array_sort(F.map_keys("cells")),
        lambda k: F.concat(k, F.lit("="), F.round(F.element_at(F.element_at("cells", k), F.lit("recall_100")), 6).cast("decimal(9,6)").cast("string")),
    )
    return table.select("model", F.array_join(entry, ";").alias("cells"))


_SUFFIXES = ("", "-ft-rat2rev-en", "-lora-ft-rev2rev-ja", "-x.y-ft-rev2rev-en")


@query(f"""WITH a AS (SELECT model_key || unnest([{", ".join(f"'{x}'" for x in _SUFFIXES)}]) AS alias FROM top100_builds),
p AS (SELECT alias, regexp_extract(alias, '^(.+?)-(lora-)?ft-(rat2rev|rev2rev)-(en|ja)$', ['b', 'm', 't', 'l']) AS p FROM a)
SELECT alias, nullif(p.b, '') AS base_model, CASE WHEN p.b = '' THEN NULL WHEN p.m = '' THEN 'full' ELSE 'lora' END AS tuning_method,
  nullif(p.t, '') AS train_task, nullif(p.l, '') AS train_lang, contains(alias, '-ft-') AS tuned FROM p""")
def alias_parts(spark: SparkSession, base: str) -> DataFrame:
    """Parts of plain and tuned model names."""
    names = F.explode(F.array(*[F.concat("model_key", F.lit(x)) for x in _SUFFIXES])).alias("alias")
    parts = read_table(spark, base, "top100_builds").select(names).withColumn("p", T.parse_alias("alias"))
    return parts.select("alias", "p.*", T.is_tuned("alias").alias("tuned"))


@query("""WITH c AS (SELECT model_key AS model, task, lang, avg(len(ranked)) AS v FROM dense_runs WHERE ranked IS NOT NULL GROUP BY ALL)
SELECT a.model, a.task, a.lang, round(a.v, 6) AS v, round(a.v - b.v, 6) AS delta_v FROM c a LEFT JOIN c b ON b.model = 'enc-multi-base' AND a.task = b.task AND a.lang = b.lang WHERE a.model <> 'enc-multi-base'""")
def deltas_to_base(spark: SparkSession, base: str) -> DataFrame:
    """Cells beside those of a base model with their difference."""
    cells = read_table(spark, base, "dense_runs").where("ranked is not null").groupBy(F.col("model_key").alias("model"), "task", "lang").agg(F.avg(F.size("ranked")).alias("v"))
    own = cells.where("model = 'enc-multi-base'")
    rest = cells.where("model <> 'enc-multi-base'").withColumn("base_model", F.lit("enc-multi-base"))
    return report.deltas(rest, own, ["v"]).select("model", "task", "lang", F.round("v", 6).alias("v"), "delta_v")
