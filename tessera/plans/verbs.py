"""The engine's verbs as functions over files and tables: build, encode, search, rerank, expand, mine,
evaluate, aggregate, test.  Each returns a lazy frame unless it writes; all compose the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, evaluate, mine, plugins, report, rerank, sparse, stats
from ..session import materialize, spread
from ..sources import readers, writers

Analyzer = Callable[[Column], Column]
STRATEGIES = ("truncate", "maxp-doc", "maxp-q", "maxp-both")


def augmented_corpus(corpus: DataFrame, augmentation: DataFrame | None, suffix: str | None = None) -> DataFrame:
    """Left join with the augmentation; it needs a suffix so that its index has a name of its own."""
    if augmentation is None:
        return corpus
    if not suffix:
        raise ValueError("an augmentation needs a suffix")
    return corpus.join(augmentation, "doc_id", "left").withColumn("text", T.augment("text", "contents")).drop("contents")


def _tokens(lang: str, analyzer: Analyzer | None):
    """Token expression of a text column; the analyzer (such as ``english``) works on the token array."""
    return lambda c: T.analyzed(c, F.lit(lang)) if analyzer is None else analyzer(T.analyzed(c, F.lit(lang)))


def build_bm25_index(
    root: str, lang: str, corpus: DataFrame, augmentation: DataFrame | None = None, suffix: str | None = None, analyzer: Analyzer | None = None
) -> None:
    """Document index and collection statistics, kept if they exist; an index needs its own analyzer again in search."""
    docs = augmented_corpus(corpus, augmentation, suffix).withColumn("space", F.lit(lang))
    base = f"{root}/bm25_{lang}" + (f"_{suffix}" if suffix else "")
    writers.write_table(f"{base}/postings", sparse.postings(spread(docs), _tokens(lang, analyzer)("text")))
    writers.write_table(f"{base}/stats", sparse.index_stats(corpus.sparkSession.read.parquet(f"{base}/postings")))


def run_bm25(
    spark: SparkSession,
    root: str,
    lang: str,
    queries: DataFrame,
    expansions: DataFrame | None = None,
    suffix: str | None = None,
    k: int = 1000,
    analyzer: Analyzer | None = None,
) -> DataFrame:
    base = f"{root}/bm25_{lang}" + (f"_{suffix}" if suffix else "")
    index, coll = spark.read.parquet(f"{base}/postings"), spark.read.parquet(f"{base}/stats")
    tokens = _tokens(lang, analyzer)
    q = queries.withColumn("space", F.lit(lang))
    if expansions is None:
        return sparse.bm25_search(sparse.query_terms(q, tokens("text")), index, coll, k)
    both = q.join(expansions.where("expansion <> ''").select("qid", "expansion"), "qid", "left")
    has = F.col("expansion").isNotNull()
    plain = sparse.query_terms(both.where(~has), tokens("text"))
    heavy = sparse.query_terms(both.where(has), tokens("text"), float(T.QUERY_REPEATS))
    extra = sparse.query_terms(both.where(has), tokens("expansion"))
    return sparse.bm25_search(sparse.weighted_terms(plain.unionByName(heavy), extra), index, coll, k)


def _chunk_rows(texts: DataFrame, id_col: str, max_length: int | None) -> DataFrame:
    """(id, parent, text): the text itself, or one row per chunk; a blank text keeps one empty chunk."""
    if max_length is None:
        return texts.select(id_col, F.col(id_col).alias("parent"), "text")
    cut = T.chunks(T.tokens("text"), max_length)
    pieces = texts.select(F.col(id_col).alias("parent"), F.posexplode_outer(F.transform(cut, lambda c: F.array_join(c, " "))).alias("n", "text"))
    return pieces.select(F.concat_ws("#", "parent", F.coalesce("n", F.lit(0))).alias(id_col), "parent", F.coalesce("text", F.lit("")).alias("text"))


def encode_dense(texts: DataFrame, encoder: plugins.Encoder, is_query: bool, id_col: str = "doc_id", max_length: int | None = None) -> DataFrame:
    """(id, parent, embedding); ``max_length`` cuts texts into chunks first."""
    rows = _chunk_rows(texts, id_col, max_length)
    vectors = plugins.encode(rows, encoder, is_query, id_col)
    if max_length is None:
        return vectors.select(id_col, F.col(id_col).alias("parent"), "embedding")
    return vectors.select(id_col, F.regexp_extract(id_col, r"^(.*)#\d+$", 1).alias("parent"), "embedding")


def run_dense(queries: DataFrame, corpus: DataFrame, encoder: plugins.Encoder, strategy: str = "truncate", max_length: int = 512, k: int = 1000) -> DataFrame:
    strategy = "maxp-doc" if strategy == "maxp" else strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    chunk_d, chunk_q = strategy in ("maxp-doc", "maxp-both"), strategy in ("maxp-q", "maxp-both")
    # encoding is the costly part: once, into written tables
    docs = materialize(encode_dense(corpus, encoder, False, "doc_id", max_length if chunk_d else None))
    asked = materialize(encode_dense(queries, encoder, True, "qid", max_length if chunk_q else None))
    return dense.search(asked, docs, k)


def run_rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: plugins.PairScorer, top_k: int = 100) -> DataFrame:
    return rerank.rerank(rerank.candidate_texts(run, queries, corpus, top_k), scorer)


def run_listwise(run: DataFrame, queries: DataFrame, corpus: DataFrame, ranker: plugins.ListRanker, top_k: int = 100, window: int = 20, stride: int = 10) -> DataFrame:
    return rerank.listwise(rerank.candidate_texts(run, queries, corpus, top_k, True), ranker, window, stride)


def listwise_cost(cells: DataFrame, prices: DataFrame, top_k: int = 100, window: int = 20, stride: int = 10, input_tokens: int = 10_000, output_tokens: int = 100) -> DataFrame:
    return report.cost_estimate(cells, prices, len(rerank.window_starts(top_k, window, stride)), input_tokens, output_tokens)


def expansion_prompts(queries: DataFrame, family: str, task: str, lang: str, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, prompt) of ``queries`` (qid, text).  Keywords for an amended article need its pair (article_id_before,
    text_before, text_after); a query without one raises and names it."""
    if family == "task_q2e" and task == "rev2rev":
        if pairs is None:
            raise ValueError("task_q2e on rev2rev needs the article pairs")
        known = pairs.select(F.col("article_id_before").alias("qid"), "text_before", "text_after", F.lit(True).alias("known"))
        both = queries.join(known, "qid", "left")
        missing = F.raise_error(F.concat(F.lit("no article pair of query "), "qid")).cast("string")
        before = F.when(F.col("known"), F.col("text_before")).otherwise(missing)
        return both.select("qid", T.prompt(F.lit(family), "text", before, "text_after", F.lit(task), F.lit(lang)).alias("prompt"))
    return queries.select("qid", T.prompt(F.lit(family), "text", "text", F.lit(None).cast("string"), F.lit(task), F.lit(lang)).alias("prompt"))


def expand_queries(spark: SparkSession, path: str, prompts: DataFrame, generator: plugins.Generator) -> None:
    """Asks for what is not done yet and merges the answers into the file."""
    try:
        prompts = writers.not_done(prompts, readers.expansions(spark, path))
    except Exception as e:  # a first run has no file
        if "PATH_NOT_FOUND" not in str(e):
            raise
    writers.upsert_expansions(spark, path, plugins.generate(prompts, generator))


def persist_cell(run: DataFrame, judgments: DataFrame, task: str, k: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first k after the self filter, per-query metrics, means); judged queries are those of the run."""
    if task == "rev2rev":
        run = evaluate.ranked(evaluate.drop_self_matches(run).select("qid", "doc_id", "score"))
    own = judgments.join(run.select("qid").distinct(), "qid", "left_semi")
    scores = evaluate.per_query(run, own)
    return run.where(F.col("rank") <= k), scores, evaluate.mean_metrics(scores)


def evaluate_ranked(
    spark: SparkSession, run_path: str, qrels_path: str, task: str, policy: str = "zero", max_docs: int = 1000, filter_self_match: bool | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-query metrics, means, audit counters) of an external ranked run."""
    filter_self = task == "rev2rev" if filter_self_match is None else filter_self_match
    prepared = evaluate.prepare_lists(readers.ranked_lists(spark, run_path), max_docs, filter_self)
    judgments = readers.qrels(spark, qrels_path)
    run = evaluate.lists_to_run(prepared)
    evaluate.require_overlap(run, judgments)
    scores = evaluate.per_query(run, judgments, policy=policy)
    return scores, evaluate.mean_metrics(scores), evaluate.audit(prepared, judgments, filter_self)


def write_cell(root: str, run: DataFrame, judgments: DataFrame, model: str, task: str, lang: str, split: str = "test", k: int = 100) -> None:
    """Everything that is kept of one cell: the raw run, the first ``k`` after the self filter where second stages
    look for them, and the metrics with their per-query values as one JSON object."""
    run = materialize(run.select("qid", "doc_id", "score", "rank"))
    writers.write_run(f"{root}/{model}_runs/{task}_{lang}.jsonl", run)
    top, scores, means = persist_cell(run, judgments, task, k)
    writers.write_run(readers.first_stage_path(root, model, task, lang), top)
    per_query = evaluate.long_metrics(scores).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    # by its format a cell is one object with a small map for every judged query
    whole = per_query.agg(F.map_from_entries(F.collect_list(F.struct("qid", "m"))).alias("per_query"))
    metrics = F.create_map(*[x for m in evaluate.NAMES for x in (F.lit(m), F.col(m))]).alias("metrics")
    total = judgments.agg(F.countDistinct("qid").alias("n_queries_total"))
    cell = means.select("n_queries", metrics).join(total).join(whole)  # one row each
    labels = {"model": model, "task": task, "lang": lang, "split": split}
    named = cell.select(*[F.lit(v).alias(c) for c, v in labels.items()], F.lit(task == "rev2rev").alias("self_match_filtered"), "*")
    writers.write_json(f"{root}/metrics/{model}_{task}_{lang}.json", named)


Cells = Mapping[tuple[str, str], readers.Bundle]


def run_bm25_all(spark: SparkSession, root: str, cells: Cells, k: int = 1000) -> None:
    """BM25 over every (task, lang) of ``cells``, each persisted; the index of a language is built once."""
    for (task, lang), bundle in cells.items():
        build_bm25_index(root, lang, bundle.corpus)
        write_cell(root, run_bm25(spark, root, lang, bundle.queries, k=k), bundle.qrels, "bm25", task, lang, bundle.split)


def run_all(spark: SparkSession, root: str, cells: Cells, encoders: Mapping[str, plugins.Encoder], bm25: bool = True, k: int = 1000) -> None:
    """BM25 and every encoder over all cells; a language's corpus is encoded once per model."""
    if bm25:
        run_bm25_all(spark, root, cells, k)
    for model, encoder in encoders.items():
        for (task, lang), bundle in cells.items():
            path = f"{root}/vectors/{T.check_alias(model)}_{lang}"
            if not readers.exists(spark, path):
                writers.write_table(path, encode_dense(bundle.corpus, encoder, False))
            asked = materialize(encode_dense(bundle.queries, encoder, True, "qid"))
            write_cell(root, dense.search(asked, spark.read.parquet(path), k), bundle.qrels, model, task, lang, bundle.split)


@dataclass(frozen=True)
class TopBuild:
    path: str
    created: bool
    n_queries: int
    top_k: int


def build_top(spark: SparkSession, root: str, run: DataFrame, model: str, task: str, lang: str, split: str, k: int = 100, force: bool = False) -> TopBuild:
    """The first ``k`` of a training split's run after the self filter, kept if the file exists."""
    if split not in ("train", "validation"):
        raise ValueError("training lists are built for train and validation")
    path = writers.top_path(root, task, lang, model, split)
    created = force or not readers.exists(spark, path)
    if created:
        kept = evaluate.ranked(evaluate.drop_self_matches(run).select("qid", "doc_id", "score")) if task == "rev2rev" else run
        writers.write_run(path, kept, k)
    return TopBuild(path, created, readers.scored_run(spark, path).select("qid").distinct().count(), k)


def mine_chain(
    spark: SparkSession, root: str, run: DataFrame, judgments: DataFrame, model: str, task: str, lang: str, split: str, seed: int = 13, exact: bool = False, k: int = 100
) -> tuple[str, DataFrame]:
    """Search result to training file: self filter, first ``k``, mining, writing.  Returns (path, counters)."""
    top = readers.scored_run(spark, build_top(spark, root, run, model, task, lang, split, k).path)
    path = f"{root}/training_data/{split}/{task}_{lang}_{model}.jsonl"
    writers.write_triples(path, build_training_data(top, judgments, task, seed, exact, k))
    return path, mine.mining_counters(top, judgments, task == "rev2rev")


def listwise_ledger(path: str, calls: DataFrame, prices: DataFrame, config: Mapping[str, str]) -> None:
    """Totals per model with the calls of every query, written as JSON beside the cell; ``calls`` as in ``report.ledger``."""
    each = report.calls_per_query(calls).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("qid", "n_calls"))).alias("per_query_calls"))
    settings = F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]) if config else F.create_map().cast("map<string,string>")
    writers.write_json(path, report.ledger(calls, prices).join(each, "model").withColumn("config", settings))


def write_aggregate(path: str, cells: DataFrame, keep: Sequence[str] | None = None) -> None:
    writers.write_json(path, aggregate(cells, keep).orderBy("model"))


def build_training_data(run: DataFrame, judgments: DataFrame, task: str, seed: int = 13, exact: bool = False, k: int = 100) -> DataFrame:
    first = run.where(F.col("rank") <= k)
    return (mine.mine_replayed if exact else mine.mine_hashed)(first, judgments, task == "rev2rev", seed)


def aggregate(cells: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """(model, cells): metrics by task-lang of every model, optionally of a few."""
    wanted = cells.where(F.col("model").isin(list(keep))) if keep else cells
    pairs = F.collect_list(F.struct(F.concat_ws("-", "task", "lang").alias("k"), F.col("metrics").alias("v")))
    return wanted.groupBy("model").agg(F.map_from_entries(pairs).alias("cells"))


def ttest_holm(cells: DataFrame, baseline: str = "bm25") -> DataFrame:
    return stats.compare_to_baseline(readers.per_query_scores(cells), baseline)


def aggregate_domain_adaptation(
    cells: DataFrame, configs: DataFrame, metrics: Sequence[str] = ("recall_100", "ndcg_10"), epochs: DataFrame | None = None
) -> DataFrame:
    """Adapted cells beside their base cells with deltas, training method, significance against the own base (Holm
    within a cell and metric; a column ``significance`` of structs) and, with ``epochs`` (alias, line_no and
    the epoch columns), the training's last and best epoch, sorted for a report."""
    flat = cells.select("model", "task", "lang", *[F.col("metrics")[m].alias(m) for m in metrics])
    tuned = flat.where(T.is_tuned("model")).withColumn("p", T.parse_alias("model"))
    tuned = tuned.select("model", "task", "lang", *metrics, "p.base_model", "p.train_task", "p.train_lang")
    how = report.attach_configs(tuned.select(F.col("model").alias("alias"), "base_model", "train_task", "train_lang").distinct(), configs)
    with_base = report.deltas(tuned, flat.where(~T.is_tuned("model")), list(metrics))
    method = how.select(F.col("alias").alias("model"), "tuning_method")
    pairs = tuned.select(F.col("model").alias("method"), F.col("base_model").alias("baseline")).distinct()
    tests = stats.compare_adapted(readers.per_query_scores(cells), pairs, [evaluate.NAMES[m] for m in metrics])
    each = F.struct("metric", "n_queries", "meandiff", "t_stat", "p_raw", "p_adj_holm", "reject")
    found = tests.groupBy(F.col("method").alias("model"), "task", "lang").agg(F.array_sort(F.collect_list(each)).alias("significance"))
    out = with_base.join(method, "model", "left").join(found, ["model", "task", "lang"], "left")
    if epochs is not None:
        out = out.join(report.training_progress(epochs).withColumnRenamed("alias", "model"), "model", "left")
    return out.orderBy("base_model", "train_task", "train_lang", "model", "task", "lang")
