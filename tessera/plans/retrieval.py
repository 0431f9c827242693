"""Queries of the retrieval, evaluation and significance operators, with their SQL.

Searches take as queries every row whose id is divisible by 50 (``ord`` of queries, ``vec_id`` of
embeddings) against all rows; everything else runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english
from ..functions import text as T
from ..operators import construct, dense, evaluate, mine, plugins, report, rerank, sparse, stats
from ..session import materialize, read_table, spread

EVERY = 50
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---- shared pieces -----------------------------------------------------------------------------

TOKENS = "list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _analyzed_sql(name: str, source: str, keep: str, text: str, lang: str) -> str:
    """CTE ``name`` (keep, tokens) over ``source``: words, or pairs of neighbouring characters for ja.

    The pairs are zipped lists: a lambda that captures a whole list would copy it per element."""
    return f"""{name}_words AS (SELECT {keep}, {lang} AS lang_of, {TOKENS.format(text)} AS words FROM {source}
), {name}_chars AS (SELECT *, CASE WHEN lang_of = 'ja' THEN string_split(array_to_string(words, ''), '') END AS chars FROM {name}_words
), {name} AS (SELECT * EXCLUDE (lang_of, words, chars), CASE WHEN lang_of = 'ja'
  THEN list_transform(list_zip(chars[1:len(chars) - 1], chars[2:len(chars)]), lambda p: p[1] || p[2]) ELSE words END AS tokens FROM {name}_chars)"""


_JUDGED = """judged AS (
  SELECT qid, doc_id, rel FROM (
    SELECT query_id AS qid, corpus_id AS doc_id, coalesce(score, 0) AS rel,
      row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY loaded_at DESC NULLS LAST, qrel_id DESC) AS n
    FROM qrels WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL) WHERE n = 1
)"""


def _judged(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "qrels").select(
        F.col("query_id").alias("qid"), F.col("corpus_id").alias("doc_id"), F.col("score").alias("rel"), "loaded_at", "qrel_id"
    )
    return evaluate.last_wins(rows, ["loaded_at", "qrel_id"])


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "corpus").select(F.col("_id").alias("doc_id"), F.col("lang").alias("space"), "lang", "text")


def _asked(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").where(F.col("ord") % EVERY == 0)
    return q.select(F.col("_id").alias("qid"), F.col("lang").alias("space"), "lang", "task", "text")


_DOCS = _analyzed_sql("docs", "corpus", "_id AS doc_id, lang AS space", "text", "lang")
_ASKED = _analyzed_sql("asked", f"(SELECT * FROM queries WHERE ord % {EVERY} = 0)", "_id AS qid, lang AS space, lang, task, text", "text", "lang")
_TERMS = """terms AS (
  SELECT space, qid, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT space, qid, unnest(tokens) AS term FROM asked) GROUP BY ALL
)"""
_BM25 = """postings AS (
  SELECT space, doc_id, term, dl, count(*) AS tf FROM (SELECT space, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY ALL
), dfs AS (
  SELECT space, term, count(*) AS df FROM postings GROUP BY ALL
), coll AS (
  SELECT space, count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM docs GROUP BY ALL
), scored AS (
  SELECT t.qid, p.doc_id, round(sum(t.qtf * ln(1.0 + (c.n_docs - d.df + 0.5) / (d.df + 0.5)) * (p.tf / (p.tf + 0.9 * (1.0 - 0.4 + 0.4 * p.dl / c.avgdl)))), 6) AS score
  FROM terms t JOIN dfs d ON t.space = d.space AND t.term = d.term JOIN coll c ON c.space = t.space
  JOIN postings p ON p.space = t.space AND p.term = t.term GROUP BY ALL
), ranked AS (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM scored
)"""


def _metric_sql(run: str, judged: str, by: str = "", policy: str = "zero") -> str:
    """CTE ``per_query`` over tables named in ``run`` (by, qid, doc_id, rank) and ``judged`` (qid, doc_id, rel)."""
    c = f"{by}, " if by else ""
    hb = f"r.{by}, " if by else ""
    on = f"AND f.{by} = u.{by}" if by else ""
    universe = (
        f"SELECT DISTINCT {hb} i.* FROM {run} r JOIN ideal i ON r.qid = i.qid"
        if policy == "skip"
        else (f"SELECT c.{by}, i.* FROM ideal i, (SELECT DISTINCT {by} FROM {run}) c" if by else "SELECT * FROM ideal")
    )
    cuts = (10, 100, 1000)
    ideal = ", ".join(f"sum(CASE WHEN place <= {k} THEN rel / log2(place + 1) END) AS ideal_{k}" for k in cuts)
    hits = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS hits_{k}, sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) END) AS dcg_{k}"
        for k in cuts
    )
    out = ", ".join(
        f"CASE WHEN n_rel > 0 THEN coalesce(hits_{k}, 0) / n_rel ELSE 0 END AS recall_{k},"
        f" CASE WHEN ideal_{k} > 0 THEN coalesce(dcg_{k}, 0) / ideal_{k} ELSE 0 END AS ndcg_{k}"
        for k in cuts
    )
    return f"""ideal AS (
  SELECT qid, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS n_rel, {ideal} FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM {judged}) GROUP BY qid
), hits AS (
  SELECT {hb} r.qid, r.rank, j.rel, row_number() OVER (PARTITION BY {hb} r.qid ORDER BY r.rank) AS nth
  FROM {run} r JOIN {judged} j ON r.qid = j.qid AND r.doc_id = j.doc_id WHERE j.rel > 0
), found AS (
  SELECT {c} qid, {hits}, sum(nth / rank) AS precisions FROM hits GROUP BY {c} qid
), universe AS ({universe}
), per_query AS (
  SELECT {f'u.{by}, ' if by else ''} u.qid, {out}, CASE WHEN n_rel > 0 THEN coalesce(precisions, 0) / n_rel ELSE 0 END AS map
  FROM universe u LEFT JOIN found f ON f.qid = u.qid {on}
)"""


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.NAMES)

# ---- scans -------------------------------------------------------------------------------------


@query("SELECT _id AS doc_id, lang, length(coalesce(text, '')) AS n_chars FROM corpus")
def corpus_scan(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "corpus")
    return c.select(F.col("_id").alias("doc_id"), "lang", F.char_length(T.text_or_empty("text")).cast("long").alias("n_chars"))


@query("SELECT _id AS qid, task, lang FROM queries WHERE _id IN (SELECT query_id FROM qrels WHERE split = 'test')")
def judged_queries(spark: SparkSession, base: str) -> DataFrame:
    judged = read_table(spark, base, "qrels").where("split = 'test'").select(F.col("query_id").alias("_id"))
    return read_table(spark, base, "queries").join(judged, "_id", "left_semi").select(F.col("_id").alias("qid"), "task", "lang")


@query(f"WITH {_JUDGED} SELECT * FROM judged")
def qrels_last_wins(spark: SparkSession, base: str) -> DataFrame:
    return _judged(spark, base)


# ---- sparse ------------------------------------------------------------------------------------


def _index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    # analysis is the costly part: done once, into a written table
    index = materialize(sparse.postings(docs, T.analyzed("text", "lang")))
    return index, sparse.index_stats(index)


@query(f"""WITH {_DOCS}, p AS (SELECT space, doc_id, unnest(tokens) AS term FROM docs)
SELECT space, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY ALL""")
def postings_stats(spark: SparkSession, base: str) -> DataFrame:
    return sparse.document_frequencies(_index(spread(_texts(spark, base)))[0])


def _bm25(spark: SparkSession, base: str, k: int = 100) -> DataFrame:
    index, coll = _index(spread(_texts(spark, base)))
    return sparse.bm25_search(sparse.query_terms(_asked(spark, base), T.analyzed("text", "lang")), index, coll, k)


@query(f"WITH {_DOCS}, {_ASKED}, {_TERMS}, {_BM25} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 100")
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    return _bm25(spark, base)


@query(f"""WITH {_DOCS}, {_ASKED}, {_TERMS}, {_BM25}, {_JUDGED},
own AS (SELECT * FROM judged WHERE qid IN (SELECT qid FROM asked)),
kept AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM ranked WHERE rank <= 1000 AND doc_id <> qid),
{_metric_sql('kept', 'own')}
SELECT task, lang, count(*) AS n_queries, {_MEANS} FROM per_query p JOIN asked a ON a.qid = p.qid GROUP BY task, lang""")
def bm25_metrics(spark: SparkSession, base: str) -> DataFrame:
    asked = _asked(spark, base).select("qid", "task", "lang")
    run = evaluate.ranked(evaluate.drop_self_matches(_bm25(spark, base, 1000)).select("qid", "doc_id", "score"))
    own = _judged(spark, base).join(asked.select("qid"), "qid", "left_semi")
    scores = evaluate.per_query(run, own).join(asked, "qid")
    return evaluate.mean_metrics(scores, ["task", "lang"])


_STOPPED = "SELECT * REPLACE (CASE WHEN space = 'en' THEN list_filter(tokens, lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in english.STOP_WORDS) + ")) ELSE tokens END AS tokens) FROM"


@query(f"""WITH {_DOCS.replace('), docs AS', '), all_docs AS')}, docs AS ({_STOPPED} all_docs), {_ASKED.replace('), asked AS', '), all_asked AS')}, asked AS ({_STOPPED} all_asked), {_TERMS}, {_BM25}
SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 100""")
def bm25_stop_words(spark: SparkSession, base: str) -> DataFrame:
    """The search with English stop words left out of texts, queries and lengths."""
    tokens = T.analyzed("text", "lang")
    kept = F.when(F.col("lang") == "en", english.without_stop_words(tokens)).otherwise(tokens)
    index = materialize(sparse.postings(spread(_texts(spark, base)), kept))
    return sparse.bm25_search(sparse.query_terms(_asked(spark, base), kept), index, sparse.index_stats(index), 100)


_EXPANDED = f"""lastexp AS (
  SELECT qid, expansion FROM (SELECT qid, expansion, row_number() OVER (PARTITION BY qid ORDER BY exp_id DESC) AS n FROM expansions
    WHERE family = 'q2e_zs' AND qid IS NOT NULL) WHERE n = 1 AND coalesce(expansion, '') <> ''
), {_analyzed_sql("exptok", "lastexp l JOIN queries q ON q._id = l.qid", "l.qid", "l.expansion", "q.lang")}, expanded AS (
  SELECT a.qid, a.space, a.tokens, e.qid IS NOT NULL AS has, e.tokens AS etokens
  FROM asked a LEFT JOIN exptok e ON a.qid = e.qid
), terms AS (
  SELECT space, qid, term, sum(w) AS qtf FROM (
    SELECT space, qid, unnest(tokens) AS term, CASE WHEN has THEN 5.0 ELSE 1.0 END AS w FROM expanded
    UNION ALL SELECT space, qid, unnest(etokens), 1.0 FROM expanded WHERE has) GROUP BY ALL
)"""


def _last_expansion(spark: SparkSession, base: str, family: str | None = None) -> DataFrame:
    e = read_table(spark, base, "expansions").where("qid is not null")
    e = e.where(F.col("family") == family) if family else e
    last = e.groupBy("qid").agg(F.max_by(F.coalesce("expansion", F.lit("")), "exp_id").alias("expansion"))
    return last


@query(f"WITH {_DOCS}, {_ASKED}, {_EXPANDED}, {_BM25} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 100")
def bm25_query_expanded(spark: SparkSession, base: str) -> DataFrame:
    index, coll = _index(spread(_texts(spark, base)))
    exp = _last_expansion(spark, base, "q2e_zs").where("expansion <> ''")
    both = _asked(spark, base).join(exp, "qid", "left")
    plain = sparse.query_terms(both, T.analyzed("text", "lang"))
    weight = F.when(F.col("expansion").isNotNull(), F.lit(float(T.QUERY_REPEATS))).otherwise(F.lit(1.0))
    q = plain.join(both.select("qid", weight.alias("w")), "qid").select("space", "qid", "term", (F.col("qtf") * F.col("w")).alias("qtf"))
    e = sparse.query_terms(both.where("expansion is not null"), T.analyzed("expansion", "lang"))
    return sparse.bm25_search(sparse.weighted_terms(q, e), index, coll, 100)


_AUGMENTED = f"""lastaug AS (
  SELECT article_id_before AS doc_id, text_after AS addition FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id_before ORDER BY pair_id DESC) AS n FROM article_pairs
    WHERE coalesce(article_id_before, '') <> '') WHERE n = 1
), augmented AS (
  SELECT c._id AS doc_id, c.lang, coalesce(c.text, '') || CASE WHEN coalesce(a.addition, '') <> '' THEN ' ' || a.addition ELSE '' END AS text
  FROM corpus c LEFT JOIN lastaug a ON a.doc_id = c._id
), {_analyzed_sql("docs", "augmented", "doc_id, lang AS space", "text", "lang")}"""


@query(f"WITH {_AUGMENTED}, {_ASKED}, {_TERMS}, {_BM25} SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= 100")
def bm25_doc_augmented(spark: SparkSession, base: str) -> DataFrame:
    pairs = read_table(spark, base, "article_pairs").where("article_id_before is not null and article_id_before <> ''")
    aug = pairs.groupBy(F.col("article_id_before").alias("doc_id")).agg(F.max_by(F.coalesce("text_after", F.lit("")), "pair_id").alias("addition"))
    docs = spread(_texts(spark, base), "doc_id").join(aug, "doc_id", "left").withColumn("text", T.augment("text", "addition"))
    index, coll = _index(docs)
    return sparse.bm25_search(sparse.query_terms(_asked(spark, base), T.analyzed("text", "lang")), index, coll, 100)


@query(f"""WITH e AS (SELECT qid, expansion FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exp_id DESC) AS n FROM expansions WHERE qid IS NOT NULL) WHERE n = 1)
SELECT q._id AS qid, md5(CASE WHEN coalesce(e.expansion, '') = '' THEN coalesce(q.text, '') ELSE concat_ws(' ', q.text, q.text, q.text, q.text, q.text, e.expansion) END) AS text_md5,
  md5(CASE WHEN coalesce(e.expansion, '') = '' THEN coalesce(q.text, '') ELSE q.text || ' [SEP] ' || e.expansion END) AS dense_md5
FROM queries q LEFT JOIN e ON e.qid = q._id""")
def query_expansion_text(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "text").join(_last_expansion(spark, base), "qid", "left")
    return q.select("qid", F.md5(T.expand_sparse("text", "expansion")).alias("text_md5"), F.md5(T.expand_dense("text", "expansion")).alias("dense_md5"))


@query("""WITH e AS (SELECT qid, expansion FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exp_id DESC) AS n FROM expansions WHERE qid IS NOT NULL) WHERE n = 1)
SELECT count(*) FILTER (coalesce(e.expansion, '') <> '') AS applied, count(*) FILTER (e.qid IS NULL) AS missing,
  count(*) FILTER (e.qid IS NOT NULL AND coalesce(e.expansion, '') = '') AS empty FROM queries q LEFT JOIN e ON e.qid = q._id""")
def expansion_stats(spark: SparkSession, base: str) -> DataFrame:
    last = _last_expansion(spark, base).withColumn("there", F.lit(True))
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid")).join(last, "qid", "left")
    return q.agg(
        F.count_if(F.coalesce(F.col("expansion") != "", F.lit(False))).alias("applied"),
        F.count_if(F.col("there").isNull()).alias("missing"),
        F.count_if(F.col("there").isNotNull() & (F.col("expansion") == "")).alias("empty"),
    )


@query("SELECT coalesce(error, 'none') AS error, family, count(*) AS n FROM expansions GROUP BY ALL")
def expansion_errors(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "expansions").groupBy(F.coalesce("error", F.lit("none")).alias("error"), "family").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT _id AS doc_id, {TOKENS.format('text')} AS tokens FROM corpus)
SELECT doc_id, len(tokens) AS n_tokens, CAST(ceil(len(tokens) / 64.0) AS BIGINT) AS n_chunks,
  md5(array_to_string(list_slice(tokens, CAST(greatest(ceil(len(tokens) / 64.0) - 1, 0) AS BIGINT) * 64 + 1, len(tokens)), ' ')) AS last_md5 FROM t""")
def chunked_corpus(spark: SparkSession, base: str) -> DataFrame:
    t = read_table(spark, base, "corpus").select(F.col("_id").alias("doc_id"), T.tokens("text").alias("tokens"))
    t = t.withColumn("chunks", T.chunks("tokens", 72))
    last = F.when(F.size("chunks") > 0, F.array_join(F.element_at("chunks", -1), " ")).otherwise(F.lit(""))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size("chunks").cast("long").alias("n_chunks"), F.md5(last).alias("last_md5"))


# ---- dense -------------------------------------------------------------------------------------

_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "embeddings")


def _vector_queries(spark: SparkSession, base: str) -> DataFrame:
    return _vectors(spark, base).where(F.col("vec_id") % EVERY == 0)


_DENSE = f"""scored AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS doc_id, round({_DOT.format('q.embedding', 'd.embedding')}, 6) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % {EVERY} = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM scored)"""


@query(f"WITH {_DENSE} SELECT * FROM ranked WHERE rank <= 10")
def dense_ip_topk(spark: SparkSession, base: str) -> DataFrame:
    return dense.search(
        dense.single(_vector_queries(spark, base), "vec_id", "qid"), dense.single(_vectors(spark, base), "vec_id", "doc_id"), 10
    )


@query(f"""WITH {_DENSE}, kept AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM ranked WHERE rank <= 1000 AND qid <> doc_id),
own AS (SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS doc_id, 1 AS rel FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0),
{_metric_sql('kept', 'own')} SELECT count(*) AS n_queries, {_MEANS} FROM per_query""")
def dense_self_filtered_metrics(spark: SparkSession, base: str) -> DataFrame:
    run = dense.search(
        dense.single(_vector_queries(spark, base), "vec_id", "qid"), dense.single(_vectors(spark, base), "vec_id", "doc_id"), 1000
    )
    run = evaluate.ranked(evaluate.drop_self_matches(run).select("qid", "doc_id", "score"))
    labels = _vectors(spark, base).select(F.col("vec_id").cast("string").alias("doc_id"), "label")
    q = _vector_queries(spark, base).select(F.col("vec_id").cast("string").alias("qid"), "label")
    own = q.join(labels, "label").where("qid <> doc_id").select("qid", "doc_id", F.lit(1).alias("rel"))
    return evaluate.mean_metrics(evaluate.per_query(run, own))


def _maxp_sql(q_parent: str, d_parent: str, where: str) -> str:
    return f"""WITH scored AS (
  SELECT CAST({q_parent} AS VARCHAR) AS qid, CAST({d_parent} AS VARCHAR) AS doc_id, round(max({_DOT.format('q.embedding', 'd.embedding')}), 6) AS score
  FROM embeddings q, embeddings d WHERE {where} GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM scored) SELECT * FROM ranked WHERE rank <= 10"""


def _parents(df: DataFrame, name: str, by_five: bool) -> DataFrame:
    parent = F.floor(F.col("vec_id") / 5) if by_five else F.col("vec_id")
    return df.select(F.col("vec_id").cast("string").alias(name), parent.cast("string").alias("parent"), "embedding")


def _maxp(spark: SparkSession, base: str, chunk_q: bool, chunk_d: bool) -> DataFrame:
    v = _vectors(spark, base)
    asked = v.where((F.floor(F.col("vec_id") / 5) if chunk_q else F.col("vec_id")) % EVERY == 0)
    docs = _parents(v, "doc_id", chunk_d)
    return dense.search(_parents(asked, "qid", chunk_q), docs, 10)


@query(_maxp_sql("q.vec_id", "d.vec_id // 5", f"q.vec_id % {EVERY} = 0"))
def maxp_doc(spark: SparkSession, base: str) -> DataFrame:
    return _maxp(spark, base, False, True)


@query(_maxp_sql("q.vec_id // 5", "d.vec_id", f"(q.vec_id // 5) % {EVERY} = 0"))
def maxp_q(spark: SparkSession, base: str) -> DataFrame:
    return _maxp(spark, base, True, False)


@query(_maxp_sql("q.vec_id // 5", "d.vec_id // 5", f"(q.vec_id // 5) % {EVERY} = 0"))
def maxp_both(spark: SparkSession, base: str) -> DataFrame:
    return _maxp(spark, base, True, True)


@query()
def encoded_corpus_topk(spark: SparkSession, base: str) -> DataFrame:
    """The encoder plug-in end to end: encode corpus and queries as whole texts, search, ten best each."""
    encoder = plugins.HashingEncoder(plugins.ModelSpec("hashing", 64, None, {"query": "query: ", "passage": "passage: "}))
    docs = materialize(plugins.encode(spread(_texts(spark, base)), encoder, False))
    asked = materialize(plugins.encode(_asked(spark, base), encoder, True, "qid"))
    parent = lambda df, i: df.select(i, F.col(i).alias("parent"), "embedding")
    return dense.search(parent(asked, "qid"), parent(docs, "doc_id"), 10)


# ---- evaluation --------------------------------------------------------------------------------

_RUNS = """runs AS (
  SELECT model_key, qid, doc_id, row_number() OVER (PARTITION BY model_key, qid ORDER BY score DESC, doc_id DESC) AS rank FROM (
    SELECT model_key, qid, doc_id, max(score) AS score FROM (SELECT model_key, qid, unnest(ranked) AS doc_id, unnest(scores) AS score FROM dense_runs)
    WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND doc_id <> qid GROUP BY ALL)
)"""


def _runs(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "dense_runs").select("model_key", "qid", F.explode(F.arrays_zip("ranked", "scores")).alias("e"))
    rows = rows.select("model_key", "qid", F.col("e.ranked").alias("doc_id"), F.col("e.scores").alias("score"))
    rows = rows.where("doc_id is not null and score is not null and not isnan(score) and doc_id <> qid")
    return evaluate.ranked(rows, ["model_key"])


def _model_means(spark: SparkSession, base: str, policy: str) -> DataFrame:
    scores = evaluate.per_query(_runs(spark, base), _judged(spark, base), ["model_key"], policy)
    return evaluate.mean_metrics(scores, ["model_key"])


@query(f"WITH {_RUNS}, {_JUDGED}, {_metric_sql('runs', 'judged', 'model_key')} SELECT model_key, count(*) AS n_queries, {_MEANS} FROM per_query GROUP BY model_key")
def rank_eval_missing_zero(spark: SparkSession, base: str) -> DataFrame:
    return _model_means(spark, base, "zero")


@query(f"WITH {_RUNS}, {_JUDGED}, {_metric_sql('runs', 'judged', 'model_key', 'skip')} SELECT model_key, count(*) AS n_queries, {_MEANS} FROM per_query GROUP BY model_key")
def rank_eval_missing_skip(spark: SparkSession, base: str) -> DataFrame:
    return _model_means(spark, base, "skip")


@query(f"""WITH {_JUDGED}, lists AS MATERIALIZED (
  SELECT model_key, qid, ranked, row_number() OVER () AS id FROM dense_runs WHERE ranked IS NOT NULL
), firsts AS (
  SELECT id, doc_id, min(n) AS n FROM (SELECT id, unnest(ranked) AS doc_id, generate_subscripts(ranked, 1) AS n FROM lists) GROUP BY id, doc_id
), placed AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY n) AS place FROM firsts
), p AS (
  SELECT l.id, l.model_key, l.qid, len(l.ranked) - count(f.place) AS dup, count(f.place) > 1000 AS cut,
    count(*) FILTER (f.place <= 1000 AND f.doc_id = l.qid) > 0 AS own, count(*) FILTER (f.place <= 1000 AND f.doc_id <> l.qid) AS n
  FROM lists l LEFT JOIN placed f ON f.id = l.id GROUP BY l.id, l.model_key, l.qid, l.ranked
), lists_of AS (
  SELECT model_key, count(*) AS n_lists, CAST(sum(dup) AS BIGINT) AS n_duplicates, count(*) FILTER (cut) AS n_truncated, count(*) FILTER (own) AS n_self_matches FROM p GROUP BY model_key
), present AS (
  SELECT DISTINCT model_key, qid, qid IN (SELECT qid FROM judged) AS judged FROM p WHERE n > 0
), found AS (SELECT model_key, count(*) FILTER (NOT judged) AS n_extra, count(*) FILTER (judged) AS n_scored FROM present GROUP BY model_key)
SELECT l.*, (SELECT count(DISTINCT qid) FROM judged) - coalesce(n_scored, 0) AS n_missing, coalesce(n_extra, 0) AS n_extra, coalesce(n_scored, 0) AS n_scored
FROM lists_of l LEFT JOIN found f ON f.model_key IS NOT DISTINCT FROM l.model_key""")
def rank_eval_audit_models(spark: SparkSession, base: str) -> DataFrame:
    """Every list of every model and shard, counted per model."""
    lists = read_table(spark, base, "dense_runs").where("ranked is not null").select("model_key", "qid", "ranked")
    return evaluate.audit(evaluate.prepare_lists(lists, filter_self=True), _judged(spark, base), True, ["model_key"])


# the same job under the name it had before it read every list
QUERIES["rank_eval_audit"], ORACLE["rank_eval_audit"] = rank_eval_audit_models, ORACLE["rank_eval_audit_models"]


@query("SELECT model_key, count(*) FILTER (list_contains(ranked, qid)) AS n_self, count(*) AS n_lists FROM dense_runs GROUP BY ALL")
def self_rank_warning(spark: SparkSession, base: str) -> DataFrame:
    own = F.coalesce(F.array_contains("ranked", F.col("qid")), F.lit(False))
    return read_table(spark, base, "dense_runs").groupBy("model_key").agg(F.count_if(own).alias("n_self"), F.count(F.lit(1)).alias("n_lists"))


_PER_QUERY = f"{_RUNS}, {_JUDGED}, {_metric_sql('runs', 'judged', 'model_key')}"


@query(f"""WITH {_PER_QUERY}, cells AS (SELECT p.model_key AS model, q.task || '-' || q.lang AS cell, avg(recall_100) AS v FROM per_query p JOIN queries q ON q._id = p.qid GROUP BY ALL)
SELECT model, {', '.join(f"round(max(CASE WHEN cell = '{c}' THEN v END), 6) AS {c.replace('-', '_')}" for c in ('rat2rev-en', 'rat2rev-ja', 'rev2rev-en', 'rev2rev-ja'))} FROM cells GROUP BY model""")
def metric_pivot(spark: SparkSession, base: str) -> DataFrame:
    scores = evaluate.per_query(_runs(spark, base), _judged(spark, base), ["model_key"])
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "task", "lang")
    means = evaluate.mean_metrics(scores.join(q, "qid").withColumnRenamed("model_key", "model"), ["model", "task", "lang"])
    cells = [f"{t}-{g}" for t in ("rat2rev", "rev2rev") for g in ("en", "ja")]
    wide = report.pivot_cells(means, "recall_100", cells)
    return wide.select("model", *[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in cells])


_LONG = " UNION ALL ".join(f"SELECT model_key, qid, '{n}' AS metric, {m} AS value FROM per_query" for m, n in evaluate.NAMES.items())


def _long(spark: SparkSession, base: str) -> DataFrame:
    scores = evaluate.per_query(_runs(spark, base), _judged(spark, base), ["model_key"])
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "task", "lang")
    return evaluate.long_metrics(scores.join(q, "qid"), ["model_key", "task", "lang"]).withColumnRenamed("model_key", "model")


# Two-sided p of Student's t by the finite series for whole degrees of freedom.
_TESTS = f"""{_PER_QUERY}, long AS ({_LONG}), cells AS (SELECT l.*, q.task, q.lang FROM long l JOIN queries q ON q._id = l.qid),
d AS (SELECT a.task, a.lang, a.metric, a.model_key AS method, a.value - b.value AS d FROM cells a JOIN cells b ON a.qid = b.qid AND a.metric = b.metric AND a.task = b.task AND a.lang = b.lang
  WHERE b.model_key = 'enc-multi-base' AND a.model_key <> 'enc-multi-base'),
tt AS (SELECT task, lang, metric, method, count(*) AS n_queries, avg(d) AS meandiff, count(*) - 1 AS df, min(d) = max(d) OR stddev_samp(d) = 0 AS constant,
    CASE WHEN min(d) = max(d) OR stddev_samp(d) = 0 THEN 0 ELSE avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t
  FROM d GROUP BY task, lang, metric, method HAVING count(*) >= 2),
angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS o FROM tt),
ps AS (SELECT *, CASE WHEN constant THEN 1.0 WHEN df % 2 = 0 THEN
      1 - sin(o) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1)) * cos(o) ** (2 * k)))
    ELSE 1 - 2 / pi() * (o + sin(o) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos(o) ** (2 * k + 1))), 0)) END AS p FROM angles)"""


@query(f"""WITH {_TESTS} SELECT task, lang, metric, method, n_queries, round(meandiff, 6) AS meandiff, round(t, 4) AS t_stat, round(p, 6) AS p_raw FROM ps""")
def paired_t(spark: SparkSession, base: str) -> DataFrame:
    tests = stats.compare_to_baseline(_long(spark, base), "enc-multi-base")
    return tests.select(
        "task", "lang", "metric", "method", "n_queries", F.round("meandiff", 6).alias("meandiff"), F.round("t_stat", 4).alias("t_stat"), F.round("p_raw", 6).alias("p_raw")
    )


@query(f"""WITH {_TESTS}, steps AS (SELECT *, p * (count(*) OVER (PARTITION BY task, lang, metric) - row_number() OVER (PARTITION BY task, lang, metric ORDER BY p, method) + 1) AS step FROM ps),
adjusted AS (SELECT *, least(1.0, max(step) OVER (PARTITION BY task, lang, metric ORDER BY p, method ROWS UNBOUNDED PRECEDING)) AS adj FROM steps)
SELECT task, lang, metric, method, n_queries, round(adj, 6) AS p_adj_holm, adj < 0.05 AS reject, adj < 0.05 AND meandiff > 0 AS gain FROM adjusted""")
def holm_adjust(spark: SparkSession, base: str) -> DataFrame:
    tests = stats.compare_to_baseline(_long(spark, base), "enc-multi-base")
    return tests.select("task", "lang", "metric", "method", "n_queries", F.round("p_adj_holm", 6).alias("p_adj_holm"), "reject", stats.significant_gain().alias("gain"))


# ---- second stage ------------------------------------------------------------------------------


def _candidates(spark: SparkSession, base: str, keep_blank: bool = False) -> DataFrame:
    return rerank.candidate_texts(_bm25(spark, base), _asked(spark, base), _texts(spark, base), 100, keep_blank)


@query(f"""WITH {_DOCS}, {_ASKED}, {_TERMS}, {_BM25}, cand AS (
  SELECT r.qid, r.doc_id, r.rank AS first_rank, list_distinct({TOKENS.format('a.text')}) AS q, list_distinct({TOKENS.format('c.text')}) AS d
  FROM ranked r JOIN asked a ON a.qid = r.qid JOIN corpus c ON c._id = r.doc_id WHERE r.rank <= 100 AND coalesce(c.text, '') <> ''
), s AS (SELECT qid, doc_id, first_rank, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) / len(q) END, 6) AS score FROM cand)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank) AS rank FROM s""")
def rerank_overlap(spark: SparkSession, base: str) -> DataFrame:
    return rerank.rerank(_candidates(spark, base), plugins.overlap_scorer)


@query()
def listwise_window(spark: SparkSession, base: str) -> DataFrame:
    return rerank.listwise(_candidates(spark, base, True), plugins.overlap_ranker)


# ---- mining and construction -------------------------------------------------------------------

_FIRST = """first AS (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM (
    SELECT qid, doc_id, max(score) AS score FROM (SELECT qid, unnest(ranked) AS doc_id, unnest(scores) AS score FROM dense_runs)
    WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
), pool AS (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) - 1 AS place FROM (SELECT * FROM first WHERE rank <= 100 AND qid <> doc_id) f
  WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.rel > 0 AND j.qid = f.qid AND j.doc_id = f.doc_id)
)"""


def _first_hundred(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "dense_runs").select("qid", F.explode(F.arrays_zip("ranked", "scores")).alias("e"))
    rows = rows.select("qid", F.col("e.ranked").alias("doc_id"), F.col("e.scores").alias("score"))
    return evaluate.ranked(rows.where("doc_id is not null and score is not null and not isnan(score)")).where("rank <= 100")


@query(f"""WITH {_JUDGED}, {_FIRST}, sizes AS (SELECT qid, count(*) AS n FROM pool GROUP BY qid), draws AS (
  SELECT j.qid, j.doc_id AS positive_doc_id, CAST(('0x' || substr(md5(concat_ws('|', '13', j.qid, j.doc_id)), 1, 8)) AS BIGINT) % s.n AS place
  FROM judged j JOIN sizes s ON s.qid = j.qid WHERE j.rel > 0)
SELECT d.qid, d.positive_doc_id, p.doc_id AS hard_negative_doc_id FROM draws d JOIN pool p ON p.qid = d.qid AND p.place = d.place""")
def hard_negatives_hashed(spark: SparkSession, base: str) -> DataFrame:
    return mine.mine_hashed(_first_hundred(spark, base), _judged(spark, base), True)


@query()
def hard_negatives_replayed(spark: SparkSession, base: str) -> DataFrame:
    return mine.mine_replayed(_first_hundred(spark, base), _judged(spark, base), True)


@query(f"""WITH {_JUDGED}, {_FIRST}, pos AS (SELECT qid, count(*) AS n_pos FROM judged WHERE rel > 0 GROUP BY qid),
c AS (SELECT qid, count(*) AS n FROM pool GROUP BY qid), e AS (
  SELECT p.qid, p.n_pos, c.n, f.qid IS NOT NULL AS there FROM pos p LEFT JOIN (SELECT DISTINCT qid FROM first) f ON f.qid = p.qid LEFT JOIN c ON c.qid = p.qid)
SELECT count(*) AS n_queries, count(*) FILTER (NOT there) AS n_missing, count(*) FILTER (there AND n IS NULL) AS n_without_candidates,
  CAST(coalesce(sum(CASE WHEN n IS NOT NULL THEN n_pos END), 0) AS BIGINT) AS n_examples, CAST(coalesce(sum(n_pos), 0) AS BIGINT) AS n_positives, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_candidates FROM e""")
def mining_counters(spark: SparkSession, base: str) -> DataFrame:
    return mine.mining_counters(_first_hundred(spark, base), _judged(spark, base), True)


@query("""WITH ids AS (
  SELECT 'query' AS missing_kind, qid AS missing_id FROM training_examples UNION ALL SELECT 'document', positive_doc_id FROM training_examples
  UNION ALL SELECT 'document', hard_negative_doc_id FROM training_examples)
SELECT missing_kind, missing_id, count(*) AS n FROM ids WHERE missing_id IS NOT NULL
  AND CASE WHEN missing_kind = 'query' THEN missing_id NOT IN (SELECT _id FROM queries) ELSE missing_id NOT IN (SELECT _id FROM corpus) END GROUP BY ALL""")
def incomplete_triples(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"))
    return mine.incomplete_triples(read_table(spark, base, "training_examples"), q, _texts(spark, base))


@query(f"""WITH {_JUDGED} SELECT t.example_id, length(q.text) AS query_chars, length(p.text) AS positive_chars, length(n.text) AS negative_chars,
  coalesce((SELECT count(*) FROM judged j WHERE j.qid = t.qid AND j.rel > 0), 0) AS n_positives
FROM training_examples t JOIN queries q ON q._id = t.qid JOIN corpus p ON p._id = t.positive_doc_id JOIN corpus n ON n._id = t.hard_negative_doc_id""")
def text_triples(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "text")
    triples = read_table(spark, base, "training_examples").select("example_id", "qid", "positive_doc_id", "hard_negative_doc_id")
    full = mine.text_triples(triples, q, _texts(spark, base), _judged(spark, base))
    chars = lambda c: F.char_length(c).cast("long")
    return full.select(
        "example_id", chars("query_text").alias("query_chars"), chars("positive_text").alias("positive_chars"), chars("negative_text").alias("negative_chars"),
        F.coalesce(F.size("qrel_positive_doc_ids"), F.lit(0)).cast("long").alias("n_positives"),
    )


@query("""SELECT DISTINCT event_id, CASE CAST(floor(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) * 3 / 4294967296) AS INT)
  WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM article_pairs WHERE event_id IS NOT NULL""")
def event_split(spark: SparkSession, base: str) -> DataFrame:
    return construct.event_split(read_table(spark, base, "article_pairs"))


_MEMBERS = "members AS (SELECT DISTINCT event_id, article_id_before AS doc_id FROM article_pairs WHERE event_id IS NOT NULL AND article_id_before IS NOT NULL)"


def _members(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "article_pairs").select("event_id", F.col("article_id_before").alias("doc_id"))


@query(f"""WITH {_MEMBERS}, a AS (SELECT event_id, doc_id, count(*) OVER (PARTITION BY event_id) AS n,
  row_number() OVER (PARTITION BY event_id ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), doc_id)), doc_id) AS place FROM members)
SELECT DISTINCT a.doc_id AS qid, m.doc_id, 1 AS rel FROM a JOIN members m ON m.event_id = a.event_id WHERE a.n >= 2 AND a.place <= 5 AND m.doc_id <> a.doc_id""")
def rev2rev_qrels(spark: SparkSession, base: str) -> DataFrame:
    return construct.article_judgments(_members(spark, base))


@query(f"WITH {_MEMBERS} SELECT DISTINCT q._id AS qid, m.doc_id, 1 AS rel FROM queries q JOIN members m ON m.event_id = q.event_id WHERE q.task = 'rat2rev'")
def rat2rev_qrels(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").where("task = 'rat2rev'").select(F.col("_id").alias("qid"), "event_id")
    return construct.rationale_judgments(q, _members(spark, base))


@query(f"""WITH p AS (SELECT pair_id, list_distinct({TOKENS.format('text_before')}) AS a, list_distinct({TOKENS.format('text_after')}) AS b FROM article_pairs WHERE text_before IS DISTINCT FROM text_after),
s AS (SELECT pair_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c FROM p)
SELECT pair_id, round(CASE WHEN na + nb = 0 THEN 0.0 ELSE 2.0 * c / (na + nb) END, 6) AS dice, round(CASE WHEN least(na, nb) = 0 THEN 0.0 ELSE c / least(na, nb) END, 6) AS simpson FROM s""")
def changed_pair_similarity(spark: SparkSession, base: str) -> DataFrame:
    p = construct.changed_pairs(read_table(spark, base, "article_pairs"))
    a, b = T.tokens("text_before"), T.tokens("text_after")
    return p.select("pair_id", F.round(T.dice(a, b), 6).alias("dice"), F.round(T.simpson(a, b), 6).alias("simpson"))


@query(f"""WITH l AS (SELECT event_id, pair_id AS id, list_distinct({TOKENS.format('text_before')}) AS t, length(text_before) AS n FROM article_pairs WHERE event_id IS NOT NULL AND text_before IS NOT NULL),
r AS (SELECT event_id, pair_id AS id, list_distinct({TOKENS.format('text_after')}) AS t, length(text_after) AS n FROM article_pairs WHERE event_id IS NOT NULL AND text_after IS NOT NULL),
b AS (SELECT l.event_id, l.id AS left_id, r.id AS right_id, len(list_intersect(l.t, r.t)) AS c, len(l.t) AS a, len(r.t) AS b, least(l.n, r.n) AS n FROM l JOIN r ON l.event_id = r.event_id WHERE len(l.t) > 0 AND len(r.t) > 0),
s AS (SELECT *, 2.0 * c / (a + b) AS dice, c / least(a, b) AS simpson FROM b)
SELECT event_id, left_id, right_id, round(dice, 6) AS dice, round(simpson, 6) AS simpson, dice >= 0.99 AS is_minor FROM s WHERE dice >= 0.7 OR (simpson >= 0.95 AND n > 40)""")
def article_alignment(spark: SparkSession, base: str) -> DataFrame:
    """Articles before and after an amendment whose texts match, within each event."""
    pairs = read_table(spark, base, "article_pairs").where("event_id is not null")

    def side(column: str) -> DataFrame:
        rows = pairs.where(F.col(column).isNotNull())
        return rows.select("event_id", F.col("pair_id").alias("id"), T.tokens(column).alias("tokens"), F.char_length(column).alias("n_chars"))

    found = construct.similarity_pairs(side("text_before"), side("text_after"), ["event_id"])
    return found.select("event_id", "left_id", "right_id", F.round("dice", 6).alias("dice"), F.round("simpson", 6).alias("simpson"), "is_minor")


# ---- costs -------------------------------------------------------------------------------------

#: (model, input, output) in USD per million tokens, for the models of the expansions table (fixed values).
PRICES = [("lm-small", 0.40, 1.60), ("lm-nano", 0.10, 0.40)]
_PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}, {o})" for m, i, o in PRICES) + ") v(model, input_price, output_price))"


@query(f"""WITH {_PRICES}, c AS (SELECT e.model, length(coalesce(q.text, '')) AS i, length(coalesce(e.expansion, '')) AS o FROM expansions e LEFT JOIN queries q ON q._id = e.qid)
SELECT c.model, count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  round((sum(i) * coalesce(max(input_price), 0) + sum(o) * coalesce(max(output_price), 0)) / 1e6, 4) AS cost_usd FROM c LEFT JOIN prices p ON p.model = c.model GROUP BY c.model""")
def cost_ledger(spark: SparkSession, base: str) -> DataFrame:
    q = read_table(spark, base, "queries").select(F.col("_id").alias("qid"), "text")
    chars = lambda c: F.char_length(T.text_or_empty(c)).cast("long")
    calls = read_table(spark, base, "expansions").join(q, "qid", "left").select("model", "qid", chars("text").alias("input_tokens"), chars("expansion").alias("output_tokens"))
    return report.ledger(calls, _prices(spark))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


@query(f"""WITH {_PRICES}, c AS (SELECT task || '-' || lang AS cell, count(*) AS n FROM queries GROUP BY ALL)
SELECT coalesce(cell, '__total__') AS cell, CAST(sum(n) AS BIGINT) AS n_queries, round(sum(n * 9 * (10000 * 0.40 + 100 * 1.60) / 1e6), 6) AS cost_usd FROM c GROUP BY ROLLUP (cell)""")
def cost_rollup(spark: SparkSession, base: str) -> DataFrame:
    cells = read_table(spark, base, "queries").groupBy(F.concat_ws("-", "task", "lang").alias("cell")).agg(F.count(F.lit(1)).alias("n_queries"))
    return report.cost_estimate(cells.withColumn("model", F.lit("lm-small")), _prices(spark), 9, 10_000, 100)


# ---- incremental evaluation --------------------------------------------------------------------


@query(f"""WITH {_JUDGED}, hits AS (SELECT DISTINCT r.model_key, r.qid, r.doc_id FROM (SELECT model_key, qid, unnest(ranked) AS doc_id FROM dense_runs) r
  JOIN judged j ON j.qid = r.qid AND j.doc_id = r.doc_id WHERE j.rel > 0)
SELECT model_key, count(*) AS n_relevant_found, (SELECT count(*) FROM judged WHERE rel > 0) AS n_judged FROM hits GROUP BY model_key""")
def streaming_recall(spark: SparkSession, base: str) -> DataFrame:
    from ..streaming.incremental import recall_from_stream

    return recall_from_stream(spark, f"{base}/dense_runs.parquet", _judged(spark, base))
