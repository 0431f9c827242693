"""Queries of the numeric part of contrastive training and of text expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contrastive, dense
from ..session import read_table

QUERIES, ORACLE = {}, {}
#: Queries of one training batch, a parameter of training.
BATCH = 32


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


_BATCH = f"""n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT k AS row, CAST(k AS VARCHAR) AS qid, CAST((k * 7 + 1) % n AS VARCHAR) AS pos, CAST((k * 11 + 5) % n AS VARCHAR) AS neg
  FROM n, range({BATCH}) r(k)), v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT row AS col, pos AS cand FROM b UNION ALL SELECT row + {BATCH}, neg FROM b),
l AS (SELECT b.row, c.col, c.cand, c.col = b.row AS is_label, list_inner_product(q.e, d.e) / 0.05 AS logit FROM b JOIN v q ON q.id = b.qid, c JOIN v d ON d.id = c.cand),
m AS (SELECT *, NOT is_label AND cand IN (CAST((row * 7 + 1) AS VARCHAR), CAST((row * 3 + 1) AS VARCHAR)) AS masked FROM l),
x AS (SELECT row, col, is_label, masked, CASE WHEN masked THEN -1e30 ELSE logit END AS logit FROM m)"""


def _batch(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(logits, masked logits) of one batch of vectors with their positives, negatives and known positives."""
    v = read_table(spark, base, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    n = v.count()
    rows = [(k, str(k), str((k * 7 + 1) % n), str((k * 11 + 5) % n), [str(k * 7 + 1), str(k * 3 + 1)]) for k in range(BATCH)]
    batch = spark.createDataFrame(rows, "row bigint, qid string, positive_doc_id string, hard_negative_doc_id string, qrel_positive_doc_ids array<string>")
    logits = contrastive.batch_logits(batch, v.withColumnRenamed("id", "qid"), v.withColumnRenamed("id", "doc_id"))
    return logits, contrastive.mask_known_positives(logits, batch)


@query(f"WITH {_BATCH} SELECT row, col, is_label, masked, CASE WHEN masked THEN NULL ELSE round(logit, 6) END AS logit FROM x")
def contrastive_logits(spark: SparkSession, base: str) -> DataFrame:
    """In-batch logits with other known positives masked."""
    masked = _batch(spark, base)[1]
    return masked.select("row", "col", "is_label", "masked", F.when(~F.col("masked"), F.round("logit", 6)).alias("logit"))


@query(f"""WITH {_BATCH}, t AS (SELECT row, max(logit) AS top, max(CASE WHEN is_label THEN logit END) AS label FROM x GROUP BY row)
SELECT x.row, round(max(top) + ln(sum(exp(logit - top))) - max(label), 6) AS loss FROM x JOIN t ON t.row = x.row GROUP BY x.row""")
def contrastive_losses(spark: SparkSession, base: str) -> DataFrame:
    losses = contrastive.row_losses(_batch(spark, base)[1])
    return losses.select("row", F.round("loss", 6).alias("loss"))


@query(f"""WITH {_BATCH}, t AS (SELECT row, max(logit) AS top, max(CASE WHEN is_label THEN logit END) AS label FROM x GROUP BY row),
r AS (SELECT x.row, max(top) + ln(sum(exp(logit - top))) - max(label) AS loss FROM x JOIN t ON t.row = x.row GROUP BY x.row),
p AS (SELECT row % 3 AS part, avg(loss) AS loss, count(*) AS n FROM r GROUP BY ALL) SELECT round(sum(loss * n) / sum(n), 6) AS loss FROM p""")
def contrastive_mean_loss(spark: SparkSession, base: str) -> DataFrame:
    """Mean of the means of unequal parts, weighted by their sizes."""
    losses = contrastive.row_losses(_batch(spark, base)[1])
    parts = losses.groupBy((F.col("row") % 3).alias("part")).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n"))
    return contrastive.weighted_mean_loss(parts).select(F.round("loss", 6).alias("loss"))


@query("""SELECT ord AS step, round(0.001 * CASE WHEN ord < 100 THEN ord / 100.0 ELSE greatest(0.0, (2000 - ord) / 1900.0) END, 9) AS lr FROM queries""")
def learning_rates(spark: SparkSession, base: str) -> DataFrame:
    """Warm-up and decay over the numbers of the queries as steps."""
    steps = read_table(spark, base, "queries").select(F.col("ord").alias("step"))
    return contrastive.learning_rate(steps, 0.001, 100, 2000).select("step", F.round("lr", 9).alias("lr"))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY ym) AS epoch, n FROM (SELECT strftime(added_at, '%Y-%m') AS ym, CAST(count(*) AS DOUBLE) AS n FROM qrels WHERE added_at IS NOT NULL GROUP BY ALL)),
f AS (SELECT epoch, n, n AS low, true AS best, 0 AS bad_epochs FROM e WHERE epoch = 1
  UNION ALL SELECT e.epoch, e.n, CASE WHEN e.n < f.low THEN e.n ELSE f.low END, e.n < f.low, CASE WHEN e.n < f.low THEN 0 ELSE f.bad_epochs + 1 END FROM f JOIN e ON e.epoch = f.epoch + 1 WHERE f.bad_epochs < 3)
SELECT epoch, n AS val_loss, best, bad_epochs, bad_epochs >= 3 AS stop FROM f""")
def early_stops(spark: SparkSession, base: str) -> DataFrame:
    """The stopping rule over monthly judgment counts as a series of losses."""
    months = read_table(spark, base, "qrels").where("added_at is not null").groupBy(F.date_format("added_at", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).cast("double").alias("val_loss"))
    rows = [(i + 1, r["val_loss"]) for i, r in enumerate(months.orderBy("ym").collect())]  # one row per month
    return contrastive.early_stopping(spark.createDataFrame(rows, "epoch bigint, val_loss double"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS ord FROM training_examples)
SELECT CAST(ord // 16 AS BIGINT) AS batch, count(*) AS n, md5(string_agg(concat_ws('|', coalesce(qid, ''), coalesce(positive_doc_id, ''), coalesce(hard_negative_doc_id, '')), ',' ORDER BY ord)) AS rows_md5 FROM o GROUP BY ALL""")
def collated_batches(spark: SparkSession, base: str) -> DataFrame:
    """Training examples in batches of 16, in the order of their ids."""
    from ..operators.evaluate import ranked

    examples = read_table(spark, base, "training_examples")
    # a global order without one task: the ranks of a single list
    order = ranked(examples.select(F.lit("all").alias("qid"), F.col("example_id").alias("doc_id"), (-F.col("example_id")).alias("score")))
    numbered = examples.join(order.select(F.col("doc_id").alias("example_id"), (F.col("rank") - 1).alias("ord")), "example_id")
    one = F.transform("rows", lambda r: F.concat_ws("|", *[F.coalesce(r[c], F.lit("")) for c in ("qid", "positive_doc_id", "hard_negative_doc_id")]))
    batches = contrastive.collate(numbered, 16)
    return batches.select("batch", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(one, ",")).alias("rows_md5"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q, v d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def dense_cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    v = dense.normalised(read_table(spark, base, "embeddings"))
    return dense.search(dense.single(v.where("vec_id % 50 = 0"), "vec_id", "qid"), dense.single(v, "vec_id", "doc_id"), 10)


@query("""SELECT doc_id, md5('query: ' || coalesce(text, '')) AS prefixed_md5, md5(left(coalesce(text, ''), 4000)) AS head_md5,
  md5(array_to_string(list_slice(string_split(trim(regexp_replace(trim(coalesce(text, ''), ' '), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' '), ' '), 1, 300), ' ')) AS words_md5,
  md5('<Instruct>: rank' || chr(10) || '<Query>: ' || coalesce(source, '') || chr(10) || '<Document>: ' || coalesce(text, '')) AS pair_md5 FROM documents""")
def text_expressions(spark: SparkSession, base: str) -> DataFrame:
    """Prefix, head by characters and by words, chat pair, over whole documents."""
    d = read_table(spark, base, "documents")
    flat = F.regexp_replace(F.trim(T.text_or_empty("text")), r"[ \t\n\x0B\f\r]+", " ")
    return d.select(
        "doc_id",
        F.md5(T.prefixed("text", "query: ")).alias("prefixed_md5"),
        F.md5(T.head_chars("text")).alias("head_md5"),
        F.md5(T.head_words(flat)).alias("words_md5"),
        F.md5(T.chat_pair("rank", "source", "text")).alias("pair_md5"),
    )
