from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E

RUN = "qid string, doc_id string, rank int"
QRELS = "qid string, doc_id string, rel int"
LISTS = "qid string, ranked array<string>"


def _scores(spark, run, qrels, **kw):
    df = E.per_query(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), **kw)
    return {r["qid"]: r.asDict() for r in df.collect()}


def _evaluate(spark, lists, qrels, max_docs=1000, filter_self=False, policy="zero"):
    prepared = E.prepare_lists(spark.createDataFrame(lists, LISTS), max_docs, filter_self)
    q = spark.createDataFrame(qrels, QRELS)
    scores = {r["qid"]: r.asDict() for r in E.per_query(E.lists_to_run(prepared), q, policy=policy).collect()}
    return scores, E.audit(prepared, q, filter_self).first().asDict()


def test_hand_values(spark):
    run = [("q", d, i + 1) for i, d in enumerate(["p1", "a", "b", "c", "d", "p2", "e", "f", "g"])]
    s = _scores(spark, run, [("q", "p1", 1), ("q", "p2", 1)])["q"]
    assert s["recall_10"] == 1.0
    assert s["ndcg_10"] == pytest.approx(0.831555, abs=1e-6)
    assert s["map"] == pytest.approx(0.666667, abs=1e-6)


def test_order_matters(spark):
    first = _scores(spark, [("q", "a", 1), ("q", "b", 2)], [("q", "b", 1)])["q"]["ndcg_10"]
    assert first == pytest.approx(0.630930, abs=1e-6)
    assert _scores(spark, [("q", "b", 1), ("q", "a", 2)], [("q", "b", 1)])["q"]["ndcg_10"] == 1.0


def test_graded_gain_is_linear(spark):
    s = _scores(spark, [("q", "a", 1), ("q", "b", 2)], [("q", "a", 1), ("q", "b", 3)])["q"]
    ideal = 3 + 1 / 1.584962500721156
    assert s["ndcg_10"] == pytest.approx((1 + 3 / 1.584962500721156) / ideal, abs=1e-9)


def test_self_filter(spark):
    qrels, lists = [("q", "p", 1)], [("q", ["q", "p"])]
    scores, audit = _evaluate(spark, lists, qrels, filter_self=True)
    assert scores["q"]["map"] == 1.0 and audit["n_self_matches"] == 1
    assert _evaluate(spark, lists, qrels)[0]["q"]["map"] == 0.5


def test_missing_policies(spark):
    qrels, lists = [("a", "x", 1), ("b", "y", 1)], [("a", ["x"]), ("c", ["z"])]
    scores, audit = _evaluate(spark, lists, qrels)
    assert scores["a"]["map"] == 1.0 and scores["b"]["map"] == 0.0
    assert (audit["n_missing"], audit["n_extra"], audit["n_scored"]) == (1, 1, 1)
    skipped, _ = _evaluate(spark, lists, qrels, policy="skip")
    assert set(skipped) == {"a"}


def test_empty_after_filter_is_missing(spark):
    scores, audit = _evaluate(spark, [("a", ["x"]), ("b", ["b"])], [("a", "x", 1), ("b", "y", 1)], filter_self=True)
    assert audit["n_missing"] == 1 and (scores["a"]["map"] + scores["b"]["map"]) / 2 == 0.5


def test_duplicates_and_truncation(spark):
    scores, audit = _evaluate(spark, [("q", ["a", "a", "b", "a"])], [("q", "b", 1)])
    assert audit["n_duplicates"] == 2 and scores["q"]["map"] == 0.5
    long = [("q", [f"f{i}" for i in range(1000)] + ["p"])]
    scores, audit = _evaluate(spark, long, [("q", "p", 1)])
    assert audit["n_truncated"] == 1 and scores["q"]["map"] == 0 and scores["q"]["recall_1000"] == 0
    assert _evaluate(spark, long, [("q", "p", 1)], max_docs=0)[0]["q"]["map"] > 0
    scores, audit = _evaluate(spark, [("q", ["a", "a", "b", "b", "p"])], [("q", "p", 1)], max_docs=3)
    assert audit["n_truncated"] == 0 and scores["q"]["recall_10"] == 1.0
    scores, audit = _evaluate(spark, [("q", ["q", "a", "p"])], [("q", "p", 1)], max_docs=2, filter_self=True)
    assert audit["n_truncated"] == 1 and scores["q"]["recall_10"] == 0
    with pytest.raises(ValueError):
        E.prepare_lists(spark.createDataFrame(long, LISTS), -1)


def test_ties_last_writes_and_no_positives(spark, rows):
    scored = spark.createDataFrame([("q", "d9", 1.0), ("q", "d10", 1.0), ("q", "d10", 0.5)], "qid string, doc_id string, score double")
    assert rows(E.ranked(scored), "rank", "doc_id") == [(1, "d9"), (2, "d10")]
    q = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", None, 2), (None, "a", 1, 3)], "qid string, doc_id string, rel int, n int")
    assert rows(E.last_wins(q, ["n"])) == [("q", "a", 0)]
    assert _scores(spark, [("q", "a", 1)], [("q", "a", 0)])["q"]["map"] == 0.0


def test_overlap_policy_and_means(spark):
    run, qrels = spark.createDataFrame([("q", "a", 1)], RUN), spark.createDataFrame([("x", "a", 1)], QRELS)
    with pytest.raises(ValueError):
        E.require_overlap(run, qrels)
    with pytest.raises(ValueError):
        E.per_query(run, qrels, policy="maybe")
    two = E.per_query(spark.createDataFrame([("a", "x", 1)], RUN), spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], QRELS))
    assert E.mean_metrics(two).first()["map"] == 0.5
    assert E.long_metrics(two).where(F.col("metric") == "AP").count() == 2


def test_ranks_of_a_hot_query_are_exact(spark):
    """One query holds nearly all of 100,000 rows, most of them ties: ranks are those of one sorted list."""
    rows = spark.range(100_000).selectExpr("if(id % 50 = 0, concat('q', id % 7), 'hot') AS qid", "concat('d', id) AS doc_id", "double(id % 3) AS score")
    got = E.ranked(rows)
    hot = [r["doc_id"] for r in got.where("qid = 'hot'").orderBy("rank").collect()]
    expected = sorted((f"d{i}" for i in range(100_000) if i % 50), key=lambda d: (int(d[1:]) % 3, d), reverse=True)
    assert hot == expected
    assert got.groupBy("qid").agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("k")).where("lo <> 1 or hi <> n or k <> n").count() == 0


def test_ranks_with_null_keys_and_no_rows(spark):
    schema = "model string, qid string, doc_id string, score double, rank string"
    df = spark.createDataFrame([(None, "q", "a", 1.0, "x"), (None, "q", "a", 2.0, "x"), (None, "q", "b", 1.5, "x"), ("m", None, "a", 1.0, "x")], schema)
    got = {tuple(r) for r in E.ranked(df, ["model"]).select("model", "qid", "doc_id", "rank").collect()}
    assert got == {(None, "q", "a", 1), (None, "q", "b", 2), ("m", None, "a", 1)}
    assert E.ranked(df.where("false"), ["model"]).count() == 0
