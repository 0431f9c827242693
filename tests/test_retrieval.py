from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.plans import retrieval

CORPUS = "_id string, lang string, text string"
QUERIES = "_id string, ord bigint, lang string, task string, text string"


def _vector(text: str) -> np.ndarray:
    out = np.zeros(64)
    for tok in re.findall(r"[^\W_]+", text.lower()):
        h = int.from_bytes(hashlib.md5(tok.encode()).digest()[:8], "little")
        out[h % 64] += 1 if h >> 63 else -1
    return out / max(np.linalg.norm(out), 1e-9)


def test_encoded_corpus_topk_reads_whole_texts(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(600))
    corpus = [(f"d{i}", "en", f"{filler} {word * 400}") for i, word in enumerate(["harbour ", "glacier ", "orchard ", "turbine "])]
    corpus += [("short", "en", "granary"), ("none", "en", None)]
    queries = [("q0", 0, "en", "rat2rev", "turbine " * 400), ("q1", 50, "en", "rat2rev", f"{filler} {'glacier ' * 400}"), ("q2", 51, "en", "rat2rev", "x")]
    spark.createDataFrame(corpus, CORPUS).write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame(queries, QUERIES).write.parquet(f"{tmp_path}/queries.parquet")
    got = retrieval.encoded_corpus_topk(spark, str(tmp_path)).collect()
    docs = {d: _vector(f"passage: {t or ''}") for d, _, t in corpus}
    for qid, text in (("q0", queries[0][4]), ("q1", queries[1][4])):
        asked = _vector(f"query: {text}")
        expected = sorted(((float(asked @ v), d) for d, v in docs.items()), reverse=True)
        mine = sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in mine] == [d for _, d in expected]
        assert np.allclose([r["score"] for r in mine], [s for s, _ in expected], atol=1e-5)
    assert {r["doc_id"] for r in got if r["rank"] == 1} == {"d3", "d1"} and {r["qid"] for r in got} == {"q0", "q1"}


def test_rank_eval_audit_models_counts_every_list(spark, tmp_path):
    long = [f"d{i}" for i in range(1001)]
    lists = [
        ("m", "q", 1, ["d1", "d1", "d2"]), ("m", "q", 2, ["d3", "d3", "d3", "q"]), ("m", "q", 2, [f"d{i}" for i in range(10)] + ["q"]),
        ("m", "own", 1, ["own", "own"]), ("m", "new", 1, ["d1"]), ("m", "r", 1, None), ("m", "r", 2, []),
        ("n", "q", 1, long), ("n", "r", 1, [*long[:1000], "r"]), ("o", "r", 1, []), (None, "q", 1, ["d1"]),
    ]
    qrels = [(1, "q", "d1", 1), (2, "q", "d2", 1), (3, "r", "d1", 0), (4, "own", "d1", 1), (5, None, "d1", 1)]
    spark.createDataFrame(lists, "model_key string, qid string, shard int, ranked array<string>").write.parquet(f"{tmp_path}/dense_runs.parquet")
    judged = spark.createDataFrame(qrels, "qrel_id bigint, query_id string, corpus_id string, score int")
    judged.selectExpr("*", "timestamp'2024-01-01' AS loaded_at").write.parquet(f"{tmp_path}/qrels.parquet")
    names = ("n_lists", "n_duplicates", "n_truncated", "n_self_matches", "n_missing", "n_extra", "n_scored")
    got = {r["model_key"]: tuple(r[c] for c in names) for r in retrieval.rank_eval_audit_models(spark, str(tmp_path)).collect()}
    assert got == {"m": (6, 4, 0, 3, 2, 1, 1), "n": (2, 0, 2, 0, 1, 0, 2), "o": (1, 0, 0, 0, 3, 0, 0), None: (1, 0, 0, 0, 2, 0, 1)}
    con = duckdb.connect()
    for t in ("dense_runs", "qrels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    columns = ", ".join(("model_key", *names))
    assert {r[0]: r[1:] for r in con.execute(f"SELECT {columns} FROM ({retrieval.ORACLE['rank_eval_audit_models']})").fetchall()} == got


def _searched(spark, base) -> int:
    """Writes tables whose texts share most of their words; returns how many pairs of a query and a document share a term."""
    words = [f"w{i}" for i in range(40)]
    corpus = [(f"d{i:03}", "en", " ".join(["the", *words[i % 7 :], f"own{i}"])) for i in range(300)] + [("none", "en", None), ("ja", "ja", "条文の本文")]
    queries = [(f"q{i}", 50 * i, "en", "rat2rev", " ".join(["the", *words[i % 5 :]])) for i in range(20)] + [("blank", 5000, "en", "rat2rev", " "), ("qja", 6000, "ja", "rat2rev", "本文の条")]
    expansions = [(i, f"q{i}", "q2e_zs", f"w{i} own{i}") for i in range(10)] + [(100, "q1", "q2e_zs", "own7 own8"), (101, "q2", "q2e_zs", None), (102, "q3", "q2d_zs", "own9")]
    pairs = [(f"p{i}", f"d{i:03}", "" if i % 5 == 0 else f"own{i + 1} the added") for i in range(50)] + [("pz", "d001", "latest"), ("pn", None, "w1")]
    spark.createDataFrame(corpus, CORPUS).coalesce(1).write.parquet(f"{base}/corpus.parquet")
    spark.createDataFrame(queries, QUERIES).coalesce(1).write.parquet(f"{base}/queries.parquet")
    spark.createDataFrame(expansions, "exp_id bigint, qid string, family string, expansion string").coalesce(1).write.parquet(f"{base}/expansions.parquet")
    spark.createDataFrame(pairs, "pair_id string, article_id_before string, text_after string").coalesce(1).write.parquet(f"{base}/article_pairs.parquet")
    return 20 * 300


def _shuffled(spark) -> int:
    """Records that all stages so far have written to exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["bm25_query_expanded", "bm25_doc_augmented", "bm25_stop_words"])
def test_search_shuffles_neither_postings_nor_pairs(spark, tmp_path, name):
    pairs = _searched(spark, tmp_path)
    before = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for queries that are too many to be broadcast
    try:
        got = sorted(tuple(r[c] for c in ("qid", "rank", "doc_id", "score")) for r in retrieval.QUERIES[name](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _shuffled(spark) - before < pairs
    con = duckdb.connect()
    for t in ("corpus", "queries", "expansions", "article_pairs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT qid, rank, doc_id, score FROM ({retrieval.ORACLE[name]})").fetchall())
    assert len(got) == 20 * 100 + 1


def _shuffled_bytes(spark) -> int:
    """Bytes that all stages so far have written to exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_augmented_search_shuffles_texts_once(spark, tmp_path):
    """Texts go to the join with their augmentations once, and no document goes to the cells of the search."""
    rng = random.Random(5)
    words = [f"{rng.getrandbits(40):010x}" for _ in range(1500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    spark.createDataFrame([(f"d{i:03}", "en", text(1200)) for i in range(240)], CORPUS).coalesce(1).write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(f"q{i}", 50 * i, "en", "rat2rev", text(2)) for i in range(3)], QUERIES).coalesce(1).write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([(f"p{i}", f"d{i:03}", text(20)) for i in range(200)], "pair_id string, article_id_before string, text_after string").coalesce(1).write.parquet(f"{tmp_path}/article_pairs.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        at = [_shuffled_bytes(spark)]
        spark.read.parquet(f"{tmp_path}/corpus.parquet").repartition(4).write.format("noop").mode("overwrite").save()
        at.append(_shuffled_bytes(spark))
        got = sorted(tuple(r[c] for c in ("qid", "rank", "doc_id", "score")) for r in retrieval.QUERIES["bm25_doc_augmented"](spark, str(tmp_path)).collect())
        at.append(_shuffled_bytes(spark))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert at[2] - at[1] < 1.6 * (at[1] - at[0])
    con = duckdb.connect()
    for t in ("corpus", "queries", "article_pairs"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT qid, rank, doc_id, score FROM ({retrieval.ORACLE['bm25_doc_augmented']})").fetchall())
