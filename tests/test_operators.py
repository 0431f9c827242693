from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.tdist import two_sided
from tessera.operators import construct, contrastive, dense, mine, plugins, report, rerank, sparse, stats


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


# ---- text --------------------------------------------------------------------------------------


def test_tokens_and_ngrams(spark):
    assert _one(spark, T.tokens("t"), t="  It's Ärger_No. 5!  ") == ["it", "s", "ärger", "no", "5"]
    assert _one(spark, T.tokens("t"), t=" .. ") == [] and _one(spark, T.tokens("t"), t=None) == []
    assert _one(spark, T.char_ngrams("t", 2), t="水質、基準") == ["水質", "質基", "基準"]
    assert _one(spark, T.char_ngrams("t", 2), t="水") == []
    assert len(_one(spark, T.char_ngrams("t", 2), t="水" * 50_000)) == 49_999


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(130))
    assert [len(c) for c in _one(spark, T.chunks(T.tokens("t"), 72), t=words)] == [64, 64, 2]
    assert _one(spark, T.chunks(T.tokens("t"), 10), t="a b") == [["a", "b"]]
    assert _one(spark, T.chunks(T.tokens("t"), 72), t=" ") == []


def test_expansion_and_augmentation(spark):
    assert _one(spark, T.expand_sparse("q", "e"), q="a b", e="c") == "a b a b a b a b a b c"
    assert _one(spark, T.expand_sparse("q", "e"), q="a b", e="") == "a b" == _one(spark, T.expand_sparse("q", "e"), q="a b", e=None)
    assert _one(spark, T.expand_dense("q", "e"), q="a", e="b") == "a [SEP] b"
    assert _one(spark, T.augment("b", "a"), b="base", a="more") == "base more"
    assert _one(spark, T.augment("b", "a"), b="base", a="") == "base" == _one(spark, T.augment("b", "a"), b="base", a=None)


def test_prompts_prefixes_heads(spark):
    p = T.prompt("f", "q", "b", "a")
    assert "deleted" in _one(spark, p, f="task_q2e", q="q", b="old", a="")
    assert _one(spark, p, f="q2d_zs", q="x" * 5000, b="", a="").count("x") == T.PROMPT_CHARS
    with pytest.raises(Exception, match="unknown prompt family"):
        _one(spark, p, f="other", q="q", b="b", a="a")
    assert _one(spark, T.prefixed("t", "query: "), t=None) == "query: "
    assert _one(spark, T.head_words("t", 2), t=" a  b c ") == "a b"


def test_similarity_coefficients(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert _one(spark, T.dice(a, b), a="x y z", b="x y") == pytest.approx(0.8)
    assert _one(spark, T.simpson(a, b), a="x y z", b="x y") == 1.0


def test_names(spark):
    row = spark.createDataFrame([("bge-m3-lora-ft-rat2rev-en",), ("bge-m3",)], "a string").select(T.parse_alias("a").alias("p")).collect()
    assert row[0]["p"].asDict() == {"base_model": "bge-m3", "tuning_method": "lora", "train_task": "rat2rev", "train_lang": "en"}
    assert row[1]["p"]["base_model"] is None
    assert T.build_alias("m", "rat2rev", "ja") == "m-ft-rat2rev-ja"
    with pytest.raises(ValueError):
        T.check_alias("../bad")
    assert T.model_key("bm25", "d2e", "q2e_zs.small") == "bm25+d2e+q2e_zs.small"
    assert T.model_key("m", strategy="maxp") == "m-maxp-doc"
    with pytest.raises(ValueError):
        T.model_key("m", "d2e", strategy="maxp-q")
    assert T.expansion_suffix("/x/q2e_zs_lm-small_rat2rev_en_test.jsonl") == "q2e_zs.lm-small"


# ---- sparse ------------------------------------------------------------------------------------


def _brute_bm25(docs, query):
    toks = {d: t.split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for d, ts in toks.items():
        s = 0.0
        for q in query.split():
            df, tf = sum(q in x for x in toks.values()), ts.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * len(ts) / avg))
        if s:
            out[d] = round(s, 6)
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = {f"d{i}": " ".join(rng.choices(words, k=rng.randint(0, 15))) for i in range(40)}
    asked = {"q1": "w1 w2 w2", "q2": "w11", "q3": "  ", "q4": "absent"}
    df = spark.createDataFrame([(d, "en", t) for d, t in docs.items()], "doc_id string, space string, text string")
    q = spark.createDataFrame([(i, "en", t) for i, t in asked.items()], "qid string, space string, text string")
    tokens = T.tokens("text")
    run = sparse.bm25_search(sparse.query_terms(q, tokens), sparse.postings(df, tokens), sparse.collection_stats(df, tokens), 5).collect()
    for qid, text in asked.items():
        best = sorted(_brute_bm25(docs, text).items(), key=lambda x: (x[1], x[0]), reverse=True)[:5]
        assert [(r["doc_id"], r["score"]) for r in sorted((r for r in run if r["qid"] == qid), key=lambda r: r["rank"])] == best


def test_expansion_is_a_weight(spark):
    docs = spark.createDataFrame([("a", "en", "x y"), ("b", "en", "y z z")], "doc_id string, space string, text string")
    tokens = T.tokens("text")
    index, coll = sparse.postings(docs, tokens), sparse.collection_stats(docs, tokens)
    one = lambda t, w=1.0: sparse.query_terms(spark.createDataFrame([("q", "en", t)], "qid string, space string, text string"), tokens, w)
    by_weight = sparse.bm25_search(sparse.weighted_terms(one("x", 5.0), one("z")), index, coll)
    by_text = sparse.bm25_search(one("x x x x x z"), index, coll)
    assert sorted(map(tuple, by_weight.collect())) == sorted(map(tuple, by_text.collect()))
    with pytest.raises(ValueError):
        sparse.best_k(by_text, 0)


def test_cell_of_search_in_small_steps(spark, monkeypatch):
    """Scores in slices, several spaces, repeated and null ids, ties and rare terms, against sums in a dictionary."""
    rng = random.Random(11)
    terms = [f"t{i}" for i in range(30)]
    asked = [(s, q, {t: rng.choice([0.5, 1.25, 2.0]) for t in rng.sample(terms, n)}) for q, s, n in [("q1", "en", 12), ("q2", "en", 3), ("q2", "ja", 5), ("q3", "ja", 1), (None, "en", 4)]]
    docs = [(s, d, dl, {t: rng.randint(1, 3) for t in rng.sample([*terms, "other"], rng.randint(1, 25))}) for d in [None, *(f"d{i:03}" for i in range(90))] for s, dl in rng.choices([("en", 10), ("ja", 20), ("xx", 5)], k=rng.choice([1, 1, 1, 2]))]
    docs += [("en", f"e{i}", 10, {"t1": 1, "t2": 1, "t3": 1}) for i in range(20)]
    expected = {}
    for s, q, weights in asked:
        for space, d, dl, tf in docs:
            if space == s and (shared := weights.keys() & tf.keys()):
                expected[q, d] = expected.get((q, d), 0) + sum(weights[t] * tf[t] / (tf[t] + 0.9 * (0.6 + 0.4 * dl / 12.5)) for t in shared)
    schema = pa.schema([("side", pa.int32()), ("space", pa.string()), ("id", pa.string()), ("length", pa.float64()), ("terms", pa.string()), ("tf", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])
    rows = [{"side": 0, "space": s, "id": q, "length": 12.5, "terms": "\0".join(w), "tf": None, "weight": list(w.values())} for s, q, w in asked]
    rows += [{"side": 1, "space": s, "id": d, "length": float(dl), "terms": "\0".join(tf), "tf": list(tf.values()), "weight": None} for s, d, dl, tf in docs]
    key = lambda x: (x[1], x[0] or "")
    for at_once, held, size in ((4, 10, 3), (60, 10, 7), (4_000_000, 2_500_000, 1000)):
        monkeypatch.setattr(sparse, "_SCORES_AT_ONCE", at_once)
        monkeypatch.setattr(sparse, "HELD", held)
        found = pa.Table.from_batches(sparse._cell(iter(pa.Table.from_pylist(rows, schema).to_batches(size)), 6, 0.9, 0.4)).to_pylist()
        for q in ("q1", "q2", "q3", None):
            best = sorted(((d, round(s, 6)) for (p, d), s in expected.items() if p == q), key=key, reverse=True)[:6]
            assert sorted(((r["doc_id"], round(r["score"], 6)) for r in found if r["qid"] == q), key=key, reverse=True) == best
        assert len(found) == sum(min(6, sum(p == q for p, _ in expected)) for q in ("q1", "q2", "q3", None))


def test_search_over_a_grid_of_blocks(spark, monkeypatch):
    rng = random.Random(4)
    docs = {f"d{i}": " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for i in range(80)}
    asked = {f"q{i}": " ".join(set(rng.choices("abcdefghz", k=3))) for i in range(9)}
    df = spark.createDataFrame(list(docs.items()), "doc_id string, text string").selectExpr("*", "'en' AS space")
    q = spark.createDataFrame(list(asked.items()), "qid string, text string").selectExpr("*", "'en' AS space")
    tokens = T.tokens("text")
    monkeypatch.setattr(sparse, "BLOCK", 5)
    monkeypatch.setattr(sparse, "GROUP", 20)
    monkeypatch.setattr(sparse, "GROUP_BY_K", 1)
    run = sparse.bm25_search(sparse.query_terms(q, tokens), sparse.postings(df, tokens), sparse.collection_stats(df, tokens), 7).collect()
    for qid, text in asked.items():
        best = sorted(_brute_bm25(docs, text).items(), key=lambda x: (x[1], x[0]), reverse=True)[:7]
        assert [(r["doc_id"], r["score"]) for r in sorted((r for r in run if r["qid"] == qid), key=lambda r: r["rank"])] == best


def test_search_of_repeated_ids_in_several_parts(spark, monkeypatch):
    """Ids are neither sorted nor together in the index; rows of one id add up, ties go to the greater id."""
    rng = random.Random(6)
    rows = [(f"d{i % 50:02}", " ".join(rng.choices("abcdef", k=6))) for i in range(56)] + [(None, "a b c d e f"), (None, "f e d c b a")] + [(f"e{i}", "a b c d e f") for i in range(9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "'en' AS space").repartition(7)
    q = spark.createDataFrame([("q1", "a b"), ("q2", "c d e f a b"), ("q3", "f")], "qid string, text string").selectExpr("*", "'en' AS space")
    tokens = T.tokens("text")
    for name, n in (("GROUP", 10), ("GROUP_BY_K", 1), ("BLOCK_TERMS", 3), ("HELD", 60)):
        monkeypatch.setattr(sparse, name, n)
    run = sparse.bm25_search(sparse.query_terms(q, tokens), sparse.postings(df, tokens), sparse.collection_stats(df, tokens), 40).collect()
    single = {str(i): text for i, (_, text) in enumerate(rows)}
    for qid, text in (("q1", "a b"), ("q2", "c d e f a b"), ("q3", "f")):
        summed = {}
        for i, score in _brute_bm25(single, text).items():
            summed[rows[int(i)][0]] = summed.get(rows[int(i)][0], 0) + score
        best = sorted(((d, round(s, 6)) for d, s in summed.items()), key=lambda x: (x[1], x[0] or ""), reverse=True)[:40]
        mine = sorted((r for r in run if r["qid"] == qid), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in mine] == [d for d, _ in best]
        assert [r["score"] for r in mine] == pytest.approx([s for _, s in best], abs=1.5e-6)


# ---- dense -------------------------------------------------------------------------------------


def test_inner_product_case(spark):
    q = spark.createDataFrame([("q1", "q1", [1.0, 0.0]), ("q2", "q2", [0.0, 1.0])], "qid string, parent string, embedding array<double>")
    d = spark.createDataFrame([("x", "x", [1.0, 0.0]), ("y", "y", [0.0, 0.8]), ("z", "z", [0.7, 0.7])], "doc_id string, parent string, embedding array<double>")
    got = {(r["qid"], r["rank"]): (r["doc_id"], r["score"]) for r in dense.search(q, d, 2, block=1).collect()}
    assert got == {("q1", 1): ("x", 1.0), ("q1", 2): ("z", 0.7), ("q2", 1): ("y", 0.8), ("q2", 2): ("z", 0.7)}


def test_chunk_maxima_against_brute_force(spark):
    rng = np.random.default_rng(5)
    qv, dv = rng.normal(size=(7, 4)), rng.normal(size=(60, 4))
    q = spark.createDataFrame([(f"c{i}", f"q{i // 3}", list(map(float, v))) for i, v in enumerate(qv)], "qid string, parent string, embedding array<double>")
    d = spark.createDataFrame([(f"c{i}", f"d{i // 4}", list(map(float, v))) for i, v in enumerate(dv)], "doc_id string, parent string, embedding array<double>")
    got = {(r["qid"], r["rank"]): r["doc_id"] for r in dense.search(q, dense.by_parent(d), 3, block=2).collect()}
    scores = qv @ dv.T
    for p in range(3):
        rows = [i for i in range(7) if i // 3 == p]
        best = {f"d{j}": round(float(scores[rows][:, 4 * j : 4 * j + 4].max()), 6) for j in range(15)}
        top = sorted(best, key=lambda x: (best[x], x), reverse=True)[:3]
        assert [got[(f"q{p}", r)] for r in (1, 2, 3)] == top


def test_many_blocks_and_groups_against_brute_force(spark):
    rng = np.random.default_rng(8)
    qv, dv = rng.integers(-3, 4, size=(30, 3)), rng.integers(-3, 4, size=(400, 3))  # many ties
    nan = float("nan")
    q = [(f"c{i}", f"q{i // 2}", [float(x) for x in v]) for i, v in enumerate(qv)] + [("n", "qn", [nan, 1.0, 1.0]), ("m", "qm", None)]
    # one document owns a third of all chunks, and a third of all rows are copies of one row
    d = [(f"c{i}", "hot" if i % 3 == 0 else f"d{i % 90}", [float(x) for x in v]) for i, v in enumerate(dv)]
    d += [("copy", "dc", [1.0, 1.0, 1.0])] * 200 + [("null", "dn", None), ("nan", "dx", [nan, 0.0, 0.0])]
    qs = spark.createDataFrame([(*r, "x") for r in q], "qid string, parent string, embedding array<double>, score string").repartition(3)
    ds = spark.createDataFrame([(*r, 1) for r in d], "doc_id string, parent string, embedding array<double>, rank int").repartition(5)
    best = {}
    for _, a, x in q:
        for _, b, y in d:
            s = sum(m * n for m, n in zip(x or (), y or ())) if x and y else nan
            if s == s:
                best[a, b] = max(s, best.get((a, b), s))
    expected = set()
    for a in {r[1] for r in q}:
        mine = sorted(((s, b) for (p, b), s in best.items() if p == a), reverse=True)[:7]
        expected |= {(a, b, s, n + 1) for n, (s, b) in enumerate(mine)}
    for block, group in ((5, 40), (2048, 65_536), (100, 7)):
        assert {tuple(r) for r in dense.search(qs, ds, 7, block, group).select("qid", "doc_id", "score", "rank").collect()} == expected
    assert "qm" not in {r[0] for r in expected} and len(expected) == 15 * 7


def test_search_of_nothing_and_normalisation(spark):
    empty = spark.createDataFrame([], "qid string, parent string, embedding array<double>")
    d = spark.createDataFrame([("x", "x", [3.0, 4.0])], "doc_id string, parent string, embedding array<double>")
    assert dense.search(empty, d, 2).count() == 0
    assert dense.normalised(d).first()["embedding"] == [0.6, 0.8]
    with pytest.raises(ValueError):
        dense.search(empty, d, 0)


# ---- statistics --------------------------------------------------------------------------------


def test_student_t():
    assert two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert two_sided(0.0, 5) == 1.0
    assert two_sided(5.292544, 112) == pytest.approx(6.064573e-07, rel=1e-5)
    assert two_sided(-3.599716, 112) == pytest.approx(4.759862e-04, rel=1e-5)
    assert two_sided(2.267495, 112) == pytest.approx(2.527853e-02, rel=1e-5)


def test_holm(spark, rows):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.5), ("g", "a", 0.04)], "family string, m string, p_raw double")
    got = {(r["family"], r["m"]): (round(r["p_adj_holm"], 9), r["reject"]) for r in stats.holm(df, ["family"], ["m"]).collect()}
    assert got == {("f", "a"): (0.04, True), ("f", "c"): (0.09, False), ("f", "b"): (0.09, False), ("f", "d"): (0.5, False), ("g", "a"): (0.04, True)}


def test_paired_tests(spark):
    rng = random.Random(1)
    rows = []
    for q in range(20):
        b = rng.random()
        rows += [("base", q, b), ("same", q, b), ("better", q, b + 0.1 + 0.01 * rng.random())]
    rows += [("short", 0, 1.0)]
    scores = spark.createDataFrame([(m, "t", "en", str(q), "AP", float(v)) for m, q, v in rows], "model string, task string, lang string, qid string, metric string, value double")
    got = {r["method"]: r for r in stats.compare_to_baseline(scores, "base").collect()}
    assert set(got) == {"same", "better"}
    assert got["same"]["t_stat"] == 0.0 and got["same"]["p_raw"] == 1.0
    assert got["better"]["reject"] and got["better"]["meandiff"] > 0
    pairs = spark.createDataFrame([("better", "base")], "method string, baseline string")
    assert stats.compare_adapted(scores, pairs, ["AP"]).count() == 1


# ---- mining and construction -------------------------------------------------------------------

RUN, QRELS = "qid string, doc_id string, rank int", "qid string, doc_id string, rel int"


def test_mining(spark, rows):
    run = spark.createDataFrame([("q1", "q1", 1), ("q1", "positive", 2), ("q1", "hard", 3)], RUN)
    qrels = spark.createDataFrame([("q1", "positive", 1)], QRELS)
    for mined in (mine.mine_hashed(run, qrels, True), mine.mine_replayed(run, qrels, True)):
        assert rows(mined, "qid", "positive_doc_id", "hard_negative_doc_id") == [("q1", "positive", "hard")]
    run = spark.createDataFrame([("q1", "p1", 1), ("q1", "n1", 2), ("q2", "p2", 1)], RUN)
    qrels = spark.createDataFrame([("q1", "p1", 1), ("q2", "p2", 1)], QRELS)
    c = mine.mining_counters(run, qrels, False).first()
    assert (c["n_examples"], c["n_without_candidates"], c["n_missing"]) == (1, 1, 0)


def test_replayed_draws(spark, rows):
    run = spark.createDataFrame([("q", f"n{i}", i + 1) for i in range(4)], RUN)
    qrels = spark.createDataFrame([("q", f"p{i}", 1) for i in range(3)], QRELS)
    rng = random.Random(42)
    expected = [("q", f"p{i}", rng.choice([f"n{j}" for j in range(4)])) for i in range(3)]
    assert rows(mine.mine_replayed(run, qrels, False, 42), "qid", "positive_doc_id", "hard_negative_doc_id") == expected


def test_construction(spark, rows):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "event_id bigint, doc_id string")
    assert rows(construct.article_judgments(members), "qid", "doc_id", "rel") == [("a", "b", 1), ("b", "a", 1)]
    split = construct.event_split(spark.range(3000).withColumnRenamed("id", "event_id")).groupBy("split").count().collect()
    assert len(split) == 3 and all(850 < r["count"] < 1150 for r in split)
    pairs = spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("a", "b")], "text_before string, text_after string")
    assert construct.changed_pairs(pairs).count() == 2
    versions = spark.createDataFrame([("x", "v1", 1), ("x", "v2", 5), ("x", "v3", 9), ("y", "w1", 1), ("y", "w2", 7)], "article string, version string, valid_from int")
    amended = spark.createDataFrame([("x", 3, 9), ("y", 3, None)], "article string, window_start int, amended_at int")
    assert rows(construct.corpus_versions(versions, amended)) == [("x", "v2"), ("y", "w1")]


def test_alignment(spark, rows):
    schema = "act string, id string, tokens array<string>, n_chars int"
    left = spark.createDataFrame([("A", "l1", ["a", "b", "c"], 50), ("A", "l2", ["a", "b", "x"], 50)], schema)
    right = spark.createDataFrame([("A", "r1", ["a", "b", "c"], 50), ("A", "r2", ["a", "b", "x", "y"], 50)], schema)
    scored = construct.similarity_pairs(left, right, ["act"])
    matched = construct.greedy_alignment(scored.withColumn("is_match", F.lit(True)), "act")
    assert rows(matched, "left_id", "right_id") == [("l1", "r1"), ("l2", "r2")]


def test_matching_pairs_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, 12) for _ in range(6)]
    def vary(i):
        t = list(base[i % 6])
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t[: rng.choice([2, 5, 12])] + ["every"]
    schema = "act string, id string, tokens array<string>, n_chars int, dice string"
    left = [(rng.choice("AB"), f"l{i}", vary(i), rng.choice([30, 60]), "") for i in range(60)] + [("A", "ln", None, 60, ""), (None, "lx", ["a"], 60, ""), ("A", "le", [], 60, "")]
    right = [(rng.choice("AB"), f"r{i}", vary(i), rng.choice([30, 60]), "") for i in range(60)] + [("A", "re", [], 60, "")]
    expected = set()
    for a, i, x, n, _ in left:
        for b, j, y, m, _ in right:
            if a == b and x and y:
                x_, y_ = set(x), set(y)
                both = len(x_ & y_)
                if 2 * both >= 0.7 * (len(x_) + len(y_)) - 1e-9 or (both >= 0.95 * min(len(x_), len(y_)) and min(n, m) > 40):
                    expected.add((i, j))
    got = construct.similarity_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["act"])
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == expected and len(expected) > 50


# ---- reranking ---------------------------------------------------------------------------------


def test_windows_and_permutations():
    assert rerank.window_starts(100) == [80, 70, 60, 50, 40, 30, 20, 10, 0]
    assert rerank.window_starts(5) == [0] and rerank.window_starts(25) == [5, 0]
    assert rerank.parse_permutation("[3] > [1] > [3] > [9]", 4) == [2, 0, 1, 3]
    ids, calls = rerank.slide("q", [(f"d{i}", str(i)) for i in range(25)], lambda q, docs: " > ".join(f"[{i}]" for i in sorted(range(1, len(docs) + 1), key=lambda i: -int(docs[i - 1]))))
    assert calls == 2 and ids[0] == "d24"


def test_rerank_ties_and_blanks(spark, rows):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "blank", 4), ("q", "gone", 5)], RUN)
    queries = spark.createDataFrame([("q", "x y")], "qid string, text string")
    corpus = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x y"), ("blank", "")], "doc_id string, text string")
    got = rerank.rerank(rerank.candidate_texts(run, queries, corpus, 10), plugins.overlap_scorer)
    assert rows(got, "rank", "doc_id") == [(1, "c"), (2, "a"), (3, "b")]
    kept = rerank.listwise(rerank.candidate_texts(run, queries, corpus, 10, True), plugins.overlap_ranker)
    assert rows(kept, "rank", "doc_id")[:2] == [(1, "c"), (2, "a")] and kept.count() == 5


def test_generator_retries(spark):
    calls = spark.createDataFrame([("a", "ok"), ("b", "filtered"), ("c", "down")], "qid string, prompt string")

    def model(prompt):
        if prompt == "filtered":
            raise plugins.Refused
        if prompt == "down":
            raise TimeoutError
        return "answer"

    got = {r["qid"]: (r["expansion"], r["error"]) for r in plugins.generate(calls, model, 2, lambda s: None).collect()}
    assert got == {"a": ("answer", None), "b": ("", "content_filter"), "c": ("", "TimeoutError")}
    assert plugins.mean_pool(np.array([[1.0, 1], [3, 5], [100, 100]]), np.array([1, 1, 0])).tolist() == [2.0, 3.0]


# ---- training numerics and reports -------------------------------------------------------------


def test_contrastive(spark):
    eye = np.eye(3).tolist()
    batch = spark.createDataFrame([(i, f"q{i}", f"p{i}", f"n{i}") for i in range(3)], "row int, qid string, positive_doc_id string, hard_negative_doc_id string")
    q = spark.createDataFrame([(f"q{i}", eye[i]) for i in range(3)], "qid string, embedding array<double>")
    d = spark.createDataFrame([(f"p{i}", eye[i]) for i in range(3)] + [(f"n{i}", eye[2 - i]) for i in range(3)], "doc_id string, embedding array<double>")
    logits = contrastive.batch_logits(batch, q, d, 1.0)
    assert logits.count() == 18 and logits.where("is_label").agg(F.min("logit")).first()[0] == 1.0
    pos = spark.createDataFrame([(i, ["p0", "p1"]) for i in range(3)], "row int, qrel_positive_doc_ids array<string>")
    masked = contrastive.mask_known_positives(logits, pos)
    assert {(r["row"], r["col"]) for r in masked.where("masked").collect()} == {(0, 1), (1, 0), (2, 0), (2, 1)}
    matrix = np.array([[r["logit"] for r in sorted(logits.where(f"row = {i}").collect(), key=lambda r: r["col"])] for i in range(3)])
    expected = float(np.mean([np.log(np.exp(m).sum()) - m[i] for i, m in enumerate(matrix)]))
    assert contrastive.mean_loss(contrastive.row_losses(logits)).first()["loss"] == pytest.approx(expected, abs=1e-6)
    with pytest.raises(ValueError):
        contrastive.batch_logits(batch, q, d, 0)


def test_schedules(spark):
    losses = [1.0, 1.1, 0.9, 0.95, 0.96, 0.97, 0.1]
    epochs = spark.createDataFrame([(i + 1, x) for i, x in enumerate(losses)], "epoch bigint, val_loss double")
    got = contrastive.early_stopping(epochs).orderBy("epoch").collect()
    assert len(got) == 6 and got[-1]["stop"] and got[-1]["bad_epochs"] == 3 and [r["best"] for r in got][:3] == [True, False, True]
    lr = [r["lr"] for r in contrastive.learning_rate(spark.range(5).withColumnRenamed("id", "step"), 1.0, 2, 4).orderBy("step").collect()]
    assert lr == [0.0, 0.5, 1.0, 0.5, 0.0]
    parts = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n int")
    assert contrastive.weighted_mean_loss(parts).first()["loss"] == 1.25


def test_costs(spark, rows):
    prices = spark.createDataFrame([("m", 0.4, 1.6)], "model string, input_price double, output_price double")
    cells = spark.createDataFrame([("rat2rev-en", "m", 113)], "cell string, model string, n_queries int")
    got = dict(rows(report.cost_estimate(cells, prices, 9, 10_000, 100), "cell", "cost_usd"))
    assert got == {"rat2rev-en": 4.23072, "__total__": 4.23072}
    calls = spark.createDataFrame([("m", "q", 1_000_000, 0), ("other", "q", 5, 5)], "model string, qid string, input_tokens bigint, output_tokens bigint")
    assert dict(rows(report.ledger(calls, prices), "model", "cost_usd")) == {"m": 0.4, "other": 0.0}


def test_domain_adaptation_report(spark):
    adapted = spark.createDataFrame([("m-ft", "m", "t", "en", 0.6)], "model string, base_model string, task string, lang string, r double")
    base = spark.createDataFrame([("m", "t", "en", 0.4)], "model string, task string, lang string, r double")
    assert report.deltas(adapted, base, ["r"]).first()["delta_r"] == pytest.approx(0.2)
    aliases = spark.createDataFrame([("b-ft-rat2rev-en", "b", "rat2rev", "en")], "alias string, base_model string, train_task string, train_lang string")
    configs = spark.createDataFrame([("b", "rat2rev", "en", "b-lora-ft-rat2rev-en", "lora")], "model string, task string, lang string, output_alias string, tuning_method string")
    got = report.attach_configs(aliases, configs).first()
    assert (got["tuning_method"], got["how"]) == ("lora", "fallback")
    table = spark.createDataFrame([("m", 0.5, 0.1, True)], "model string, value double, delta double, reject boolean")
    assert "+0.100†" in report.markdown_table(table, "R@100")
    assert pd.notna(got["alias"])
