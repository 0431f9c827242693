from __future__ import annotations

import json

from tessera.operators import plugins
from tessera.plans import verbs
from tessera.sources import readers

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon"]


def _bundle(spark):
    corpus = spark.createDataFrame([(f"d{i}", f"{WORDS[i % 5]} text {i}") for i in range(50)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", WORDS[i], i) for i in range(5)], "qid string, text string, ord bigint")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i + j}", 1) for i in range(5) for j in (0, 5)], "qid string, doc_id string, rel int")
    return corpus, queries, qrels


def test_search_evaluate_mine(spark, tmp_path):
    corpus, queries, qrels = _bundle(spark)
    verbs.build_bm25_index(str(tmp_path), "en", corpus)
    run = verbs.run_bm25(spark, str(tmp_path), "en", queries)
    top, scores, means = verbs.persist_cell(run, qrels, "rat2rev")
    assert means.first()["recall_10"] == 1.0 and scores.count() == 5 and top.count() == 50
    triples = verbs.build_training_data(run, qrels, "rat2rev").collect()
    assert len(triples) == 10 and all(r["hard_negative_doc_id"] != r["positive_doc_id"] for r in triples)
    exp = spark.createDataFrame([("q0", "beta"), ("q1", "")], "qid string, expansion string")
    wider = verbs.run_bm25(spark, str(tmp_path), "en", queries, exp)
    assert wider.where("qid = 'q0'").count() == 20 and wider.where("qid = 'q1'").count() == 10


def test_dense_strategies_and_reranking(spark):
    corpus, queries, _ = _bundle(spark)
    encoder = plugins.HashingEncoder(plugins.ModelSpec("h", 256))
    for strategy in (*verbs.STRATEGIES, "maxp"):
        run = verbs.run_dense(queries, corpus, encoder, strategy, k=10)
        assert run.count() == 50
    again = verbs.run_rerank(run, queries, corpus, plugins.overlap_scorer, 10)
    assert {r["score"] for r in again.where("rank = 1").collect()} == {1.0}
    assert verbs.run_listwise(run, queries, corpus, plugins.overlap_ranker, 10).count() == 50


def test_external_run_and_significance(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text(json.dumps({"qid": "q", "ranked": ["q", "a", "p"]}) + "\n")
    (tmp_path / "qrels").write_text("q 0 p 1\n")
    _, means, audit = verbs.evaluate_ranked(spark, str(tmp_path / "run.jsonl"), str(tmp_path / "qrels"), "rev2rev")
    assert means.first()["map"] == 0.5 and audit.first()["n_self_matches"] == 1
    (tmp_path / "m").mkdir()
    for model, base in (("bm25", 0.1), ("m", 0.2), ("m-ft-rat2rev-en", 0.4)):
        cell = {"model": model, "task": "rat2rev", "lang": "en", "metrics": {"recall_100": base, "ndcg_10": base}}
        cell["per_query"] = {f"q{i}": {"R@100": base + 0.01 * i * base} for i in range(5)}
        (tmp_path / "m" / f"{model}.json").write_text(json.dumps(cell))
    cells = readers.metric_cells(spark, str(tmp_path / "m"))
    tests = {r["method"]: r for r in verbs.ttest_holm(cells).collect()}
    assert set(tests) == {"m", "m-ft-rat2rev-en"} and all(r["reject"] for r in tests.values())
    assert verbs.aggregate(cells, ["m"]).count() == 1
    configs = spark.createDataFrame([], "model string, task string, lang string, output_alias string, tuning_method string")
    da = verbs.aggregate_domain_adaptation(cells, configs).first()
    assert abs(da["delta_recall_100"] - 0.2) < 1e-9 and da["tuning_method"] is None


def test_resume_of_expansions(spark, tmp_path):
    path = str(tmp_path / "exp")
    prompts = spark.createDataFrame([("a", "one"), ("b", "two")], "qid string, prompt string")
    verbs.expand_queries(spark, path, prompts, lambda p: "" if p == "two" else "first")
    verbs.expand_queries(spark, path, prompts, lambda p: "second")
    assert {r["qid"]: r["expansion"] for r in readers.expansions(spark, path).collect()} == {"a": "first", "b": "second"}


def _bundles(spark):
    corpus, queries, qrels = _bundle(spark)
    again = queries.selectExpr("concat('d', ord) AS qid", "text", "ord")  # queries that are articles
    own = qrels.selectExpr("replace(qid, 'q', 'd') AS qid", "doc_id", "rel")
    b = lambda task, q, j: readers.Bundle(task, "en", "test", corpus, q, j)
    return {("rat2rev", "en"): b("rat2rev", queries, qrels), ("rev2rev", "en"): b("rev2rev", again, own)}


def test_all_cells_end_to_end(spark, tmp_path):
    root, cells = str(tmp_path), _bundles(spark)
    verbs.run_all(spark, root, cells, {"hash": plugins.HashingEncoder(plugins.ModelSpec("h", 256))}, k=30)
    found = readers.metric_cells(spark, f"{root}/metrics")
    assert {(r["model"], r["task"]) for r in found.collect()} == {(m, t) for m in ("bm25", "hash") for t in ("rat2rev", "rev2rev")}
    assert readers.complete_cells(found, ["recall_10", "map"]).where("not complete").count() == 0
    assert readers.per_query_scores(found).where("model = 'bm25' and task = 'rat2rev'").count() == 5 * 7
    # the raw run has the self matches, the lists of the second stage do not
    raw = readers.scored_run(spark, f"{root}/bm25_runs/rev2rev_en.jsonl")
    assert raw.where("qid = doc_id").count() == 5 and readers.first_stage_run(spark, root, "bm25", "rev2rev", "en").where("qid = doc_id").count() == 0
    assert readers.first_stage_run(spark, root, "hash", "rat2rev", "en").count() > 0
    verbs.write_aggregate(f"{root}/aggregate.json", found)
    assert spark.read.json(f"{root}/aggregate.json").count() == 2


def test_mining_chain_and_kept_lists(spark, tmp_path):
    root, cells = str(tmp_path), _bundles(spark)
    b = cells["rev2rev", "en"]
    verbs.build_bm25_index(root, "en", b.corpus)
    run = verbs.run_bm25(spark, root, "en", b.queries)
    first = verbs.build_top(spark, root, run, "bm25", "rev2rev", "en", "train", 5)
    again = verbs.build_top(spark, root, run, "bm25", "rev2rev", "en", "train", 5)
    assert (first.created, again.created, again.n_queries) == (True, False, 5)
    path, counters = verbs.mine_chain(spark, root, run, b.qrels, "bm25", "rev2rev", "en", "train", exact=True, k=5)
    triples = readers.triples(spark, path).collect()
    assert triples and all(r["qid"] not in (r["hard_negative_doc_id"],) for r in triples) and counters.first()["n_queries"] == 5
    try:
        verbs.build_top(spark, root, run, "bm25", "rev2rev", "en", "test")
        raise AssertionError("test is no training split")
    except ValueError:
        pass


def test_adaptation_report_with_significance_and_progress(spark, tmp_path):
    for model, base in (("enc", 0.2), ("enc-ft-rat2rev-en", 0.5)):
        cell = {"model": model, "task": "rat2rev", "lang": "en", "metrics": {"recall_100": base, "ndcg_10": base}}
        cell["per_query"] = {f"q{i}": {"R@100": base + 0.01 * i * base, "nDCG@10": 0.3} for i in range(6)}
        (tmp_path / f"{model}.json").write_text(json.dumps(cell))
    configs = spark.createDataFrame([("enc", "rat2rev", "en", "enc-ft-rat2rev-en", "full")], "model string, task string, lang string, output_alias string, tuning_method string")
    lines = [{"epoch": e, "step": e, "train_loss": 1.0, "val_loss": 1.0 / e, "lr": 0.1, "best": e == 2, "bad_epochs": 0} for e in (1, 2, 3)]
    (tmp_path / "epochs.jsonl").write_text("\n".join(map(json.dumps, lines)))
    epochs = readers.epoch_metrics(spark, str(tmp_path / "epochs.jsonl")).selectExpr("'enc-ft-rat2rev-en' AS alias", "*")
    row = verbs.aggregate_domain_adaptation(readers.metric_cells(spark, str(tmp_path / "*.json")), configs, epochs=epochs).first()
    tests = {s["metric"]: s for s in row["significance"]}
    assert row["tuning_method"] == "full" and abs(row["delta_recall_100"] - 0.3) < 1e-9
    assert tests["R@100"]["reject"] and tests["nDCG@10"]["p_raw"] == 1.0 and not tests["nDCG@10"]["reject"]
    assert (row["last"]["epoch"], row["best"]["epoch"]) == (3, 2)


def test_ledger_file(spark, tmp_path):
    calls = spark.createDataFrame([("m", "q1", 10, 2), ("m", "q1", 5, 1), ("m", "q2", 1, 1)], "model string, qid string, input_tokens bigint, output_tokens bigint")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_price double, output_price double")
    verbs.listwise_ledger(str(tmp_path / "x.api_ledger.json"), calls, prices, {"window_size": "20"})
    row = spark.read.json(str(tmp_path / "x.api_ledger.json")).first()
    assert (row["n_calls"], row["input_tokens"]) == (3, 16) and row["per_query_calls"]["q1"] == 2 and row["config"]["window_size"] == "20"


def test_prompts_by_task_and_language(spark):
    q = spark.createDataFrame([("a", "why"), ("b", "more")], "qid string, text string")
    pairs = spark.createDataFrame([("a", "old", None), ("b", None, "new")], "article_id_before string, text_before string, text_after string")
    got = {r["qid"]: r["prompt"] for r in verbs.expansion_prompts(q, "task_q2e", "rev2rev", "en", pairs).collect()}
    assert "old" in got["a"] and "deleted" in got["a"] and "new" in got["b"]
    assert "改正理由: why" in verbs.expansion_prompts(q, "task_q2e", "rat2rev", "ja").first()["prompt"]
    for bad, message in (((q, "task_q2e", "rev2rev", "en", pairs.limit(1)), "no article pair of query"), ((q, "other", "rat2rev", "en"), "unknown prompt family")):
        try:
            verbs.expansion_prompts(*bad).collect()
            raise AssertionError(message)
        except Exception as e:
            assert message in str(e)


def test_model_plugins():
    base = plugins.ModelSpec("enc", 8, 512, {"query": "q: "})
    spec = plugins.resolve_spec(base, {"max_length": 128, "output_alias": "enc-ft"}, {"max_length": 256, "output_alias": "x"})
    assert (spec.name, spec.token_limit, spec.before) == ("enc-ft", 128, {"query": "q: "})
    assert plugins.resolve_spec(base, None, {"max_length": 256}).token_limit == 256 and plugins.resolve_spec(base) == base
    score = plugins.yes_no_scorer(lambda chats: [(len(c), 1.0) for c in chats], "rank")
    assert score([("q", "d")]) == [len("<Instruct>: rank\n<Query>: q\n<Document>: d") - 1.0] and score([]) == []
