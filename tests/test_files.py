from __future__ import annotations

import gzip
import json

import pytest

from tessera.sources import readers, writers


def _write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n")
    return str(path)


def test_run_round_trip(spark, rows, tmp_path):
    run = spark.createDataFrame(
        [("q0", "a", 3.0, 1), ("q0", 'b"x', 2.5, 2), ("q0", "c", 1.0, 3), ("q1", "日本", 1.0, 1)], "qid string, doc_id string, score double, rank int"
    )
    writers.write_run(str(tmp_path / "run"), run)
    assert rows(readers.scored_run(spark, str(tmp_path / "run"))) == rows(run)
    writers.write_run(str(tmp_path / "cut"), run, 1)
    assert readers.scored_run(spark, str(tmp_path / "cut")).count() == 2


def test_strict_lists(spark, rows, tmp_path):
    good = tmp_path / "run.jsonl.gz"
    with gzip.open(good, "wt") as f:
        f.write('{"qid": 1, "ranked": ["a", ["b", 2.0]]}\n\n{"qid": "q2", "ranked": []}\n')
    assert rows(readers.ranked_lists(spark, str(good))) == [("1", ["a", "b"]), ("q2", [])]
    for lines, message in (
        ([{"qid": "q", "ranked": ["a"]}, {"qid": "q", "ranked": ["a"]}], "duplicate qid"),
        ([{"qid": "q", "ranked": [1]}], "document-ID strings"),
        (["", "{broken"], ":2: invalid JSON"),
        ([{"qid": "q"}], "required"),
        ([{"qid": "q", "ranked": "a"}], "list"),
    ):
        with pytest.raises(readers.RankedListError, match=message):
            readers.ranked_lists(spark, _write(tmp_path / "bad.jsonl", lines))


def test_judgments_of_both_formats(spark, rows, tmp_path):
    path = _write(tmp_path / "qrels", ["q1 0 d1 1", "q1 0 d2 0", "q2 Q0 d3 2", {"query-id": "q3", "corpus-id": "d", "score": 1}, {"query-id": "q3", "corpus-id": "d"}])
    assert rows(readers.qrels(spark, path)) == [("q1", "d1", 1), ("q1", "d2", 0), ("q2", "d3", 2), ("q3", "d", 0)]
    with pytest.raises(Exception, match="four columns"):
        readers.qrels(spark, _write(tmp_path / "wrong", ["q1 d1 1"])).collect()


def test_bundle(spark, rows, tmp_path):
    corpus = _write(tmp_path / "c.jsonl", [{"_id": f"d{i}", "text": "x"} for i in range(3)] + [{"_id": "n"}])
    queries = _write(tmp_path / "q.jsonl", [{"_id": "q2", "text": "b"}, {"_id": "q1", "text": "a"}, {"_id": "q3", "text": "c"}])
    qrels = _write(tmp_path / "r.jsonl", [{"query-id": "q1", "corpus-id": "d1", "score": 1}, {"query-id": "q2", "corpus-id": "d2", "score": 1}])
    b = readers.load_bundle(spark, corpus, queries, qrels, "rat2rev", "en")
    assert rows(b.queries, "qid") == [("q1",), ("q2",)] and readers.first_queries(b.queries, 1).first()["qid"] == "q2"
    assert ("n", "") in rows(b.corpus, "doc_id", "text")
    with pytest.raises(ValueError):
        readers.load_bundle(spark, corpus, queries, qrels, "other", "en")


def test_expansions_upsert(spark, rows, tmp_path):
    path = str(tmp_path / "exp")
    schema = "qid string, expansion string, error string"
    writers.upsert_expansions(spark, path, spark.createDataFrame([("b", "old", None), ("a", "keep", None)], schema))
    writers.upsert_expansions(spark, path, spark.createDataFrame([("b", "", "timeout")], schema))
    assert rows(readers.expansions(spark, path)) == [("a", "keep", None), ("b", "", "timeout")]
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "qid string")
    assert rows(writers.not_done(asked, readers.expansions(spark, path))) == [("b",), ("c",)]


def test_cells_and_configs(spark, rows, tmp_path):
    (tmp_path / "m").mkdir()
    cell = {"model": "m", "task": "rat2rev", "lang": "en", "metrics": {"map": 0.5}, "per_query": {"q": {"AP": 0.5, "R@10": 1.0}}}
    _write(tmp_path / "m" / "x.json", [cell])
    _write(tmp_path / "m" / "x.api_ledger.json", [{"n_calls": 3}])
    cells = readers.metric_cells(spark, str(tmp_path / "m"))
    assert cells.count() == 1 and readers.per_query_scores(cells).count() == 2
    assert rows(readers.complete_cells(cells, ["map"]), "complete") == [(True,)]
    assert rows(readers.complete_cells(cells, ["map", "recall_10"]), "complete") == [(False,)]
    for folder in ("other", "b"):
        (tmp_path / "t" / folder).mkdir(parents=True)
        _write(tmp_path / "t" / folder / "train_config.json", [{"model": "b", "task": "rat2rev", "lang": "en", "output_alias": "z", "tuning_method": folder}])
    assert rows(readers.train_configs(spark, str(tmp_path / "t" / "*" / "train_config.json")), "tuning_method") == [("b",)]


def test_paths_and_logs(spark, tmp_path):
    assert readers.first_stage_path("r", "bm25", "rat2rev", "en") == "r/bm25_top100/rat2rev_en.jsonl"
    a, b = spark.range(3), spark.range(4)
    assert writers.content_path("r", "x", a) != writers.content_path("r", "x", b)
    writers.append_log(str(tmp_path / "log"), a)
    writers.append_log(str(tmp_path / "log"), a)
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" if i % 7 else "\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "*.txt"))
        assert lines.rdd.getNumPartitions() > 4
        got = {(r["value"], r["line_no"]) for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"{n}{i}", i) for n in "ab" for i in range(1, 5001) if i % 7}


def test_upsert_keeps_one_record_and_recovers(spark, rows, tmp_path):
    path, schema = str(tmp_path / "exp"), "qid string, expansion string, error string, extra int"
    writers.upsert_expansions(spark, path, spark.createDataFrame([("a", "", "timeout", 1), ("a", "x", None, 2), ("a", None, None, 3)], schema))
    assert rows(readers.expansions(spark, path)) == [("a", "x", None)]
    (tmp_path / "exp").rename(tmp_path / "exp.old")  # what a crash between the two moves leaves behind
    writers.upsert_expansions(spark, path, spark.createDataFrame([("b", "y", None, 1)], schema))
    assert rows(readers.expansions(spark, path)) == [("a", "x", None), ("b", "y", None)]
    assert not (tmp_path / "exp.old").exists()


def test_first_documents_per_split_and_first_stage(spark, rows, tmp_path):
    run = spark.createDataFrame([(s, f"q-{s}", d, 3.0 - i, i + 1) for s in ("train", "test") for i, d in enumerate("abc")], "split string, qid string, doc_id string, score double, rank int")
    root = str(tmp_path)
    paths = writers.write_top(root, run, "rat2rev", "en", "m", 2)
    assert paths == {"train": f"{root}/dense_top100/train/rat2rev_en_m.jsonl", "test": f"{root}/dense_top100/rat2rev_en_m.jsonl"}
    assert rows(readers.first_stage_run(spark, root, "m", "rat2rev", "en"), "qid", "doc_id") == [("q-test", "a"), ("q-test", "b")]
    assert readers.first_stage_run(spark, root, "m", "rat2rev", "en", 1).count() == 1
    with pytest.raises(FileNotFoundError, match="bm25_top100"):
        readers.first_stage_run(spark, root, "bm25", "rat2rev", "en")
    with pytest.raises(ValueError, match="split"):
        writers.write_top(root, run.selectExpr("cast(null as string) AS split", "qid", "doc_id", "score", "rank"), "rat2rev", "en", "m")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera import session

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="share"):
        session.ensure_checkpoint_dir(Session())


def test_intermediate_tables_are_removed(spark):
    from tessera import session

    with session.intermediate_tables(spark):
        table = session.materialize(spark.range(5))
        assert table.count() == 5 and readers.exists(spark, session.tables_folder(spark))
    assert not readers.exists(spark, session.tables_folder(spark))
