from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mix, pack
from tessera.llm.tokens import TokenCounter, count_tokens, source_name


def test_token_counter():
    count = TokenCounter()
    assert count("") == 0 and count("The wind farm.") >= 3
    assert 0 < count("あ" * 60_000) < 180_001  # a run far too long to merge at once


def test_source_names_and_null_texts(spark, rows):
    df = spark.createDataFrame([(1, " A  b ", "x"), (2, "A_B", None), (3, None, ""), (4, "a-b", "x y")], "doc_id bigint, source string, text string")
    assert rows(count_tokens(df)) == [(1, "a_b", 1), (3, None, 0), (4, "a_b", 2)]
    assert df.select(source_name("source").alias("s")).first()["s"] == "a_b"


def test_pack_fills_and_mixes():
    rng = random.Random(1)
    items = [(rng.choice("aaab"), i, 0, rng.randint(1, 300)) for i in range(3000)]
    total = Counter()
    for q, _, _, n in items:
        total[q] += n
    shares = {q: n / sum(total.values()) for q, n in total.items()}
    windows, _ = pack.pack(items, shares, capacity=1000)
    assert sorted(k for w in windows for k, _, _ in w) == list(range(3000))
    assert all(sum(n for _, _, n in w) <= 1000 for w in windows)
    used = sum(total.values()) / (1000 * len(windows))
    assert used > 0.98
    queue = {i: q for q, i, _, _ in items}
    run = Counter()
    for k, w in enumerate(windows[: len(windows) * 3 // 4]):
        for i, _, n in w:
            run[queue[i]] += n
        # the mixture follows the target in every prefix, to within an item
        assert abs(run["b"] - shares["b"] * sum(run.values())) <= 1300, k


def test_pack_items(spark, rows):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b", None, "odd"]), rng.choice([0, 1, 50, 99, 400])) for i in range(2000)] + [(9000, "a", 2500), (9001, "a", 2000)]
    df = spark.createDataFrame(data, "id bigint, queue string, n_tokens bigint")
    out = pack.pack_items(df, ["a", "b"], 1000, 40_000).collect()
    sizes, fill = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["id"]] += r["n_tokens"]
        fill[r["container_id"]] += r["n_tokens"]
    assert sizes == {i: n for i, _, n in data}
    assert max(fill.values()) <= 1000
    pieces = Counter(r["id"] for r in out)
    assert pieces[9000] == 3 and pieces[9001] == 2 and all(n == 1 for i, n in pieces.items() if i < 9000)
    assert sum(fill.values()) / (1000 * len(fill)) > 0.9
    report = pack.packing_report(spark.createDataFrame(out), 1000).first()
    assert report["tokens"] == sum(n for _, _, n in data) and report["n_containers"] == len(fill)
    assert pack.pack_items(df.where("false"), ["a"], 1000).count() == 0
    assert pack.pack_items(spark.createDataFrame([(1, "a", 0)], "id bigint, queue string, n_tokens bigint"), ["a"], 1000).count() == 1


STYLE = {"law": "Article {i}\n(a) The party shall act; see point {i}.\n", "talk": "- so we said: hello, friend {i}!\n- and then? yes!\n", "card": "<b>{i}</b> = {i} % | {i}\n"}


def _documents(spark, seed=5, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(list(STYLE), [6, 3, 1])[0]
        text = "".join(STYLE[s].format(i=rng.randint(1, 99)) for _ in range(rng.randint(1, 12)))
        named = rng.choices([s, s.upper(), None], [8, 1, 1])[0]
        rows.append((i, text, named, s))
    rows += [(9000, None, "law", ""), (9001, "", "law", ""), (9002, "Article 1\n" * 50, "elsewhere", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, truth string")


def test_mix_reaches_targets(spark):
    docs = _documents(spark)
    targets = spark.createDataFrame([("law", 0.5, 1), ("talk", 0.4, 3), ("card", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mix.mix_sources(docs, targets)
    out = mixed.collect()
    total = sum(r["n_tokens"] for r in count_tokens(docs).collect())
    assert sum(r["n_tokens"] * r["copies"] for r in out) == pytest.approx(total / 2, rel=0.03)
    caps = {"law": 1, "talk": 3, "card": 4}
    assert all(1 <= r["copies"] <= caps.get(r["source"], 4) for r in out)
    assert not {r["doc_id"] for r in out} & {9000, 9001, 9002}
    assert len({r["doc_id"] for r in out}) == len(out)
    for r in mix.mix_report(mixed, targets).collect():
        assert r["actual_share"] == pytest.approx(r["target_share"], abs=0.02)


def test_mix_reports_what_it_cannot_reach(spark):
    docs = _documents(spark, 6, 400)
    targets = spark.createDataFrame([("card", 0.9, 1), ("law", 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix.mix_report(mix.mix_sources(docs, targets), targets).collect()}
    assert report["card"]["actual_share"] < 0.9 and report["card"]["most_repeats"] == 1
    assert mix.mix_sources(docs.where("false"), targets).count() == 0


def test_classifier_on_held_out_documents(spark):
    docs = _documents(spark, 7, 1200)
    names = sorted(STYLE)
    model = mix.train_classifier(docs.where("doc_id < 800"), names)
    held = docs.where("doc_id >= 800 and doc_id < 9000").collect()
    right = sum(names[int(np.argmax(model.posterior(r["text"])))] == r["truth"] for r in held)
    assert right > 0.97 * len(held)


def test_pack_to_stated_targets(spark):
    rng = random.Random(9)
    data = [(i, rng.choices(["a", "b", "stray"], [8, 3, 1])[0], rng.randint(1, 120)) for i in range(6000)] + [(7000, "a", 2300), (7001, "b", 0), (7001, "b", 0)]
    df = spark.createDataFrame(data, "id bigint, queue string, n_tokens bigint")
    targets = {"a": 0.5, "b": 0.5}
    packed = pack.pack_items(df, ["a", "b"], 1000, 60_000, targets)
    out = packed.collect()
    placed, fill = Counter(), Counter()
    for r in out:
        placed[r["id"]] += r["n_tokens"]
        fill[r["container_id"]] += r["n_tokens"]
    assert placed == Counter({i: n for i, _, n in data}) and max(fill.values()) <= 1000
    assert sum(r["id"] == 7001 for r in out) == 2
    mixed = [r for r in out if r["mixed"]]
    share = Counter()
    for r in mixed:
        share[r["queue"]] += r["n_tokens"]
    # b is the scarce one: nearly all of it is mixed, one to one
    assert set(share) == {"a", "b"} and abs(share["a"] / sum(share.values()) - 0.5) < 0.02
    assert share["b"] > 0.9 * sum(n for _, q, n in data if q == "b")
    report = pack.packing_report(packed, 1000, targets).first()
    assert report["mean_deviation"] < 0.08 and report["unused_share"] < 0.05
    assert abs(report["mixed_share"] - sum(share.values()) / sum(placed.values())) < 1e-9
    assert pack.pack_items(df.where("queue = 'stray'"), ["a", "b"], 1000, 60_000, targets).where("mixed").count() == 0
    assert pack.pack_items(df.where("false"), ["a", "b"], 1000, 60_000, targets).count() == 0
