from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import similarity as S
from tessera.llm.shingles import ShingleRule, Shingler, Sketcher, SketchPlan, jaccard

RULE = ShingleRule(word_n=3, char_n=5)
RECORDS = "rec string, space string, lang string, text string, extra int"


def _plain(text, lang):
    tokens, t = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            t += c
        elif t:
            tokens.append(t)
            t = ""
    if lang == "ja":
        s = "".join(tokens)
        return {s[i : i + 5] for i in range(len(s) - 4)}
    return {tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)}


def _variants(n=60, seed=4):
    """Families of edited texts: (id, lang, text)."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for f in range(n // 6):
        base = rng.choices(words, k=60)
        for v in range(6):
            t = list(base)
            for _ in range(v * 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            lang = "ja" if f % 3 == 0 else "en"
            out.append((f"{f}-{v}", lang, ("" if lang == "ja" else " ").join(t)))
    return out


def _expected(rows, threshold):
    sets = [(i, g, _plain(t, g)) for i, g, t in rows]
    out = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, g, a), (j, h, b) = sets[x], sets[y]
            if i != j and g == h and a and b and len(a & b) >= threshold * len(a | b):
                out.add(tuple(sorted((i, j))))
    return out


def test_shingles_are_the_sets_of_the_definition():
    sh = Shingler(RULE)
    for text, lang in [("A b, c D-e_f 1.5", "en"), ("水質基準の、検査を行う", "ja"), ("a b", "en"), ("", "ja"), ("ＡＢ é ß", "fr")]:
        assert len(sh(text, lang)) == len(_plain(text, lang))
    a, b = "one two three four five", "one two three four six"
    assert jaccard(sh(a, "en"), sh(b, "en")) == pytest.approx(2 / 4)
    assert jaccard(sh("", "en"), sh("", "en")) == 0.0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    plan = SketchPlan()
    sk = Sketcher(plan)
    common, x, y = (rng.integers(1, 2**63, size=n, dtype=np.uint64) for n in (900, 50, 50))
    odd = sk.odd_sketches(sk.minima([np.concatenate([common, x]), np.concatenate([common, y])]))
    bits = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
    estimate = 1 + plan.bits / (4 * plan.samples) * np.log(1 - 2 * bits / plan.bits)
    assert estimate == pytest.approx(0.9, abs=0.06)
    assert bits <= sk.most_differing_bits(0.9)


def test_pairs_against_brute_force(spark, rows):
    data = _variants()
    data += [("copy", *data[0][1:]), ("null", "en", None), ("nolang", None, "w1 w2 w3 w4"), ("short", "en", "w1 w2"), ("empty", "en", "")]
    df = spark.createDataFrame([(i, "t", g, x, 1) for i, g, x in data], RECORDS)
    members, links = S.near_duplicates(df, 0.6, RULE)
    got = set(rows(S.record_pairs(members, links), "rec_a", "rec_b"))
    assert got == _expected([d for d in data if d[1] and d[2]], 0.6)
    groups = {r["rec"]: r["group_id"] for r in S.connected_groups(members, links).collect()}
    assert set(groups) == {x for p in got for x in p}
    assert all(groups[a] == groups[b] for a, b in got)
    assert all(min(i for i, g in groups.items() if g == gid) == gid for gid in set(groups.values()))


def test_many_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(f"r{i:04d}", "t", "en", text, 0) for i in range(600)] + [("x", "t", "en", text + " more", 0)], RECORDS)
    members, links = S.near_duplicates(df, 0.6, RULE)
    assert links.count() == 1 and members.select("cls").distinct().count() == 2
    groups = S.connected_groups(members, links)
    assert groups.count() == 601 and groups.select("group_id").distinct().count() == 1


def test_empty_and_two_texts_per_record(spark, rows):
    none = spark.createDataFrame([], RECORDS)
    members, links = S.near_duplicates(none, 0.6, RULE)
    assert S.record_pairs(members, links).count() == 0 and S.connected_groups(members, links).count() == 0
    a, b = "one two three four five six", "seven eight nine ten eleven"
    df = spark.createDataFrame([("r1", "t", "en", a, 0), ("r1", "t", "en", b, 0), ("r2", "t", "en", a, 0), ("r3", "t", "en", b, 0)], RECORDS)
    members, links = S.near_duplicates(df, 0.6, RULE)
    assert rows(S.record_pairs(members, links)) == [("r1", "r2"), ("r1", "r3")]
    assert {r["group_id"] for r in S.connected_groups(members, links).collect()} == {"r1"}


def test_cross_split(spark, rows):
    data = _variants(48)
    splits = {d[0]: ("train", "test", "validation", None)[k % 4] for k, d in enumerate(data)}
    table = [(i, "q" if k % 2 else "p", g, x, splits[i]) for k, (i, g, x) in enumerate(data)]
    df = spark.createDataFrame(table, "rec string, space string, lang string, text string, split string")
    got = {(r["space"], *sorted((r["rec_train"], r["rec_eval"]))) for r in S.cross_split_pairs(df, "train", 0.6, RULE).collect()}
    expected = set()
    for space in "qp":
        for a, b in _expected([(i, g, x) for i, s, g, x, _ in table if s == space], 0.6):
            if None not in (splits[a], splits[b]) and (splits[a] == "train") != (splits[b] == "train"):
                expected.add((space, a, b))
    assert got == expected


def test_bands_are_independent():
    plan = SketchPlan()
    chosen = Sketcher(plan)._bands
    assert chosen.shape == (plan.bands, plan.rows) and len(np.unique(chosen)) == chosen.size
