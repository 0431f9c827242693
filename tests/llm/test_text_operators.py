from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import canon, defects, split, subjects, topn

# ---- canonical form ----------------------------------------------------------------------------

SAME = [
    ("the office", "ｔｈｅ oﬃce"),
    ("café", "café"),
    ("non-smoking", "non‐smoking"),
    ("a b", "a b"),
    ("a b", "a　b"),
    ("word", "wo​rd﻿"),
    ("word", "wo­rd"),
    ("Annex III", "Annex Ⅲ"),
    ("ガイド", "ｶﾞｲﾄﾞ"),
    ("が", "が"),
    ("大気", "⼤気"),
    ("青い", "⾭ い".replace(" ", "")),
    ("ロニカ", "口二力"),
    ("ペロ", "ぺ口"),
    ("scope", "ѕсоре"),
    ("É", "Έ"),
]
DIFFERENT = [("cafe", "café"), ("はん", "ばん"), ("ハ", "パ"), ("The", "the"), ("a,b", "a;b"), ("a  b", "a b"), ("a\nb", "a b"), ("1", "l"), ("a\r\nb", "a\nb")]


def test_canonical_pairs(spark):
    texts = sorted({t for p in SAME + DIFFERENT for t in p} | {"", "é" * 100_000})
    df = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)] + [("null", None, None)], "rec string, body string, canonical string")
    form = {r["id"]: r["canonical"] for r in canon.canonical_text(df, "rec", "body").collect()}
    at = {t: form[str(i)] for i, t in enumerate(texts)}
    assert form["null"] is None and at[""] == ""
    for a, b in SAME:
        assert at[a] == at[b], (a, b)
    for a, b in DIFFERENT:
        assert at[a] != at[b], (a, b)
    again = spark.createDataFrame([(k, v) for k, v in form.items()], "rec string, body string")
    assert {r["id"]: r["canonical"] for r in canon.canonical_text(again, "rec", "body").collect()} == form


def test_identical_looking_pairs(spark, rows):
    data = [("a", "oﬃce"), ("b", "office"), ("c", "office"), ("d", "offıce"), ("e", None), (None, "office"), ("f", "x"), ("g", "x")]
    keys = canon.visual_keys(spark.createDataFrame(data, "rec string, body string"), "rec", "body")
    assert rows(canon.identical_looking_pairs(keys)) == [("a", "b"), ("a", "c")]
    assert canon.identical_looking_pairs(canon.visual_keys(spark.createDataFrame([], "rec string, body string"), "rec", "body")).count() == 0


def test_tables_follow_unicode():
    source, target, many = canon.tables()
    fold = dict(zip(source, target)) | many
    for ch in "Ａ１ﾏⅣ㍿ﬁ⼤":
        assert fold[ch] == unicodedata.normalize("NFKC", ch)
    assert "é" not in fold and "a" not in fold


# ---- splitting ---------------------------------------------------------------------------------


def _rebuild(pieces, overlap):
    return pieces[0] + "".join(p[overlap:] for p in pieces[1:])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。.\n(1)、,A-", min_size=0, max_size=700), st.integers(20, 80), st.integers(0, 15))
def test_pieces_rebuild_the_text(text, limit, overlap):
    pieces = [p for p, _ in split.pieces_of(text, limit, overlap)]
    assert all(len(p) <= limit for p in pieces)
    assert _rebuild(pieces, overlap) == text
    for before, after in zip(pieces, pieces[1:]):
        assert after[:overlap] == before[len(before) - overlap :]


def test_no_piece_exceeds_the_limit():
    import random

    rng = random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice(["\n\n", "\n1. ", ". A", ", ", " "]) + "x" * rng.randint(1, 900) for _ in range(rng.randint(5, 60)))
        pieces = [p for p, _ in split.pieces_of(text)]
        assert max(map(len, pieces)) <= split.LIMIT and _rebuild(pieces, split.OVERLAP if len(pieces) > 1 else 0) == text


def test_natural_boundaries_come_first():
    paragraphs = ["Sentence one here. Sentence two follows. " * 20 for _ in range(30)]
    text = "\n\n".join(paragraphs)
    pieces = split.pieces_of(text)
    assert [b for _, b in pieces[1:]] == ["paragraph"] * (len(pieces) - 1)
    assert len(pieces) <= 1.6 * len(text) / 3800 + 1
    assert {b for _, b in split.pieces_of("x" * 9000)[1:]} == {"hard"}
    assert {b for _, b in split.pieces_of("word " * 3000)[1:]} == {"blank"}


def test_split_items(spark, rows):
    long = "第1条　水質を守る。\n" * 20_000
    df = spark.createDataFrame([("a", long, 1), ("b", "x" * 4000, 1), ("c", None, 1), ("d", "", 1), ("e", "𠮷" * 4001, 1)], "id string, text string, piece int")
    got = split.split_items(df, "id", "text")
    assert {r["id"] for r in got.collect()} == {"a", "e"}
    pieces = [r["piece"] for r in got.where("id = 'a'").orderBy("piece_no").collect()]
    assert _rebuild(pieces, 200) == long
    assert split.split_items(df.where("false"), "id", "text").count() == 0
    with pytest.raises(ValueError):
        split.split_items(df, "id", "text", 10, 10)


# ---- top N -------------------------------------------------------------------------------------


def test_top_n_against_brute_force(spark, rows):
    import random

    rng = random.Random(2)
    nan = float("nan")
    data = []
    for _ in range(400):
        n = rng.randint(0, 6)
        q = "hot" if rng.random() < 0.4 else rng.choice(["q1", "q2", "d1"])
        data.append((rng.choice("mn"), q, [rng.choice(["d1", "d2", "d3", "d10", "d4", None]) for _ in range(n)], [rng.choice([0.5, 0.25, -0.0, 0.0, nan, None]) for _ in range(n)], 7))
    data += [("absent", "q1", ["d1"], [1.0], 7), ("m", "q9", None, None, 7), ("m", "q9", ["d1", "d2"], [1.0], 7)]
    runs = spark.createDataFrame(data, "model_key string, qid string, ranked array<string>, scores array<double>, top_k int")
    limits = spark.createDataFrame([("m", 2), ("n", 3)], "model_key string, top_k int")
    best: dict = {}
    for m, q, ds, ss, _ in data:
        for d, s in zip(ds or [], ss or []):
            if d and s is not None and s == s and d != q and m != "absent":
                best.setdefault((m, q), {})[d] = max(s + 0.0, best.get((m, q), {}).get(d, -9.0))
    expected = sorted(((m, q, d) for (m, q), b in best.items() for d in sorted(b, key=lambda d: (b[d], d), reverse=True)[: {"m": 2, "n": 3}[m]]), key=repr)
    got = topn.merge_shard_lists(runs.repartition(7), limits)
    assert rows(got, "model_key", "qid", "doc_id") == expected
    assert topn.merge_shard_lists(runs.where("false"), limits).count() == 0


# ---- defects -----------------------------------------------------------------------------------

PROMPT = "For that purpose, the grid operator shall audit the annual gas storage level before 3 May 2020. A gas shipper may renew the wind farm connection."
PROMPT_JA = "環境保全指導員は、別表第20に掲げる希少な野生動植物について、水質基準を調査しなければならない。廃棄物処理業者は、騒音の規制を評価することができる。"


@pytest.mark.parametrize(
    ("text", "lang", "defect"),
    [
        (None, "en", "empty"), ("", "en", "empty"), (" ​\n", "ja", "empty"), ("N/A", "en", "empty"), ("Keywords:", "en", "empty"),
        ("（なし）", "ja", "empty"), ("```\n```", "en", "empty"), ("...", "en", "empty"),
        ("I'm sorry, but I cannot help with this. Please consult a qualified lawyer.", "en", "refusal"),
        ("申し訳ありませんが、この依頼にはお答えできません。", "ja", "refusal"),
        ("The authority may decline to audit the grid. The operator cannot suspend it.", "en", None),
        ("Les autorités doivent surveiller la santé des travailleurs et le dépôt des comptes.", "en", "other_language"),
        ("以下に示します。\nhydrogen valley\nboiler efficiency label\nwind farm", "ja", "other_language"),
        ("The operator shall act. The national title is 「石油の備蓄に関する法律」.", "en", None),
        (PROMPT, "en", "copy"), (PROMPT.upper(), "en", "copy"), ("Sure! " + PROMPT[:100], "en", "copy"), (PROMPT_JA[:40], "ja", "copy"),
        (f'The query states: "{PROMPT}" The energy regulator may then inspect every pipeline capacity kept by an electricity supplier, unless the committee has asked to limit the district heating network in the region within twelve days.', "en", None),
        ("The regulator shall inspect the pipeline and the", "en", "truncated"), ("1. gas pipe\n2. wind farm\n3.", "en", "truncated"),
        ("水質、騒音、", "ja", "truncated"), ("The regulator shall inspect the pipeline.", "en", None),
    ],
)
def test_defects(text, lang, defect):
    assert defects.judge(PROMPT_JA if lang == "ja" else PROMPT, text, lang)[0] == defect


def test_broken_list_entries(spark, rows):
    whole = "gas storage level\nblackout protocol\nwind farm connection\nblackout protocol"
    data = [(i, "q", whole) for i in range(4)] + [(9, "q", "wind farm connection\nblackout protocol\ngas sto"), (10, "q", "wind farm connection\ngas storage level"), (11, "none", None), (12, "none", "x" * 50_000)]
    answers = spark.createDataFrame([(*d, "q2e_zs", "prompt") for d in data], "exp_id bigint, qid string, expansion string, family string, text string")
    prompts = spark.createDataFrame([("q", PROMPT, "en"), ("q", PROMPT, "en"), (None, "x", "en")], "qid string, text string, lang string")
    got = rows(defects.defective_answers(answers, prompts))
    assert got == [(11, "empty"), (12, "truncated"), (9, "truncated")]
    assert defects.defective_answers(answers.where("false"), prompts).count() == 0


def test_alignment_measures():
    assert defects.lcs_length(list("abcde"), list("xaycz")) == 2
    assert defects.containment(list("abcd"), list("zabcdz"), 2) == 1.0
    assert defects.longest_stretch(list("abxcd"), list("abcd")) == 2


# ---- subjects ----------------------------------------------------------------------------------


def test_units():
    assert subjects.units_of("One is here. Two is there.\n- three\n\n(a) four") == ["One is here.", "Two is there.", "- three", "(a) four"]
    assert subjects.units_of("一つ目。二つ目。") == ["一つ目。", "二つ目。"]
    assert subjects.units_of("a b; c d; e") == ["a b", "c d", "e"]
    assert subjects.units_of("<p>One is.</p><p>Two&nbsp;is.</p>") == ["One is.", "Two is."]


def test_subject_assignment(spark, rows):
    areas = spark.createDataFrame([("energy", "", "wind farm, gas pipe", "送電線"), ("sport", "", "ski lift, boxing bout", "水泳場")], "subject_area string, title_ja string, scope_note_en string, scope_note_ja string")
    e = "A gas shipper shall inspect the wind farm near the boiler house. "
    s = "A coach shall open the ski lift near the boxing bout. "
    verbs, places = ["may open", "shall visit", "must close", "can sell"], ["in May", "at Elim", "by rail", "on Monday", "for free"]
    vary = lambda t, k: t.replace("shall inspect", verbs[k % 4]).replace("shall open", verbs[k % 4]).replace(". ", f" {places[k % 5]}. ")
    docs = [(i, "".join(vary(e if i % 2 else s, i + j) for j in range(4))) for i in range(20)]
    docs += [(100, e + e + s), (101, e + s), (102, e + e + s + s), (103, None), (104, ""), (105, "The file is kept. " * 9000 + e + e), (106, "The boiler house of the gas shipper shall be kept. " * 2), (None, e + e)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, " Energy" if i % 2 else "sport") for i in range(20)] + [(None, "energy"), (3, "nonsense"), (3, None)], "doc_id bigint, subject_area string")
    model = subjects.fit_subjects(documents, labels, areas)
    got = {(r["doc_id"], r["subject_area"]) for r in subjects.assign_subjects(documents, model).collect()}
    assert {(100, "energy"), (102, "energy"), (102, "sport"), (105, "energy"), (106, "energy"), (None, "energy")} <= got
    assert not {x for x in got if x[0] in (101, 103, 104)} and (100, "sport") not in got
    bare = subjects.fit_subjects(documents, labels.where("false"), areas)
    assert (100, "energy") in {(r["doc_id"], r["subject_area"]) for r in subjects.assign_subjects(documents, bare).collect()}
    comp = {r["subject_area"]: r["n_documents"] for r in subjects.composition(subjects.assign_subjects(documents.where("doc_id < 20"), model), documents.where("doc_id < 20")).collect()}
    assert comp == {"energy": 10, "sport": 10, "none": 0}


def test_subject_weights_come_from_all_documents(spark):
    import math

    areas = spark.createDataFrame([("energy", "", "wind farm, gas pipe", ""), ("sport", "", "ski lift", "")], "subject_area string, title_ja string, scope_note_en string, scope_note_ja string")
    docs = [(i, "The wind farm is open. The ski lift is shut." if i < 4 else "The gas pipe is old. It is long.") for i in range(40)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "energy") for i in range(4)], "doc_id bigint, subject_area string")
    terms = subjects.fit_subjects(documents, labels, areas).terms
    assert terms["gas pipe"] == ("energy", pytest.approx(math.log(80 / 36))) and terms["wind farm"][1] == pytest.approx(math.log(80 / 4))
    both = lambda df: sorted(map(tuple, df.collect()))
    assert both(subjects.fit_and_assign(documents, labels, areas)) == both(subjects.assign_subjects(documents, subjects.fit_subjects(documents, labels, areas)))


def test_subject_sample_is_drawn_per_area(spark):
    labelled = spark.createDataFrame([(i, ["rare"] if i < 30 else ["common"]) for i in range(3030)], "doc_id bigint, areas array<string>")
    drawn = [r["areas"][0] for r in subjects._sampled(labelled, 200).collect()]
    assert drawn.count("rare") == 30 and 120 < drawn.count("common") < 230


@pytest.mark.parametrize(
    ("text", "lang", "other"),
    [
        ("Оператор должен проверить уровень хранения.", "en", True), ("Ο διαχειριστής ελέγχει το δίκτυο.", "en", True),
        ("يجب على المشغل أن يفحص الشبكة.", "en", True), ("ผู้ประกอบการต้องตรวจสอบ", "en", True), ("운영자는 저장 수준을 감사하여야 한다.", "ja", True),
        ("The operator shall measure α and β.", "en", False), ("水質基準を調査する。", "ja", False), ("水質基準\n騒音規制", "ja", False),
    ],
)
def test_language_by_script(text, lang, other):
    assert defects.is_other_language(text, lang) is other


def test_many_copies_of_two_spellings(spark):
    schema = "rec string, body string"
    df = spark.range(4000).selectExpr("concat('r', id) AS rec", "if(id = 7, 'oﬃce', 'office') AS body")
    keys = canon.visual_keys(df, "rec", "body")
    assert canon.identical_looking_pairs(keys).count() == 3999
    assert {(r["group_id"], r["n_forms"]) for r in canon.identical_looking_groups(keys).collect()} == {(keys.selectExpr("lower(hex(canon)) AS c").first()["c"], 2)}
    assert canon.identical_looking_groups(canon.visual_keys(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], schema), "rec", "body")).count() == 0
