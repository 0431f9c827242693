from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import english as E
from tessera.functions import text as T
from tessera.plans import verbs


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
        ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
        ("conditional", "condit"), ("rational", "ration"), ("vietnamization", "vietnam"), ("operator", "oper"), ("formaliti", "formal"), ("triplicate", "triplic"),
        ("electrical", "electr"), ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"),
        ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("is", "is"), ("水質", "水質"), ("a1s", "a1s"),
    ],
)
def test_porter(word, stem):
    assert E.porter(word) == stem


def test_stop_words_and_stems(spark):
    df = spark.createDataFrame([("The Operators of the grid",), ("of the",), (None,)], "t string")
    got = [r["x"] for r in df.select(E.english(T.tokens("t")).alias("x")).collect()]
    assert got == [["oper", "grid"], [], []]
    assert df.limit(1).select(E.stemmed(F.lit(None).cast("array<string>")).alias("x")).first()["x"] is None


def test_search_with_an_analyzer(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "inspecting the wind farms"), ("b", "the the the"), ("c", "a gas pipe")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "The inspection of a farm", 1)], "qid string, text string, ord bigint")
    plain = verbs.build_bm25_index(str(tmp_path / "plain"), "en", corpus) or verbs.run_bm25(spark, str(tmp_path / "plain"), "en", q)
    assert {r["doc_id"] for r in plain.collect()} == {"a", "b", "c"}
    verbs.build_bm25_index(str(tmp_path / "stem"), "en", corpus, analyzer=E.english)
    assert {r["doc_id"] for r in verbs.run_bm25(spark, str(tmp_path / "stem"), "en", q, analyzer=E.english).collect()} == {"a"}
