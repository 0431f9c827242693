"""Held-out sentences: written after the templates, never used to change them."""

from __future__ import annotations

import os

import pytest

from tessera.llm import defects, languages, refusals

REFUSALS_EN = """Regrettably, we won't be writing anything on this subject.
I'd rather not speculate about that.
This is not a task I can take on.
My instructions prevent me from drafting such a passage.
Sorry, I have to refuse.
It isn't appropriate for me to offer an opinion here.
I do not have the ability to answer legal queries.
No reply can be provided to this request.
Discussing that topic goes beyond what I was designed for.
Our policy forbids generating this material.
I am afraid I cannot be of help with that.
We're not authorised to respond to this question.
There is insufficient context for me to respond.
I must abstain from giving an answer.
This question lies beyond my expertise.
I shall not produce that text.
Producing this document would breach our guidelines.
Nothing I can say would answer this properly.
I decline to list keywords for this query.
Apologies, this one is off limits for me.""".split("\n")
REFUSALS_JA = """恐縮ですが、ご依頼の文章は作成できかねます。
そのような内容の出力はポリシーで禁止されています。
私には法的な判断をお示しすることができません。
ご質問の内容は専門外のため、お答えを控えます。
誠に勝手ながら、対応を見送らせていただきます。
これ以上の説明は致しかねます。
当サービスではこの種の依頼をお受けしておりません。
情報不足により回答不能です。
キーワードの提供はご遠慮させていただきます。
このトピックについて言及することは避けさせていただきます。""".split("\n")
ANSWERS = """The supervisory authority shall not disclose the information without the consent of the provider.
An applicant who is unable to attend shall notify the examination board in writing.
The Commission may refuse recognition where the scope of the licence is exceeded.
This Article shall not apply to questions of taxation.
Answers to the written questions shall be given within six weeks.
The policy shall prohibit the use of drift nets outside the protected area.
No application may be processed after the expiry of the time limit.
Operators not able to provide evidence of conformity shall withdraw the product.
It is not possible to renew a connection permit that has lapsed.
The rules do not allow a transfer of quota between regions.
Requests which fall outside the competence of the agency shall be forwarded.
unsafe product notification
refusal of entry
scope of the derogation
The model shall be made available in the system of the supplier.
応募者は、回答を拒否することができる。
この法律は、対象外とされた施設には適用しない。
主務大臣は、申請に対する回答を保留してはならない。
事業者は、資料の提供の要求に応じなければならない。
情報の提供が不十分であるときは、命令を取り消すことができる。
許可されていない行為の禁止
依頼の範囲を超える作業
規則に反する行為があったときは、登録を取り消す。""".split("\n")


def test_unseen_refusals_and_answers():
    found = [bool(refusals.refuses(s)) for s in REFUSALS_EN + REFUSALS_JA]
    wrong = [s for s in ANSWERS if refusals.refuses(s)]
    recall = sum(found) / len(found)
    precision = sum(found) / (sum(found) + len(wrong))
    assert recall >= 0.8 and precision >= 0.95


def test_phrasings_known_while_writing_templates():
    for s in ("That falls outside the scope of this assistant.", "Answering this would be inappropriate.", "この件についてはコメントを差し控えます。", "本件は回答の対象外です。"):
        assert refusals.refuses(s)


def test_concepts():
    assert refusals.concepts_en("I can’t help with the request") == ["SELF", "NEG", "ACT", "ASK"]
    assert refusals.concepts_ja("回答できません。")[0] == ["ACT", "CANNOT"]
    assert not refusals.refuses("") and not refusals.refuses("…")


# the first article of the Universal Declaration of Human Rights
FOREIGN = [
    "Tous les êtres humains naissent libres et égaux en dignité et en droits.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren.",
    "Todos los seres humanos nacen libres e iguales en dignidad y derechos.", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
    "Alla människor är födda fria och lika i värde och rättigheter.", "Alle mennesker er født frie og lige i værdighed og rettigheder.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "Toate ființele umane se nasc libere și egale în demnitate și în drepturi.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
]
ENGLISH = [
    "All human beings are born free and equal in dignity and rights.", "They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "The quick brown fox jumps over the lazy dog while musicians rehearse.", "hydrogen valley\nboiler efficiency label\nwind farm", "quantum entanglement\nblack hole\nneutrino",
]
PROMPTS = "/root/testdata/sf0.01/queries.parquet"


@pytest.mark.skipif(not os.path.exists(PROMPTS), reason="needs the test tables")
def test_languages_never_seen(spark):
    profiles = languages.learn_profiles(spark.read.parquet(PROMPTS))
    assert set(profiles) == {"en", "ja"}
    other = lambda t, g: defects.is_other_language(t, g, profiles)
    missed = [t for t in FOREIGN if not other(t, "en")]
    assert len(missed) <= 1, missed
    assert [t for t in ENGLISH if other(t, "en")] == []
    assert all(other(t, "ja") for t in ("人人生而自由,在尊嚴和權利上一律平等。他們賦有理性和良心", *FOREIGN))
    assert not any(other(t, "ja") for t in ("水質基準\n騒音規制", "量子力学入門、天文学、電磁気学、統計力学", "電力会社の送電線使用料金を定める。"))


def test_little_text_teaches_no_profile(spark):
    assert languages.learn_profiles(spark.createDataFrame([("a b c", "en"), (None, "ja"), ("x", None)], "text string, lang string")) == {}
    assert languages.script_of("１２３") is None and languages.script_of("") is None


def test_longest_common_and_cut_copies():
    assert defects.longest_common(list("abxcdez"), list("cdeabx")) == (3, 0, 3)
    assert defects.longest_common([], ["a"])[0] == 0 == defects.longest_common(["a"], [])[0]
    assert defects.longest_stretch(["x"] * 3000, ["x"] * 3000) == 3000
    prompt = "The list of approved establishments shall be kept by the competent authority and shall be renewed each year in May."
    assert defects.is_copy(prompt, "Approved establishments.", "en") and not defects.is_copy(prompt, "approved establishments", "en")
    changed = prompt.replace("kept", "held")
    assert defects.is_copy(prompt, changed, "en") and not defects.is_copy(prompt, "The authority keeps a register of farms and renews each permit in June.", "en")
