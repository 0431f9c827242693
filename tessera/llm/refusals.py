"""Refusals by aligning sentences with templates.

A sentence is reduced to a sequence of concepts (who speaks, a negation, an act of answering, the request,
a scope, a rule, …); words of no concept stay as gaps, function words drop out.  A template is a short
sequence of concepts.  It is aligned with the sentence as a copy is with its prompt: its shingles (pairs of
neighbouring concepts) name the templates worth aligning, the longest common subsequence must hold the
whole template within a compact span, and where no speaker is named, the concepts must make up
most of the sentence, so that a provision about scope or refusal is not one.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Concept -> words and phrases (an inflected word is listed as its stem with *).
CONCEPTS_EN = {
    "SELF": "i|we|me|us|my|our|myself|ourselves|this assistant|the assistant|this system|this model|this service|this tool|this chatbot|language model|ai|assistant",
    "NEG": "not|no|cannot|unable|never|nothing|neither|nor|without|hardly|incapable",
    "DECLINE": "declin*|refus*|abstain*|refrain*|reluctant|unwilling|withhold*|forgo*|opt out|pass on|hold back|steer clear|stay away|step back|sit this one out",
    "ACT": "answer*|respon*|reply*|replies|help*|assist|assistance|assisting|provid*|giv*|writ*|generat*|produc*|creat*|draft*|compos*|comply*|fulfil*|complet*|continu*|discuss*|comment*|engag*|offer*|supply*|suppl*|shar*|do|proceed*|handl*|address*|advis*|guess*|speculat*|support*|return*|output*|list|extract*|say|tell*|process*|accommodat*|entertain*|honour*|honor*|tackle*|touch*|weigh in|undertak*|deal",
    "ASK": "request*|question*|quer*|prompt*|inquir*|enquir*|topic*|task*|that|this|it|such|these|those|matter|subject",
    "SORRY": "sorry|apolog*|unfortunately|regret*|afraid|pardon|forgive",
    "OUT": "outside|beyond|exceed*|out of|off limits|not within|not part",
    "SCOPE": "scope|remit|capabilit*|abilit*|expertise|purview|limit*|bounds|boundar*|mandate|role|competence|designed|trained|meant|built|intended|what",
    "BAD": "inappropriate|improper|unsafe|unethical|irresponsible|harmful|unsuitable|unacceptable|inadvisable|unwise",
    "RULES": "polic*|guideline*|rules|instructions|terms|restrictions|safety|principles|programming",
    "FORBID": "prevent*|forbid*|prohibit*|restrict*|bar|bars|disallow*|stop|stops|against|violat*|breach*|contrary",
    "ALLOW": "allow*|permit*|able|possible|position|authori*|comfortable|appropriate|willing|qualified|equipped|free|right|something|anything|way",
    "INFO": "context|information|details|data|knowledge|material",
    "ENOUGH": "enough|sufficient|adequate",
    "LACK": "lack*|insufficient|missing",
}
#: Words that carry no concept and no content.
FUNCTION_EN = frozenset(
    "a an the of to for in on at by with from as is am are be been being was were would could should can will shall may might must have has had do does did and or but so if"
    " because since here there any some very really just too also therefore well please rather feel find falls fall go goes going want like able able yet now at all".split()
)
TEMPLATES_EN = (
    "SELF NEG ACT|SELF NEG ALLOW ACT|SELF NEG ALLOW|SELF DECLINE|SELF ACT NEG|NEG ALLOW SELF ACT|NEG ALLOW ACT ASK|NEG SCOPE SELF ACT|ASK OUT SCOPE|ACT OUT SCOPE|OUT SCOPE SELF"
    "|ACT BAD|BAD ACT|BAD SELF ACT|ASK NEG ALLOW SELF|RULES FORBID SELF|RULES FORBID ACT|RULES NEG ALLOW SELF|RULES NEG ALLOW ACT|ACT FORBID RULES|ASK FORBID RULES|FORBID SELF RULES|NEG ENOUGH INFO SELF ACT"
    "|SELF LACK INFO ACT|SORRY SELF NEG|SORRY NEG|SORRY DECLINE|NEG ACT ASK ACT|NEG ACT ACT|ASK ACT NEG|SELF FORBID ACT|ASK NEG SELF ACT|ASK SELF NEG ACT|SELF NEG SCOPE ACT|NEG SELF ACT"
)

CONCEPTS_JA = {
    "SELF": "私|わたし|当方|当社|弊社|我々|本システム|本サービス|本モデル|本アシスタント|当アシスタント|当サービス|ＡＩ|ai|アシスタント|言語モデル",
    "ASK": "ご質問|質問|ご依頼|依頼|ご要望|要望|ご要請|本件|この件|その件|当該内容|この内容|その内容|そのような|このような|リクエスト|お問い合わせ|お尋ね|問い|この話題|話題|トピック|クエリ|こちら|これ以上|ご期待",
    "ACT": "お答え|答え|ご回答|回答|返答|応答|返信|お返事|生成|作成|ご提供|提供|コメント|言及|説明|ご案内|案内|ご対応|対応|お手伝い|手伝|支援|サポート|ご協力|協力|助言|執筆|出力|お応え|応じ|抽出|取り扱|扱|判断|お力|沿う|沿え|沿い|添え|添う|お受け|引き受け|記述|お出し|お示し|示す",
    "CANNOT": "できません|できない|できかね|出来ません|出来ない|出来かね|かねます|かねる|いたしかね|致しかね|しかね|不可能|不可|無理|られません|ておりません|ていません|しません|いたしません|ことはありません|得ません|なれません|ません",
    "DECLINE": "差し控え|差控え|控え|見送|お断り|断り|辞退|遠慮|拒否|見合わせ|ご容赦|ご勘弁",
    "OUT": "対象外|範囲外|範囲を超|専門外|管轄外|想定外|機能外|守備範囲|権限外|外れ|超えて|超える|対象では",
    "BAD": "不適切|適切ではありません|適切でない|適切ではない|ふさわしくありません|望ましくありません|好ましくありません|差し障り|支障",
    "RULES": "方針|ポリシー|ガイドライン|規約|規則|指針|安全上|仕様上|制約上",
    "FORBID": "禁じられ|禁止され|許可され|認められ|許され|制限され|反し|反する|抵触",
    "SORRY": "申し訳|すみません|すいません|恐れ入り|恐縮|残念ながら|あいにく|ごめん|お詫び|遺憾",
    "INFO": "情報|文脈|資料|前提",
    "LACK": "不足|足り|乏し|不十分",
}
TEMPLATES_JA = (
    "ACT CANNOT|ACT DECLINE|ASK CANNOT|DECLINE ACT|ACT OUT|ASK OUT|OUT ACT|ACT BAD|ASK BAD|RULES ACT CANNOT|RULES FORBID|ACT FORBID|ASK FORBID|SORRY CANNOT|SORRY DECLINE|INFO LACK ACT|SELF CANNOT|SELF OUT|ASK DECLINE"
)

_APOSTROPHE = re.compile("[’ʼ′`]")
_CONTRACTIONS = ((re.compile(r"\bcan't\b"), "cannot"), (re.compile(r"\bwon't\b"), "will not"), (re.compile(r"n't\b"), " not"), (re.compile(r"'(?:m|re|ve|ll|d|s)\b"), " "))
_WORD = re.compile(r"[a-z]+")
_POLITE = re.compile(r"(?:ます|ません|です|でした|ました|ください|下さい|ございません)(?:が|ので|から|し)?[。．.!！\s]*$")
#: A sentence without any of these stands for no template.
_GATE_EN = re.compile(
    r"\b(?:i|we|me|us|my|our|assistant|chatbot|model|system|service|tool|sorry|apolog\w*|unfortunately|regret\w*|outside|beyond|exceeds?|out of|off.limits|inappropriate|improper|unsafe|"
    r"unethical|irresponsible|harmful|unsuitable|unacceptable|inadvisable|unwise|polic\w+|guidelines?|rules|instructions|declin\w+|refus\w+|no (?:answer|response|reply)|not (?:possible|appropriate|able|allowed|permitted)|unable)\b",
    re.I,
)


def _lookup(concepts: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, str]], dict[tuple[str, ...], str]]:
    """(word -> concept, (stem, concept) from the longest, phrase -> concept)."""
    words, stems, phrases = {}, [], {}
    for concept, entries in concepts.items():
        for e in entries.split("|"):
            if " " in e:
                phrases[tuple(e.split())] = concept
            elif e.endswith("*"):
                stems.append((e[:-1], concept))
            else:
                words.setdefault(e, concept)
    return words, sorted(stems, key=lambda x: -len(x[0])), phrases


_WORDS, _STEMS, _PHRASES = _lookup(CONCEPTS_EN)
_JA = {p: c for c, entries in CONCEPTS_JA.items() for p in entries.split("|")}
_JA_PATTERN = re.compile("|".join(sorted(_JA, key=lambda p: -len(p))))


@lru_cache(maxsize=100_000)
def _concept_of(word: str) -> str | None:
    return _WORDS.get(word) or next((c for s, c in _STEMS if word.startswith(s)), None)


def concepts_en(sentence: str) -> list[str | None]:
    """Concepts in order, None for every other content word."""
    low = _APOSTROPHE.sub("'", sentence.lower())
    for pattern, plain in _CONTRACTIONS:
        low = pattern.sub(plain, low)
    words, out, i = _WORD.findall(low), [], 0
    while i < len(words):
        for n in (4, 3, 2):
            hit = _PHRASES.get(tuple(words[i : i + n]))
            if hit:
                out.append(hit)
                i += n
                break
        else:
            c = _concept_of(words[i])
            if c or words[i] not in FUNCTION_EN:
                out.append(c)
            i += 1
    return out


def concepts_ja(sentence: str) -> tuple[list[str], float]:
    """(concepts in order, share of the letters they cover)."""
    found = [(m.group(), _JA[m.group()]) for m in _JA_PATTERN.finditer(sentence.lower())]
    letters = sum(c.isalnum() for c in sentence)
    return [c for _, c in found], sum(len(t) for t, _ in found) / letters if letters else 0.0


def _shingles(concepts: list[str]) -> set[tuple[str, str]]:
    return set(zip(concepts, concepts[1:]))


_EN = [(t.split(), _shingles(t.split())) for t in TEMPLATES_EN.split("|")]
_JAT = [(t.split(), _shingles(t.split())) for t in TEMPLATES_JA.split("|")]


def _aligned(template: list[str], concepts: list[str | None]) -> int | None:
    """Content words inside the most compact span that holds the template as a subsequence; None without one."""
    best = None
    for start, c in enumerate(concepts):
        if c != template[0]:
            continue
        at, gaps = 1, 0
        for i in range(start + 1, len(concepts)):
            if at == len(template):
                break
            if concepts[i] == template[at]:
                at += 1
            elif concepts[i] is None:
                gaps += 1
        if at == len(template) and (best is None or gaps < best):
            best = gaps
    return best


def _containment(wanted: set[tuple[str, str]], held: set[tuple[str, str]]) -> float:
    return len(wanted & held) / len(wanted)


def refuses_en(sentence: str, most_gaps: int = 2, least_share: float = 0.6) -> bool:
    if not _GATE_EN.search(sentence):
        return False
    concepts = concepts_en(sentence)
    known = [c for c in concepts if c]
    if len(known) < 2:
        return False
    # neighbours with up to one other concept between them
    held = _shingles(known) | set(zip(known, known[2:]))
    spoken = "SELF" in known
    dense = len(known) >= least_share * len(concepts)
    for template, wanted in _EN:
        if (spoken if "SELF" in template else dense) and _containment(wanted, held) >= 0.5:
            gaps = _aligned(template, concepts)
            if gaps is not None and gaps <= most_gaps:
                return True
    return False


def refuses_ja(sentence: str) -> bool:
    concepts, share = concepts_ja(sentence)
    if len(concepts) < 2:
        return False
    # statutes are not written in the polite form; without it only a sentence of little else counts
    if share < (0.15 if _POLITE.search(sentence) else 0.6):
        return False
    held = _shingles(concepts) | set(zip(concepts, concepts[2:]))
    return any(_containment(wanted, held) >= 0.5 and _aligned(template, concepts) is not None for template, wanted in _JAT)


def refuses(sentence: str) -> bool:
    """The sentence declines to answer."""
    return refuses_en(sentence) if sentence.isascii() or not re.search(r"[ぁ-ヿ㐀-鿿]", sentence) else refuses_ja(sentence)
