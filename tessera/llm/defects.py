"""Broken prompt and response pairs.

Each response gets at most one defect, tested in this order:

``empty``           nothing but blanks, invisible characters, markup, labels or placeholders;
``refusal``         its sentences align with refusal templates (``refusals``) and nothing else is left;
``other_language``  its script, function words or character n-grams (``languages``) are not those of the prompt's language;
``copy``            prompt and response are aligned by shingle containment and by the longest common
                    subsequence of tokens: nothing of its own remains;
``truncated``       a passage without a sentence end, or a keyword list that stops inside an entry.

Whether a list's last entry is complete is decided by all data: the endings of the other entries of
all lists are counted, and an ending that no complete entry has is a broken one.

Defined results for odd input: a null response is ``empty``; a response whose prompt is missing is
still tested for everything that needs no prompt; an unknown language is not tested for language;
very long texts are aligned whole; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .languages import Profile, language_of, learn_profiles
from .refusals import refuses

TOKEN = re.compile(r"[^\W_]+")

# Placeholders and labels that answer nothing.
PLACEHOLDERS = frozenset(
    "null none nil nan n/a na empty undefined todo tbd なし 該当なし 無し 回答なし 未回答 空".split()
) | {"no answer", "no response", "not available", "no content"}
LABELS = re.compile(
    r"^(?:the )?(?:answer|keywords?|passage|query|response|output|result|expansion|text|document|改正理由文|キーワード|クエリ|回答|答え|文章|出力|本文)\s*[:：]\s*",
    re.I,
)
#: Courtesy openings that carry no answer.
OPENINGS = re.compile(
    r"^(?:sure[!.,]?|certainly[!.,]?|of course[!.,]?|here (?:is|are) (?:the|a|your|some)[^:.\n]{0,40}[:.]|"
    r"以下に示します。?|以下のとおりです。?|以下の通りです。?|承知しました。?|はい、?)\s*",
    re.I,
)

# Courtesy.
#: Sentences that may stand beside a refusal without being an answer.
BESIDE_EN = re.compile(
    r"^(?:thank you|thanks|sorry|unfortunately|i apologi[sz]e|please (?:consult|contact|ask|try|seek|rephrase)|is there (?:something|anything)|"
    r"the query (?:concerns|is about|asks|states)|this (?:query|question|request) (?:concerns|is about|asks)|let me know|feel free|as an? (?:ai|language model)|if you)",
    re.I,
)
BESIDE_JA = re.compile(
    r"^(?:ご質問|申し訳|残念ながら|恐れ入り|すみません|ご了承|専門家に|別のご|ご理解|AI|恐縮|お問い合わせ|弁護士|ご不便|何か)"
)

_LINE = re.compile(r"[\r\n]+")
_MARKER = re.compile(r"^\s*(?:[-*•・○◦‣]|[(（]?(?:\d{1,3}|[０-９]{1,3}|[a-z])[.)．）、:：]|\d{1,3}\s*　)\s*")
_SENTENCE_END = re.compile(r"[.!?。！？｡．](?:[\"'”’」』）)\]*_`]|\s)*$")
_OPEN_MARKER = re.compile(r"(?:^|[\r\n。.])\s*[(（]?(?:\d{1,3}|[０-９]{1,3}|[a-z])[.)．）、]\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")


_INVISIBLE = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Cf") + "]")


@lru_cache(maxsize=4)
def visible(text: str) -> str:
    """The text without format characters."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


@lru_cache(maxsize=4)
def strip_noise(text: str) -> str:
    """The text without invisible characters, markup at the ends and courtesy openings."""
    text = visible(text).strip(" \t\r\n\v\f 　`*_#<>|~")
    for _ in range(3):
        shorter = OPENINGS.sub("", LABELS.sub("", text)).strip(" \t\r\n　`*_#")
        if shorter == text:
            break
        text = shorter
    return text


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    core = strip_noise(text)
    bare = core.strip("\"'“”‘’「」『』()（）[]{}<>.…,、。:：;-–—*/\\ 　").lower()
    if not any(c.isalnum() for c in bare):
        return True
    return bare in PLACEHOLDERS or LABELS.sub("", bare + ":") == ""


#: Share of the letters that may stand beside a refusal without being one or a courtesy.
MOST_OWN = 0.25


def is_refusal(text: str) -> bool:
    """Every sentence aligns with a refusal template or stands beside one, and at least one refuses."""
    core = strip_noise(text)
    own, refusing = 0, False
    for s in _SENTENCE.split(core):
        s = s.strip() if s else ""
        if not s:
            continue
        if refuses(s):
            refusing = True
        elif not (BESIDE_EN.search(s) or BESIDE_JA.search(s)):
            own += len(s)
            if own > MOST_OWN * len(core):
                return False  # whatever follows
    return refusing


def is_other_language(text: str, lang: str | None, profiles: dict[str, Profile] | None = None) -> bool:
    if lang not in ("en", "ja"):
        return False
    core = strip_noise(text)
    found = language_of(core)
    if found is not None and found != lang:
        return True
    profile = (profiles or {}).get(lang)
    return found is not None and profile is not None and profile.foreign(core)


def _tokens(text: str, lang: str | None) -> list[str]:
    tokens = TOKEN.findall(text.lower())
    return list("".join(tokens)) if lang == "ja" else tokens


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def longest_stretch(a: list[str], b: list[str]) -> int:
    """Length of the longest contiguous run of tokens that both have."""
    return longest_common(a, b)[0]


def longest_common(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest contiguous run both have, by a suffix automaton of ``b``."""
    link, length, step, end = [-1], [0], [{}], [0]
    last = 0
    for i, t in enumerate(b, 1):
        now = len(link)
        link.append(0)
        length.append(length[last] + 1)
        end.append(i)
        step.append({})
        p = last
        while p >= 0 and t not in step[p]:
            step[p][t] = now
            p = link[p]
        if p >= 0:
            q = step[p][t]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(t) == q:
                    step[p][t] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    state = run = 0
    best = (0, 0, 0)
    for i, t in enumerate(a, 1):
        while state and t not in step[state]:
            state = link[state]
            run = length[state]
        if t in step[state]:
            state = step[state][t]
            run += 1
        if run > best[0]:
            best = (run, i - run, end[state] - run)
    return best


def containment(a: list[str], b: list[str], n: int) -> float:
    """Share of a's n-shingles (with repetition) that occur in b; 0 when a is shorter than n."""
    if len(a) < n:
        return 0.0
    known = set(zip(*(b[i:] for i in range(n))))
    return sum(map(known.__contains__, zip(*(a[i:] for i in range(n))))) / (len(a) - n + 1)


#: Share of a copy's tokens that the alignment with the prompt must hold.
LEAST_ALIGNED = 0.93


def is_copy(prompt: str | None, text: str, lang: str | None, most: float = 0.8) -> bool:
    """The response is the prompt's wording: by containment, or, lightly changed, by alignment."""
    if not prompt:
        return False
    a, b = _tokens(strip_noise(text), lang), _tokens(prompt, lang)
    n = 8 if lang == "ja" else 4
    if len(a) < n:
        # too short for a shingle: the prompt itself, or, if it is no entry of keywords, a stretch of it
        return a == b or (len(a) > 1 and _SENTENCE_END.search(text.strip()) is not None and longest_stretch(a, b) == len(a))
    # tokens that the prompt has at all bound both measures
    shared = sum(map(set(b).__contains__, a))
    if shared < min(most * (len(a) - n + 1), LEAST_ALIGNED * len(a)):
        return False
    # entries of a keyword list may each stand in the prompt: there one stretch must make up most of it
    is_list = list_entries(text) is not None
    if containment(a, b, n) >= most:
        return not is_list or longest_stretch(a, b) >= 0.5 * len(a)
    # no subsequence is longer than what the two have in common in any order
    if (Counter(a) & Counter(b)).total() < LEAST_ALIGNED * len(a):
        return False
    # aligned where the two agree best: tokens found here and there in a long prompt are no copy
    length, i, j = longest_common(a, b)
    if length < (0.5 * len(a) if is_list else 1):
        return False
    slack = n + len(a) // 4
    return lcs_length(a, b[max(0, j - i - slack) : j - i + len(a) + slack]) >= LEAST_ALIGNED * len(a)


@lru_cache(maxsize=4)
def list_entries(text: str) -> list[str] | None:
    """The entries of a keyword list, None for a passage."""
    core = visible(text).strip()
    lines = [x.strip() for x in _LINE.split(core) if x.strip()]
    marked = [_MARKER.sub("", x) for x in lines]
    if lines and (LABELS.fullmatch(lines[0] + " ") or OPENINGS.fullmatch(lines[0])):
        lines, marked = lines[1:], marked[1:]
    if not lines or re.search(r"[.。!?！？](?=\s|$|[^\d\s])", " ".join(marked)[:-1] if marked[-1:] != [""] else " ".join(marked)):
        return None
    if len(lines) > 1:
        flat = [x for line in marked for x in (re.split(r"、", line) if "、" in line else [line])]
        return flat
    one = marked[0]
    parts = re.split(r"\s*[、,，;；]\s*", one)
    return parts if len(parts) > 1 else None


def entry_endings(entry: str, lang: str | None) -> list[str]:
    """What tells a complete entry from a broken one, the most specific first.

    The last four characters, or the last two words; an entry of fewer is marked with ``^``.  A last
    word that is elsewhere a whole entry is complete as well.
    """
    entry = entry.strip().rstrip(".。").lower()
    if lang == "ja":
        return ["^" + entry if len(entry) < 4 else entry[-4:]]
    words = TOKEN.findall(entry)
    if not words:
        return ["^"]
    return [" ".join(["^", *words][-2:])] + (["^ " + words[-1]] if len(words) > 1 else [])


def breaks_off(text: str) -> bool | None:
    """True or False for a passage or an openly broken list; None when the last entry must be looked up."""
    core = visible(text).rstrip()
    if not core:
        return False
    if _OPEN_MARKER.search(core) or core[-1] in "、,，;；:：(（「『-–—・*":
        return True
    entries = list_entries(text)
    if entries is None:
        return not _SENTENCE_END.search(core) or core.endswith(("...", "…"))
    return None


def judge(prompt: str | None, text: str | None, lang: str | None, profiles: dict[str, Profile] | None = None) -> tuple[str | None, list[str], list[str]]:
    """(defect or None, endings of a list's last entry that must be looked up, endings of its other entries)."""
    if is_empty(text):
        return "empty", [], []
    if is_refusal(text):
        return "refusal", [], []
    if is_other_language(text, lang, profiles):
        return "other_language", [], []
    if is_copy(prompt, text, lang):
        return "copy", [], []
    broken = breaks_off(text)
    entries = list_entries(text) or []
    others = [entry_endings(e, lang)[0] for e in entries[:-1]]
    if broken is None:
        return None, entry_endings(entries[-1], lang), others
    return ("truncated" if broken else None), [], others


def defective_answers(answers: DataFrame, prompts: DataFrame, least: int = 2) -> DataFrame:
    """(exp_id, defect) of every defective row of ``answers`` (exp_id, qid, expansion).

    ``prompts`` is (qid, text, lang).  ``least``: how often an ending must be seen on complete
    entries of the same language to count as complete.
    """

    # two tables of fixed size, learned from all prompts
    profiles = prompts.sparkSession.sparkContext.broadcast(learn_profiles(prompts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                judge(_text(p), _text(t), _text(g), profiles.value) for p, t, g in zip(batch["text"], batch["expansion"], batch["lang"])
            ]
            yield pd.DataFrame(
                {
                    "exp_id": batch["exp_id"],
                    "lang": batch["lang"],
                    "defect": [r[0] for r in rows],
                    "endings": [r[1] for r in rows],
                    "others": [r[2] for r in rows],
                }
            )

    both = answers.select("exp_id", "qid", "expansion").join(
        prompts.select("qid", "text", "lang").where("qid is not null").dropDuplicates(["qid"]), "qid", "left"
    )
    judged = materialize(
        both.select("exp_id", "text", "expansion", "lang").mapInPandas(
            run, "exp_id bigint, lang string, defect string, endings array<string>, others array<string>"
        )
    )
    complete = (
        judged.select("lang", F.explode("others").alias("ending"))
        .groupBy("lang", "ending")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    row = F.monotonically_increasing_id()
    open_lists = judged.where("defect is null and size(endings) > 0").select(row.alias("row"), "exp_id", "lang", "endings")
    looked_up = open_lists.select("row", "exp_id", "lang", F.explode("endings").alias("ending")).join(
        complete.withColumn("known", F.lit(True)), ["lang", "ending"], "left"
    )
    broken = (
        looked_up.groupBy("row", "exp_id")
        .agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("known"))
        .where(~F.col("known"))
        .select("exp_id", F.lit("truncated").alias("defect"))
    )
    return judged.where("defect is not null").select("exp_id", "defect").unionByName(broken)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None
