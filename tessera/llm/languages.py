"""Which language a text is in: by script, by function words, and by character n-gram profiles.

A profile holds the probabilities of a language's character sequences, learned from all texts known to be
in it (here the prompts).  A text whose average surprise under the profile lies far above that of
the language's own texts is in another language, whichever that is; no profile of the other is needed.
Tables have a fixed size: three letters each of 28 classes (a to z, blank, any other letter) for scripts with
blanks, hashed pairs of characters for scripts without.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in a an is are be by for with that on shall may which from as at or it this where kept".split()),
    "fr": frozenset("le la les des du de et est une un dans par pour sur au aux que qui ne pas en ou à l d".split()),
    "de": frozenset("der die das und ist den dem des ein eine nicht mit von zu werden wird für auf im oder wie ob zur".split()),
    "es": frozenset("el la los las del de y es una un en por para con que se al o no".split()),
    "it": frozenset("il lo gli della delle del di e è una un in per con che si al o non dei nel".split()),
    "pt": frozenset("o os as da das do dos de e é uma um em por para com que se ao ou não na no".split()),
    "nl": frozenset("de het een en van is in op te voor met dat die niet aan door of worden".split()),
}
_LANGUAGES = {w: [g for g, ws in FUNCTION_WORDS.items() if w in ws] for w in frozenset().union(*FUNCTION_WORDS.values())}
CHINESE_ONLY = re.compile("[这们对应为时会来说实还没过样与须经该规请给让从动产业务机关办]")

_HANGUL = re.compile(r"[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\uac00-\ud7ff]")
#: Letters between the Latin blocks and the CJK ones: Greek, Cyrillic, Arabic, Thai and the rest.
_OTHER_SCRIPT = re.compile(r"[\u0370-\u10ff\u1200-\u1cff\u1f00-\u1fff\u2c00-\u2c5f\u2c80-\u2dff]")
_CJK = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_CJK_RUN = re.compile(r"[\u3005\u3400-\u9fff]+")
_CLAUSE = re.compile("[。，,]")
_RUNNING = re.compile(r"[.!?](?:\s|$)")
_KANA = re.compile("[ぁ-ヿｦ-ﾟ]")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")

BLANK, FOREIGN, CLASSES = 0, 27, 28
CELLS = 1 << 16
#: Bits a character by which a text must surprise more than its language's texts do: running text, lists of
#: terms (whose words may be rarer), scripts without blanks.  Shorter texts tell too little.
MARGIN_TEXT, MARGIN_LIST, MARGIN_CJK, LEAST_LETTERS = 2.5, 3.6, 5.0, 12
#: Share of English function words that running English text has at least.
LEAST_FUNCTION_WORDS = 0.06


def script_of(text: str) -> str | None:
    """``ko``, ``other`` (any other script than Latin), ``cjk``, ``latin``, None for a text without letters."""
    if text.isascii():
        return "latin" if _LETTER.search(text) else None
    n = len(_LETTER.findall(text))
    if not n:
        return None
    if len(_HANGUL.findall(text)) > 0.5 * n:
        return "ko"
    if len(_OTHER_SCRIPT.findall(text)) > 0.5 * n:
        return "other"
    return "cjk" if len(_CJK.findall(text)) > 0.5 * n else "latin"


@lru_cache(maxsize=4)
def function_words(text: str) -> tuple[dict[str, int], int]:
    """(function words of each language in the text, all its words)."""
    words = _WORD.findall(text.lower())
    score = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in filter(_LANGUAGES.__contains__, words):
        for lang in _LANGUAGES[w]:
            score[lang] += 1
    return score, len(words)


def language_of(text: str) -> str | None:
    """``ja``, ``zh``, ``ko``, ``other``, a language of ``FUNCTION_WORDS``, or None without letters."""
    script = script_of(text)
    if script in (None, "ko", "other"):
        return script
    if script == "cjk":
        return "zh" if not _KANA.search(text) and len(CHINESE_ONLY.findall(text)) >= 2 else "ja"
    score, total = function_words(text)
    best = max(score, key=lambda k: (score[k], k == "en"))
    if best != "en" and score[best] >= max(2, 1.5 * score["en"]) and score[best] >= 0.12 * total:
        return best
    return "en"


def _latin_codes(text: str) -> np.ndarray:
    """One class per letter, runs of anything else as one blank."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where((raw >= 0xDF) & (raw < 0x2000), FOREIGN, BLANK)).astype(np.int64)
    return codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]


def _cells(text: str, kind: str) -> np.ndarray:
    """The table cells of a text's character sequences."""
    if kind == "latin":
        c = _latin_codes(text)
        return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:] if len(c) > 2 else np.empty(0, dtype=np.int64)
    raw = np.frombuffer("".join(_CJK.findall(text)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    pairs = (raw[:-1] * np.uint64(0x9E3779B1) + raw[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return (pairs % np.uint64(CELLS)).astype(np.int64)


def kind_of(lang: str) -> str:
    return "cjk" if lang in ("ja", "zh") else "latin"


class Profile:
    """Surprise, in bits a character, of texts under one language's sequences."""

    def __init__(self, lang: str, counts: np.ndarray):
        self.lang, self.kind = lang, kind_of(lang)
        if self.kind == "latin":
            grid = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
            one = grid.sum(axis=(0, 1)) + 1.0
            two = grid.sum(axis=0)
            two = (two + 20 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 20)
            three = (grid + 5 * two[None]) / (grid.sum(axis=2, keepdims=True) + 5)
            self._bits = -np.log2(three).reshape(-1)
        else:
            self._bits = -np.log2((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))
        self.usual = float((counts * self._bits).sum() / max(1, counts.sum()))

    def surprise(self, text: str) -> float | None:
        """Mean surprise, None for a text too short to tell."""
        cells = _cells(text, self.kind)
        return float(self._bits[cells].mean()) if len(cells) >= LEAST_LETTERS else None

    def foreign(self, text: str) -> bool:
        """The text, whose script is the profile's, is in another language."""
        if self.kind == "cjk":
            # Japanese clauses have kana; without any, only terms are Japanese
            if _KANA.search(text) or not (_CLAUSE.search(text) or any(len(r) >= LEAST_LETTERS for r in _CJK_RUN.findall(text))):
                return False
            s = self.surprise(text)
            return s is not None and s > self.usual + MARGIN_CJK
        score, words = function_words(text)
        if score[self.lang] >= LEAST_FUNCTION_WORDS * words:
            return False
        s = self.surprise(text)
        return s is not None and s > self.usual + (MARGIN_TEXT if _RUNNING.search(text) else MARGIN_LIST)


def learn_profiles(texts: DataFrame, langs: tuple[str, ...] = ("en", "ja")) -> dict[str, Profile]:
    """One profile per language from all of ``texts`` (text, lang); what comes back is one table of fixed size per language."""
    size = {lang: CLASSES**3 if kind_of(lang) == "latin" else CELLS for lang in langs}

    schema = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: np.zeros(n, dtype=np.int64) for lang, n in size.items()}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells, n = np.unique(_cells(text, kind_of(lang)), return_counts=True)
                counts[lang][cells] += n
        for lang, table in counts.items():
            at = np.nonzero(table)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "cell": at, "n": table[at]}, schema=schema)

    known = texts.select("text", "lang").where(F.col("lang").isin(*langs) & F.col("text").isNotNull())
    rows = known.mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = {}
    for lang in langs:
        mine = rows.filter(pa.compute.equal(rows["lang"], lang))
        counts = np.zeros(size[lang], dtype=np.int64)
        counts[mine["cell"].to_numpy()] = mine["n"].to_numpy()
        # with little to learn from, everything would look foreign
        if counts.sum() >= 20_000:
            out[lang] = Profile(lang, counts)
    return out
