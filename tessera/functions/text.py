"""Text expressions: tokens, chunks, prefixes, expansion, augmentation, similarity of token sets.

All are column expressions evaluated in the JVM.  Null text counts as empty unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How often a sparse query is repeated before its expansion (fixed value).
QUERY_REPEATS = 5
#: What joins a dense query and its expansion (fixed value).
DENSE_SEPARATOR = " [SEP] "
#: Head truncation of prompts, in characters (fixed value).
PROMPT_CHARS = 4000
#: Declared cap of a passage, in words (fixed value).
PASSAGE_WORDS = 300


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-cased maximal runs of Unicode letters and numbers; an empty array for an empty text."""
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def char_ngrams(c: Column | str, n: int) -> Column:
    """Sequences of ``n`` characters of the joined tokens, for scripts without blanks.

    The characters are bound once as a lambda variable; positions are array accesses, so a text of any
    length takes linear time."""
    chars = F.array(F.split(F.array_join(tokens(c), ""), ""))
    grams = F.transform(
        chars,
        lambda a: F.when(
            F.size(a) >= n,
            F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.concat(*[F.get(a, i + k) for k in range(n)])),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.flatten(grams)


def analyzed(c: Column | str, lang: Column | str, char_langs: tuple[str, ...] = ("ja",), n: int = 2) -> Column:
    """Tokens, or character n-grams for languages written without blanks."""
    return F.when(_col(lang).isin(*char_langs), char_ngrams(c, n)).otherwise(tokens(c))


def prefixed(c: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text_or_empty(c))


def head_chars(c: Column | str, n: int = PROMPT_CHARS) -> Column:
    return F.substring(text_or_empty(c), 1, n)


def head_words(c: Column | str, n: int = PASSAGE_WORDS) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text_or_empty(c)), r"\s+"), 1, n), " ")


def chunks(token_array: Column | str, max_length: int) -> Column:
    """Non-overlapping chunks of ``max(max_length - 8, 64)`` tokens; no tokens give no chunks."""
    size = max(max_length - 8, 64)
    cut = F.transform(
        F.array(_col(token_array)),
        lambda t: F.when(
            F.size(t) > 0,
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.size(t) / size).cast("int") - 1), lambda i: F.slice(t, i * size + 1, F.lit(size))
            ),
        ).otherwise(F.array().cast("array<array<string>>")),
    )
    return F.flatten(cut)


def expand_sparse(query: Column | str, expansion: Column | str, repeats: int = QUERY_REPEATS) -> Column:
    """The query repeated before its expansion; a missing or empty expansion leaves the query as it is."""
    q, e = text_or_empty(query), _col(expansion)
    return F.when(e.isNull() | (e == ""), q).otherwise(F.concat_ws(" ", F.array_join(F.array_repeat(q, repeats), " "), e))


def expand_dense(query: Column | str, expansion: Column | str) -> Column:
    q, e = text_or_empty(query), _col(expansion)
    return F.when(e.isNull() | (e == ""), q).otherwise(F.concat(q, F.lit(DENSE_SEPARATOR), e))


def augment(base: Column | str, addition: Column | str) -> Column:
    """The document followed by its augmentation; without one the document as it is."""
    b, a = text_or_empty(base), _col(addition)
    return F.when(a.isNull() | (a == ""), b).otherwise(F.concat_ws(" ", b, a))


_ASK = {
    ("passage", "en"): "Write a passage of law that answers this query.",
    ("passage", "ja"): "次の問い合わせに答える法令の一節を書いてください。",
    ("keywords", "en"): "List keywords for this query.",
    ("keywords", "ja"): "次の問い合わせのキーワードを列挙してください。",
    ("together", "en"): "List up to 10 keywords, one per line, that help to find articles amended together with this one.",
    ("together", "ja"): "この条文とともに改正される条文を探すためのキーワードを、1行に1つ、10個まで挙げてください。",
    ("for reason", "en"): "List up to 10 keywords, one per line, that help to find the articles this rationale amends.",
    ("for reason", "ja"): "この改正理由により改正される条文を探すためのキーワードを、1行に1つ、10個まで挙げてください。",
    ("explain", "en"): "Explain this article in plain words.",
    ("explain", "ja"): "この条文を平易に説明してください。",
}
_PARTS = {"en": ("Query", "Before", "After", "Rationale", "Article", "(the article was deleted)"), "ja": ("問い合わせ", "改正前", "改正後", "改正理由", "条文", "（削除された条文）")}


def prompt(family: Column | str, query: Column | str, before: Column | str, after: Column | str, task: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """One prompt per family, task and language: a passage, keywords, keywords informed by an amendment
    (``rev2rev`` shows the article before and after, ``rat2rev`` the rationale), an explanation.

    A deleted article (null or empty text after) is described as deleted; texts are cut at the head.
    Without a task an amendment is shown, without a language the prompt is English; an unknown family raises.
    """
    f, t = _col(family), F.lit("rev2rev") if task is None else _col(task)
    g = F.lit("en") if lang is None else _col(lang)
    q, b = head_chars(query), head_chars(before)

    def of(code: str) -> Column:
        names = _PARTS[code]
        part = lambda name, text: F.concat(F.lit(f"\n{name}: "), text)
        ask = lambda kind: F.lit(_ASK[kind, code])
        a = F.when(text_or_empty(after) == "", F.lit(names[5])).otherwise(head_chars(after))
        return (
            F.when(f == "q2d_zs", F.concat(ask("passage"), part(names[0], q)))
            .when(f == "q2e_zs", F.concat(ask("keywords"), part(names[0], q)))
            .when((f == "task_q2e") & (t == "rat2rev"), F.concat(ask("for reason"), part(names[3], q)))
            .when(f == "task_q2e", F.concat(ask("together"), part(names[1], b), part(names[2], a)))
            .when(f == "d2e", F.concat(ask("explain"), part(names[4], b)))
            .otherwise(F.raise_error(F.concat(F.lit("unknown prompt family "), F.coalesce(f, F.lit("null")))).cast("string"))
        )

    return F.when(g == "ja", of("ja")).otherwise(of("en"))


def chat_pair(instruction: str, query: Column | str, document: Column | str) -> Column:
    return F.concat(
        F.lit(f"<Instruct>: {instruction}\n<Query>: "), text_or_empty(query), F.lit("\n<Document>: "), text_or_empty(document)
    )


def dice(a: Column | str, b: Column | str) -> Column:
    """2 |A ∩ B| / (|A| + |B|) over distinct entries; two empty sets give 0."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def simpson(a: Column | str, b: Column | str) -> Column:
    """|A ∩ B| / min(|A|, |B|) over distinct entries; an empty set gives 0."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


# ---- model names -------------------------------------------------------------------------------

_ALIAS = r"^(.+?)-(lora-)?ft-(rat2rev|rev2rev)-(en|ja)$"


def parse_alias(c: Column | str) -> Column:
    """struct(base_model, tuning_method, train_task, train_lang); null fields if it is no tuned alias."""
    c = _col(c)
    part = lambda i: F.when(c.rlike(_ALIAS), F.regexp_extract(c, _ALIAS, i))
    method = F.when(part(2) == "", F.lit("full")).when(part(2).isNotNull(), F.lit("lora"))
    return F.struct(
        part(1).alias("base_model"), method.alias("tuning_method"), part(3).alias("train_task"), part(4).alias("train_lang")
    )


def is_tuned(c: Column | str) -> Column:
    return _col(c).contains("-ft-")


def build_alias(base: str, task: str, lang: str, lora: bool = False) -> str:
    return check_alias("-".join([base, *(["lora"] if lora else []), "ft", task, lang]))


def check_alias(alias: str) -> str:
    """The alias itself if it is a safe path component."""
    if not alias or alias in (".", "..") or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._+-]*", alias):
        raise ValueError(f"unsafe alias {alias!r}")
    return alias


def model_key(base: str, doc_suffix: str | None = None, expansion: str | None = None, strategy: str | None = None) -> str:
    """``base[-strategy][+docaug][+family.llm]``; augmentation goes with truncation only."""
    if strategy and strategy != "truncate" and doc_suffix:
        raise ValueError("augmentation needs the strategy 'truncate'")
    name = base if strategy in (None, "truncate") else f"{base}-{'maxp-doc' if strategy == 'maxp' else strategy}"
    return "+".join([name, *([doc_suffix] if doc_suffix else []), *([expansion] if expansion else [])])


def expansion_suffix(path: str) -> str:
    """``<family>.<llm>`` of an expansion file named ``<family>_<llm>_<task>_<lang>_<split>.jsonl``."""
    stem = re.sub(r"\.jsonl(?:\.gz)?$", "", path.rsplit("/", 1)[-1])
    stem = re.sub(r"_(?:rat2rev|rev2rev)_(?:en|ja)(?:_(?:train|validation|test))?$", "", stem)
    m = re.match(r"(q2d_zs|q2e_zs|task_q2e|d2e|d2q)[_.](.+)$", stem)
    return f"{m[1]}.{m[2]}" if m else stem
