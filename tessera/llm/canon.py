"""One consistent form for texts that look the same.

Every Arrow batch is registered with an embedded DuckDB connection and rewritten by one SQL
expression: regular expressions drop invisible characters and unify blanks and hyphens, ``replace``
expands compatibility characters that stand for several characters, ``translate`` maps every other
compatibility form and look-alike to one representative, and ``nfc_normalize`` composes marks.

The mapping is built from Unicode's own decompositions by rule; only the look-alikes of different
scripts, which Unicode does not decompose, are listed below.

Kept apart on purpose: accents and voicing marks, digits, case, punctuation, line breaks and the
number of blanks.  Defined results for odd input: null stays null, an empty text stays empty and is
compared like any other; texts of any length are handled whole; repeated rows are repeated.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs "look-alike representative".
LATIN_CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw"
LATIN_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj ϹC"
KANA_KANJI = "口ロ 囗ロ 二ニ 力カ 工エ 夕タ 卜ト 八ハ 厶ム 匕ヒ 才オ 一ー へヘ"
RADICAL_KANJI = "靑青 戶戸 黑黒 龜亀 靣面 ⺠民 ⻑長 ⻘青 ⻄西 ⻩黄 ⻭歯 ⻫斉 ⻯竜 ⻲亀 ⻝食 ⻤鬼 ⻁虎 ⻆角 ⺒巳 ⺝月 ⺡氵 ⻌辶"

#: Dashes of hyphen shape.
HYPHENS = "‐‑‒–−﹣－"
#: Format characters that are visible and therefore stay.
VISIBLE_FORMAT = "؀-؅۝܏࣢"
#: Default-ignorable characters outside the category "format".
IGNORABLE = "͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\U000e0100-\U000e01ef"


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, expansions): single-character map as two parallel strings, and one-to-many map."""
    alike = {k: v for t in (LATIN_CYRILLIC, LATIN_GREEK, KANA_KANJI, RADICAL_KANJI) for k, v in _pairs(t).items()}
    fold = str.maketrans(alike)
    source, target, many = [], [], {}
    planes = [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]
    for code in planes:
        ch = chr(code)
        parts = unicodedata.normalize("NFKD", ch).translate(fold)
        new = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", parts).translate(fold))
        if ch in HYPHENS:
            new = "-"
        if new == ch or unicodedata.category(ch) in ("Zs", "Cf", "Cn"):
            continue
        if len(new) == 1:
            source.append(ch)
            target.append(new)
        elif new != unicodedata.normalize("NFC", ch):
            many[ch] = new
    return "".join(source), "".join(target), many


def _char_class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(chars)) + "]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, present: dict[str, str]) -> str:
    """The SQL expression; ``present`` holds the one-to-many characters that occur in the batch."""
    source, target, _ = tables()
    ignorable = "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in IGNORABLE)
    invisible = f"[\\p{{Cf}}{ignorable}]"
    keep = "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in VISIBLE_FORMAT)
    # RE2 has no class subtraction: visible format characters are captured and put back
    out = f"regexp_replace({column}, {_quoted(f'([{keep}])|{invisible}')}, '\\1', 'g')"
    out = f"regexp_replace({out}, '[\\p{{Zs}}\\t]', ' ', 'g')"
    for ch, new in present.items():
        out = f"replace({out}, {_quoted(ch)}, {_quoted(new)})"
    return f"nfc_normalize(translate({out}, {_quoted(source)}, {_quoted(target)}))"


def _connection():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '400MB'")
    return con


#: Bytes of text that one SQL call sees; a single longer text is still taken whole.
_BYTES_AT_ONCE = 16 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """(id, body) tables of bounded size: a batch of very long texts is taken in several calls."""
    for batch in batches:
        rows = max(1, batch.num_rows * _BYTES_AT_ONCE // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield pa.Table.from_batches([batch.slice(at, rows)]).rename_columns(["id", "body"])


def _run(batches: Iterator[pa.RecordBatch], select: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """``select`` over every part, with ``{form}`` standing for the expression of the consistent form."""
    con, many = _connection(), tables()[2]
    found = _quoted(_char_class(many))
    schema = pa.schema([(n, pa.string()) for n in names])
    for rows in _parts(batches):
        con.register("batch", rows)
        hits = con.execute(
            f"SELECT DISTINCT unnest(regexp_extract_all(body, {found})) FROM batch WHERE regexp_matches(body, {found})"
        ).fetchall()
        form = canonical_sql("body", {h[0]: many[h[0]] for h in sorted(hits)})
        out = con.sql(select.replace("{form}", form)).to_arrow_table()
        con.unregister("batch")
        yield from out.cast(schema).to_batches()


def canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, canonical): the text of every record in its consistent form."""
    return _run(batches, "SELECT id, {form} AS canonical FROM batch", ["id", "canonical"])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, raw digest, canonical digest): what a comparison of all records needs."""
    select = "SELECT id, md5(body) AS raw, md5({form}) AS canon FROM batch WHERE body IS NOT NULL"
    return _run(batches, select, ["id", "raw", "canon"])


def canonical_text(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical): the consistent form of every record's text."""
    two = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(canonical_batches, "id string, canonical string")


def visual_keys(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec, raw, canon): 128-bit digests of the text and of its consistent form, null texts left out."""
    two = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = two.where("id is not null and text is not null").mapInArrow(key_batches, "id string, raw string, canon string")
    return keys.select(F.col("id").alias("rec"), F.unhex("raw").alias("raw"), F.unhex("canon").alias("canon"))


def identical_looking_pairs(keys: DataFrame) -> DataFrame:
    """(rec_a, rec_b): records whose strings differ but whose consistent forms agree.

    Exact copies are classes of one raw digest; classes of one form are joined with each other, never a
    class with itself, and members are attached to the class pairs found.
    """
    classes = keys.select("canon", "raw").distinct()
    a, b = classes.withColumnRenamed("raw", "raw_a"), classes.withColumnRenamed("raw", "raw_b")
    links = a.join(b, "canon").where("raw_a < raw_b").select("raw_a", "raw_b")
    members = keys.select("raw", "rec").distinct()
    left = members.select(F.col("raw").alias("raw_a"), F.col("rec").alias("x"))
    right = members.select(F.col("raw").alias("raw_b"), F.col("rec").alias("y"))
    both = links.join(left, "raw_a").join(right, "raw_b").where("x <> y")
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def identical_looking_groups(keys: DataFrame) -> DataFrame:
    """(rec, group_id, n_forms): one row per record that looks like a differently written one; ``group_id`` names
    the consistent form, ``n_forms`` counts its spellings.  Copies stay one row each."""
    forms = keys.groupBy("canon").agg(F.countDistinct("raw").alias("n_forms")).where("n_forms > 1")
    return keys.join(forms, "canon").select("rec", F.lower(F.hex("canon")).alias("group_id"), "n_forms").distinct()
