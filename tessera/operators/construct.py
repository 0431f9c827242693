"""Deriving splits, anchors and judgments from amendment events, and aligning article versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, simpson
from ..session import materialize
from .mine import hash_order

SPLITS = ("train", "validation", "test")
ANCHORS = 5
DICE_MIN, SIMPSON_MIN, SIMPSON_CHARS, MINOR_EDIT = 0.7, 0.95, 40, 0.99


def event_split(events: DataFrame, event: str = "event_id") -> DataFrame:
    """(event, split): every event in one of three splits of nearly equal size, by a hash of its id.

    The third is a comparison with the hash space, so no global sort is needed and a new event never
    moves an old one."""
    first = F.conv(F.substring(F.md5(F.col(event).cast("string")), 1, 8), 16, 10).cast("long")
    third = F.floor(first * 3 / F.lit(1 << 32)).cast("int")
    return events.select(event).where(F.col(event).isNotNull()).distinct().select(
        event, F.element_at(F.array(*[F.lit(s) for s in SPLITS]), third + 1).alias("split")
    )


def anchors(members: DataFrame, n: int = ANCHORS) -> DataFrame:
    """(event_id, qid): at most ``n`` articles per event of at least two articles, by hash order."""
    distinct = members.where("event_id is not null and doc_id is not null").select("event_id", "doc_id").distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy("event_id"))
    w = Window.partitionBy("event_id").orderBy(hash_order(F.col("event_id").cast("string"), "doc_id"), "doc_id")
    return (
        distinct.withColumn("n_event", size)
        .withColumn("place", F.row_number().over(w))
        .where((F.col("n_event") >= 2) & (F.col("place") <= n))
        .select("event_id", F.col("doc_id").alias("qid"))
    )


def article_judgments(members: DataFrame, n: int = ANCHORS) -> DataFrame:
    """(qid, doc_id, rel): for every anchor the other articles of its event."""
    distinct = members.where("event_id is not null and doc_id is not null").select("event_id", "doc_id").distinct()
    return (
        anchors(members, n).join(distinct, "event_id").where("qid <> doc_id").select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    )


def rationale_judgments(rationales: DataFrame, members: DataFrame) -> DataFrame:
    """(qid, doc_id, rel): for every rationale (qid, event_id) all articles of its event."""
    distinct = members.where("event_id is not null and doc_id is not null").select("event_id", "doc_id").distinct()
    return rationales.join(distinct, "event_id").select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))


def changed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose text changed: equal texts (null equals null) are renumbering only and drop out."""
    return pairs.where(~F.col("text_before").eqNullSafe(F.col("text_after")))


def corpus_versions(versions: DataFrame, amendments: DataFrame) -> DataFrame:
    """(article, version): the version just before the earliest amendment inside the window, or else the
    version at the window's start.  ``versions`` (article, version, valid_from), ``amendments``
    (article, window_start, amended_at or null)."""
    wanted = amendments.groupBy("article").agg(F.coalesce(F.min("amended_at"), F.min("window_start")).alias("at"), F.count("amended_at").alias("k"))
    ok = F.when(F.col("k") > 0, F.col("valid_from") < F.col("at")).otherwise(F.col("valid_from") <= F.col("at"))
    return versions.join(wanted, "article").where(ok).groupBy("article").agg(F.max_by("version", "valid_from").alias("version"))


def similarity_pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, left_id, right_id, dice, simpson, is_match, is_minor) of the pairs of a block ``on`` that match, i.e.
    reach the Dice threshold, or the Simpson threshold with long enough texts; sides have (on, id, tokens, n_chars).

    A matching pair shares at least ``DICE_MIN`` of the smaller token set (both thresholds imply it), so it shares one
    of that set's rarest tokens, those beyond a share of ``DICE_MIN``: only these of the smaller side
    meet all tokens of the larger.  Blocks of any size are joined by token, never all pairs of a block.
    Null tokens or ids match nothing.
    """
    sides = {}
    for x, df in (("l", left), ("r", right)):
        sides[x] = materialize(
            df.where("id is not null and tokens is not null")
            .select(*on, F.col("id").alias(f"{x}_id"), F.array_distinct("tokens").alias(f"{x}_tokens"), F.col("n_chars").alias(f"{x}_chars"))
            .withColumn(f"{x}_size", F.size(f"{x}_tokens"))
        )
    each = [d.select(*on, F.col(f"{x}_id").alias("id"), F.explode(f"{x}_tokens").alias("token")) for x, d in sides.items()]
    frequency = each[0].unionByName(each[1]).groupBy(*on, "token").agg(F.count(F.lit(1)).alias("n"))

    def postings(x: str) -> DataFrame:
        """One row per token with the place of the token among its set's, the rarest first."""
        rows = sides[x].select(*on, f"{x}_id", f"{x}_size", F.explode(f"{x}_tokens").alias("token")).join(frequency, [*on, "token"])
        w = Window.partitionBy(*on, f"{x}_id").orderBy("n", "token")
        return rows.withColumn(f"{x}_place", F.row_number().over(w)).select(*on, "token", f"{x}_id", f"{x}_size", f"{x}_place")

    a, b = materialize(postings("l")), materialize(postings("r"))
    first = lambda x: F.col(f"{x}_place") <= F.col(f"{x}_size") - F.ceil(F.col(f"{x}_size") * DICE_MIN - 1e-9) + 1
    smaller_left = a.where(first("l")).join(b, [*on, "token"]).where("l_size <= r_size")
    smaller_right = a.join(b.where(first("r")), [*on, "token"]).where("r_size < l_size")
    candidates = smaller_left.unionByName(smaller_right).select(*on, "l_id", "r_id").distinct()
    both = candidates.join(sides["l"], [*on, "l_id"]).join(sides["r"], [*on, "r_id"])
    scored = both.withColumn("dice", dice("l_tokens", "r_tokens")).withColumn("simpson", simpson("l_tokens", "r_tokens"))
    long_enough = F.least("l_chars", "r_chars") > SIMPSON_CHARS
    return scored.select(
        *on, F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "dice", "simpson",
        ((F.col("dice") >= DICE_MIN) | ((F.col("simpson") >= SIMPSON_MIN) & long_enough)).alias("is_match"),
        (F.col("dice") >= MINOR_EDIT).alias("is_minor"),
    ).where("is_match")


def greedy_alignment(matches: DataFrame, on: str) -> DataFrame:
    """(on, left_id, right_id, dice): one-to-one matching per block, best pair first.

    Sequential by definition, hence one block per group; blocks are articles of one act."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, keep = set(), set(), []
        ordered = pdf.sort_values(["dice", "left_id", "right_id"], ascending=[False, True, True], kind="stable")
        for i, a, b in zip(ordered.index, ordered["left_id"], ordered["right_id"]):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(i)
        return pdf.loc[keep, [on, "left_id", "right_id", "dice"]]

    kinds = dict(matches.dtypes)
    schema = f"{on} {kinds[on]}, left_id {kinds['left_id']}, right_id {kinds['right_id']}, dice double"
    return matches.where("is_match").groupBy(on).applyInPandas(run, schema)

