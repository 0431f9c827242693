"""Similarity joins: near-duplicate records and overlaps across splits.

1.  Every text becomes a shingle set; equal sets of one space (table and language) are one *class*,
    so exact copies, however many, meet the join as a single row.
2.  In the same pass a set gets minwise samples, grouped in bands, and an odd sketch: samples folded into a
    parity bitmap whose XOR population count estimates high similarities precisely.  A task sketches a
    set it has seen before only once; the sets themselves are neither stored nor shuffled.
3.  Postings (band, class number, short sketch) are spread by band and made distinct there.  Classes that
    share a band key are candidates unless their short sketches or their sizes rule them out; the odd
    sketches drop the clearly dissimilar ones; for the few that are left the texts are shingled again
    and the exact Jaccard similarity of the sets decides.

Nothing is capped: a bucket of any size is joined by its key.
A candidate is missed only by the banding itself, with the probability stated at ``SketchPlan``.

Defined results for odd input: null texts, null languages, texts too short for one shingle and empty
texts are similar to nothing; a text of any length is shingled whole; a repeated row (same record id)
is one record; empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize
from .shingles import SIZE_SHIFT, Shingler, ShingleRule, Sketcher, SketchPlan

#: Shingles of the texts that are sketched together; bounds the memory of one pass.
_SHINGLES_AT_ONCE = 400_000


class _Sets:
    """Shingle sets with their 128-bit class digests; sets of different spaces or languages never meet."""

    def __init__(self, rule: ShingleRule):
        self._shingler, self._salts = Shingler(rule), {}

    def __call__(self, space: str, lang: str, text: str) -> tuple[bytes, np.ndarray] | None:
        salt = self._salts.get((space, lang))
        if salt is None:
            salt = self._salts[space, lang] = np.uint64(xxhash.xxh3_64_intdigest(f"{space}\x1f{lang}".encode()))
        s = self._shingler(text, lang, salt)
        return (xxhash.xxh3_128_digest(s.tobytes()), s) if len(s) else None


def _texts(records: DataFrame) -> DataFrame:
    return records.where("rec is not null and space is not null and lang is not null and text is not null")


def shingle_sets(records: DataFrame, rule: ShingleRule) -> DataFrame:
    """(rec, space, lang, text) -> (rec, cls, shingles)."""
    schema = pa.schema([("rec", pa.string()), ("cls", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(rule)
        for batch in batches:
            rows = []
            for rec, space, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                made = sets(space, lang, text)
                if made:
                    rows.append((rec, made[0], made[1].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return _texts(records).select("rec", "space", "lang", "text").mapInArrow(run, "rec string, cls binary, shingles array<bigint>")


def sketched_texts(records: DataFrame, rule: ShingleRule, plan: SketchPlan) -> DataFrame:
    """(rec, space, lang, text, tag) -> (rec, space, tag, cls, num, bands, sketch, short), one row per text.

    ``num`` is half of the class digest.  The three sketches are null where the task has sketched the class
    with the same tag before, so copies cost a digest each."""
    ints = pa.list_(pa.int64())
    schema = pa.schema(
        [("rec", pa.string()), ("space", pa.string()), ("tag", pa.string()), ("cls", pa.binary()), ("num", pa.int64()), ("bands", ints), ("sketch", ints), ("short", ints)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sketcher = _Sets(rule), Sketcher(plan)
        seen: set[tuple[bytes, str | None]] = set()
        rows, fresh, held = [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], schema[i].type) for i in range(4)]
            columns.append(pa.array(np.array([int.from_bytes(r[3][:8], "little", signed=True) for r in rows], dtype=np.int64)))
            if fresh:
                minima = sketcher.minima(fresh)
                sizes = np.array([len(s) for s in fresh])
                at = np.full(len(rows), -1)
                at[[i for i, r in enumerate(rows) if r[4]]] = np.arange(len(fresh))
                for values in (sketcher.band_keys(minima), sketcher.odd_sketches(minima), sketcher.short_sketches(minima, sizes)):
                    columns.append(_lists(np.ascontiguousarray(values).view(np.int64), at))
            else:
                columns += [pa.nulls(len(rows), ints)] * 3
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for rec, space, lang, text, tag in zip(*[c.to_pylist() for c in batch.columns]):
                made = sets(space, lang, text)
                if not made:
                    continue
                new = (made[0], tag) not in seen
                rows.append((rec, space, tag, made[0], new))
                if new:
                    seen.add((made[0], tag))
                    fresh.append(made[1])
                    held += len(made[1])
                if held > _SHINGLES_AT_ONCE or len(rows) >= 20_000:
                    yield flush()
                    rows, fresh, held = [], [], 0
        if rows:
            yield flush()

    kinds = "rec string, space string, tag string, cls binary, num bigint, bands array<bigint>, sketch array<bigint>, short array<bigint>"
    return _texts(records).select("rec", "space", "lang", "text", "tag").mapInArrow(run, kinds)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Row ``at[i]`` of ``values`` as the i-th list, null where ``at`` is negative; rows come in order."""
    there = at >= 0
    ends = np.cumsum(np.where(there, values.shape[1], 0)).astype(np.int32)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~there, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def band_candidates(sketched: DataFrame, threshold: float, train: str | None = None) -> DataFrame:
    """(num_a, num_b): class numbers that share a band and are not ruled out by their short sketches and sizes.

    Without ``train`` each pair once, otherwise ``num_a`` has rows with that tag and ``num_b`` rows with
    another.  The short sketches travel with the postings, so what merely shares a band is dropped inside
    the join and never shuffled as a pair.  Copies from different tasks meet here and become one."""
    own = F.lit(True) if train is None else F.col("tag") == F.lit(train)
    other = F.lit(True) if train is None else F.col("tag") != F.lit(train)
    rows = sketched.where("bands is not null").select(
        F.explode("bands").alias("band"), "num", F.col("short")[0].alias("s0"), F.col("short")[1].alias("s1"), own.alias("own"), other.alias("other")
    )
    posted = rows.repartition("band").groupBy("band", "num", "s0", "s1").agg(F.max("own").alias("own"), F.max("other").alias("other"))

    def side(x: str, flag: str) -> DataFrame:
        return posted.where(flag).select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("num", "s0", "s1")])

    low = F.lit((1 << SIZE_SHIFT) - 1)
    differing = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")).bitwiseAND(low))
    size = lambda c: F.shiftrightunsigned(c, SIZE_SHIFT)
    apart = F.abs(size("s1_a") - size("s1_b"))
    keep = F.col("num_a") < F.col("num_b") if train is None else F.col("num_a") != F.col("num_b")
    both = side("a", "own").join(side("b", "other"), "band").where(keep)
    both = both.where((apart <= Sketcher.most_size_steps(threshold)) & (differing <= Sketcher.most_short_bits(threshold)))
    return both.select("num_a", "num_b").distinct()


def verified_pairs(candidates: DataFrame, sketched: DataFrame, records: DataFrame, threshold: float, rule: ShingleRule, plan: SketchPlan) -> DataFrame:
    """(cls_a, cls_b, similarity) of the candidates that reach the threshold exactly.

    A pair of classes that both belong to one and the same record only is left out."""
    most = Sketcher(plan).most_differing_bits(threshold)
    differing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # the only record a class belongs to, null if there are several: two classes of one record are no pair of records
    alone = F.when(F.min("rec") == F.max("rec"), F.min("rec"))
    first = F.min(F.when(F.col("sketch").isNotNull(), F.struct("rec", "sketch")))
    classes = sketched.groupBy("num", "cls").agg(alone.alias("owner"), first.alias("r"))
    classes = materialize(classes.select("num", "cls", "owner", "r.rec", "r.sketch"))

    def side(x: str) -> DataFrame:
        return classes.select(*[F.col(c).alias(f"{c}_{x}") for c in ("num", "cls", "owner", "sketch")])

    differ = F.col("owner_a").isNull() | F.col("owner_b").isNull() | (F.col("owner_a") != F.col("owner_b"))
    near = candidates.join(side("a"), "num_a").join(side("b"), "num_b").where((differing <= most) & (F.col("cls_a") != F.col("cls_b")) & differ)
    close = materialize(near.select("cls_a", "cls_b"))
    needed = close.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    chosen = materialize(classes.join(needed, "cls", "left_semi").select("rec", "cls"))
    again = records.join(chosen.select("rec").distinct(), "rec", "left_semi")
    # a record may have several texts, of which one is the class's
    sets = shingle_sets(again, rule).join(chosen, ["rec", "cls"], "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets)
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    either = F.size("shingles_a") + F.size("shingles_b") - common
    return (
        close.join(sets.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("shingles_a")), "cls_a")
        .join(sets.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("shingles_b")), "cls_b")
        .select("cls_a", "cls_b", (common / either).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def near_duplicates(
    records: DataFrame, threshold: float = 0.8, rule: ShingleRule = ShingleRule(), plan: SketchPlan = SketchPlan()
) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (rec, cls) is every record's class, ``links`` (cls_a, cls_b,
    similarity) every pair of different classes that reach the threshold, once, but for two texts that
    only one record has.

    ``records`` has ``rec``, ``space``, ``lang`` and ``text``; only texts of one space and language
    are compared.
    """
    texts = records.select("rec", "space", "lang", "text", F.lit(None).cast("string").alias("tag"))
    sketched = materialize(sketched_texts(texts, rule, plan))
    links = cut_lineage(verified_pairs(band_candidates(sketched, threshold), sketched, texts, threshold, rule, plan))
    return sketched.select("rec", "cls").distinct(), links


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_a, rec_b, smaller first): all pairs of different records the classes and links imply."""
    a = members.select(F.col("cls").alias("cls_a"), F.col("rec").alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("rec").alias("y"))
    across = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select("x", "y").where("x <> y")
    shared = members.groupBy("cls").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("cls")
    copies = members.join(shared, "cls", "left_semi")
    within = (
        copies.select("cls", F.col("rec").alias("x")).join(copies.select("cls", F.col("rec").alias("y")), "cls").where("x < y")
    ).select("x", "y")
    return (
        across.unionByName(within)
        .select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
        .distinct()
    )


def connected_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec, group_id, n_links): one row per record that has a partner.

    ``group_id`` is the smallest record id of the connected component, ``n_links`` the number of
    links to other classes, summed over the record's texts.  Components are found over classes only
    (copies are one class, and the classes of one record's texts are tied together) by alternating
    large-star and small-star steps; every step is checkpointed, nothing is collected but a count.
    """
    first = members.groupBy("rec").agg(F.min("cls").alias("lo"))
    ties = members.join(first, "rec").where("cls <> lo").select(F.col("lo").alias("u"), F.col("cls").alias("v"))
    mesh = links.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
    edges = cut_lineage(ties.unionByName(mesh).distinct())
    seen = None
    # the steps settle after a number of rounds that grows with the square of the logarithm of the edges
    for _ in range(16 + edges.count().bit_length() ** 2):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # after convergence every edge is (class, root); a class without an edge is its own root
    per_class = members.groupBy("cls").agg(F.min("rec").alias("least"), F.max("rec").alias("most"))
    rooted = per_class.join(edges.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls")
    )
    named = (
        rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.max("most").alias("other")).where("group_id <> other")
    )
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
    of_class = rooted.join(named, "root").select("cls", "group_id").join(ends, "cls", "left")
    return (
        members.join(of_class, "cls")
        .groupBy("rec")
        .agg(F.min("group_id").alias("group_id"), F.sum(F.coalesce("k", F.lit(0))).alias("n_links"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def cross_split_pairs(
    records: DataFrame,
    train: str = "train",
    threshold: float = 0.8,
    rule: ShingleRule = ShingleRule(),
    plan: SketchPlan = SketchPlan(),
) -> DataFrame:
    """(space, split, rec_train, rec_eval, similarity): confirmed overlaps of training and other rows.

    ``records`` has ``rec``, ``space``, ``lang``, ``text`` and ``split``; a null split is neither
    training nor evaluation.  Only classes with training rows are probed by classes with evaluation
    rows, so pairs within one side are never formed.
    """
    keyed = records.where("split is not null and space is not null and rec is not null").select(
        # ids are unique within a table only
        F.to_json(F.struct("space", "rec")).alias("rec"), F.col("rec").alias("id"), "space", "lang", "text", F.col("split").alias("tag")
    )
    sketched = materialize(sketched_texts(keyed, rule, plan))
    links = verified_pairs(band_candidates(sketched, threshold, train), sketched, keyed, threshold, rule, plan)
    ends = sketched.select("cls", F.get_json_object("rec", "$.rec").alias("rec"), "space", F.col("tag").alias("split")).distinct()
    a = ends.where(F.col("split") == train).select(F.col("cls").alias("cls_a"), F.col("rec").alias("rec_train"))
    b = ends.where(F.col("split") != train).select(F.col("cls").alias("cls_b"), F.col("rec").alias("rec_eval"), "split", "space")
    shared = ends.groupBy("cls").agg(F.bool_or(F.col("split") == train).alias("t"), F.bool_or(F.col("split") != train).alias("e")).where("t and e")
    same = shared.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("similarity"))
    return (
        links.unionByName(same)
        .join(a, "cls_a")
        .join(b, "cls_b")
        .groupBy("space", "split", "rec_train", "rec_eval")
        .agg(F.max("similarity").alias("similarity"))
    )
