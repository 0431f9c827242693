"""Mixing sources to target token shares with soft memberships.

1.  Documents whose (normalised) source is one of the mix have that source as their whole membership.
    Documents without a source get posteriors from a naive Bayes classifier trained on a bounded
    sample of the documents that name theirs.  Documents of other named sources stay out.
2.  Documents with the same membership and repetition cap share one rate.  Their token totals are
    gathered in a written table, and projected-gradient least squares, preconditioned by row and
    column sums, finds rates in [0, cap] whose expected tokens per source match the targets; every
    step is one distributed aggregation that returns one number per source.
3.  A rate r = k + f becomes k copies of every document and one more of the documents that come first
    by hash until they hold the fraction f of the group's tokens, so token shares are met to within a
    document.  Prefix sums over hash buckets place that cut without sorting a group as a whole.

A source whose documents cannot reach its target within the cap gives all it has; the shortfall is
reported, not made up by others.

Defined results for odd input: null texts are no documents; empty texts have no tokens and are never
chosen; sources are compared after trimming, lower-casing and joining words by ``_``; a repeated row is a
document of its own; repeated targets are summed and the smallest cap holds; no targets or no
documents give an empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import RANK_FILE, TOKENIZER_DIR, TokenCounter, source_name

#: Bound of the classifier's sample: about this many documents per source.
SAMPLE_PER_SOURCE = 400
FEATURES = 1 << 12
#: Memberships are kept in steps of 1 / LEVELS, so that equal ones can share a rate.
LEVELS = 16
STEPS = 40
#: Documents that one bucket of the rounding holds on average.
BUCKET_DOCUMENTS = 2000

_FEATURE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")


def _features(text: str) -> np.ndarray:
    """Hashed pairs of neighbouring marks and words: how a source writes rather than what about."""
    marks = _FEATURE.findall(text.lower())
    shape = ["9" if m.isdigit() else m for m in marks]
    grams = [f"{a}\x1f{b}" for a, b in zip(["^", *shape], shape)]
    return np.fromiter((xxhash.xxh3_64_intdigest(g) % FEATURES for g in grams), dtype=np.int64, count=len(grams))


class SourceClassifier:
    """Multinomial naive Bayes with length-normalised evidence."""

    def __init__(self, sources: list[str], counts: np.ndarray, documents: np.ndarray):
        self.sources = sources
        smooth = counts + 0.5
        self.weights = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.prior = np.log((documents + 1.0) / (documents.sum() + len(sources)))

    def posterior(self, text: str) -> np.ndarray:
        f = _features(text)
        score = self.prior.copy()
        if len(f):
            # neighbouring features are not independent: n of them count as n ** 0.75
            score = score + self.weights[:, f].sum(axis=1) * len(f) ** -0.25
        p = np.exp(score - score.max())
        return p / p.sum()


def train_classifier(documents: DataFrame, sources: list[str], per_source: int = SAMPLE_PER_SOURCE) -> SourceClassifier:
    """Feature counts are summed on the executors; only a (source, feature) table comes back."""
    named = documents.select(source_name("source").alias("s"), "doc_id", "text").where(
        F.col("s").isin(sources) & F.col("text").isNotNull()
    )
    sizes = {r["s"]: r["n"] for r in named.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("classifier"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = F.lit(False)
    for s, n in sizes.items():
        chosen = chosen | ((F.col("s") == s) & (unit < F.lit(min(1.0, per_source / n))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sources), FEATURES + 1), dtype=np.int64)
        at = {s: i for i, s in enumerate(sources)}
        for batch in batches:
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[at[s], :FEATURES] += np.bincount(_features(text), minlength=FEATURES)
                counts[at[s], FEATURES] += 1
        row, col = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"s": row, "f": col, "n": counts[row, col]})

    table = (
        named.where(chosen)
        .select("s", "text")
        .mapInArrow(run, "s bigint, f bigint, n bigint")
        .groupBy("s", "f")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most len(sources) x (FEATURES + 1) rows
    )
    counts = np.zeros((len(sources), FEATURES + 1))
    for r in table:
        counts[r["s"], r["f"]] = r["n"]
    return SourceClassifier(sources, counts[:, :FEATURES], counts[:, FEATURES])


def memberships(
    documents: DataFrame, classifier: SourceClassifier, directory: str = TOKENIZER_DIR, file: str = RANK_FILE
) -> DataFrame:
    """(doc_id, source, n_tokens, levels): token counts and memberships in steps of 1 / LEVELS.

    ``levels`` is null for documents of named sources outside the mix.
    """
    sources = classifier.sources
    one_hot = {s: [LEVELS if i == j else 0 for j in range(len(sources))] for i, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(directory, file)
        for batch in batches:
            texts, named = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            levels = []
            for s, t in zip(named, texts):
                if s:
                    levels.append(one_hot.get(s))
                    continue
                p = classifier.posterior(t) * LEVELS
                whole = np.floor(p).astype(int)
                for i in np.argsort(whole - p, kind="stable")[: LEVELS - whole.sum()]:
                    whole[i] += 1
                levels.append(whole.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([count(t) for t in texts], pa.int64()),
                    pa.array(levels, pa.list_(pa.int32())),
                ],
                names=["doc_id", "source", "n_tokens", "levels"],
            )

    narrow = documents.select("doc_id", source_name("source").alias("source"), "text").where("text is not null")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, source string, n_tokens bigint, levels array<int>")


def fit_rates(groups: DataFrame, targets: np.ndarray, caps: np.ndarray, steps: int = STEPS) -> tuple[DataFrame, list[float]]:
    """((key, rate), residual by step) for ``groups`` (key, levels, tokens), a written table.

    x <- clip(x - D_col^-1 A' D_row^-1 (A x - b), 0, cap) with A the expected tokens per source at
    unit rate; it converges for any non-negative A.  Every step is one distributed pass: a task
    replays the steps so far for its groups (a handful of numbers each) and returns its part of A x.
    """
    scale = float(max(1.0, targets.sum()))
    wanted = targets / scale
    moves: list[np.ndarray] = []

    def rates_of(levels: np.ndarray, done: list[np.ndarray]) -> np.ndarray:
        share = levels / LEVELS
        cap = share_caps(share, caps)
        x = np.minimum(cap, 0.5)
        for g in done:
            x = np.clip(x - share @ g, 0.0, cap)
        return x

    def totals(done: list[np.ndarray] | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(targets))
            for batch in batches:
                levels = np.array(batch.column(0).to_pylist(), dtype=float)
                tokens = batch.column(1).to_numpy(zero_copy_only=False) / scale
                rates = np.ones(len(tokens)) if done is None else rates_of(levels, done)
                out += (levels / LEVELS).T @ (tokens * rates)
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(out)), "v": out})

        sums = groups.select("levels", "tokens").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(len(targets))
        for r in sums.collect():  # one number per source
            out[r["i"]] = r["v"]
        return out

    row_sum = np.maximum(totals(None), 1e-30)
    history: list[float] = []
    for _ in range(steps):
        rest = totals(moves) - wanted
        history.append(float(np.abs(rest).sum()))
        if history[-1] < 1e-7 or len(history) > 2 and history[-3] - history[-1] < 1e-6:
            break
        moves.append(rest / row_sum)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(targets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates_of(levels, moves))], names=["key", "rate"])

    return groups.select("key", "levels").mapInArrow(final, "key string, rate double"), history


def share_caps(share: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """A document may repeat as often as every source it plausibly belongs to allows."""
    plausible = share >= 0.25
    plausible[~plausible.any(axis=1)] = True
    return np.where(plausible, caps[None, :], np.inf).min(axis=1)


def mix_sources(documents: DataFrame, targets: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(doc_id, source, n_tokens, copies, levels) of every chosen document, copies >= 1."""
    rows = (
        targets.select(source_name("source").alias("s"), "target_share", "max_repeats")
        .where("s is not null and target_share is not null")
        .groupBy("s")
        .agg(F.sum("target_share").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("m"))
        .orderBy("s")
        .collect()  # one row per source of the mix
    )
    sources = [r["s"] for r in rows]
    weights, caps = np.array([r["w"] for r in rows], dtype=float), np.array([max(0, r["m"]) for r in rows], dtype=float)
    classifier = train_classifier(documents, sources)
    docs = materialize(memberships(documents, classifier))
    sizes = docs.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    key = F.concat_ws(",", "levels")
    groups = (
        docs.where("levels is not null")
        .groupBy(key.alias("key"), "levels")
        .agg(F.sum("n_tokens").alias("tokens"))
        .where("tokens > 0")
    )
    rates, history = fit_rates(materialize(groups), weights * fraction * float(sizes["t"] or 0), caps)
    if len(history) == STEPS and history[-1] > 1e-3 and history[-2] - history[-1] > 1e-5:
        raise RuntimeError(f"the rates did not settle in {STEPS} steps: {history[-1]:.2g} of the mix is left")
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    plan = rates.select("key", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("part"))
    buckets = max(64, int(sizes["n"] or 0) // BUCKET_DOCUMENTS)
    chosen = docs.where("levels is not null and n_tokens > 0").select(
        "doc_id", "source", "n_tokens", "levels", key.alias("key")
    )
    # one row per membership: few with few sources, many with many; the planner measures the side before it broadcasts
    placed = chosen.join(materialize(plan), "key").withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(buckets))
    )
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("key", "bucket", "part").agg(F.sum("n_tokens").alias("t"))
    whole_group = Window.partitionBy("key")
    cut = (
        sums.withColumn("upto", F.sum("t").over(upto))
        .withColumn("wanted", F.col("part") * F.sum("t").over(whole_group))
        # the bucket in which the wanted sum is reached; rounding may leave it just past the last one
        .where(F.col("upto") >= F.col("wanted"))
        .groupBy("key")
        .agg(F.min(F.struct("bucket", (F.col("wanted") - (F.col("upto") - F.col("t"))).alias("rest"))).alias("c"))
        .select("key", F.col("c.bucket").alias("cut"), F.col("c.rest").alias("rest"))
    )
    cut = materialize(cut)
    with_cut = placed.join(cut, "key", "left")
    clear = with_cut.where("cut is null or bucket <> cut").withColumn(
        "copies", F.col("whole") + F.when(F.col("part") <= 0, 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0)
    )
    # only the documents of the one bucket that holds the cut are ordered
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id")
    inside = (
        with_cut.where("bucket = cut")
        .withColumn("run", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("copies", F.col("whole") + F.when(F.col("run") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0))
        .drop("run")
    )
    return clear.unionByName(inside).where("copies > 0").select("doc_id", "source", "n_tokens", "copies", "levels")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats, max_repeats).

    Tokens count by membership, so a document without a source adds to each source what it belongs to it.
    """
    wanted = (
        targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    names = [r["source"] for r in wanted.select("source").orderBy("source").collect()]
    each = mixed.select("n_tokens", "copies", F.posexplode("levels").alias("i", "level")).where("level > 0")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1) if names else F.lit(None).cast("string")
    per = (
        each.groupBy(named.alias("source"))
        .agg(
            F.sum(F.col("n_tokens") * F.col("copies") * F.col("level") / LEVELS).alias("tokens"),
            F.count(F.lit(1)).alias("documents"),
            F.max("copies").alias("most_repeats"),
        )
    )
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    return (
        wanted.join(per, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source",
            "target_share",
            (F.coalesce("tokens", F.lit(0.0)) / F.col("all_tokens")).alias("actual_share"),
            F.coalesce("tokens", F.lit(0.0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            "max_repeats",
        )
    )
