"""Top N items within every group by secondary sort.

Rows are sorted by (group, score descending, item descending) inside a partition and streamed as
Arrow batches; only the items already emitted for the open group are remembered (at most N), never
the group itself.  The same stream runs twice: once on the unshuffled input partitions, which
shrinks every group to N rows per partition (so a group that holds a third of all rows never meets
in one task), and once after hash-partitioning the survivors by group.

Defined results for odd input: null and NaN scores, null items and items equal to the group's own
query are dropped; an item counts once with its highest score; ties go to the larger item string
(code points); -0.0 equals 0.0; a list without a matching score list yields nothing; a group whose
model has no (or a non-positive) N yields nothing; empty tables give an empty result; a null query
forms a group of its own; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "g1 string, g2 string, item string, score double, n int"
_ARROW = pa.schema(
    [("g1", pa.string()), ("g2", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("n", pa.int32())]
)


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (the first entry is left False)."""
    out = np.zeros(len(column), dtype=bool)
    if len(column) > 1:
        text = pc.fill_null(column, "\x00null")
        out[1:] = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
    return out


def _stream_first_n(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_group, emitted = None, set()
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        g1, g2, item = batch.column(0), batch.column(1), batch.column(2)
        limit = batch.column(4).to_numpy(zero_copy_only=False)
        group = np.cumsum(_changes(g1) | _changes(g2))
        coded = item.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = coded.dictionary
        # first occurrence of every (group, item): the highest score of that item in this batch
        _, first = np.unique(group * np.int64(len(values)) + codes, return_index=True)
        first.sort()
        key = (g1[0].as_py(), g2[0].as_py())
        carried = 0
        if key == open_group:
            carried = len(emitted)
            head = first[group[first] == 0]
            names = values.take(pa.array(codes[head])).to_pylist()
            fresh = np.fromiter((x not in emitted for x in names), dtype=bool, count=len(names))
            first = np.concatenate([head[fresh], first[len(head) :]])
        else:
            emitted = set()
        if len(first):
            own = group[first]
            starts = np.searchsorted(own, own, side="left")
            place = np.arange(len(first)) - starts + np.where(own == 0, carried, 0)
            keep = first[place < limit[first]]
        else:
            keep = first
        last = group[-1]
        if last > 0:
            emitted = set()
        tail = keep[group[keep] == last]
        emitted.update(values.take(pa.array(codes[tail])).to_pylist())
        open_group = (g1[size - 1].as_py(), g2[size - 1].as_py())
        if len(keep):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _ARROW)], schema=_ARROW).take(
                pa.array(keep)
            )


def _sorted_stream(df: DataFrame) -> DataFrame:
    ordered = df.sortWithinPartitions("g1", "g2", F.col("score").desc(), F.col("item").desc())
    return ordered.mapInArrow(_stream_first_n, _SCHEMA)


def top_n(items: DataFrame, group: tuple[str, str], item: str, score: str, n: str) -> DataFrame:
    """(group columns, item, score): the ``n`` best distinct items of every group.

    ``items`` is in long form: one row per (group, item, score), ``n`` the group's own limit.
    """
    clean = items.select(
        F.col(group[0]).cast("string").alias("g1"),
        F.col(group[1]).cast("string").alias("g2"),
        F.col(item).cast("string").alias("item"),
        (F.col(score).cast("double") + F.lit(0.0)).alias("score"),
        F.col(n).cast("int").alias("n"),
    ).where("item is not null and score is not null and not isnan(score) and n > 0")
    local = _sorted_stream(clean)
    final = _sorted_stream(local.repartition("g1", "g2"))
    return final.select(
        F.col("g1").alias(group[0]), F.col("g2").alias(group[1]), F.col("item").alias(item), F.col("score").alias(score)
    )


def merge_shard_lists(runs: DataFrame, limits: DataFrame) -> DataFrame:
    """(model_key, qid, doc_id, score) from shard lists ``ranked``/``scores`` and per-model ``top_k``.

    ``limits`` has one row per model, a table of fixed size, hence the broadcast.
    """
    sizes = limits.where("model_key is not null").groupBy("model_key").agg(F.max("top_k").alias("n"))
    long = (
        runs.select("model_key", "qid", F.explode(F.arrays_zip("ranked", "scores")).alias("e"))
        .select("model_key", "qid", F.col("e.ranked").alias("doc_id"), F.col("e.scores").alias("score"))
        .where("doc_id is not null and score is not null and (qid is null or doc_id <> qid)")
        .join(F.broadcast(sizes), "model_key")
    )
    return top_n(long, ("model_key", "qid"), "doc_id", "score", "n")
