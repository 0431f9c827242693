"""Exact vector search: inner product, cosine and chunk-max (max-P) over a grid of blocks.

Both sides stay on the executors.  Query vectors are cut into blocks of at most ``BLOCK`` rows,
document vectors into groups of at most about ``GROUP`` rows, both by a hash; every cell (block, group)
of the grid is one matrix product that returns its best k documents per query.  A cell's memory is
bounded by ``BLOCK``, ``GROUP`` and k, whatever the number of queries or documents.

Chunks need no common place: with score = maximum over all chunk pairs of two parents, a parent among
the k best reaches its maximum in some cell, and the parents ahead of it there are ahead of it
everywhere, so it is among that cell's k best as well.

Defined results for odd input: null vectors are left out, as are pairs whose product is not a number;
a repeated row changes nothing; no queries or no documents give no rows; ties go to the larger
document id as string; vectors of unequal length raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .sparse import DIGITS, best_k

#: Rows of a query block and of a document group.
BLOCK = 2048
GROUP = 65_536
#: Scores of one product that are held at once.
_SCORES_AT_ONCE = 4_000_000


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """L2-normalised vectors, so that the inner product is the cosine; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn(
        column, F.transform(column, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
    )


def search(queries: DataFrame, documents: DataFrame, k: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(qid, doc_id, score, rank) for ``queries`` (qid, parent, embedding) and ``documents``
    (doc_id, parent, embedding), both cheap to count (tables rather than encoders' output).

    Scores are maxima over all chunk pairs of the two parents; ``qid`` and ``doc_id`` of the result
    are the parents.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    q = queries.where("parent is not null and embedding is not null")
    d = documents.where("parent is not null and embedding is not null")
    n_queries, n_documents = q.count(), d.count()
    if not n_queries or not n_documents:
        return spark.createDataFrame([], "qid string, doc_id string, score double, rank int")
    width = shuffle_width(spark)
    # twice as many parts as needed: what a hash puts into one of them then stays within the bound
    blocks = _parts(n_queries, block)
    groups = max(_parts(n_documents, group), -(-width // blocks))

    def side(df: DataFrame, own: str, n: int, other: str, m: int, salt: str, key: str) -> DataFrame:
        # the partition number keeps copies of one row from meeting in one cell
        place = F.pmod(F.xxhash64(F.lit(salt), key, "parent", F.spark_partition_id()), F.lit(n)).cast("int") if n > 1 else F.lit(0)
        return df.select(
            place.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.col("parent").cast("string").alias("parent"), "embedding"
        )

    left = side(d, "g", groups, "b", blocks, "d", "doc_id")
    right = side(q, "b", blocks, "g", groups, "q", "qid")
    # without a stated number of partitions the small cells would be merged into few tasks
    parts = max(width, min(blocks * groups, 8 * width))
    local = (
        left.repartition(parts, "b", "g")
        .groupBy("b", "g")
        .cogroup(right.repartition(parts, "b", "g").groupBy("b", "g"))
        .applyInArrow(lambda docs, asked: _cell(docs, asked, k), "qid string, doc_id string, score double")
    )
    # one exchange: the maxima and the ranks both need a query's rows together, at most k a cell
    best = local.repartition("qid").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return best_k(best, k)


def _parts(rows: int, most: int) -> int:
    return 1 if rows <= most else -(-2 * rows // most)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1)


def _by_parent(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents in descending order, vectors sorted alike, start of every parent)."""
    names, code = np.unique(np.array(table.column("parent").to_pylist(), dtype=object), return_inverse=True)
    order = np.argsort(-code, kind="stable")
    starts = np.searchsorted(-code[order], -np.arange(len(names))[::-1])
    return names[::-1], _matrix(table.column("embedding"))[order], starts


def _cell(docs: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best documents of every query of one cell by (rounded score, document id), both descending."""
    schema = pa.schema([("qid", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])
    if not docs.num_rows or not asked.num_rows:
        return schema.empty_table()
    doc_names, doc_vectors, doc_starts = _by_parent(docs)
    names, vectors, starts = _by_parent(asked)
    ends = np.append(doc_starts[1:], len(doc_vectors))
    floor = np.full(len(names), -np.inf)
    held_q, held_d, held_s = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    step = max(1, _SCORES_AT_ONCE // len(vectors))
    at = 0
    while at < len(doc_names):
        # whole parents, as many as fit, at least one; a longer parent is scored in slices
        to = max(at + 1, int(np.searchsorted(ends, doc_starts[at] + step, side="right")))
        scores = np.full((len(names), to - at), -np.inf)
        for lo in range(doc_starts[at], ends[to - 1], step):
            hi = min(lo + step, ends[to - 1])
            product = vectors @ doc_vectors[lo:hi].T
            product[np.isnan(product)] = -np.inf
            first = int(np.searchsorted(doc_starts, lo, side="right")) - 1
            inner = np.maximum(doc_starts[first : int(np.searchsorted(doc_starts, hi))] - lo, 0)
            part = np.maximum.reduceat(np.maximum.reduceat(product, inner, axis=1), starts, axis=0)
            window = scores[:, first - at : first - at + part.shape[1]]
            np.maximum(window, part, out=window)
        scores = np.round(scores, DIGITS)
        # parents come in descending order: of equal scores the earlier one wins, so only greater ones may enter
        wanted = scores > floor[:, None]
        if scores.shape[1] > k:
            wanted &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        new_q, new_d = np.nonzero(wanted)
        all_q, all_d = np.concatenate([held_q, new_q]), np.concatenate([held_d, new_d + at])
        all_s = np.concatenate([held_s, scores[new_q, new_d]])
        order = np.lexsort((all_d, -all_s, all_q))
        sorted_q = all_q[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left")
        kept = order[place < k]
        held_q, held_d, held_s = all_q[kept], all_d[kept], all_s[kept]
        last = order[place == k - 1]
        floor[all_q[last]] = all_s[last]
        at = to
    return pa.table([pa.array(names[held_q], pa.string()), pa.array(doc_names[held_d], pa.string()), held_s], schema=schema)


def single(vectors: DataFrame, id_col: str, name: str) -> DataFrame:
    """Vectors that are their own parent."""
    key = F.col(id_col).cast("string")
    return vectors.select(key.alias(name), key.alias("parent"), "embedding")


def by_parent(chunks: DataFrame) -> DataFrame:
    """Chunks placed so that those of a parent are neighbours, for writing; ``search`` does not need it."""
    return chunks.repartition("parent").sortWithinPartitions("parent")
