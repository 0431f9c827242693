"""Document index and BM25 search.

score(q, d) = sum over terms of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 (1 - b + b dl / avgdl)).
Repeated query terms act linearly, so a query expansion is a weight (5 qtf + qtf_e), never a longer text.

The index has one row per document (space, doc_id, dl, terms) with its term frequencies counted inside
the row, so building it shuffles nothing; ``space`` keeps languages apart.  Document frequencies are
counted inside the tasks before they are joined with the queried terms.  Search runs over a grid of query
blocks and document groups: a cell holds its queries' weights, which are broadcast block by block, and
streams its documents from where the index lies, so neither documents nor postings nor pairs of a query and
a document are ever shuffled or spilled, only every cell's best k of a query.  Frequent terms are scored by
a matrix product, rare ones one by one.  A cell's memory is bounded by ``BLOCK``, ``BLOCK_TERMS``, ``HELD``
and ``_SCORES_AT_ONCE``, whatever the number of queries or documents; the index is read once for every
block of queries, so it should be a written table.

Defined results for odd input: null and empty texts have no terms but count as documents; a query
without terms has no results; a null id is an id like any other, after all others; repeated ids add up
(rows with such ids are brought together by a shuffle of their own), ids are expected to be unique.  Weights of query terms are positive, terms hold no U+0000.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import input_partitions, materialize, shuffle_width

K1, B = 0.9, 0.4
DIGITS = 6
#: Rows of a query block, their terms on average, and results that a cell holds for them.
BLOCK = 8192
BLOCK_TERMS = 2_000_000
HELD = 2_500_000
#: Fewest rows of a document group, also as a multiple of k, which limits what the cells send on.
GROUP = 16_384
GROUP_BY_K = 64
#: Results that the cells send on for each document at most, unless so few cells would keep few cores busy.
SENT = 10
CELLS = 12
#: Scores of one cell that are held at once.
_SCORES_AT_ONCE = 4_000_000
#: A term is scored by the matrix product if so large a part of the scores has it.
_FREQUENT = 0.013
_SEPARATOR = "\0"


def term_vector(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array in linear time after sorting it; null for no tokens.

    Arrays are bound as lambda variables, so that none is computed twice."""

    def runs(a: Column) -> Column:
        n = F.size(a)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        spans = F.transform(
            F.array(starts),
            lambda s: F.transform(s, lambda x, j: F.struct(F.get(a, x).alias("term"), (F.coalesce(F.get(s, j + 1), n) - x).alias("tf"))),
        )
        return F.when(n > 0, F.get(spans, F.lit(0)))

    return F.get(F.transform(F.array(F.sort_array(tokens)), runs), F.lit(0))


def term_counts(texts: DataFrame, id_col: str, token_array: Column) -> DataFrame:
    """(space, id, dl, terms), one row per text."""
    t = texts.select("space", F.col(id_col).alias("id"), token_array.alias("tokens"))
    return t.select("space", "id", F.size("tokens").alias("dl"), term_vector(F.col("tokens")).alias("terms"))


def postings(documents: DataFrame, token_array: Column, id_col: str = "doc_id") -> DataFrame:
    """The index (space, doc_id, dl, terms) of ``documents`` (space, id, text columns of the expression)."""
    return term_counts(documents, id_col, token_array).withColumnRenamed("id", "doc_id")


def document_frequencies(index: DataFrame) -> DataFrame:
    each = index.select("space", F.explode("terms").alias("t")).select("space", "t.term", "t.tf")
    return each.groupBy("space", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def collection_stats(documents: DataFrame, token_array: Column) -> DataFrame:
    """(space, n_docs, avgdl), one row per space; documents without tokens count."""
    return index_stats(documents.select("space", F.size(token_array).alias("dl")))


def index_stats(index: DataFrame) -> DataFrame:
    """``collection_stats`` of an index."""
    return index.groupBy("space").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, token_array: Column, weight: float = 1.0) -> DataFrame:
    """(space, qid, term, qtf); blank queries have no terms and thus no results."""
    # explode would infer a filter that analyses the texts once more
    t = term_counts(queries, "qid", token_array).select("space", F.col("id").alias("qid"), F.explode_outer("terms").alias("t"))
    return t.where("t is not null").select("space", "qid", "t.term", (F.col("t.tf") * F.lit(float(weight))).alias("qtf"))


def weighted_terms(query: DataFrame, expansion: DataFrame) -> DataFrame:
    """Sum of two (space, qid, term, qtf) tables."""
    return query.unionByName(expansion).groupBy("space", "qid", "term").agg(F.sum("qtf").alias("qtf"))


def best_k(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows per query by (rounded score, doc id as string), both descending, with ``rank``."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(*(by or ["qid"])).orderBy(F.col("score").desc(), F.col("doc_id").cast("string").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(terms: DataFrame, index: DataFrame, stats: DataFrame, k: int = 1000, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of all documents that share a term with the query."""
    if k <= 0:
        raise ValueError("k must be positive")
    width = shuffle_width(terms.sparkSession)
    asked = materialize(terms.groupBy("space", "qid", "term").agg(F.sum("qtf").alias("qtf")))
    df = index.select("space", F.explode("terms.term").alias("term")).groupBy("space", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, ["space", "term"]).join(stats, "space").select("space", "qid", "term", "avgdl", (F.col("qtf") * idf).alias("weight"))
    n_terms, n_queries = asked.agg(F.count(F.lit(1)), F.count_distinct(F.struct("qid"))).first()
    blocks = max(1, -(-n_queries // min(BLOCK, max(1, HELD // k))), -(-n_terms // BLOCK_TERMS))
    place = F.xxhash64("doc_id")
    n_docs, most = index.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = max(-(-CELLS // blocks), SENT * n_docs // max(1, n_queries * k))
    groups = max(1, min(width // blocks, few, -(-n_docs // max(GROUP, GROUP_BY_K * k))))

    queries = (
        weighted.groupBy("space", "qid", "avgdl")
        .agg(F.collect_list(F.struct("term", "weight")).alias("t"))
        .select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "space", F.col("qid").cast("string").alias("id"), F.col("avgdl").alias("length"), F.array_join("t.term", _SEPARATOR).alias("terms"), F.col("t.weight").alias("weight"))
    )
    queries = materialize(queries) if blocks > 1 else queries
    parts = [index] if most < 2 else _apart(index, place)
    parts = [_in_groups(x.where("terms is not null"), groups) for x in parts[:1]] + [x.where("terms is not null").repartition(groups, "doc_id").sortWithinPartitions("doc_id") for x in parts[1:]]
    documents = [x.select(F.lit(1).alias("side"), "space", F.col("doc_id").cast("string").alias("id"), F.col("dl").cast("double").alias("length"), F.array_join("terms.term", _SEPARATOR).alias("terms"), F.col("terms.tf").cast("array<int>").alias("tf")) for x in parts]

    def scored(block: int) -> list[DataFrame]:
        sent = terms.sparkSession.sparkContext.broadcast(queries.where(F.col("block") == block).drop("block").toArrow())
        cell = lambda batches: _cell(chain(sent.value.to_batches(), batches), k, k1, b)
        return [x.mapInArrow(cell, "qid string, doc_id string, score double") for x in documents]

    best = reduce(DataFrame.unionByName, chain.from_iterable(scored(i) for i in range(blocks))).select(
        F.col("qid").cast(terms.schema["qid"].dataType).alias("qid"), F.col("doc_id").cast(index.schema["doc_id"].dataType).alias("doc_id"), F.round("score", DIGITS).alias("score")
    )
    return best_k(best, k)


def _in_groups(documents: DataFrame, groups: int) -> DataFrame:
    """At most ``groups`` parts, without a shuffle unless the documents come in far fewer."""
    return documents.repartition(groups) if input_partitions(documents) < groups // 2 else documents.coalesce(groups)


def _apart(index: DataFrame, place: Column) -> list[DataFrame]:
    """The rows whose ids are surely unique, and all others."""
    repeated = materialize(index.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place"))
    return [index.withColumn("place", place).join(repeated, "place", how) for how in ("left_anti", "left_semi")]


def _cell(batches: Iterator[pa.RecordBatch], k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The k best documents of every query of one cell by (rounded score, document id), both descending.

    Queries come before documents, rows of the same id one after another; those of the last id wait for the next batch."""
    asked, held, best = [], None, None
    for batch in batches:
        n = pc.sum(pc.equal(batch.column("side"), 0)).as_py() or 0
        if n:
            asked.append(batch.slice(0, n))
        docs = pa.Table.from_batches([batch.slice(n)])
        if not docs.num_rows or not asked:
            continue
        best = best or _Best(pa.Table.from_batches(asked), k, k1, b)
        docs = pa.concat_tables([held, docs]) if held else docs
        ids = docs.column("id").to_pylist()
        cut = len(ids) - 1
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        best.add(docs.slice(0, cut), ids[:cut])
        held = docs.slice(cut)
    if best:
        best.add(held, held.column("id").to_pylist())
        yield from best.rows()


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _postings(rows: pa.Table, values: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, value) of every term of ``rows``."""
    terms, numbers = pc.split_pattern(_array(rows.column("terms")), _SEPARATOR), _array(rows.column(values))
    lengths = pc.list_value_length(terms).to_numpy()
    if not np.array_equal(lengths, pc.list_value_length(numbers).to_numpy()):
        raise ValueError("a term holds U+0000")
    return np.repeat(np.arange(rows.num_rows), lengths), terms.flatten(), numbers.flatten().to_numpy().astype(np.float64)


class _Space:
    """The weights of a cell's queries in one space, by term."""

    def __init__(self, rows: pa.Table, place: dict[str | None, int]):
        self.queries = np.array([place[q] for q in rows.column("id").to_pylist()], dtype=np.int64)
        self.avgdl = rows.column("length")[0].as_py()
        query, terms, weight = _postings(rows, "weight")
        coded = terms.dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.terms) + 1))

    def scores(self, docs: pa.Table, k1: float, b: float) -> np.ndarray:
        """Queries x documents; 0 where they share no term."""
        n_queries, n_docs = len(self.queries), docs.num_rows
        doc, terms, tf = _postings(docs, "tf")
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy()
        known = np.nonzero(code >= 0)[0]
        small = code[known].astype(np.uint16 if len(self.terms) < 65_536 else np.int64)  # radix sort
        known = known[np.argsort(small, kind="stable")]
        doc, code, tf = doc[known], code[known], tf[known]
        value = tf / (tf + k1 * (1.0 - b + b * docs.column("length").to_numpy()[doc] / self.avgdl))
        starts = np.searchsorted(code, np.arange(len(self.terms) + 1))
        n_with, n_asked = np.diff(starts), np.diff(self.starts)
        frequent = n_with * n_asked > _FREQUENT * n_queries * n_docs
        place = np.cumsum(frequent) - 1
        left, right = np.zeros((n_queries, frequent.sum())), np.zeros((frequent.sum(), n_docs))
        mine = np.repeat(frequent, n_asked)
        left[self.query[mine], np.repeat(place, n_asked)[mine]] = self.weight[mine]
        right[place[code[frequent[code]]], doc[frequent[code]]] = value[frequent[code]]
        out = left @ right
        for t in np.nonzero(~frequent & (n_with > 0))[0]:
            q, d = slice(self.starts[t], self.starts[t + 1]), slice(starts[t], starts[t + 1])
            out[self.query[q, None], doc[d]] += self.weight[q, None] * value[d]
        return out


class _Best:
    """The best k of a cell's queries among the documents added so far."""

    def __init__(self, asked: pa.Table, k: int, k1: float, b: float):
        self.k, self.k1, self.b = k, k1, b
        self.names = list(dict.fromkeys(asked.column("id").to_pylist()))
        place = {q: i for i, q in enumerate(self.names)}
        self.spaces = {s: _Space(asked.filter(pc.equal(asked.column("space"), s)), place) for s in asked.column("space").unique().to_pylist()}
        self.docs: list[str | None] = []
        self.floor = np.full(len(self.names), -np.inf)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def add(self, rows: pa.Table, ids: list[str | None]) -> None:
        """Documents, all rows of an id at once and one after another."""
        if not ids:
            return
        new = np.array([True, *(x != y for x, y in zip(ids[1:], ids, strict=False))])
        of = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        most = max(len(s.queries) for s in self.spaces.values()) if new.all() else len(self.names)
        step = max(1, _SCORES_AT_ONCE // most)
        for at in range(0, len(first), step):
            lo, hi = first[at], first[at + step] if at + step < len(first) else len(ids)
            n, part, own = min(step, len(first) - at), rows.slice(lo, hi - lo), of[lo:hi] - at
            whole = np.zeros((len(self.names), n)) if n < hi - lo else None
            base = len(self.docs)
            self.docs += [ids[i] for i in first[at : at + n]]
            for name, space in self.spaces.items():
                there = pc.fill_null(pc.equal(part.column("space"), name), False).to_numpy()
                if not there.any():
                    continue
                scores = space.scores(part.filter(pa.array(there)), self.k1, self.b)
                if whole is None:
                    self._enter(space.queries, own[there] + base, scores)
                else:
                    np.add.at(whole, (space.queries[:, None], own[there]), scores)
            if whole is not None:
                self._enter(np.arange(len(self.names)), np.arange(n) + base, whole)
            if sum(len(x[0]) for x in self.held[1:]) > min(HELD, max(10_000, len(self.names) * self.k)):
                self._cut()

    def _enter(self, queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        # a score that is less by a unit of the last digit may still be equal when rounded
        wanted = (scores > 0) & (scores >= self.floor[queries, None])
        if wanted.sum() > 2 * self.k * len(queries) and len(docs) > self.k:
            wanted &= scores >= np.partition(scores, len(docs) - self.k, axis=1)[:, [len(docs) - self.k]] - 10.0**-DIGITS
        q, d = np.nonzero(wanted)
        self.held.append((queries[q], docs[d], scores[q, d]))

    def _cut(self) -> None:
        q, d, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        rounded = np.floor(s * 10.0**DIGITS + 0.5) / 10.0**DIGITS
        by_id = np.empty(len(self.docs), np.int64)
        by_id[pc.array_sort_indices(pa.array(self.docs, pa.string()), null_placement="at_start").to_numpy()] = np.arange(len(self.docs))
        order = np.lexsort((-by_id[d], -rounded, q))
        by_query = q[order]
        place = np.arange(len(order)) - np.searchsorted(by_query, by_query, side="left")
        last, kept = order[place == self.k - 1], order[place < self.k]
        self.floor[q[last]] = rounded[last] - 10.0**-DIGITS
        used, place = np.unique(d[kept], return_inverse=True)
        self.docs = [self.docs[i] for i in used]
        self.held = [(q[kept], place, s[kept])]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        names, docs = pa.array(self.names, pa.string()), pa.array(self.docs, pa.string())
        q, d, s = self.held[0]
        for at in range(0, len(q), 100_000):
            of = slice(at, at + 100_000)
            yield pa.record_batch([names.take(pa.array(q[of])), docs.take(pa.array(d[of])), pa.array(s[of])], ["qid", "doc_id", "score"])
