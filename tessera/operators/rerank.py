"""Second-stage ranking: pairwise scorers and sliding-window list rankers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plugins import ListRanker, PairScorer


def candidate_texts(run: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int, keep_blank: bool = False) -> DataFrame:
    """(qid, doc_id, first_rank, query, document) of the first ``top_k`` candidates; texts are joined
    after the cut.  Blank or absent documents drop out, or stay as '' for list rankers."""
    first = run.where(F.col("rank") <= top_k).select("qid", "doc_id", F.col("rank").alias("first_rank"))
    docs = corpus.select("doc_id", F.col("text").alias("document"))
    both = first.join(queries.select("qid", F.col("text").alias("query")), "qid")
    if keep_blank:
        return both.join(docs, "doc_id", "left").withColumn("document", F.coalesce("document", F.lit("")))
    return both.join(docs.where("document is not null and document <> ''"), "doc_id")


def rerank(candidates: DataFrame, scorer: PairScorer, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score, rank): by score, ties in first-stage order.  Only candidates are returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = scorer(list(zip(pdf["query"], pdf["document"])))
            yield pdf[["qid", "doc_id", "first_rank"]].assign(score=[round(float(s), digits) for s in scores])

    scored = candidates.select("qid", "doc_id", "first_rank", "query", "document").mapInPandas(
        run, "qid string, doc_id string, first_rank int, score double"
    )
    return by_score(scored)


def by_score(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("first_rank"))
    return scored.withColumn("rank", F.row_number().over(w)).select("qid", "doc_id", "score", "rank")


def window_starts(n: int, size: int = 20, stride: int = 10) -> list[int]:
    """Starts of the windows from the tail to the head; one window when everything fits."""
    if size <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    if n <= size:
        return [0]
    return sorted({*range(0, n - size + 1, stride), n - size}, reverse=True)


def parse_permutation(reply: str, n: int) -> list[int]:
    """Zero-based order named by a reply like ``[3] > [1]``: out-of-range and repeated numbers are
    dropped, unmentioned ones follow in their old order."""
    named = list(dict.fromkeys(int(x) - 1 for x in re.findall(r"\[(\d+)\]", reply) if 1 <= int(x) <= n))
    return named + [i for i in range(n) if i not in set(named)]


def slide(query: str, documents: Sequence[tuple[str, str]], ranker: ListRanker, size: int = 20, stride: int = 10) -> tuple[list[str], int]:
    """(ids in their new order, number of calls): each window's reply rewrites its slice in place."""
    order = list(documents)
    starts = window_starts(len(order), size, stride) if order else []
    for s in starts:
        part = order[s : s + size]
        order[s : s + size] = [part[i] for i in parse_permutation(ranker(query, [t for _, t in part]), len(part))]
    return [d for d, _ in order], len(starts)


def listwise(candidates: DataFrame, ranker: ListRanker, size: int = 20, stride: int = 10) -> DataFrame:
    """(qid, doc_id, rank, score = -rank, n_calls): windows are sequential inside a query and parallel
    across queries; a group is one query's candidates, bounded by their ``top_k``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_rank")
        ids, calls = slide(pdf["query"].iloc[0], list(zip(pdf["doc_id"], pdf["document"])), ranker, size, stride)
        ranks = range(1, len(ids) + 1)
        return pd.DataFrame(
            {"qid": pdf["qid"].iloc[0], "doc_id": ids, "rank": list(ranks), "score": [float(-r) for r in ranks], "n_calls": calls}
        )

    return candidates.select("qid", "doc_id", "first_rank", "query", "document").groupBy("qid").applyInPandas(
        run, "qid string, doc_id string, rank int, score double, n_calls int"
    )
