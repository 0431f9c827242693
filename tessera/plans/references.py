"""p1: orphan references of the judgment and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import Reference, orphan_references, orphan_report, parent_intervals, reference_stream
from ..session import read_table

FIELDS = [
    Reference("qrels", "query_id", "qrel_id", "added_at", "queries"),
    Reference("qrels", "corpus_id", "qrel_id", "added_at", "corpus"),
    Reference("training_examples", "positive_doc_id", "example_id", "mined_at", "corpus"),
    Reference("training_examples", "hard_negative_doc_id", "example_id", "mined_at", "corpus"),
]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    tables = {f.table: read_table(spark, base, f.table) for f in FIELDS}
    parents = parent_intervals(
        {
            "queries": (read_table(spark, base, "queries"), "_id", "added_at", None),
            "corpus": (read_table(spark, base, "corpus"), "_id", "added_at", "deleted_at"),
        }
    )
    return orphan_references(reference_stream(tables, FIELDS), parents)


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    return orphan_report(p1_found(spark, base))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_FOUND = """
WITH parents AS (
  SELECT 'queries' AS parent, _id AS key, added_at AS born, CAST(NULL AS TIMESTAMP) AS gone FROM queries
  UNION ALL SELECT 'corpus', _id, added_at, deleted_at FROM corpus
), refs AS (
  SELECT 'qrels' AS src_table, 'query_id' AS ref_field, qrel_id AS row_id, added_at AS t, 'queries' AS parent, query_id AS key FROM qrels
  UNION ALL SELECT 'qrels', 'corpus_id', qrel_id, added_at, 'corpus', corpus_id FROM qrels
  UNION ALL SELECT 'training_examples', 'positive_doc_id', example_id, mined_at, 'corpus', positive_doc_id FROM training_examples
  UNION ALL SELECT 'training_examples', 'hard_negative_doc_id', example_id, mined_at, 'corpus', hard_negative_doc_id FROM training_examples
), states AS (
  SELECT src_table, ref_field, row_id,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN p.born > t THEN 'late' WHEN p.gone <= t THEN 'deleted' END AS state,
    strftime(t, '%Y-%m') AS ym
  FROM refs r LEFT JOIN parents p ON r.parent = p.parent AND r.key = p.key
  WHERE r.key IS NOT NULL
)"""

ORACLE = {
    "p1_found": _FOUND + " SELECT src_table, ref_field, row_id, state, ym FROM states WHERE state IS NOT NULL",
    "p1_report": _FOUND
    + " SELECT src_table, ref_field, state, ym, count(*) AS n_references FROM states"
    " WHERE state IS NOT NULL GROUP BY ALL",
}
