from __future__ import annotations

import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "bm25_metrics", "rank_eval_audit"} <= set(queries)
