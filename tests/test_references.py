from __future__ import annotations

from datetime import datetime as D

from tessera.operators.references import Reference, orphan_references, orphan_report, parent_intervals, reference_stream

REFS = "row bigint, a string, b string, made timestamp, parent string, born timestamp"
PARENTS = "k string, born timestamp, gone timestamp, parent string"
FIELDS = [Reference("t", "a", "row", "made", "p"), Reference("t", "b", "row", "made", "p")]


def _orphans(spark, refs, parents):
    tables = {"t": spark.createDataFrame(refs, REFS)}
    p = parent_intervals({"p": (spark.createDataFrame(parents, PARENTS), "k", "born", "gone")})
    return orphan_references(reference_stream(tables, FIELDS), p)


def test_states_and_months(spark, rows):
    t = D(2024, 5, 10)
    refs = [
        (1, "ok", "nowhere", t, None, None),
        (2, "later", None, t, None, None),
        (3, "gone", "gone now", t, None, None),
        (4, "OK", "ok ", t, "x", None),  # keys match only exactly
        (5, "ok", "late and gone", None, None, None),  # no time: never late or deleted
    ]
    parents = [
        ("ok", D(2024, 1, 1), None, None),
        ("later", D(2024, 5, 11), None, None),
        ("gone", D(2023, 1, 1), D(2024, 5, 9), None),
        ("gone now", D(2023, 1, 1), t, None),
        ("late and gone", D(2025, 1, 1), D(2025, 2, 1), None),
    ]
    got = rows(_orphans(spark, refs, parents), "ref_field", "row_id", "state", "ym")
    assert got == [
        ("a", 2, "late", "2024-05"),
        ("a", 3, "deleted", "2024-05"),
        ("a", 4, "missing", "2024-05"),
        ("b", 1, "missing", "2024-05"),
        ("b", 3, "deleted", "2024-05"),
        ("b", 4, "missing", "2024-05"),
    ]


def test_repeated_parents_nulls_and_repeats(spark, rows):
    t = D(2024, 5, 10)
    refs = [(1, "k", "always", t, None, None), (1, "k", "always", t, None, None), (2, "k2", "x" * 100_000, t, None, None)]
    parents = [
        ("k", D(2024, 6, 1), None, None),
        ("k", D(2024, 1, 1), D(2024, 2, 1), None),  # one record from its first addition on, never gone for good
        ("always", None, None, None),
        ("k2", D(2024, 1, 1), D(2024, 2, 1), None),
        ("k2", D(2024, 1, 1), D(2024, 3, 1), None),
        (None, t, t, None),
    ]
    got = rows(_orphans(spark, refs, parents), "ref_field", "row_id", "state")
    assert got == [("a", 2, "deleted"), ("b", 2, "missing")]


def test_hot_key_empty_tables_and_report(spark, rows):
    t = D(2024, 5, 10)
    refs = [(i, "hot", None, t, None, None) for i in range(500)]
    report = orphan_report(_orphans(spark, refs, []))
    assert rows(report) == [("t", "a", "missing", "2024-05", 500)]
    assert _orphans(spark, [], [("hot", t, None, None)]).count() == 0
