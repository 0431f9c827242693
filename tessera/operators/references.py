"""References to records that do not exist.

Every reference carries the time t at which its row was made; every parent key carries a validity
interval [added_at, deleted_at).  Both sides are hash-partitioned and sorted on the key and merged
linearly in one pass (Spark's sort-merge join), which separates three kinds of orphan:

* ``missing``  no parent with exactly that key (binary string equality);
* ``late``     the parent's ``added_at`` is after t;
* ``deleted``  the parent's ``deleted_at`` is at or before t.

Defined results for odd input: a null reference is no reference and gives no row; a null t can only
be ``missing`` and has a null month; a null ``added_at`` counts as "always there" and a null
``deleted_at`` as "still there"; a parent key that occurs several times lives from its earliest
addition to its latest deletion; repeated reference rows give repeated result rows; empty tables
give an empty result.  Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """One referring column: where it is, what identifies its row, when it was made, what it names."""

    table: str
    field: str
    row_id: str
    made_at: str
    parent: str


def reference_stream(tables: dict[str, DataFrame], fields: list[Reference]) -> DataFrame:
    """(src_table, ref_field, row_id, t, join_key): all non-null references as one narrow stream."""
    by_table: dict[str, list[Reference]] = {}
    for f in fields:
        by_table.setdefault(f.table, []).append(f)
    parts = []
    for name, group in by_table.items():
        # one scan per table: the referring columns become rows of an array instead of union branches
        entries = F.array(
            *[
                F.struct(F.lit(f.field).alias("ref_field"), F.lit(f.parent).alias("parent"), F.col(f.field).alias("key"))
                for f in group
            ]
        )
        first = group[0]
        parts.append(
            tables[name]
            .select(
                F.lit(name).alias("src_table"),
                F.col(first.row_id).alias("row_id"),
                F.col(first.made_at).alias("t"),
                F.explode(entries).alias("e"),
            )
            .where(F.col("e.key").isNotNull())
            .select("src_table", "e.ref_field", "row_id", "t", _join_key(F.col("e.parent"), F.col("e.key")))
        )
    return reduce(DataFrame.unionByName, parts)


def parent_intervals(parents: dict[str, tuple[DataFrame, str, str | None, str | None]]) -> DataFrame:
    """(join_key, born, gone): one validity interval per parent key, pre-aggregated map-side."""
    never = F.lit(None).cast("timestamp")
    parts = [
        df.select(
            F.lit(name).alias("parent"),
            F.col(key).alias("key"),
            (F.col(born) if born else never).alias("born"),
            (F.col(gone) if gone else never).alias("gone"),
        ).where(F.col("key").isNotNull())
        for name, (df, key, born, gone) in parents.items()
    ]
    one = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("parent", "key")
        .agg(
            F.min("born").alias("born"),
            F.bool_or(F.col("born").isNull()).alias("always"),
            F.max("gone").alias("gone"),
            F.bool_or(F.col("gone").isNull()).alias("stays"),
        )
    )
    return one.select(
        _join_key(F.col("parent"), F.col("key")),
        F.when(~F.col("always"), F.col("born")).alias("born"),
        F.when(~F.col("stays"), F.col("gone")).alias("gone"),
    )


def _join_key(parent, key):
    # a computed key makes the planner put an exchange of its own directly under the merge, which is
    # the shape in which adaptive execution splits a partition that one hot key has blown up
    return F.concat_ws("\x1f", parent, key).alias("join_key")


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(src_table, ref_field, row_id, state, ym): one row per reference without a living target."""
    merged = references.join(parents.withColumn("there", F.lit(True)).hint("merge"), "join_key", "left")
    t = F.col("t")
    state = (
        F.when(F.col("there").isNull(), F.lit("missing"))
        .when(F.col("born") > t, F.lit("late"))
        .when(F.col("gone") <= t, F.lit("deleted"))
    )
    return (
        merged.withColumn("state", state)
        .where(F.col("state").isNotNull())
        .select("src_table", "ref_field", "row_id", "state", F.date_format("t", "yyyy-MM").alias("ym"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, reason and calendar month."""
    return orphans.groupBy("src_table", "ref_field", "state", "ym").agg(F.count(F.lit(1)).alias("n_references"))
