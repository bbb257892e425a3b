"""References to records that are missing, deleted or late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references of ``refs`` that no record of ``parents`` backs at their time, with ``status``.

    ``refs``: ``kind``, ``key`` (in comparable form), ``at`` and any other columns but ``status``; ``parents``: ``kind``,
    ``key``, ``start``, ``end``: a record holds from ``start`` (included) until ``end`` (excluded; null is open).
    ``status``: ``missing`` (no record of the key at any time), ``late`` (all records start after ``at``) or ``deleted``.

    Both sides are co-partitioned and sorted by ``kind`` and ``key`` and merged in one pass: a sort-merge anti-join that
    reads a key's validity intervals beside its references and stops at the first that holds. Intervals are not gathered
    in one row: repeats are left out before the shuffle, the rest stay rows that spill. A key with very many references
    is split by the adaptive skew join. Only what is left over meets the first start of its key, on the same partitioning.

    References with a null key or kind are no references and are left out. A reference with a null ``at`` is compared
    with all times. Records with a null ``start`` never hold. Empty parents make every reference ``missing``.
    """
    names = {"kind": "_kind", "key": "_key", "start": "_start", "end": "_end"}
    spans = parents.filter("kind is not null and key is not null and start is not null").select(*names).distinct().withColumnsRenamed(names)
    same = (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key"))
    holds = F.col("at").isNull() | ((F.col("_start") <= F.col("at")) & (F.col("_end").isNull() | (F.col("_end") > F.col("at"))))
    orphans = refs.filter("kind is not null and key is not null").join(spans.hint("merge"), same & holds, "left_anti")
    first = spans.groupBy("_kind", "_key").agg(F.min("_start").alias("_first"))
    status = F.when(F.col("_first").isNull(), "missing").when(F.col("_first") <= F.col("at"), "deleted").otherwise("late")
    return orphans.join(first.hint("merge"), same, "left").withColumn("status", status).drop("_kind", "_key", "_first")


def orphan_report(orphans: DataFrame, *by: str) -> DataFrame:
    """Orphans counted by the columns ``by``, month of ``at`` and status."""
    month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    return orphans.groupBy(*by, month, "status").agg(F.count(F.lit(1)).alias("orphans"))
