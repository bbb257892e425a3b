"""Changes of tables as rewrites: upserts, cascading deletes, versions and filled columns; coverage of name sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import latest


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the latest version of both tables."""
    return latest(table.unionByName(changes), keys, version)


def without_parents(child: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``child`` without the rows of parents that are deleted; rows without parent stay."""
    keys = gone.select(F.col(gone_key).alias("_gone")).distinct()
    return child.join(keys, child[key] == keys["_gone"], "left_anti")


def up_to(df: DataFrame, time: str, moment: Column) -> DataFrame:
    """Rows before ``moment``; later ones and that moment's are deleted."""
    return df.filter(F.col(time).isNull() | (F.col(time) < moment))


def filled_in(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``column`` with ``value`` where it is null."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def coverage(known: DataFrame, handled: DataFrame, name: str) -> DataFrame:
    """Each name of either table with ``status``: covered, gap (known only) or extra (handled only)."""
    a, b = known.select(name).distinct().withColumn("_a", F.lit(1)), handled.select(name).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), "gap").when(F.col("_a").isNull(), "extra").otherwise("covered")
    return a.join(b, name, "full_outer").select(name, status.alias("status"))


def evaluation(results: DataFrame, score: str, least: float) -> DataFrame:
    """Cases, passed cases and mean score."""
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col(score) >= least).alias("passed"), F.avg(score).alias("mean_score"))
