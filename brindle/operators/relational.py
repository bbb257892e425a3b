"""Relational shapes: latest and current rows, page cuts, as-of lookups, interval tests, zero-filled counts, trailing counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def date_condition(col: Column, before=None, after=None, on=None, between: tuple | None = None) -> Column:
    """Before and after exclude the day, between includes both; conditions not given do not count."""
    return all_of(col < F.lit(before) if before else None, col > F.lit(after) if after else None, col == F.lit(on) if on else None,
        col.between(*map(F.lit, between)) if between else None)


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether [start, end] touches [low, high]; a null end is open."""
    return (start <= high) & (end.isNull() | (end >= low))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is greatest by ``order`` (all columns as ties); a partial aggregation, no sort of a group."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(*keys, "_m.*").select(*df.columns)


def preferred(df: DataFrame, keys: list[str], wanted: Column, *order: str) -> DataFrame:
    """One row a key: one for which ``wanted`` holds, else another; of several the greatest by ``order``, then by all columns."""
    rest = [c for c in df.columns if c not in order]
    ranked = F.struct(F.coalesce(wanted, F.lit(False)).alias("_w"), F.struct(*order, *rest).alias("_r"))
    return df.groupBy(*keys).agg(F.max(ranked).alias("_m")).select("_m._r.*").select(*df.columns)


def current_or_last(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The open row with the latest start of each key, else the one with the latest start; ``is_current`` tells which."""
    order = F.struct(F.col(end).isNull().alias("o"), F.col(start).alias("s"), F.struct(*[F.col(c) for c in df.columns]).alias("r"))
    return df.groupBy(*keys).agg(F.max(order).alias("_m")).select("_m.r.*", F.col("_m.o").alias("is_current"))


def zero_filled(dim: DataFrame, key: str, **counted: tuple[DataFrame, str]) -> DataFrame:
    """``dim`` with the number of rows of each table for its key, 0 without any; each table is counted before the join."""
    for name, (table, column) in counted.items():
        counts = table.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias(name))
        dim = dim.join(counts, dim[key].eqNullSafe(counts["_key"]), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)))
    return dim


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows behind ``after`` by ``key``."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(size)


def cursor_page(df: DataFrame, order: list[Column], size: int, within: Column | None = None) -> DataFrame:
    """The first ``size`` rows and ``has_more``; one row beyond is read to tell."""
    rows = (df if within is None else df.filter(within)).orderBy(*order).limit(size + 1)
    place = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows at most
    return place.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).filter(F.col("_n") <= size).drop("_n")


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], stretch: str = "day") -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row of the same key at or before its time; null without any.

    Both sides are one stream, sorted by key and time; the last value seen is carried on. A key that holds very many rows
    is cut into stretches (days, hours ...): each begins with the last value carried out of those before.
    Of right rows at one time the greatest values stand.
    """
    carried = F.struct(*[F.col(v) for v in values])
    r = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(right_time)
        .alias("_t")).agg(F.max(carried).alias("_v"))
    rows = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).select(F.col(by).alias("_k"), F.col(left_time).alias("_t"),
        F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), "_row", F.lit(1).alias("_side"))
    both = rows.unionByName(r.select("_k", "_t", "_v", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side")))
    both = both.withColumn("_stretch", F.date_trunc(stretch, "_t"))
    in_stretch = Window.partitionBy("_k", "_stretch").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_v", ignorenulls=True).over(in_stretch))
    ends = r.withColumn("_stretch", F.date_trunc(stretch, "_t")).groupBy("_k", "_stretch").agg(F.max(F.struct("_t", "_v")).getField("_v").alias("_end"))
    stretches = both.select("_k", "_stretch").distinct().join(ends, ["_k", "_stretch"], "left")
    before = Window.partitionBy("_k").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    into = stretches.select(F.col("_k").alias("_ik"), F.col("_stretch").alias("_im"), F.last("_end", ignorenulls=True).over(before).alias("_into"))
    joined = here.filter("_side = 1").join(into, F.col("_k").eqNullSafe(F.col("_ik")) & F.col("_stretch").eqNullSafe(F.col("_im")), "left")
    return joined.withColumn("_out", F.coalesce("_here", "_into")).select("_row.*", *[F.col(f"_out.{v}").alias(v) for v in values])


def trailing_count(df: DataFrame, by: str, time: str, hours: int, name: str = "trailing") -> DataFrame:
    """How many rows of the same key lie within the ``hours`` up to each row's time, itself included.

    Each row is counted in its stretch of ``hours`` and, for the rows of the next one, there too; so a task holds two
    stretches of a key and never its whole history. Rows without time count with each other. Columns keep their names.
    """
    length = hours * 3_600_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    own = F.floor(at / length)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(by).alias("_by"), at.alias("_at"), own.alias("_own"))
    placed = rows.withColumn("_stretch", F.explode(F.when(F.col("_own").isNull(), F.array("_own")).otherwise(F.array("_own", F.col("_own") + 1))))
    window = Window.partitionBy("_by", "_stretch").orderBy("_at").rangeBetween(-length, 0)
    counted = placed.withColumn("_n", F.count(F.lit(1)).over(window)).filter(F.col("_stretch").eqNullSafe(F.col("_own")))
    return counted.select("_row.*", F.col("_n").alias(name))


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int = 64) -> DataFrame:
    """Row numbers from 1 within each key, in no order that means anything, without one task per key: numbers within salted parts
    plus offsets."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*keys, "_salt").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_s")]
    joined = salted.withColumn("_inner", inner).join(offsets, reduce(lambda a, b: a & b, same))
    return joined.withColumn(name, F.col("_inner") + F.col("_before")).drop("_salt", "_inner", "_before", "_s", *[f"_k_{k}" for k in keys])


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 within each key in the given order, without one task per key.

    All rows are range-partitioned by key and order; a task numbers its stretch of a key, to which the sizes of the
    stretches before are added (a row a key and task). The sorted rows are written to the checkpoint folder, so that stretches
    stay what they were counted as.
    """
    at = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    cut = cut_lineage(at.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_seq").alias("_from"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_from", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    joined = cut.join(starts, reduce(lambda a, b: a & b, same))
    return joined.withColumn(name, F.col("_seq") - F.col("_from") + F.col("_before") + 1).select(*df.columns, name)


def running_size(df: DataFrame, by: str, order: str, size: Column, cap: int, rows: int) -> DataFrame:
    """The first ``rows`` rows of each key while their sizes add up to ``cap`` at most; ``running`` is the sum.

    A key is cut to its first rows before the shuffle, so that no task sorts all rows of one.
    """
    seen = Window.partitionBy(by).orderBy(order)
    first = df.withColumn("_n", F.row_number().over(seen)).filter(F.col("_n") <= rows)
    counted = first.withColumn("running", F.sum(size).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.filter(F.col("running") <= cap).drop("_n")
