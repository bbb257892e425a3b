"""Incremental, repeatable loads and their bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.relational import latest


def new_rows(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those done, each key once."""
    return df.dropDuplicates([key]).join(done.select(key), key, "left_anti")


def append_new(df: DataFrame, path: str, key: str, partition_by: list[str] | None = None) -> int:
    """Append the rows whose key the Parquet table at ``path`` lacks; running it again adds nothing. Returns how many.

    The table is read once, its key column alone; with ``partition_by`` only the partitions that the new rows fall into
    (a key must then always fall into the same one). The rows appended are counted as they are written.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where):
        done = spark.read.parquet(path)
        if partition_by:
            done = done.join(F.broadcast(df.select(*partition_by).distinct()), partition_by, "left_semi")  # names of partitions
        fresh = new_rows(df, done, key)
    else:
        fresh = df.dropDuplicates([key])
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    return int(seen.get["rows"])


#: Escapes of the text format of a database dump.
_ESCAPED = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v"}


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a dump with their ``place``: the block of the file, then the place within it, so that a large file is
    read by many tasks and its order is still known."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    return lines.select(F.struct("f", "b", F.monotonically_increasing_id().alias("i")).alias("place"), F.col("value").alias("line"))


def dump_rows(lines: DataFrame, schema: str, keep: list[str] | None = None) -> DataFrame:
    """``table_name``, ``columns`` and ``fields`` of every row that a dump copies; a null field is null.

    ``lines``: ``place`` (any orderable column) and ``line``. Tables come under ``schema``, whatever theirs was; only those
    named in ``keep`` are kept. Where a table's rows begin and end is a short list (two rows a table), the only thing that is
    broadcast; rows are told apart by their place, without one task reading the whole file.
    """
    head = r"^COPY (?:[\w\"]+\.)?\"?(\w+)\"? \((.*)\) FROM stdin;$"
    marks = lines.filter(F.col("line").rlike(head) | (F.col("line") == "\\.")).withColumn("table", F.regexp_extract("line", head, 1))
    after = F.lead("place").over(Window.orderBy("place"))  # two rows a table
    names = F.transform(F.split(F.regexp_extract("line", head, 2), ","), lambda c: F.replace(F.trim(c), F.lit('"'), F.lit("")))
    spans = marks.withColumn("until", after).filter("table <> ''").select(F.concat(F.lit(f"{schema}."), F.col("table")).alias("table_name"),
        names.alias("columns"), F.col("place").alias("since"), "until")
    if keep is not None:
        spans = spans.filter(F.substring_index("table_name", ".", -1).isin(keep))
    within = (F.col("place") > F.col("since")) & (F.col("until").isNull() | (F.col("place") < F.col("until")))

    def field(raw: Column) -> Column:
        out = F.replace(raw, F.lit("\\\\"), F.lit("\x00"))
        for code, sign in _ESCAPED.items():
            out = F.replace(out, F.lit(code), F.lit(sign))
        return F.when(raw != "\\N", F.replace(out, F.lit("\x00"), F.lit("\\")))

    return lines.join(F.broadcast(spans), within).select("table_name", "columns", F.transform(F.split("line", "\t", -1), field).alias("fields"))


def dump_table(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table of a dump with the named columns, as text."""
    own = rows.filter(F.col("table_name") == table)
    return own.select(*[F.try_element_at("fields", F.nullif(F.array_position("columns", c), F.lit(0)).cast("int")).alias(c) for c in columns])


def cached(entries: DataFrame, key: str, stored: str, now: Column, seconds: int) -> DataFrame:
    """The last entry of each key that is not older than ``seconds``; later ones than ``now`` are not there yet."""
    alive = entries.filter((F.col(stored) <= now) & (F.col(stored) >= now - F.expr(f"interval {seconds} seconds")))
    return latest(alive, [key], stored)


def event_lines(df: DataFrame, kind: Column, *columns: str) -> DataFrame:
    """Rows as lines of a stream of JSON events: ``type`` and the columns that are not null."""
    return df.select(F.to_json(F.struct(kind.alias("type"), *columns)).alias("event"))


def replace_all(df: DataFrame, path: str) -> None:
    """Overwrite the table at ``path``; refuses an empty source."""
    if df.isEmpty():
        raise ValueError("the source is empty")
    df.write.mode("overwrite").parquet(path)


def keys_with_prefix(done: DataFrame, key: str, prefix: str) -> DataFrame:
    return done.filter(F.col(key).startswith(prefix))


def without_prefix(done: DataFrame, key: str, prefix: str) -> DataFrame:
    """The progress without the keys of one kind, so that they are loaded again."""
    return done.filter(~F.coalesce(F.col(key).startswith(prefix), F.lit(False)))


def resource_key(source_type, source_id, language, chunk):
    """``{type}:{id}:{language}:{chunk}``."""
    return F.concat_ws(":", source_type, source_id.cast("string"), language, chunk.cast("string"))


def reconcile(spark: SparkSession, pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows of each table in source and target, and whether they agree."""
    counts = [a.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(b.agg(F.count(F.lit(1)).alias("target_rows")))
        .select(F.lit(name).alias("table_name"), "source_rows", "target_rows") for name, (a, b) in pairs.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("agree", F.col("source_rows") == F.col("target_rows"))


def unexpected_tables(spark: SparkSession, keep: list[str]) -> list[str]:
    """Tables of the catalog that are not on the list."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name not in keep)


def resolve_subset(acts: DataFrame, regulations: DataFrame, wanted: list[str], explicit: list[str]) -> DataFrame:
    """``id``, ``known``: the acts wanted, the regulations made under them, and explicit ids; unknown ids are marked."""
    spark = acts.sparkSession
    asked = spark.createDataFrame([(x,) for x in [*wanted, *explicit]], "id string").distinct()
    under = regulations.join(asked, regulations["enabling_act_id"] == asked["id"], "left_semi").select(F.col("regulation_id").alias("id"))
    known = acts.select(F.col("act_id").alias("id")).union(regulations.select("regulation_id")).distinct().withColumn("known", F.lit(True))
    return asked.union(under).distinct().join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def reembed(resources: DataFrame, vectors: DataFrame, key: str, old_model: str, new_model: str) -> DataFrame:
    """Resources of the old model with their new vector and model; others as they are. One pass, no paging that shifts."""
    fresh = vectors.select(F.col(key), F.col("vector").alias("_v"))
    take = (F.col("model") == old_model) & F.col("_v").isNotNull()
    joined = resources.join(fresh, key, "left")
    return joined.withColumn("vector", F.when(take, F.col("_v")).otherwise(F.col("vector"))).withColumn("model", F.when(take, new_model)
        .otherwise(F.col("model"))).select(*resources.columns)
