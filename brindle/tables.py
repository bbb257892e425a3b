"""Loading of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def register(spark: SparkSession, base: str, *names: str) -> None:
    """Make the tables visible to SQL under their names."""
    for name in names:
        load(spark, base, name).createOrReplaceTempView(name)


#: Every table, by name.
TABLES = [
    "abuse_labels", "acts", "acts_copy", "bills_bill", "bills_votequestion", "chunk_input", "cross_references", "customer", "documents", "embeddings",
        "events", "hansards_statement",
    "leg_resources", "lineitem", "message_v2", "nation", "orders", "part", "region", "regulations", "regulations_copy", "source_targets", "supplier",
]
