"""Keys in their comparable form, and text values in theirs."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|(?<!\s)\s+$"  # the lookbehind keeps long inner runs linear
KEY_JOINTS = r"(?U)[\s/\-‐-―−]+"


def norm_key(col: Column) -> Column:
    """Trimmed, upper case, every run of white space, slashes and dashes as one hyphen; blank and null give null."""
    upper = F.upper(F.regexp_replace(col.cast("string"), EDGE_SPACE, ""))
    return F.nullif(F.regexp_replace(upper, KEY_JOINTS, "-"), F.lit(""))


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFC")


def norm_value(col: Column) -> Column:
    """NFC, trimmed, every run of white space (no-break space too) as one space; null and blank give null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(_nfc(col), EDGE_SPACE, ""), SPACE, " "), F.lit(""))


def standing(df: DataFrame, keys: list[str], version: str | None, *tie: str) -> DataFrame:
    """The row with the latest ``version`` of each key; ties go to the greatest ``tie`` columns, then values.

    A null version is older than any other. One partial aggregation, so that a key that holds a large share of the rows
    is reduced before the shuffle. All columns must be orderable. An empty table gives an empty table.
    """
    first = [c for c in (version, *tie) if c]
    order = first + [c for c in df.columns if c not in first and c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)
