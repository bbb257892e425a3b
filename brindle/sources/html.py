"""Links and plain text of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import squeezed


def page_links(pages: DataFrame, id_col: str, html: str, pattern: str = "") -> DataFrame:
    """Distinct link targets of each page that contain ``pattern``, with the place of the first."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)href=\"([^\"]+)\""), 1)).alias("place", "url")
    return pages.select(id_col, found).filter(F.col("url").contains(pattern)).groupBy(id_col, "url").agg(F.min("place").alias("place"))


def plain_text(html: Column) -> Column:
    """Text without scripts, styles and tags; no-break spaces as spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return squeezed(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), "&nbsp;|\u00a0", " "))


def content_hash(col: Column) -> Column:
    """SHA-256 of the text with no-break spaces as spaces: pages with equal hashes are unchanged."""
    return F.sha2(F.regexp_replace(col, "\u00a0", " "), 256)


def changed_pages(now: DataFrame, before: DataFrame, key: str, content: str) -> DataFrame:
    """Pages that are new or whose content differs from the stored hash (``key``, ``hash``)."""
    fresh = now.withColumn("hash", content_hash(F.col(content)))
    return fresh.join(before.select(key, "hash"), [key, "hash"], "left_anti")
