"""Validity of inputs, forms of identifiers, keys of cached results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of identifiers and labels, and the bounds of a limit.
ACT_ID, REGULATION_ID, LABEL = r"(?i)^[A-Z]+-\d+(\.\d+)?$", r"(?i)^(SOR|SI|CRC|DORS)-[A-Za-z0-9_.\-]+$", r"^[A-Za-z0-9_\s.\-–—]+$"
AMENDMENT = r"(?i)(\d{4}),\s*c\.\s*(\d+)(?:,\s*s\.\s*(\d+))?"
LABEL_CHARS, LEAST, MOST, MOST_INTEGER = 100, 1, 100, 1_000_000


def _sure(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def valid_act_id(col: Column) -> Column:
    return _sure(col.rlike(ACT_ID))


def valid_regulation_id(col: Column) -> Column:
    return _sure(col.rlike(REGULATION_ID))


def valid_label(col: Column) -> Column:
    """Letters, digits, dots, dashes and spaces, up to 100 characters."""
    return _sure(col.rlike(LABEL) & (F.length(col) <= LABEL_CHARS))


def valid_language(col: Column) -> Column:
    return _sure(col.isin("en", "fr"))


def positive_integer(col: Column) -> Column:
    """The whole number that a text begins with, from 1 to a million; null for others."""
    number = F.regexp_extract(col, r"^\s*\+?(\d{1,7})(?!\d)", 1).try_cast("int")
    return F.when(number.between(1, MOST_INTEGER), number)


def clamped(limit: int | None, default: int = 10) -> int:
    """A limit between 1 and 100."""
    return min(max(LEAST, default if limit is None else limit), MOST)


def regulation_id(instrument: Column) -> Column:
    """An instrument's number as an id: slashes as dashes, commas with what follows as underscores."""
    return F.regexp_replace(F.replace(instrument, F.lit("/"), F.lit("-")), r",\s*", "_")


def alpha_number(col: Column) -> Column:
    return F.replace(col, F.lit("/"), F.lit("-"))


def file_name(alpha: Column) -> Column:
    """The name of an instrument's file: slashes as dashes, spaces as underscores."""
    return F.replace(alpha_number(alpha), F.lit(" "), F.lit("_"))


def cache_key(prefix: str, query: Column, language: Column | None = None, threshold: float = 0.4, limit: int = 10, **extras: Column) -> Column:
    """The key of a cached search: prefix, options, extras (``NA`` where missing) and a hash of the query."""
    parts = [F.lit(prefix), F.lit("any") if language is None else F.coalesce(language, F.lit("any")), F.lit(f"{threshold:g}"), F.lit(str(limit))]
    parts += [F.concat(F.lit(f"{name}:"), F.coalesce(value.cast("string"), F.lit("NA"))) for name, value in extras.items()]
    return F.concat_ws(":", *parts, F.sha1(query))


def amendment(col: Column) -> Column:
    """Year, chapter and section of a citation such as ``2023, c. 8, s. 46``; null for others, the section where it has none."""
    number = lambda i: F.regexp_extract(col, AMENDMENT, i).try_cast("int")
    return F.when(col.rlike(AMENDMENT), F.struct(number(1).alias("year"), number(2).alias("chapter"), number(3).alias("section")))


def paired(terms: Column, others: Column) -> Column:
    """Each term with the other list's at its place, or with its only one; ``pos`` from 0."""
    other = lambda i: F.coalesce(F.try_element_at(others, i + 1), F.when(F.size(others) == 1, F.try_element_at(others, F.lit(1))))
    return F.transform(terms, lambda t, i: F.struct(i.alias("pos"), t.alias("term"), other(i).alias("paired")))


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date's parts; a missing month or day is the first."""
    two = lambda c: F.lpad(F.coalesce(F.nullif(c, F.lit("")), F.lit("01")), 2, "0")
    return F.when(F.nullif(year, F.lit("")).isNotNull(), F.concat_ws("-", year, two(month), two(day)))
