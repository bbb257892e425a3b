"""Numbers of sections and scopes in provisions' wording; corrections of terms; comparable JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A section's number has up to six digits before its decimals, so that a range has a million sections at most.
_NUMBER = r"(?<!\d)\d{1,6}(?!\d)(?:\.\d+)?"
#: A number this near behind the start of a range belongs to the range (fixed value).
NEAR = 30


def section_list(text: str | None) -> list[str]:
    """The sections that a wording such as "sections 17 to 19 and 21 to 28" names.

    Ranges of whole numbers are written out, of decimal ones only their ends; adjacent numbers are a range; single numbers
    near a range's start do not count again.
    """
    wording = re.sub(r"(?i)sections?\s*to\.?", "sections ", text or "")
    wording = re.sub(rf"({_NUMBER})\s+({_NUMBER})", r"\1 to \2", wording)
    out, starts = [], []
    for m in re.finditer(rf"({_NUMBER})\s*(?:to|-)\s*({_NUMBER})", wording):
        a, z = m.groups()
        starts.append(m.start())
        if "." in a + z:
            out += [a, z] if a != z else [a]
        else:
            out += map(str, range(int(a), int(z) + 1))
    named = set(out)
    for m in re.finditer(rf"\b{_NUMBER}\b", wording):
        if m.group() not in named and not any(s <= m.start() < s + NEAR for s in starts):
            out.append(m.group())
            named.add(m.group())
    return out


# Wordings that name further sections, or all of them.
_FURTHER = [re.compile(r"(?i)in this section and (?:in )?sections?\s+(.+?)(?:\.|$)"),
    re.compile(r"(?i)au présent article et aux articles?\s*(?:à\.?)?\s*([\d\s.,àto-]+)")]
_APPLIED = [re.compile(r"(?i)(?:apply|definitions apply) in sections?\s*(?:to\.?)?\s*([\d\s.,to-]+)"),
    re.compile(r"(?i)(?:s'appliquent|appliquent)\s*(?:aux|au)\s*articles?\s*(?:à\.?)?\s*([\d\s.,àto-]+)")]


def scope_of(wording: str | None, current: str | None, document: str = "act") -> tuple[str, list[str] | None]:
    """What a definition covers and, for sections, which: the whole document unless its wording says otherwise."""
    low = (wording or "").lower()
    if kind := wide_scope(low):
        return kind, None
    for here, further in zip(("in this section", "présent article"), _FURTHER):
        if here in low:
            more = further.search(low)
            return "section", list(dict.fromkeys([*([current] if current else []), *(section_list(more.group(1)) if more else [])]))
    for pattern in _APPLIED:
        if (found := pattern.search(low)) and (sections := section_list(found.group(1))):
            return "section", sections
    return document, None


def wide_scope(low: str) -> str | None:
    """The scope of a wording in lower case that covers a document or a part."""
    if ("in this act" in low and "in this act and" not in low) or "la présente loi" in low:
        return "act"
    if ("in this regulation" in low and "sections" not in low) or "le présent règlement" in low:
        return "regulation"
    if ("in this part" in low and "sections" not in low) or ("dans la présente partie" in low and "articles" not in low):
        return "part"
    return None


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("sections", T.ArrayType(T.StringType()))]))
def scope(wording: pd.Series, current: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scope_of(w, c) for w, c in zip(wording, current)], columns=["kind", "sections"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def section_numbers(text: pd.Series) -> pd.Series:
    return text.map(section_list)


def scope_kind(wording: Column) -> Column:
    """What a definition's wording covers: act, regulation, part or section; null if it does not say."""
    low = F.lower(wording)
    has = low.contains
    act = (has("in this act") & ~has("in this act and")) | has("la présente loi")
    regulation = (has("in this regulation") & ~has("sections")) | has("le présent règlement")
    part = (has("in this part") & ~has("sections")) | (has("dans la présente partie") & ~has("articles"))
    section = has("in this section") | has("présent article") | low.rlike(r"(?:sections|articles)\D{0,6}\d")
    return F.when(act, "act").when(regulation, "regulation").when(part, "part").when(section, "section")


def corrected(doc: Column, term: Column, corrections: dict[str, list[tuple[str, str]]]) -> Column:
    """The term with its document's corrections (a list of settings), each in the letter case of what it replaces."""

    def fix(doc_id: str | None, text: str | None) -> str | None:
        for wrong, right in corrections.get(doc_id, ()) if text is not None else ():
            cased = lambda m, r=right: r.upper() if m.group().isupper() else r[0].upper() + r[1:] if m.group()[0].isupper() else r
            text = re.sub(re.escape(wrong), cased, text, flags=re.IGNORECASE)
        return text

    @F.pandas_udf(T.StringType())
    def run(docs: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([fix(d, t) for d, t in zip(docs, terms)], dtype=object)

    return run(doc, term)


def _bare(value):
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in sorted(value.items()) if v is not None}
    return [_bare(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def comparable_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and without null members, so that equal values are equal texts; null if unreadable."""

    def canon(t: str | None) -> str | None:
        try:
            return json.dumps(_bare(json.loads(t)), ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([canon(t) for t in text], dtype=object)
