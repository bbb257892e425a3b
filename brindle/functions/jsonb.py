"""Tests on and changes of JSON texts, without a fixed schema."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_at(text: Column, name: str) -> Column:
    """The array that is the member ``name``; null where there is none."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{name}", "array<variant>")


def array_length(text: Column, name: str) -> Column:
    """How many elements that array has; null where there is none."""
    found = array_at(text, name)
    return F.when(found.isNotNull(), F.size(found))


def has_element(text: Column, name: str, value: str, member: str | None = None) -> Column:
    """Whether the array ``name`` holds ``value`` (or an object whose ``member`` it is)."""
    path = "$" if member is None else f"$.{member}"
    return F.coalesce(F.exists(array_at(text, name), lambda x: F.coalesce(F.try_variant_get(x, path, "string") == value, F.lit(False))), F.lit(False))


def contains(text: Column, wanted: Mapping[str, str | int | bool]) -> Column:
    """Whether the object has all these members with these values."""
    doc, out = F.try_parse_json(text), F.lit(True)
    for name, value in wanted.items():
        out = out & F.coalesce(F.try_variant_get(doc, f"$.{name}", "string") == (value if isinstance(value, str) else json.dumps(value)),
            F.lit(False))
    return out


def with_member(text: Column, name: str, value: Column) -> Column:
    """The object with the member ``name`` set to a text, last; other members stay as they are. Null where it is no object."""
    members = F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>")
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    kept = F.transform(F.map_entries(F.map_filter(members, lambda k, _: k != name)),
        lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))
    own = F.concat(quoted(F.lit(name)), F.lit(":"), quoted(value))
    return F.when(members.isNotNull(), F.concat(F.lit("{"), F.array_join(F.concat(kept, F.array(own)), ","), F.lit("}")))
