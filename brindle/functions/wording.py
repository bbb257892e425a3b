"""Wordings with placeholders, as column expressions.

``{name}`` is the field's text, ``{name|default}`` with another wording where it is missing; ``<name:...>`` is only there if
the field is given, ``<!name:...>`` only if it is not. A null or empty field is missing. Wordings nest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import filled

Node = str | tuple[str, str, list]  # plain text, or (kind, field, inner) with kind value, given or missing


def parsed(wording: str) -> list[Node]:
    def run(at: int, end: str) -> tuple[list[Node], int]:
        out: list[Node] = []
        while at < len(wording) and wording[at] != end:
            if wording[at] == "{":
                stop = min(p for p in (wording.find("|", at), wording.find("}", at)) if p >= 0)
                name, inner = wording[at + 1 : stop], []
                if wording[stop] == "|":
                    inner, stop = run(stop + 1, "}")
                out.append(("value", name, inner))
                at = stop + 1
            elif wording[at] == "<":
                stop = wording.index(":", at)
                name = wording[at + 1 : stop]
                inner, stop = run(stop + 1, ">")
                out.append(("missing" if name[0] == "!" else "given", name.lstrip("!"), inner))
                at = stop + 1
            else:
                stop = min((p for p in (wording.find(c, at) for c in ("{", "<", end)) if p >= 0), default=len(wording))
                out.append(wording[at:stop])
                at = stop
        return out, at

    return run(0, "\0")[0]


def worded(wording: str, fields: Mapping[str, Column]) -> Column:
    """The wording over the given fields; fields that are not given are missing."""
    none = F.lit(None).cast("string")
    get = lambda name: filled(fields[name].cast("string")) if name in fields else none

    def build(nodes: list[Node]) -> Column:
        parts = []
        for node in nodes:
            if isinstance(node, str):
                parts.append(F.lit(node))
                continue
            kind, name, inner = node
            if kind == "value":
                parts.append(F.coalesce(get(name), build(inner)))
            else:
                parts.append(F.when(get(name).isNotNull() if kind == "given" else get(name).isNull(), build(inner)).otherwise(""))
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")

    return build(parsed(wording))


def worded_sql(wording: str, get: Callable[[str], str]) -> str:
    """The same as SQL text; ``get`` gives the SQL of a field (null where it is missing)."""

    def build(nodes: list[Node]) -> str:
        parts = []
        for node in nodes:
            if isinstance(node, str):
                parts.append("'" + node.replace("'", "''") + "'")
                continue
            kind, name, inner = node
            value = f"nullif(CAST({get(name)} AS VARCHAR), '')"
            if kind == "value":
                parts.append(f"coalesce({value}, {build(inner)})")
            else:
                parts.append(f"CASE WHEN {value} IS {'NOT NULL' if kind == 'given' else 'NULL'} THEN {build(inner)} ELSE '' END")
        return "(" + " || ".join(parts) + ")" if parts else "''"

    return build(parsed(wording))


def lined(lines: list[str], fields: Mapping[str, Column]) -> Column:
    """The lines as one text. A line that begins with ``?`` is only there if all fields it names are given."""
    none = F.lit(None).cast("string")
    out = []
    for line in lines:
        text = worded(line.lstrip("?"), fields)
        names = [n[1] for n in parsed(line.lstrip("?")) if isinstance(n, tuple) and n[0] == "value"] if line.startswith("?") else []
        for name in names:
            given = filled(fields[name].cast("string")).isNotNull() if name in fields else F.lit(False)
            text = F.when(given, text).otherwise(none)
        out.append(text)
    return F.concat_ws("\n", *out)


def lined_sql(lines: list[str], get: Callable[[str], str]) -> str:
    out = []
    for line in lines:
        text = worded_sql(line.lstrip("?"), get)
        names = [n[1] for n in parsed(line.lstrip("?")) if isinstance(n, tuple) and n[0] == "value"] if line.startswith("?") else []
        for name in names:
            text = f"CASE WHEN nullif(CAST({get(name)} AS VARCHAR), '') IS NOT NULL THEN {text} END"
        out.append(text)
    return f"concat_ws(chr(10), {', '.join(out)})"
