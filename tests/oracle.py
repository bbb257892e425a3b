"""Comparison of a Spark query with its DuckDB SQL over the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    """A value in a form in which equal results of both engines are equal."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value.isoformat() if isinstance(value, dt.date) else value


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, base: str, query, sql: str) -> str:
    """Empty if the results agree."""
    df = query(spark, base)
    mine = table(df.columns, df.collect())
    with duckdb.connect() as con:
        for path in Path(base).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        con.execute("SET TimeZone = 'UTC'")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        other = table(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != other:
        a, b = set(mine), set(other)
        return f"{len(mine)} and {len(other)} rows; only here {sorted(a - b, key=repr)[:3]}; only there {sorted(b - a, key=repr)[:3]}"
    return ""
