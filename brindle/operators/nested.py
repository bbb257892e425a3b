"""Nested JSON columns as linked flat tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrow import byte_slices, gathered
from brindle.functions.json_index import Elements, Values


class Path(NamedTuple):
    """Where an item's array lies: members from the column's value down, and the item name; ``inner`` are arrays in its elements."""

    item: str
    column: str
    members: tuple[str, ...] = ()
    inner: tuple[tuple[str, str], ...] = ()  # (item, member) pairs


#: Bytes of texts that are indexed together; a task's memory is a small multiple of them, or of its longest text.
SLICE_BYTES = 2 << 20
NAMES = ["parent_id", "item", "outer_pos", "pos", "element"]
SCHEMA = "parent_id string, item string, outer_pos int, pos int, element string"


def flatten_nested(df: DataFrame, id_col: str, paths: list[Path], with_text: bool = True) -> DataFrame:
    """One row per object in the arrays that ``paths`` name, for each row of ``df``.

    Result: ``parent_id``, ``item``, ``outer_pos`` (place of the outer element for arrays within elements, else -1),
    ``pos`` (from 0, elements that are no objects keep their place) and ``element`` (the object's JSON text, null unless
    ``with_text``).

    The texts of a batch are indexed together, in slices of about ``SLICE_BYTES``: bitmaps of quotes, brackets and delimiters, depths by prefix sums, then
    spans. Strings that hold JSON count as that JSON down to the array; an object in place of an array is an array of one.
    Null, empty and unreadable texts, and other values than these, give no row. Rows are taken as they come: repeats of
    ``id_col`` give repeated rows. Other columns are not read.
    """
    columns = list(dict.fromkeys(p.column for p in paths))
    names = [f"_c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, [i + 1 for i in range(len(columns))], SLICE_BYTES):
                out: list[pa.RecordBatch] = []

                def add(item: str, found: Elements, outer: bool) -> None:
                    for index, rows, place, pos, tokens in found.parts:
                        n = len(rows)
                        text = gathered(index.data, index.start[tokens], index.end[tokens]) if with_text else pa.nulls(n, pa.large_string())
                        columns = [batch.column(0).take(pa.array(rows)), pa.array([item] * n, pa.string()),
                            pa.array(place if outer else np.full(n, -1), pa.int32()), pa.array(pos, pa.int32()), text]  # noqa: B023
                        out.append(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns[:2]] + columns[2:4] + [text.cast(pa.string())],
                            NAMES))  # noqa: B023

                tops = {c: Values.parse(batch.column(i + 1).to_pylist()) for i, c in enumerate(columns)}
                for path in paths:
                    values = tops[path.column]
                    for name in path.members:
                        values = values.member(name)
                    found = values.elements()
                    add(path.item, found, False)
                    for item, name in path.inner:
                        add(item, found.values().member(name).elements(), True)
                yield from out

    picked = df.select(F.col(f"`{id_col}`").cast("string").alias("_id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(columns, names)])
    return picked.mapInArrow(run, SCHEMA)


def element_fields(flat: DataFrame, item: str, schema: str) -> DataFrame:
    """The rows of one ``item`` with the members of ``schema`` as columns; absent members are null."""
    return flat.filter(F.col("item") == item).select("parent_id", "outer_pos", "pos", F.from_json("element", schema).alias("_e")).select("parent_id",
        "outer_pos", "pos", "_e.*")
