"""Oversized texts cut into balanced, overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, REACH = 6144, 1024, 400
#: Boundaries by falling strength; a cut goes behind the match.
BOUNDARIES = [re.compile(p) for p in (r"\n\n\s*", r"\n\s*", r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]", r"[;:,]\s+|[、，；]", r"\s+")]
MARKS = re.compile(r"[̀-ͯ︀-️‍​]")


def cleaned(col: Column) -> Column:
    """CRLF and CR as LF, three or more LF as two, outer white space stripped."""
    lines = F.regexp_replace(F.regexp_replace(col, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"(?U)^[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+$", "")


def boundary(text: str, target: int, low: int, high: int) -> int | None:
    """The strongest boundary in (low, high], of equals the nearest to ``target``."""
    window = text[low:high]
    for pattern in BOUNDARIES:
        places = [low + m.end() for m in pattern.finditer(window) if low < low + m.end()]
        if places:
            return min(places, key=lambda p: (abs(p - target), p))
    return None


def snap(text: str, target: int, low: int, high: int) -> int:
    """The boundary in (low, high]; without any, a place between characters."""
    place = boundary(text, target, low, high)
    if place is not None:
        return place
    place = min(max(target, low + 1), high)
    while place > low + 1 and MARKS.match(text, place):  # a mark stays with its letter
        place -= 1
    return place


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int]]:
    """Spans of the pieces: none longer than ``limit``, consecutive ones overlapping by up to ``overlap``, all text covered.

    The least number of pieces is computed and targets are set at equal lengths; each is moved to the strongest boundary
    within ``reach``, and the targets of what remains are set again from there. Without any, the reach is doubled up to the
    last cut and the limit, and only a stretch without boundary is cut between characters. Where the rest would no longer
    fit into the pieces that are left, a piece is added.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    least = lambda chars: max(1, -(-(chars - overlap) // (limit - overlap)))
    spans, start, done, pieces = [], 0, 0, least(n)
    while n - start > limit:
        pieces = max(pieces, least(n - start))
        target = start + round((n - start + (pieces - 1) * overlap) / pieces)
        end, near = None, reach
        while end is None:
            high = min(max(target + near, done + 1), start + limit, n - 1)
            low = min(max(target - near, done), high - 1)
            if low == done and high == min(start + limit, n - 1):  # all that a cut may take
                end = snap(text, target, low, high)
            else:
                end = boundary(text, target, low, high)
            near = 2 * near + 1
        spans.append((start, end))
        begin = max(end - overlap, start + 1)
        places = [begin + m.end() for b in BOUNDARIES[:3] for m in b.finditer(text[begin:end]) if begin + m.end() < end]
        start, done, pieces = min(places) if places else snap(text, begin, begin - 1, end) if begin < end else end, end, pieces - 1
    return [*spans, (start, n)]


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> DataFrame:
    """The pieces of each text: ``item_id``, ``chunk_index`` (from 0), ``n_pieces``, ``start``, ``end``, ``item_chars``, ``text``.

    Texts are cleaned first; ``start`` and ``end`` count characters of the cleaned text, and so does ``limit``. Texts
    within the limit are one piece; null and blank texts give none. Rows are taken as they come, without a shuffle;
    repeats of ``id_col`` give repeated pieces. Other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["item_id", "chunk_index", "n_pieces", "start", "end", "item_chars", "text"], [pa.string(), pa.int32(), pa.int32(), pa.int64(),
            pa.int64(), pa.int64(), pa.string()]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            rows, size = [], 0
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                spans = split_text(text, limit, overlap, reach) if text else []
                for i, (a, z) in enumerate(spans):
                    rows.append((item, i, len(spans), a, z, len(text), text[a:z]))
                    size += z - a
                if size > 8 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    schema = "item_id string, chunk_index int, n_pieces int, start bigint, end bigint, item_chars bigint, text string"
    return df.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), cleaned(F.col(f"`{text_col}`").cast("string"))
        .alias("text")).filter("text <> ''").mapInArrow(run, schema)
