"""Texts as ordered chunks: by characters, by tokens, by provisions, by headings and by paragraphs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters and tokens, and how far a cut may move.
CHARS, CHAR_OVERLAP, MOVE = 6144, 1024, 200
TOKENS, TOKEN_OVERLAP = 1536, 256
# The headings that divide a bill, as multi-line patterns.
BILL_HEADINGS = [(r"^(PART\s+\d+(?:\s+.+)?)\s*$", "PART"), (r"^(DIVISION\s+\d+(?:\s+.+)?)\s*$", "DIVISION"),
    (r"(?i)^(SCHEDULE\s*\d*)\s*$", "SCHEDULE"), (r"^(SUMMARY)\s*$", "SUMMARY"), (r"^(RECOMMENDATION)\s*$", "RECOMMENDATION"),
    (r"^(TABLE OF PROVISIONS)\s*$", "TABLE"), (r"^(SHORT TITLE)\s*$", "SHORT_TITLE"), (r"^(INTERPRETATION)\s*$", "INTERPRETATION")]
MARKER = re.compile(r"(?:^|\s)(\(\d+\)|\([a-z]\)|\([ivxlcdm]+\)|\([A-Z]\))(?=\s|[A-Z])")
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
_ENDS = re.compile(r"[.!?]\s")


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n")).strip()


def by_chars(text: str, size: int = CHARS, overlap: int = CHAR_OVERLAP) -> list[str]:
    """A text of up to ``size`` characters whole; else windows of about that length. An end moves behind the mark of the last
    sentence end within 200 of it, the next window begins ``overlap`` before it. A last window longer than the overlap is
    followed by its tail."""
    text, out, start = tidy(text), [], 0
    if len(text) <= size:
        return [text] if text else []
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            marks = [m.start() + 1 for m in _ENDS.finditer(text, max(start, end - MOVE), min(len(text), end + MOVE))]
            end = marks[-1] if marks else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end - overlap <= start:
            break
        start = end - overlap
    return out


def estimate(text: str) -> int:
    return -(-len(text) // 4)


class _Packer:
    """Collects pieces up to a budget of tokens; a new chunk begins with the last pieces that fit the overlap."""

    def __init__(self, most: int, overlap: int):
        self.most, self.overlap, self.out, self.pieces, self.used = most, overlap, [], [], 0

    def close(self, keep: bool = False) -> None:
        if self.pieces:
            self.out.append(" ".join(p for p, _ in self.pieces).strip())
        tail: list[tuple[str, int]] = []
        for p in reversed(self.pieces if keep else []):
            if sum(n for _, n in tail) + p[1] > self.overlap:
                break
            tail.insert(0, p)
        self.pieces, self.used = tail, sum(n for _, n in tail)

    def add(self, piece: str, tokens: int) -> None:
        if self.used + tokens > self.most and self.pieces:
            self.close(keep=True)
        self.pieces.append((piece, tokens))
        self.used += tokens


def packed(units: list[str], most: int, overlap: int, count: Callable[[str], int], whole_rest: bool = False) -> list[str]:
    """Units packed into chunks of ``most`` tokens; a unit beyond that is cut by words. What its last cut leaves counts as
    one unit in the next overlap if ``whole_rest``, else word by word."""
    box = _Packer(most, overlap)
    for unit in units:
        if (tokens := count(unit)) > most:
            box.close()
            for word in unit.split():
                box.add(word, count(word + " "))
            if whole_rest and box.pieces:
                box.pieces = [(" ".join(p for p, _ in box.pieces), box.used)]
        else:
            box.add(unit, tokens)
    box.close()
    return box.out


def by_tokens(text: str, most: int = TOKENS, overlap: int = TOKEN_OVERLAP, count: Callable[[str], int] = estimate) -> list[str]:
    text = tidy(text)
    if not text or count(text) <= most:
        return [text] if text else []
    return packed([s for s in _SENTENCE_GAP.split(text) if s.strip()], most, overlap, count)


def kind_of_marker(marker: str) -> str | None:
    inner = marker[1:-1]
    if inner.isdigit():
        return "subsection"
    if re.fullmatch(r"(?i)[ivx]{2,}|[ivx]", inner):
        return "subparagraph"
    return "paragraph" if re.fullmatch("[a-z]", inner) else "clause" if re.fullmatch("[A-Z]", inner) else None


class Unit(NamedTuple):
    content: str
    kind: str | None
    marker: str | None


def legal_units(text: str) -> list[Unit]:
    """The text before the first marker, then one unit from each marker to the next."""
    marks = [(m.start(1), m.group(1)) for m in MARKER.finditer(text)]
    edges = [0, *[at for at, _ in marks], len(text)]
    parts = [text[a:z].strip() for a, z in zip(edges, edges[1:])]
    units = [Unit(parts[0], None, None)] if parts[0] or not marks else []
    return units + [Unit(p, kind_of_marker(m), m) for p, (_, m) in zip(parts[1:], marks) if p]


def history(notes: list[dict], lang: str = "en") -> str:
    """Historical notes as one closing paragraph; dates follow a note whose text does not give them."""
    label, enacted, in_force = ("Historique", "édicté", "en vigueur") if lang == "fr" else ("History", "enacted", "in force")
    parts = []
    for note in notes:
        text, made, held = note["text"], note.get("enactedDate"), note.get("inForceStartDate")
        told = f" ({enacted}: {made})" if made and made not in text else ""
        parts.append(text + told + (f" ({in_force}: {held})" if held and held != made and held not in text else ""))
    return f"\n\n{label}: {'; '.join(parts)}" if parts else ""


def legal_chunks(text: str, most: int = TOKENS, overlap: int = TOKEN_OVERLAP, prefix: str = "", count: Callable[[str], int] = estimate) -> list[str]:
    """A provision whole if it fits with its ``prefix``; else packed into chunks, cut at markers where possible, each headed by
    the prefix (10 tokens are kept free)."""
    if not text.strip():
        return []
    if count(prefix + text) <= most:
        return [prefix + text]
    room, text = most - (count(prefix) + 10 if prefix else 0), tidy(text)
    body = [text] if count(text) <= room else packed([u.content for u in legal_units(text)], room, overlap, count, whole_rest=True)
    return [prefix + b for b in body]


def headed(parts: list[str]) -> str:
    """The parts that are given as one heading line and a blank one."""
    return " | ".join(p for p in parts if p) + "\n\n" if any(parts) else ""


def _under(header: str, text: str, size: int, overlap: int) -> list[str]:
    return [header + text] if len(header) + len(text) <= size else [header + c for c in by_chars(text, size - len(header), overlap)]


def bill_chunks(text: str, parts: tuple[str, ...] = (), size: int = CHARS, overlap: int = CHAR_OVERLAP) -> list[str]:
    """Sections at a bill's headings, the text before them if it is over 100 characters; long sections by characters. Every
    chunk is headed by ``parts`` and the section's heading line, ``PREAMBLE`` for the text before."""
    if not text.strip():
        return []
    text = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n"))
    marks = sorted((m.start(), m.group(1).strip()) for pattern, _ in BILL_HEADINGS for m in re.finditer(pattern, text, re.MULTILINE))
    if not marks:
        return _under(headed([*parts]), text, size, overlap)
    sections = [("PREAMBLE", text[: marks[0][0]])] if marks[0][0] > 100 else []
    sections += [(name, text[at:end]) for (at, name), (end, _) in zip(marks, [*marks[1:], (len(text), "")])]
    return [c for name, body in sections if body.strip() for c in _under(headed([*parts, name]), body.strip(), size, overlap)]


def with_header(text: str, header: str, size: int = CHARS, overlap: int = CHAR_OVERLAP) -> list[str]:
    """Chunks by characters, each headed; the header counts towards the size."""
    whole = tidy(text)
    return _under(headed([header]), whole, size, overlap) if whole else []


def paragraph_chunks(text: str, parts: tuple[str, ...] = (), size: int = CHARS, overlap: int = CHAR_OVERLAP) -> list[str]:
    """A speech without its tags (those of paragraphs are line ends) whole if it fits with its heading, else its paragraphs
    packed up to the size; a longer paragraph, or a speech of only one, by characters. Nothing but tags gives nothing."""
    plain = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n"))
    plain, header = re.sub("<[^>]+>", "", re.sub(r"</?p>", "\n", plain)).strip(), headed([*parts])
    paragraphs = [p.strip() for p in re.split(r"\n\n+", plain) if p.strip()]
    if not plain or len(paragraphs) < 2 or len(header) + len(plain) <= size:
        return _under(header, plain, size, overlap) if plain else []
    room, out, held = size - len(header), [], ""
    for p in paragraphs:
        if held and (len(held) + len(p) + 2 > room or len(p) > room):
            out, held = [*out, held], ""
        if len(p) > room:
            out += by_chars(p, room, overlap)
        else:
            held = f"{held}\n\n{p}" if held else p
    return [header + c for c in ([*out, held] if held else out)]


def chunk_rows(df: DataFrame, id_col: str, text_col: str, chunk: Callable[[str], list]) -> DataFrame:
    """``item_id``, ``chunk_index``, ``content``, ``kind``, ``marker`` of the chunks of each text; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(chunk(text) if text else []):
                    unit = c if isinstance(c, Unit) else Unit(c, None, None)
                    rows.append((item, i, *unit))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols,
                (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["item_id", "chunk_index", "content", "kind", "marker"])

    return df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run,
        "item_id bigint, chunk_index int, content string, kind string, marker string")
