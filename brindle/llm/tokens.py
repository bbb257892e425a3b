"""Encoding of texts with a public byte-level tokenizer, by fragments between forced boundaries."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a batch are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20
#: Fragments that a worker remembers.
REMEMBERED = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class FragmentEncoder:
    """Encodes fragments of texts independently.

    A byte pair that occurs inside no token can never be bridged by a merge, so a text may be cut there and the ids of
    its fragments joined. The tokenizer's word pattern must find the same words in the fragments: it looks ahead only in
    runs of white space and treats an apostrophe with what follows it specially, so there is no cut after white space nor
    before an apostrophe, and none inside a character.
    """

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        bridged = np.zeros((256, 256), bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8)
            bridged[t[:-1], t[1:]] = True
        self.never = ~bridged
        self.never[:, 0x27] = False
        self.never[:, 0x80:0xC0] = False
        self.never[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        self.known: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions before which the bytes may be cut."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        cut = self.never[b[:-1], b[1:]]
        wide = np.zeros(len(b), bool)  # last bytes of white space outside ASCII
        wide[1:] |= (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
        if len(b) > 2:
            x, y, z = b[:-2], b[1:-1], b[2:]
            wide[2:] |= (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F)
            wide[2:] |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        return np.flatnonzero(cut & ~wide[:-1]) + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, Iterator[int]]:
        """(number of ids of each text, ids of all texts in order); null texts have none."""
        raw = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = bytes(raw.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        starts = np.union1d(self.cuts(np.frombuffer(data, np.uint8)), bounds[:-1][bounds[:-1] < bounds[1:]])
        ends = np.append(starts[1:], len(data))[: len(starts)].tolist()
        pieces = [data[a:z] for a, z in zip(starts.tolist(), ends)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for piece in {p for p in pieces if p not in known}:
            known[piece] = tuple(self.encoding.encode_ordinary(piece.decode("utf-8")))
        found = [known[p] for p in pieces]
        size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        at = np.searchsorted(starts, bounds)
        return size[at[1:]] - size[at[:-1]], chain.from_iterable(found)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    rows, size = batch.num_rows, max(1, batch.column(column).nbytes)
    step = max(1, int(rows * SLICE_BYTES / size)) if size > SLICE_BYTES else max(1, rows)
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def _over_texts(df: DataFrame, text_col: str, tokenizer: str | None, name: str, kind: pa.DataType, column: Callable) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or default_tokenizer(), "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: under 1 MB whatever the data
    pattern, keep = public_tokenizers.PATTERN, [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = FragmentEncoder(ranks.value, pattern)
        for batch in batches:
            for part in _slices(batch, len(keep)):
                sizes, ids = encoder.encode(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column(sizes, ids)], [*keep, name])

    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast({"list<element: int32>": "array<int>"}.get(str(kind), "bigint"))
        .alias(name)).schema
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text_col: str, tokenizer: str | None = None, name: str = "ids") -> DataFrame:
    """The columns of ``df`` without ``text_col``, and ``ids``: the text's tokens, without special tokens.

    ``tokenizer`` is the path of a file of byte-pair ranks. Null and empty texts give an empty list. Strings of special
    tokens in a text are ordinary text. Whole texts are encoded, however long; no shuffle. A column called ``name`` is
    replaced.
    """
    df = df.drop(name) if name != text_col else df
    lists = lambda sizes, ids: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
        pa.array(np.fromiter(ids, np.int32, int(sizes.sum()))))
    return _over_texts(df, text_col, tokenizer, name, pa.list_(pa.field("element", pa.int32())), lists)


def count_tokens(df: DataFrame, text_col: str, tokenizer: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The columns of ``df`` without ``text_col``, and ``n_tokens``: how many tokens the text has; null and empty have 0."""
    df = df.drop(name) if name != text_col else df
    return _over_texts(df, text_col, tokenizer, name, pa.int64(), lambda sizes, ids: pa.array(sizes, pa.int64()))
