"""Sentence alignment of rough translations by length-based dynamic programming."""

from __future__ import annotations

import gc
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beads: sentences taken on the left and right, and their cost besides lengths and shared words; the last one crosses.
BEADS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (2, 2))
PRIOR = np.array([0.1, 2.8, 3.0, 3.2, 3.0, 5.5, 3.4])
#: Variance of a length per character; greatest cost of a length; cost of a number without its like; weight of shared words.
VARIANCE, FARTHEST, NUMBER, SHARED = 8.0, 6.0, 1.6, 0.55
#: Sentences on a side of one tile of the table of costs.
WINDOW = 600
#: Documents of up to so many sentences a side are aligned together, over tables of so many cells in all.
SMALL, CELLS = 160, 60_000
#: Evidence that sentences left over by the path need to be paired out of order.
MOVED = 2.5

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NUMBER = re.compile(r"\d+(?:[.,   ]\d+)*")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DIGIT, _NO_DIGIT = re.compile(r"\d"), re.compile(r"\D")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


class _Stems(dict):
    """Raw tokens to the anchors among their words: the first five letters without accents, or short names whole."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        found = self[raw] = tuple(s for w in _WORD.findall(raw) if (s := self.stem(w)))
        return found

    @staticmethod
    def stem(word: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()
        return plain if word[0].isupper() and len(plain) <= 5 else plain[:5] if len(plain) >= 5 else ""


_stems = _Stems()


def _anchors(sentence: str) -> tuple[set[str], set[str]]:
    numbers = {_NO_DIGIT.sub("", n) for n in _NUMBER.findall(sentence)} if _DIGIT.search(sentence) else set()
    return numbers, set(chain.from_iterable(map(_stems.__getitem__, sentence.split())))


def _weights(left: list[set[str]], right: list[set[str]]) -> dict[str, float]:
    """The weight of each anchor that both sides have, over the whole document (rare ones weigh more)."""
    a, b = (Counter(chain.from_iterable(rows)) for rows in (left, right))
    cells = len(left) * len(right)
    return {x: min(max(log1p(cells / (n * b[x])), 0.2), 4.0) for x, n in a.items() if x in b}


def _shared(left: list[set[str]], right: list[set[str]], weights: dict[str, float] | None) -> np.ndarray:
    """For each pair of sentences, how many anchors they share, or how much those weigh."""
    ids: dict[str, int] = {}
    common = set().union(*left) & set().union(*right)
    a, b = np.zeros((len(left), len(common))), np.zeros((len(right), len(common)))
    for table, rows in ((a, left), (b, right)):
        for i, anchors in enumerate(rows):
            for x in anchors & common:
                table[i, ids.setdefault(x, len(ids))] = 1
    if weights and common:
        a *= np.array([weights[x] for x in ids])
    return a @ b.T


def _length_cost(x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    """Minus the log likelihood of length ``y`` as the rendering of ``x``, with a floor for outliers."""
    delta = (y - x * ratio) / np.sqrt(VARIANCE * (x * ratio + y) / 2 + 1e-9)
    return np.minimum(delta * delta / 2, FARTHEST)


def _costs(x: np.ndarray, y: np.ndarray, lack_a: np.ndarray, lack_b: np.ndarray, fit: np.ndarray, ratio: float) -> np.ndarray:
    """The cost of each bead by the last sentences that it takes: (bead, left, right, document), two rows and columns before
    the first. Lengths and numbers of sentences are (sentence, document), ``fit`` is (left, right, document)."""
    n, m = len(x), len(y)
    cost = np.full((len(BEADS), n + 3, m + 3, x.shape[1]), np.inf)
    at = lambda k, i, j: cost[k, 2 + i :, 2 + j :][: n + 1 - i, : m + 1 - j]
    at(0, 1, 1)[:] = PRIOR[0] + _length_cost(x[:, None], y[None, :], ratio) - (fit - NUMBER * (lack_a[:, None] + lack_b[None, :]))
    at(1, 1, 0)[:] = PRIOR[1]
    at(2, 0, 1)[:] = PRIOR[2]
    pair_x, pair_y = x[:-1] + x[1:], y[:-1] + y[1:]
    rows = fit[:-1] + fit[1:] - NUMBER * (lack_a[:-1] + lack_a[1:])[:, None]
    if n > 1:
        at(3, 2, 1)[:] = PRIOR[3] + _length_cost(pair_x[:, None], y[None, :], ratio) - (rows - NUMBER * lack_b[None, :])
    if m > 1:
        at(4, 1, 2)[:] = PRIOR[4] + _length_cost(x[:, None], pair_y[None, :], ratio) - (fit[:, :-1]
            + fit[:, 1:] - NUMBER * (lack_a[:, None] + (lack_b[:-1] + lack_b[1:])[None, :]))
    if n > 1 and m > 1:
        at(5, 2, 2)[:] = PRIOR[5] + _length_cost(pair_x[:, None], pair_y[None, :], ratio) - (rows[:, :-1]
            + rows[:, 1:] - NUMBER * (lack_b[:-1] + lack_b[1:])[None, :])
        single = cost[0, 3:, 3:]
        at(6, 2, 2)[:] = PRIOR[6] + single[:-1, 1:] + single[1:, :-1]
    return cost


def _sweep(cost: np.ndarray, table: np.ndarray, top: int, edge: int) -> np.ndarray:
    """Fills ``table`` (left, right, document) with the cheapest totals, diagonal by diagonal, from row ``top`` and column
    ``edge`` on; gives the best bead of each cell."""
    n, m, docs, width = table.shape[0] - 3, table.shape[1] - 3, table.shape[2], table.shape[1]
    flat, total, came = cost.reshape(len(BEADS), -1, docs), table.reshape(-1, docs), np.zeros((table.shape[0] * width, docs), np.int8)
    back = np.array([a * width + b for a, b in BEADS])[:, None]
    for k in range(top + edge or 1, n + m + 1):
        i = np.arange(max(top, k - m), min(n, k - edge) + 1)
        cell = (i + 2) * width + (k - i + 2)
        reach = total[cell[None, :] - back] + flat[:, cell]
        came[cell], total[cell] = reach.argmin(0), reach.min(0)
    return came.reshape(table.shape)


class _Document:
    """Lengths and anchors of both sides, and the table of the cheapest totals in tiles of ``WINDOW`` by ``WINDOW`` cells."""

    def __init__(self, left: list[str], right: list[str], ratio: float):
        self.n, self.m, self.ratio = len(left), len(right), ratio
        self.x, self.y = np.array([len(s.strip()) for s in left], float), np.array([len(s.strip()) for s in right], float)
        (self.num_a, self.word_a), (self.num_b, self.word_b) = zip(*map(_anchors, left)), zip(*map(_anchors, right))
        self.lack_a, self.lack_b = np.array([len(s) for s in self.num_a], float), np.array([len(s) for s in self.num_b], float)
        self.words, self.numbers = _weights(self.word_a, self.word_b), _weights(self.num_a, self.num_b)
        # totals of the last two rows of cells of each row of tiles, and of the last two columns of each column of tiles
        self.below, self.beside = {}, {}

    def shares(self) -> tuple[list[int], list[int], list[float]]:
        """What each pair of sentences shares: left, right and weight of every anchor that both have."""
        left, right, weight = [], [], []
        for rows_a, rows_b, known, scale, more in ((self.word_a, self.word_b, self.words, SHARED, 0.0),
            (self.num_a, self.num_b, self.numbers, 1.5 * SHARED, 2 * NUMBER)):
            places: dict[str, list[int]] = {x: [] for x in known}
            for j, anchors in enumerate(rows_b):
                for x in anchors:
                    if x in places:
                        places[x].append(j)
            for i, anchors in enumerate(rows_a):
                for x in anchors:
                    if at := places.get(x):
                        left += [i] * len(at)
                        right += at
                        weight += [scale * known[x] + more] * len(at)
        return left, right, weight

    def tile(self, r: int, c: int) -> tuple[np.ndarray, int, int]:
        """The best bead of each cell of tile (r, c), after the tiles above and before it; and the cell at its corner.

        A cell (i, j) stands for i sentences taken on the left and j on the right. The first two rows and columns of a tile
        behind others are cells of those; their totals are copied.
        """
        i0, j0 = max(0, r * WINDOW - 1), max(0, c * WINDOW - 1)
        i1, j1 = min(self.n, (r + 1) * WINDOW), min(self.m, (c + 1) * WINDOW)
        p, q = slice(i0, i1), slice(j0, j1)
        same = _shared(self.num_a[p], self.num_b[q], None)
        fit = SHARED * (_shared(self.word_a[p], self.word_b[q], self.words)
            + 1.5 * _shared(self.num_a[p], self.num_b[q], self.numbers)) + 2 * NUMBER * same
        cost = _costs(self.x[p, None], self.y[q, None], self.lack_a[p, None], self.lack_b[q, None], fit[:, :, None], self.ratio)
        table = np.full((i1 - i0 + 3, j1 - j0 + 3, 1), np.inf)
        if r:
            table[2:4, 2:, 0] = self.below[r - 1][:, j0 : j1 + 1]
        if c:
            table[2:, 2:4, 0] = self.beside[c - 1][i0 : i1 + 1]
        if not r and not c:
            table[2, 2] = 0
        came = _sweep(cost, table, 2 * bool(r), 2 * bool(c))
        self.below.setdefault(r, np.full((2, self.m + 1), np.inf))[:, j0 : j1 + 1] = table[-2:, 2:, 0]
        self.beside.setdefault(c, np.full((self.n + 1, 2), np.inf))[i0 : i1 + 1] = table[2:, -2:, 0]
        return came[2:, 2:, 0], i0, j0

    def path(self) -> list[tuple[int, int]]:
        """Pairs on the cheapest path of beads. Only the tiles that it passes are held again, one at a time."""
        own = lambda k: max(0, k - 1) // WINDOW
        for r in range(own(self.n) + 1):
            for c in range(own(self.m) + 1):
                held = (r, c), self.tile(r, c)

        def bead(i: int, j: int) -> int:
            nonlocal held
            if held[0] != (own(i), own(j)):
                held = (own(i), own(j)), self.tile(own(i), own(j))
            came, i0, j0 = held[1]
            return int(came[i - i0, j - j0])

        return _traced(self.n, self.m, bead)

    def moved(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Pairs of sentences that ``pairs`` leave over, greatest gain first, looked up by shared anchors."""
        free_a, free_b = sorted(set(range(self.n)) - {i for i, _ in pairs}), np.array(sorted(set(range(self.m)) - {j for _, j in pairs}), int)
        if not free_a or not len(free_b):
            return []
        y, lack = self.y[free_b], self.lack_b[free_b]
        places: list[dict[str, list[int]]] = [{}, {}]
        for index, known, rows in zip(places, (self.words, self.numbers), (self.word_b, self.num_b)):
            for q, j in enumerate(free_b):
                for anchor in rows[j] & known.keys():
                    index.setdefault(anchor, []).append(q)
        open_, queue = np.ones(len(free_b), bool), []

        def put(p: int) -> None:
            i, fit = free_a[p], np.zeros(len(free_b))
            for anchor in sorted(self.word_a[i] & places[0].keys()):
                fit[places[0][anchor]] += SHARED * self.words[anchor]
            for anchor in sorted(self.num_a[i] & places[1].keys()):
                fit[places[1][anchor]] += 1.5 * SHARED * self.numbers[anchor] + 2 * NUMBER
            gain = np.where(open_, fit - NUMBER * (self.lack_a[i] + lack) - _length_cost(self.x[i], y, self.ratio), -np.inf)
            q = int(gain.argmax())
            if gain[q] > MOVED:
                heapq.heappush(queue, (-gain[q], p, q))

        for p in range(len(free_a)):
            put(p)
        found = []
        while queue:
            _, p, q = heapq.heappop(queue)
            if open_[q]:
                open_[q] = False
                found.append((free_a[p], int(free_b[q])))
            else:
                put(p)
        return found


def _traced(i: int, j: int, bead: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The pairs on the way back from cell (i, j) by the best bead of each."""
    pairs = []
    while i or j:
        kind = bead(i, j)
        a, b = BEADS[kind]
        i, j = i - a, j - b
        if kind == 6:
            pairs += [(i, j + 1), (i + 1, j)]
        elif kind == 5:
            pairs += [(i, j), (i + 1, j + 1)]
        else:
            pairs += [(i + p, j + q) for p in range(a) for q in range(b)]
    return pairs


def _paths(docs: list[_Document], ratio: float) -> list[list[tuple[int, int]]]:
    """The cheapest path of each of some small documents, over one table with a layer a document."""
    n, m, count = max(d.n for d in docs), max(d.m for d in docs), len(docs)
    x, y, lack_a, lack_b = (np.zeros((size, count)) for size in (n, m, n, m))
    for k, d in enumerate(docs):
        x[: d.n, k], y[: d.m, k], lack_a[: d.n, k], lack_b[: d.m, k] = d.x, d.y, d.lack_a, d.lack_b
    shares = [d.shares() for d in docs]
    layer = np.repeat(np.arange(count), [len(w) for _, _, w in shares])
    left, right, weight = (np.fromiter(chain.from_iterable(s[part] for s in shares), float, len(layer)) for part in range(3))
    fit = np.bincount(((left * m + right) * count + layer).astype(np.int64), weight, n * m * count).reshape(n, m, count)
    table = np.full((n + 3, m + 3, count), np.inf)
    table[2, 2] = 0
    came = _sweep(_costs(x, y, lack_a, lack_b, fit, ratio), table, 0, 0)
    out = []
    for k, d in enumerate(docs):
        own = came[2 : d.n + 3, 2 : d.m + 3, k].tolist()
        out.append(_traced(d.n, d.m, lambda i, j: own[i][j]))  # noqa: B023
    return out


def align_all(texts: list[tuple[list[str], list[str]]], ratio: float) -> list[list[tuple[int, int, bool]]]:
    """For each document (sentences of the left, of the right): the pairs that translate one another, and whether a pair was
    found out of order, off the path.

    The cheapest path of beads over the whole document, then sentences left over anywhere in it, paired out of order. Small
    documents are laid on one another in tables of up to ``CELLS`` cells, others have their own, computed in tiles of
    ``WINDOW`` sentences a side, of which only the edges are kept, and tiles are computed again on the way back. The result
    depends on none of these.
    """
    docs = {k: _Document(a, b, ratio) for k, (a, b) in enumerate(texts) if a and b}
    paths = {k: d.path() for k, d in docs.items() if max(d.n, d.m) > SMALL}
    size = lambda k: (max(docs[k].n, docs[k].m), min(docs[k].n, docs[k].m))
    group: list[int] = []
    for k in sorted(docs.keys() - paths.keys(), key=size):
        if group and (len(group) + 1) * (size(k)[0] + 3) ** 2 > CELLS:
            paths |= zip(group, _paths([docs[g] for g in group], ratio))
            group = []
        group.append(k)
    if group:
        paths |= zip(group, _paths([docs[g] for g in group], ratio))
    moved = {k: docs[k].moved(path) for k, path in paths.items()}
    return [sorted([(i, j, False) for i, j in paths[k]] + [(i, j, True) for i, j in moved[k]]) if k in docs else [] for k in range(len(texts))]


def align(left: list[str], right: list[str], ratio: float) -> list[tuple[int, int]]:
    """The pairs of one document."""
    return [(i, j) for i, j, _ in align_all([(left, right)], ratio)[0]]


def length_ratio(df: DataFrame, left: str, right: str) -> float:
    """Characters of ``right`` to one of ``left``, over all rows that have both; 1 if there are none."""
    r = df.filter(f"trim(`{left}`) <> '' and trim(`{right}`) <> ''").agg(F.sum(F.length(left)).alias("a"), F.sum(F.length(right)).alias("b")).first()
    return r["b"] / r["a"] if r["a"] else 1.0


def _aligner(keys: int, ratio: float, split: bool):
    filled = lambda row: [i for i, s in enumerate(row) if s and s.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the many sets of anchors form no cycles, but would be searched for them again and again
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = list(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist()))
                    if split:
                        found = align_all([(sentences(a), sentences(b)) for a, b in texts], ratio)
                    else:  # the places of blank sentences are kept
                        places = [(filled(a), filled(b)) for a, b in texts]
                        pairs = align_all([([a[i] for i in p], [b[j] for j in q]) for (a, b), (p, q) in zip(texts, places)], ratio)
                        found = [[(p[i], q[j], moved) for i, j, moved in own] for own, (p, q) in zip(pairs, places)]
                    rows = pa.array(np.repeat(np.arange(len(found)), [len(own) for own in found]))
                    lefts, rights = (pa.array([pair[side] for own in found for pair in own], pa.int32()) for side in (0, 1))
                    moved = pa.array([pair[2] for own in found for pair in own], pa.bool_())
                    columns = [*[batch.column(k).take(rows) for k in range(keys)], lefts, rights, moved]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:keys], "en_pos", "fr_pos", "_moved"])
        finally:  # the worker serves other tasks too
            gc.enable()

    return run


def align_documents(df: DataFrame, keys: list[str], left: str, right: str, ratio: float | None = None, moved: str | None = None) -> DataFrame:
    """``keys``, ``en_pos``, ``fr_pos``: the sentences of texts ``left`` and ``right`` that translate one another. With a name
    for it, a column ``moved`` tells pairs found out of order from those on the path.

    ``left`` and ``right`` are texts, split at white space after a full stop, exclamation or question mark, or arrays of
    sentences. Beads of one to one, omission, merge, split, two to two and crossing are weighed by a normal model of the
    length ratio (estimated over all rows unless given) together with shared numbers, names and word beginnings; sentences
    that the path leaves over are paired out of order where the evidence is strong. Null and blank texts and sentences
    give no rows. A row per pair, without a shuffle; other columns are not read.
    """
    split = dict(df.dtypes)[left] == "string"
    if ratio is None:
        ratio = length_ratio(df if split else df.select(F.array_join(left, " ").alias(left), F.array_join(right, " ").alias(right)), left, right)
    columns = df.select(*keys, left, right).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    schema = columns.select(*keys).schema.add("en_pos", T.IntegerType()).add("fr_pos", T.IntegerType()).add("_moved", T.BooleanType())
    pairs = columns.mapInArrow(_aligner(len(keys), ratio, split), schema)
    return pairs.drop("_moved") if moved is None else pairs.withColumnRenamed("_moved", moved)
