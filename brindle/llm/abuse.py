"""Abusive, hateful and sexual passages: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most labelled documents that the classifier is fitted on, and the characters of theirs; of their passages, the most that are
#: held against the suspected ones.
LABELLED, LABELLED_CHARS, AGAINST = 2000, 20_000_000, 12000
#: Most landmarks, and the hashed width of the kernel's features.
LANDMARKS, WIDTH = 500, 1 << 14
#: Subsequence lengths with the widest span each, and the weight of every skipped character.
SPANS, DECAY = ((3, 5), (4, 7)), 0.6
#: How much more frequent in abusive texts than in all a telling word is.
LIFT = 11.0
#: Decision value above which a passage is abusive.
THRESHOLD = -0.35
#: Passages longer than this many words are scored in overlapping stretches.
STRETCH = 14
#: Cyrillic and Greek letters, digits and signs that stand for Latin letters (fixed values).
ALIKE = str.maketrans("аеорсухіјѕһԁԛԝвнкмт" + "αορνικτυεη" + "013457@$!|", "aeopcyxijshdqwbhkmt" + "aopviktuen" + "oieastasil")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_RUN = re.compile(r"(\w)\1{2,}")
_DRAWN = re.compile(r"(?<![^\W_])([^\W\d_])(?:([^\w\s]|[_ ])([^\W\d_])(?=\2|(?![^\W_]))){2,}")
_WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
_UNSEEN = re.compile(r"[\u0300-\u036f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")  # accents and signs without width
_PLAIN = str.maketrans({"’": "'", "œ": "oe", "æ": "ae", "Œ": "oe", "Æ": "ae"})


def folded(text: str) -> str:
    """Compatibility forms in lower case without accents, ligatures and signs without width."""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))).translate(_PLAIN)
    return text.lower()


def _word(raw: str) -> str:
    """A folded word without outer signs, look-alikes as Latin letters, drawn-out letters once; numbers as 0."""
    core = _WORD.search(raw)
    if not core:
        return ""
    w = core.group()
    return _RUN.sub(r"\1", w.translate(ALIKE)) if any(c.isalpha() for c in w) else "0"


def plain_words(line: str) -> Iterator[list[str]]:
    """The words of each sentence of a line, by patterns over the folded line; spelled-out words joined."""
    for sentence in _SENTENCE.split(folded(line)):
        joined = _DRAWN.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), sentence)
        if words := [w for raw in joined.split() if (w := _word(raw))]:
            yield words


#: Marks of a remembered token: one letter that stands alone at its beginning or end, several in a row there, and white
#: space within. Letters that stand alone on both sides of a space may spell a word together.
_BEGIN, _END, _BEGIN_MORE, _END_MORE, _SPACED = "\x01", "\x02", "\x03", "\x04", "\x05"
_SPELLED = re.compile(
    f"{_END_MORE} [{_BEGIN}{_BEGIN_MORE}]|[{_END}{_END_MORE}] {_BEGIN_MORE}|[{_END}{_END_MORE}] {_BEGIN}[^ ]{_END} [{_BEGIN}{_BEGIN_MORE}]"
)
_MARKED = re.compile(f"[{_BEGIN}{_END}{_BEGIN_MORE}{_END_MORE}{_SPACED}]")
_RUNS = re.compile(r"[^\W_]+")
_ANY_MARK = re.compile(f"[{_END}{_END_MORE}] |{_SPACED}")


def _alone(runs: list[tuple[int, int]], whole: str) -> int:
    """How many letters stand alone in a row from the token's beginning, one sign between each two; ``runs`` are its runs of
    letters and digits."""
    count, end = 0, -1
    for a, z in runs:
        if z - a > 1 or a != end + 1 or not whole[a].isalpha():
            break
        count, end = count + 1, z
    return count


class _Tokens(dict):
    """Raw tokens to their words, with marks; the line end behind a word ends its sentence. Forgets all when it is full."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 300_000:
            self.clear()
        whole = folded(raw)
        runs = [m.span() for m in _RUNS.finditer(whole)]
        first, n = _alone(runs, whole), len(whole)
        last = _alone([(n - z, n - a) for a, z in reversed(runs)], whole[::-1])
        begin = _BEGIN_MORE if first > 1 else _BEGIN if first else ""
        end = _END_MORE if last > 1 else _END if last else ""
        if any(c.isspace() for c in whole):
            begin += _SPACED
        word = _word(_DRAWN.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), whole))
        found = self[raw] = begin + word + end + ("\n" if whole[-1:] in tuple(".!?…") else "")
        return found


class _Words(_Tokens):
    """Raw tokens to their bare words."""

    def __missing__(self, raw: str) -> str:
        found = self[raw] = _MARKED.sub("", _tokens[raw]).rstrip("\n")
        return found


_tokens, _words = _Tokens(), _Words()


def words_of(text: str) -> Iterator[list[str]]:
    """The words of each sentence: those of :func:`plain_words`, but every token is folded once and remembered.

    Only lines with letters that stand alone side by side, which may spell a word, and tokens that fold to several, go
    through the patterns again.
    """
    for line in text.split("\n"):
        joined = " ".join(map(_tokens.__getitem__, line.split()))
        if _ANY_MARK.search(joined) and (_SPACED in joined or _SPELLED.search(joined)):
            yield from plain_words(line)
            continue
        if _MARKED.search(joined):
            joined = _MARKED.sub("", joined)
        for sentence in joined.split("\n"):
            if words := sentence.split():
                yield words


def passages(text: str) -> Iterator[str]:
    """The sentences of a text, long ones as overlapping stretches of words, folded; spelled-out words joined."""
    for words in words_of(text):
        if len(words) <= STRETCH:
            yield " ".join(words)
        else:
            for at in range(0, len(words) - STRETCH // 2, STRETCH // 2):
                yield " ".join(words[at : at + STRETCH])


#: Shapes of subsequences: the places of their characters from the first, in order of the last one; their weights; the mass of
#: the subsequences that begin at one character.
_OFFSETS = sorted(((0, *o) for p, span in SPANS for o in combinations(range(1, span), p - 1)), key=lambda o: (o[-1], o))
_WEIGHTS = np.array([DECAY ** (o[-1] + 1 - len(o)) for o in _OFFSETS], np.float32)
_MASS = float((_WEIGHTS**2).sum())


#: Odd factors of the hash.
_MIX = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.float32]]]:
    """(characters of each text, characters from each one to its text's end, and for every shape of subsequence: the place of
    its last character, the hashed subsequence that begins at each character, and its weight)."""
    padded = [f" {t} " for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    mixed = [codes * m for m in _MIX[:4]]
    shift = np.uint32(33 - WIDTH.bit_length())

    def shapes() -> Iterator[tuple[int, np.ndarray, np.float32]]:
        for offsets, weight in zip(_OFFSETS, _WEIGHTS):
            n = len(codes) - offsets[-1]
            if n > 0:
                h = mixed[0][:n] + mixed[1][offsets[1] : n + offsets[1]]
                for k in range(2, len(offsets)):
                    h += mixed[k][offsets[k] : n + offsets[k]]
                h *= _MIX[4]
                h ^= h >> np.uint32(15)
                h *= _MIX[0]
                h >>= shift
                yield offsets[-1], h, weight

    return size, left, shapes()


def embedded(texts: list[str]) -> np.ndarray:
    """Rows whose inner products are the kernel, each divided by the root of its text's length."""
    size, left, shapes = _hashed(texts)
    owner = np.repeat(np.arange(len(texts)), size) * WIDTH
    cells, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for last, cols, weight in shapes:
        cells.append((owner[: len(cols)] + cols)[left[: len(cols)] > last])
        weights.append(np.full(len(cells[-1]), weight, np.float32))
    dense = np.bincount(np.concatenate(cells), np.concatenate(weights), len(texts) * WIDTH).astype(np.float32).reshape(len(texts), WIDTH)
    return dense / np.sqrt(_lengths(texts))[:, None]


def _lengths(texts: list[str]) -> np.ndarray:
    return _MASS * np.fromiter((len(t) + 2 for t in texts), np.float32, len(texts))


class Model(NamedTuple):
    weights: np.ndarray  # of each hashed subsequence: the landmarks' combination
    bias: float
    threshold: float


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Decision value of each passage; the sum over landmarks collapses to one weight a subsequence."""
    if not texts:
        return np.zeros(0)
    size, left, shapes = _hashed(texts)
    value = np.zeros(size.sum(), np.float32)  # of what begins at each character
    for last, same in groupby(shapes, key=lambda shape: shape[0]):
        n = len(value) - last
        here = np.zeros(n, np.float32)
        for _, cols, weight in same:
            here += np.take(model.weights * weight, cols)
        value[:n] += here * (left[:n] > last)
    return np.add.reduceat(value, np.cumsum(size) - size) / np.sqrt(_lengths(texts)) + model.bias


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray | None = None, rounds: int = 10) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps from ``w``; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1]) if w is None else w
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active] * np.sqrt(cost[active, None]).astype(x.dtype)
        step = np.linalg.solve((xa.T @ xa).astype(np.float64) + np.diag(ridge), xa.T.astype(np.float64) @ (y[active] * np.sqrt(cost[active])))
        w, moved = step, np.abs(step - w).max()
        if moved < 1e-3 * np.abs(w).max():
            break
    return w


def fit(docs: list[tuple[str, bool]], common: dict[str, int] | None = None, n_docs: int = 0, c: float = 8.0, turns: int = 6,
    seed: int = 7) -> Model | None:
    """Fit on labelled texts. A text is abusive if one of its passages is, so the passages' labels are found in turns.

    ``common`` tells in how many of all ``n_docs`` documents a word occurs: only passages with a word that is ``LIFT``
    times as frequent in abusive texts as in all are suspected of making a text abusive, and a text without any is left out as a
    mistake of its annotators. All passages are suspected without ``common``. Suspected passages are held against up to
    ``AGAINST`` others: at first any, then those that the first machine takes for the worst. Null if there are no texts of
    either kind.
    """
    bags = [(list(dict.fromkeys(passages(t))), bad) for t, bad in docs]
    texts = [p for ps, _ in bags for p in ps]
    bag = np.repeat(np.arange(len(bags)), [len(ps) for ps, _ in bags])
    bad_bag = np.array([b for _, b in bags], bool)
    if not len(texts) or not bad_bag[bag].any() or bad_bag[bag].all():
        return None
    clean_texts = {p for ps, bad in bags if not bad for p in ps}
    suspect = bad_bag[bag] & np.array([p not in clean_texts for p in texts])
    if common is not None:
        seen = Counter(w for ps, bad in bags if bad for w in {w for p in ps for w in p.split()})
        lift = {w: n / bad_bag.sum() * (n_docs + 1) / (common.get(w, 0) + 1 + n_docs / 1000) for w, n in seen.items()}
        telling = np.array([max((lift.get(w, 0.0) for w in p.split()), default=0.0) >= LIFT for p in texts])
        suspect &= telling if (suspect & telling).any() else True
    rng = np.random.default_rng(seed)
    pool, rest = rng.permutation(np.flatnonzero(suspect)), rng.permutation(np.flatnonzero(~suspect))
    share = 1.0 / np.bincount(bag, suspect, len(bags))[bag].clip(1)
    model, value = None, np.zeros(len(texts))
    for stage in range(2):
        if stage:  # landmarks and the passages held against them again, from what the first ones found
            value = np.concatenate([scores(texts[i : i + 2000], model) for i in range(0, len(texts), 2000)])
            pool = np.array(sorted(np.flatnonzero(suspect & (value > -0.6)), key=lambda i: -value[i]), np.int64)
            rest = np.array(sorted(np.flatnonzero(~suspect), key=lambda i: -value[i]), np.int64)
        clean = rest[~bad_bag[bag[rest]]]
        marks = embedded([texts[i] for i in np.concatenate([_spread(texts, pool, LANDMARKS * 2 // 3), _spread(texts, clean, LANDMARKS // 3)])])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-5 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        taken = np.sort(np.concatenate([np.flatnonzero(suspect), rest[:AGAINST]]))
        x = np.ones((len(taken), root.shape[1] + 1), np.float32)
        for i in range(0, len(taken), 128):
            x[i : i + 128, :-1] = (embedded([texts[k] for k in taken[i : i + 128]]) @ marks.T) @ root
        own, maybe, negative = bag[taken], suspect[taken], ~bad_bag[bag[taken]]
        label, cost, use, w = np.where(maybe, 1.0, -1.0), np.where(maybe, share[taken], 1.0) * c, negative | maybe, None
        if stage:
            label, cost, use = _turn(value[taken], own, maybe, negative, bad_bag, c)
        for _ in range(turns):
            w = _svm(x[use], label[use], cost[use], w)
            label, cost, use = _turn(x @ w, own, maybe, negative, bad_bag, c)
        model = Model((marks.T @ (root @ w[:-1])).astype(np.float32), float(w[-1]), THRESHOLD)
    return model


def _turn(value: np.ndarray, bag: np.ndarray, maybe: np.ndarray, negative: np.ndarray, bad_bag: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray,
    np.ndarray]:
    """Label and cost of each passage by the values found, and whether it is used: the worst suspected one of each abusive
    text is abusive, others if they look it; of texts that are settled so, what looks harmless is."""
    best = np.full(len(bad_bag), -np.inf)
    np.maximum.at(best, bag[maybe], value[maybe])
    found = best[bag] > -0.5
    positive = maybe & ((value >= best[bag]) | (value > 0.3))
    use = negative | positive | (bad_bag[bag] & found & (value < -0.5))
    return np.where(positive, 1.0, -1.0), np.where(positive & ~found, 0.2 * c, c), use


def _spread(texts: list[str], pool: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the passages, in order, leaving out those whose words were mostly seen in two before."""
    seen: dict[str, int] = {}
    first, later = [], []
    for i in pool:
        words = set(texts[i].split())
        known = sum(seen.get(w, 0) >= 2 for w in words)
        (later if known > 0.8 * len(words) else first).append(i)
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    return np.array([*first, *later][:most], np.int64)


def labelled(labels: DataFrame, documents: DataFrame, most: int = LABELLED, chars: int = LABELLED_CHARS) -> list[tuple[str, bool]]:
    """Up to ``most`` documents of up to ``chars`` characters in all with most of their annotators on one side:
    (text, abusive), taken in the order of a hash. Both bounds are parameters."""
    side = F.when(F.col("label").isin("abusive", "hateful", "sexual"), 1).when(F.col("label") == "none", -1)
    votes = labels.groupBy("doc_id").agg(F.sum(side).alias("_v")).filter("_v <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select("doc_id", "text").join(F.broadcast(votes), "doc_id").filter("text is not null")
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # ``most`` rows
    rows = texts.withColumn("_chars", so_far).filter(F.col("_chars") <= chars).select("text", "_v", "doc_id").collect()
    return [(r["text"], r["_v"] > 0) for r in sorted(rows, key=lambda r: r["doc_id"])]


def word_frequencies(documents: DataFrame, docs: list[tuple[str, bool]]) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the abusive labelled texts occurs, and how many documents have a text.

    The words looked for are those of a bounded sample, so that they can be sent to all tasks and their counts collected.
    Letters that spell a word between white space are not put together here.
    """
    wanted = frozenset(w for text, bad in docs if bad for p in passages(text) for w in p.split())
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                counts.update(shared.value.intersection(map(_words.__getitem__, set(text.split()))))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts], pa.string()), pa.array([n, *counts.values()], pa.int64())], ["word", "n"])

    rows = documents.filter("text is not null").select(F.col("text").cast("string")).mapInArrow(run,
        "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def train(labels: DataFrame, documents: DataFrame) -> Model | None:
    """A model from the labelled documents, with word frequencies of all documents."""
    docs = labelled(labels, documents)
    return fit(docs, *word_frequencies(documents, docs)) if docs else None


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``source``, ``score`` (of the worst passage) and ``abusive`` for every document.

    Null and empty texts, and texts without letters, have a null score and are not abusive. Without a model (no usable
    labels) no document is. Whole texts are scored, passage by passage, without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            best: list[float | None] = []
            for at in range(0, batch.num_rows, 500):
                texts = [list(passages(t)) if t and model else [] for t in batch.column(2).slice(at, 500).to_pylist()]
                fresh = list({p for ps in texts for p in ps if p not in known})
                if len(known) > 200_000:
                    known.clear()
                    fresh = list({p for ps in texts for p in ps})
                for k in range(0, len(fresh), 400):
                    known.update(zip(fresh[k : k + 400], scores(fresh[k : k + 400], model).tolist()))
                best += [max((known[p] for p in ps), default=None) for ps in texts]
            bad = [s is not None and s > model.threshold for s in best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.float64()), pa.array(bad, pa.bool_())],
                ["doc_id", "source", "score", "abusive"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run,
        "doc_id bigint, source string, score double, abusive boolean")
