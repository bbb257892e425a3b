"""Hybrid retrieval: a set of queries against all resources, by vector and by words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.vector import cosine
from brindle.session import cut_lineage

#: Weights of cosine and words (fixed values); queries that one pass over the resources scores, and that are
#: scored at once; rows that a task holds before it leaves out what can no longer be among the best.
VECTOR_WEIGHT, WORD_WEIGHT, BLOCK, SCORED_AT_ONCE, HELD = 0.7, 0.3, 65_536, 4096, 500_000
_WORD = re.compile(r"[^\W_]+")

SCORED = "query_id bigint, resource_id bigint, source_type string, language string, cosine double, keyword double, score double, own_language boolean"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; null ones and those of another length are zero. Whole buffers are taken where all have ``width``."""
    n = len(column)
    out = np.zeros((n, width))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == width)
    if len(good):
        flat = column.filter(pa.array(lengths == width)).flatten()
        out[good] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(good), width)
    return out


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """Of rows (group, score, row ...) the best ``k`` of each group; ties at the edge stay, the last step orders them."""
    group, score, *rest = (np.concatenate(columns) for columns in zip(*parts))
    order = np.lexsort((-score, group))
    group, score = group[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    size = np.diff(np.append(first, len(group)))
    edge = score[np.minimum(first + k, first + size) - 1]
    keep = score >= np.repeat(edge, size)
    return [(group[keep], score[keep], *(c[order][keep] for c in rest))]


def _scorer(block, k: int, threshold: float, per_source: bool, fallback: bool):
    """Rows of a task that can still be among the best ``k`` of a query (of its source, or of either language class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, langs, terms = block.value
        starts = range(0, len(ids), SCORED_AT_ONCE)
        wanted: list[dict[str, list[tuple[int, int]]]] = [{} for _ in starts]  # for each part of the queries
        for q, words in enumerate(terms):
            for w in words:
                wanted[q // SCORED_AT_ONCE].setdefault(w, []).append((q % SCORED_AT_ONCE, len(words)))
        known = set().union(*wanted)
        count = np.array([len(w) for w in terms])
        kinds: dict[str | None, int] = {}  # source types and languages met, as numbers
        tongues: dict[str | None, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        rows, room = 0, HELD
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                vectors = _matrix(batch.column(3), matrix.shape[1])
                norms = np.sqrt((vectors * vectors).sum(1))
                vectors /= np.where(norms > 0, norms, 1)[:, None]
                said = [Counter(w for w in _WORD.findall((text or "").lower()) if w in known) for text in batch.column(4).to_pylist()] if known else [
                    ]
                kind = np.array([kinds.setdefault(s, len(kinds)) for s in batch.column(1).to_pylist()], np.int64)
                names = batch.column(2).to_pylist()
                tongue = np.array([tongues.setdefault(s, len(tongues)) for s in names], np.int64)
                names = np.array(names, object)
                for start, own_terms in zip(starts, wanted):
                    part = slice(start, start + SCORED_AT_ONCE)
                    cosine = vectors @ matrix[part].T
                    keyword, hits = np.zeros_like(cosine), np.zeros(cosine.shape, np.int32)
                    for r, words in enumerate(said):
                        for w, tf in words.items():
                            for q, size in own_terms.get(w, ()):
                                keyword[r, q] += tf / (tf + 1) / size
                                hits[r, q] += 1
                    matched = (hits == count[None, part]) & (count[part] > 0)[None, :]
                    keyword[~matched] = 0
                    score = np.round(VECTOR_WEIGHT * cosine + WORD_WEIGHT * keyword, 6)
                    cosine, keyword = np.round(cosine, 6), np.round(keyword, 6)
                    own = names[:, None] == langs[None, part]
                    r, q = np.nonzero((cosine >= threshold) | matched)
                    group = ((q + start) * (1 << 20) + (kind[r] if per_source else 0)) * 2 + (own[r, q] if fallback else 0)
                    held += _best([(group, score[r, q], q + start, batch.column(0).to_numpy()[r], kind[r], tongue[r], cosine[r, q], keyword[r, q],
                        own[r, q])], k)
                    rows += len(held[-1][0])
                    if rows > 2 * room:
                        held = _best(held, k)
                        rows = len(held[0][0])
                        room = max(HELD, rows)
        if held:
            ((_, score, q, found, kind, tongue, cosine, keyword, own),) = _best(held, k)
            name = lambda codes, known: pa.array(list(known), pa.string()).take(pa.array(codes))
            for at in range(0, len(q), 50_000):
                p = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[p]]), pa.array(found[p]), name(kind[p], kinds), name(tongue[p], tongues),
                    pa.array(cosine[p]), pa.array(keyword[p]), pa.array(score[p]), pa.array(own[p])],
                    ["query_id", "resource_id", "source_type", "language", "cosine", "keyword", "score", "own_language"])

    return run


def search(queries: DataFrame, resources: DataFrame, k: int, threshold: float, *, fallback: bool = False, per_source: bool = False,
    block: int = BLOCK) -> DataFrame:
    """The best ``k`` resources of each query, with ``rank`` from 1.

    ``queries``: ``query_id``, ``vector``, ``language``, ``terms`` (array); ``resources``: ``resource_id``, ``source_type``,
    ``language``, ``vector``, ``text``. A resource qualifies by a cosine of at least ``threshold`` or by holding every
    term; its score (to six places, ties by ``resource_id``) is 0.7 times the cosine plus 0.3 times the mean of tf / (tf + 1). With ``fallback`` only resources in
    the query's language count, unless none qualifies; with ``per_source`` ``k`` counts within each source type.

    Queries are taken in blocks of ``block``: each block is a matrix of bounded size that is sent to all tasks, and one
    pass over the resources multiplies it in batches. A task emits at its end what can still be among the best of all its
    batches, so that the shuffle grows with tasks and not with rows. The resources are written to the checkpoint folder
    once if there are several blocks, so that their own plan runs once. Null vectors and vectors of another length count as
    zero; a null language matches none.
    """
    spark = resources.sparkSession
    n_blocks = max(1, math.ceil(queries.count() / block))
    parts = []
    picked = resources.select(F.col("resource_id").cast("bigint"), "source_type", "language", "vector", "text")
    if n_blocks > 1:
        picked = cut_lineage(picked)
    for b in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "vector", "language", "terms").collect()
        width = max((len(r["vector"]) for r in rows if r["vector"]), default=1)
        matrix = np.array([r["vector"] if r["vector"] and len(r["vector"]) == width else [0.0] * width for r in rows], np.float64).reshape(len(rows),
            width)
        norms = np.sqrt((matrix * matrix).sum(1))
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), matrix / np.where(norms > 0, norms, 1)[:, None],
            np.array([r["language"] if r["language"] is not None else "?" for r in rows], object),
            [list(dict.fromkeys(t for t in r["terms"] or [] if t)) for r in rows]))
        if rows:
            parts.append(picked.mapInArrow(_scorer(sent, k, threshold, per_source, fallback), SCORED))
    if not parts:
        return spark.createDataFrame([], SCORED + ", rank int")
    found = reduce(DataFrame.unionByName, parts)
    if fallback:
        any_own = F.max(F.col("own_language").cast("int")).over(Window.partitionBy("query_id"))
        found = found.withColumn("_any", any_own).filter(F.col("own_language") | (F.col("_any") == 0)).drop("_any")
    keys = ["query_id", "source_type"] if per_source else ["query_id"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "resource_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_by_reference(queries: DataFrame, resources: DataFrame, k: int, threshold: float) -> DataFrame:
    """The best ``k`` resources that carry a query's own reference (a bill's number), with ``rank`` from 1.

    ``queries``: ``query_id``, ``vector``, ``reference``; ``resources``: ``resource_id``, ``vector``, ``reference``. An
    equi-join on the reference, split by the adaptive skew join where one is frequent; only pairs of one reference are
    compared, and only the best ``k`` of a query leave a task. A cosine below ``threshold`` or of a zero or null vector does
    not count. Null references match nothing.
    """
    q = queries.filter("reference is not null").select("query_id", F.col("vector").alias("_q"), "reference")
    pairs = q.join(resources.select("resource_id", "vector", "reference"), "reference").withColumn("cosine",
        F.round(cosine(F.col("_q"), F.col("vector")), 6))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "resource_id"))
    return pairs.filter(F.col("cosine") >= threshold).withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "resource_id",
        "reference", "cosine", "rank")


# Least cosine of a search, and of one for a bill's own number.
THRESHOLD, STRICT = 0.4, 0.5
#: Source types, and which of them are narrowed to the query's bill number if it has one.
SOURCES = ["bill", "vote_question", "vote_party", "vote_member", "hansard", "committee", "committee_report", "committee_meeting", "politician",
    "party", "election", "candidacy", "session", "riding"]
BY_NUMBER = {"bill": STRICT, "vote_question": None}


def search_source(queries: DataFrame, resources: DataFrame, source: str, k: int = 10, threshold: float | None = None, where: Column | None = None,
    fallback: bool = False) -> DataFrame:
    """A search within one source type: ``query_id``, ``resource_id``, ``cosine``, ``rank``.

    Bills and vote questions are narrowed to the number in a query (column ``reference``) where it has one, bills then with
    a cosine of at least 0.5. ``where`` is a further condition on resources. Other source types ignore the number.
    """
    own = resources.filter(F.col("source_type") == source) if where is None else resources.filter((F.col("source_type") == source) & where)
    least = THRESHOLD if threshold is None else threshold
    if source not in BY_NUMBER:
        return search(queries, own, k, least, fallback=fallback).select("query_id", "resource_id", "cosine", "rank")
    narrowed = search_by_reference(queries, own, k, max(least, BY_NUMBER[source] or least)).select("query_id", "resource_id", "cosine", "rank")
    return narrowed.unionByName(search(queries.filter("reference is null"), own, k, least, fallback=fallback)
        .select("query_id", "resource_id", "cosine", "rank"))
