"""Differences between two copies of a table whose keys may repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.relational import numbered_within
from brindle.session import cut_lineage

#: Most leftover rows of one key that are paired over a dense table of costs; keys beyond go through a sparse network.
EXACT_ROWS = 400


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum-cost assignment that matches every row or every column, whichever are fewer.

    Shortest augmenting paths with potentials; ties go to the lowest column.
    """
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)  # the row that holds each column, from 1; 0 is free
    for i in range(1, n + 1):
        owner[0], here = i, 0
        dist, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[here] = True
            row = owner[here]
            open_ = ~done[1:]
            reach = cost[row - 1] - u[row] - v[1:]
            better = open_ & (reach < dist[1:])
            dist[1:][better] = reach[better]
            came[1:][better] = here
            masked = np.where(open_, dist[1:], np.inf)
            step = int(masked.argmin()) + 1
            delta = masked[step - 1]
            u[owner[done]] += delta
            v[done] -= delta
            dist[1:][open_] -= delta
            here = step
            if owner[here] == 0:
                break
        while here:
            owner[here] = owner[came[here]]
            here = came[here]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rows of stretches (sizes over 0, equal totals) laid side by side: indices of those that overlap, and by how much."""
    x, y = a.cumsum(), b.cumsum()
    ends = np.unique(np.concatenate([x, y]))
    return np.searchsorted(x, ends), np.searchsorted(y, ends), np.diff(ends, prepend=0)


class _Network:
    """A flow network in arrays; arc ``a ^ 1`` is the reverse of arc ``a``."""

    def __init__(self, nodes: int, source: int, sink: int, start: np.ndarray, end: np.ndarray, room: np.ndarray, cost: np.ndarray):
        mix = lambda p, q: np.stack([p, q], 1).ravel()
        self.nodes, self.source, self.sink = nodes, source, sink
        self.start, self.end, self.room, self.cost = mix(start, end), mix(end, start), mix(room, 0 * room), mix(cost, -cost)

    def distances(self) -> np.ndarray:
        far = np.iinfo(np.int64).max // 4
        dist = np.full(self.nodes, far)
        dist[self.source] = 0
        open_ = self.room > 0
        start, end, cost = self.start[open_], self.end[open_], self.cost[open_]
        while True:
            near = dist[start] < far
            new = dist.copy()
            np.minimum.at(new, end[near], dist[start[near]] + cost[near])
            if (new == dist).all():
                return dist
            dist = new

    def fill(self, tight: np.ndarray) -> None:
        """A greatest flow over the ``tight`` arcs (Dinic)."""
        while True:
            open_ = np.flatnonzero(tight & (self.room > 0))
            start, end = self.start[open_], self.end[open_]
            level, depth = np.full(self.nodes, -1), 0
            level[self.source] = 0
            while level[self.sink] < 0:
                new = end[(level[start] == depth) & (level[end] < 0)]
                if not len(new):
                    return
                depth += 1
                level[new] = depth
            down = open_[level[end] == level[start] + 1]
            down = down[np.argsort(self.start[down], kind="stable")]
            first = np.searchsorted(self.start[down], np.arange(self.nodes + 1))
            here, last, arcs, to = first[:-1].tolist(), first[1:].tolist(), down.tolist(), self.end[down].tolist()
            room = self.room[down].tolist()
            path: list[int] = []
            at = self.source
            while True:
                if at == self.sink:
                    least = min(room[p] for p in path)
                    for p in path:
                        room[p] -= least
                    full = next(k for k, p in enumerate(path) if not room[p])
                    at = int(self.start[arcs[path[full]]])
                    del path[full:]
                elif here[at] < last[at]:
                    p = here[at]
                    if room[p]:
                        path.append(p)
                        at = to[p]
                    else:
                        here[at] += 1
                elif path:
                    p = path.pop()
                    at = int(self.start[arcs[p]])
                    here[at] += 1
                else:
                    break
            moved = self.room[down] - np.array(room, dtype=np.int64)
            self.room[down] -= moved
            self.room[down ^ 1] += moved


def transport(x: np.ndarray, y: np.ndarray, have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of ``x``, row of ``y``, units) of the least total of unequal fields, units given by ``have`` and ``want``.

    Every unit of the smaller side is paired. ``x`` and ``y`` hold a code per field; -1 equals nothing. A set of fields
    with their codes that both sides have is a hub between the rows that have it, so that the network grows with the rows and
    not with their pairs. A cheapest further path costs at least as much as the one before it and at most all fields; so
    one greatest flow over the tight arcs for each cost below that settles all (primal-dual), and the rest is paired as it comes.
    """
    n, m, fields = len(x), len(y), x.shape[1]
    into, out, hubs = [], [], 0  # (row, hub, cost)
    for size in range(fields, 0, -1):
        for kept in combinations(range(fields), size):
            a, b = np.flatnonzero((x[:, kept] >= 0).all(1)), np.flatnonzero((y[:, kept] >= 0).all(1))
            both = np.concatenate([x[np.ix_(a, kept)], y[np.ix_(b, kept)]])
            if not len(a) or not len(b):
                continue
            code = np.unique(both, axis=0, return_inverse=True)[1].ravel()
            shared = np.intersect1d(code[: len(a)], code[len(a) :])
            for rows, own, arcs in ((a, code[: len(a)], into), (b, code[len(a) :], out)):
                keep = np.isin(own, shared)
                arcs.append(np.stack([rows[keep], hubs + np.searchsorted(shared, own[keep]), np.full(keep.sum(), fields - size)], 1))
            hubs += len(shared)
    none = np.zeros((0, 3), dtype=np.int64)
    into, out = np.concatenate([none, *into]), np.concatenate([none, *out])
    # rows of x, hubs, rows of y, source, sink
    source, sink, wide = n + hubs + m, n + hubs + m + 1, np.int64(have.sum() + want.sum())
    start = np.concatenate([into[:, 0], n + out[:, 1], np.full(n, source), n + hubs + np.arange(m)])
    end = np.concatenate([n + into[:, 1], n + hubs + out[:, 0], np.arange(n), np.full(m, sink)])
    room = np.concatenate([np.full(len(into) + len(out), wide), have, want]).astype(np.int64)
    cost = np.concatenate([into[:, 2], np.zeros(len(out) + n + m, dtype=np.int64)])
    net = _Network(sink + 1, source, sink, start, end, room, cost)
    while (dist := net.distances())[sink] < fields:
        net.fill((dist[net.start] + net.cost == dist[net.end]) & (dist[net.start] <= fields))
    flow = net.room[1::2]
    a, b = flow[: len(into)], flow[len(into) : len(into) + len(out)]
    a_order, b_order = (np.flatnonzero(f)[np.argsort(arcs[f > 0, 1], kind="stable")] for f, arcs in ((a, into), (b, out)))
    p, q, units = _overlaps(a[a_order], b[b_order])
    i, j = into[a_order[p], 0], out[b_order[q], 0]
    left, right = have - np.bincount(i, units, n).astype(np.int64), want - np.bincount(j, units, m).astype(np.int64)
    rest = min(left.sum(), right.sum())
    cut = lambda r: np.diff(np.minimum(r.cumsum(), rest), prepend=0)
    left, right = cut(left), cut(right)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    p, q, more = _overlaps(left[a], right[b])
    return np.concatenate([i, a[p]]), np.concatenate([j, b[q]]), np.concatenate([units, more])


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row per difference between two tables that hold ``keys`` and ``fields``.

    Result: the key columns, ``difference`` (``missing_in_right``, ``missing_in_left``, or the name of an unequal field),
    ``left_value``, ``right_value`` and ``copies`` (how many pairs or rows differ so).

    Identical rows cancel by multiplicity in one partial aggregation over whole rows, which needs no task that holds all
    rows of a key. What is left is paired within its key so that the total number of unequal fields is least, however many
    rows that are. Keys with up to ``exact_rows`` leftover rows get an assignment over a dense table of costs. Beyond that,
    one field needs no more than numbered rows, without a task per key; several fields go through a sparse network, in one
    task per key, whose memory grows with the key's distinct leftover rows.

    The leftovers are written to the checkpoint folder once, so that the branches do not recompute them.

    Nulls are values that equal each other, in keys too. Empty tables give every row of the other side as missing.
    Columns besides ``keys`` and ``fields`` are ignored, whatever their names.
    """
    k, f = [f"_k{i}" for i in range(len(keys))], [f"_f{i}" for i in range(len(fields))]
    pick = lambda df, sign: df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keys + fields, k + f)], F.lit(sign).cast("long")
        .alias("_n"))
    net = pick(left, 1).unionByName(pick(right, -1)).groupBy(*k, *f).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    size = net.groupBy(*k).agg(F.sum(F.when(F.col("_n") > 0, F.col("_n")).otherwise(0)).alias("_l"),
        F.sum(F.when(F.col("_n") < 0, -F.col("_n")).otherwise(0)).alias("_r"))
    same_key = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in k])
    sized = cut_lineage(net.alias("n").join(size.alias("s"), same_key("n", "s")).select("n.*", "s._l", "s._r"))

    one_sided = sized.filter("_l = 0 or _r = 0").select(*k, *f, "_n")
    small = sized.filter(F.expr(f"_l > 0 and _r > 0 and _l + _r <= {int(exact_rows)}"))
    large = sized.filter(F.expr(f"_l > 0 and _r > 0 and _l + _r > {int(exact_rows)}"))
    single, multiple = small.filter("_l = 1 and _r = 1"), small.filter("not (_l = 1 and _r = 1)")

    sides = [F.max(F.when(F.col("_n") > 0, F.struct(*f))).alias("_a"), F.max(F.when(F.col("_n") < 0, F.struct(*f))).alias("_b")]
    paired = single.groupBy(*k).agg(*sides).withColumn("_c", F.lit(1).cast("long"))
    groups = multiple.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("_n", *f))).alias("_rows"))
    side = "struct<" + ", ".join(f"{c}: string" for c in f) + ">"
    exact = groups.select(*k, F.explode(_pair_up(f, side)("_rows")).alias("_p")).select(*k, "_p._a", "_p._b", "_p._c")
    pairs = paired.unionByName(exact)
    if not large.isEmpty():
        pairs = pairs.unionByName(_pair_in_order(large, k, f) if len(f) == 1 else _pair_by_flow(large, k, f))
    lone = one_sided.select(*k, F.when(F.col("_n") > 0, F.struct(*f)).alias("_a"), F.when(F.col("_n") < 0, F.struct(*f)).alias("_b"), F.abs("_n")
        .alias("_c"))
    return _report(pairs.unionByName(lone), keys, k, fields, f)


def _pair_up(f: list[str], side: str):
    """Pandas UDF: leftover rows of a key, negative counts for the right side, to pairs and rows without partner."""

    @F.pandas_udf(f"array<struct<_a: {side}, _b: {side}, _c: bigint>>")
    def pair(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in groups:
            out = []
            for rows in batch:
                a = [r for r in rows if r["_n"] > 0 for _ in range(r["_n"])]
                b = [r for r in rows if r["_n"] < 0 for _ in range(-r["_n"])]
                codes: dict = {}
                code = lambda r: [codes.setdefault((c, r[c]), len(codes)) for c in f]  # noqa: B023, E731
                x, y = np.array([code(r) for r in a]), np.array([code(r) for r in b])
                found = assign((x[:, None, :] != y[None, :, :]).sum(2).astype(float))
                used_a, used_b = {i for i, _ in found}, {j for _, j in found}
                got = [(a[i], b[j]) for i, j in found] + [(r, None) for i, r in enumerate(a) if i not in used_a] + [(None, r) for j,
                    r in enumerate(b) if j not in used_b]
                cut = lambda r: None if r is None else {c: r[c] for c in f}
                out.append([{"_a": cut(p), "_b": cut(q), "_c": 1} for p, q in got])
            yield pd.Series(out)

    return pair


def _pair_in_order(large: DataFrame, k: list[str], f: list[str]) -> DataFrame:
    """Pairs for keys with very many leftovers of one field: all pairs differ in it, so numbered rows are paired."""
    rest = large.select(*k, *f, "_n").withColumn("_u", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))))
    a, b = (numbered_within(rest.filter(side), k, [*f, "_u"], "_i") for side in ("_n > 0", "_n < 0"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k] + [F.col("a._i") == F.col("b._i")])
    both = a.alias("a").join(b.alias("b"), same, "full_outer")
    side = lambda t: F.when(F.col(f"{t}._n").isNotNull(), F.struct(*[F.col(f"{t}.{c}").alias(c) for c in f]))
    key = [F.when(F.col("a._n").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in k]
    return both.select(*key, side("a").alias("_a"), side("b").alias("_b"), F.lit(1).cast("long").alias("_c"))


def _pair_by_flow(large: DataFrame, k: list[str], f: list[str]) -> DataFrame:
    """Pairs of least cost for keys with very many leftovers. Rows that are equal in all values that the other side has
    too are one row of the network."""

    def pair(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.column("_n").to_numpy()
        sides = np.flatnonzero(n > 0), np.flatnonzero(n < 0)
        codes = np.empty((len(n), len(f)), dtype=np.int64)
        for i, c in enumerate(f):
            own = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            own = (own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy()
            codes[:, i] = np.where(np.isin(own, np.intersect1d(own[sides[0]], own[sides[1]])), own, -1)
        kinds, rows, units = [], [], []
        for side in sides:
            kind, which = np.unique(codes[side], axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            kinds.append(kind)
            rows.append(side[order])
            units.append((which.ravel()[order], np.abs(n[side[order]])))
        total = [np.bincount(which, size).astype(np.int64) for which, size in units]
        i, j, size = transport(*kinds, *total)
        lone = [t - np.bincount(p, size, len(t)).astype(np.int64) for t, p in zip(total, (i, j))]
        a, b = np.flatnonzero(lone[0]), np.flatnonzero(lone[1])
        i = np.concatenate([i, a, np.full(len(b), -1)])
        j = np.concatenate([j, np.full(len(a), -1), b])
        size = np.concatenate([size, lone[0][a], lone[1][b]])
        for own in (0, 1):  # kinds to their rows, on one side after the other; -1 stays
            mine, other = (i, j) if own == 0 else (j, i)
            order = np.argsort(mine, kind="stable")
            order, gone = order[mine[order] >= 0], order[mine[order] < 0]
            p, q, cut = _overlaps(units[own][1], size[order])
            mine, other, size = np.concatenate([rows[own][p], mine[gone]]), np.concatenate([other[order[q]], other[gone]]), np.concatenate(
                [cut, size[gone]])
            i, j = (mine, other) if own == 0 else (other, mine)

        def values(row: np.ndarray) -> pa.Array:
            taken = [table.column(c).combine_chunks().take(pa.array(row, mask=row < 0)) for c in f]
            return pa.StructArray.from_arrays([t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t for t in taken], f, mask=pa.array(row < 0))

        zero = pa.array(np.zeros(len(i), dtype=np.int64))
        return pa.table([*[table.column(c).take(zero) for c in k], values(i), values(j), pa.array(size, pa.int64())], names=[*k, "_a", "_b", "_c"])

    side = T.StructType([T.StructField(c, T.StringType()) for c in f])
    schema = large.select(*k).schema.add("_a", side).add("_b", side).add("_c", "long")
    return large.select(*k, *f, "_n").groupBy(*k).applyInArrow(pair, schema)


def _report(pairs: DataFrame, keys: list[str], k: list[str], fields: list[str], f: list[str]) -> DataFrame:
    none = F.lit(None).cast("string")
    cell = lambda what, a, b: F.struct(what.alias("difference"), a.alias("left_value"), b.alias("right_value"))
    gone = F.when(F.col("_b").isNull(), F.lit("missing_in_right")).when(F.col("_a").isNull(), F.lit("missing_in_left"))
    cells = [F.when(gone.isNotNull(), cell(gone, none, none))]
    for name, c in zip(fields, f):
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        cells.append(F.when(gone.isNull() & ~a.eqNullSafe(b), cell(F.lit(name), a, b)))
    flat = pairs.select(*k, "_c", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("_d"))
    grouped = flat.groupBy(*k, "_d").agg(F.sum("_c").alias("copies"))
    return grouped.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "_d.*", "copies")
