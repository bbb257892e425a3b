"""Mixing of sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import cut_lineage

#: Newton steps at most, and the relative error of a source's tokens at which they end.
STEPS, CLOSE = 60, 1e-9
#: Bins a power of two of the lengths that the first solution is taken over.
GRAIN = 16
#: Bins of the rounding threshold's search, twice over, and the most sizes a power of two that fill what it leaves.
BINS, SIZES = 1024, 64


class Goal(NamedTuple):
    source: str
    share: float
    cap: int
    tokens: float  # to reach
    full: bool  # every document is repeated as often as allowed


def source_name(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|(?<!\s)\s+$", ""))


def goals(targets: list[tuple[str, float, int]], held: dict[str, int], total: float | None) -> list[Goal]:
    """What each source is to give. Sources without tokens give nothing and the others keep their proportions.

    Without ``total`` the mixture is the largest in which every such source meets its share. A larger ``total`` exhausts
    some sources, and the others share the rest in proportion.
    """
    usable = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and held.get(s, 0) > 0]
    if not usable:
        return []
    most = {s: cap * held[s] for s, _, cap in usable}
    whole = sum(share for _, share, _ in usable)
    fitting = min(most[s] * whole / share for s, share, _ in usable)
    want, rest, open_ = {}, min(total, sum(most.values())) if total is not None else fitting, {s: share for s, share, _ in usable}
    while open_:
        scale = rest / sum(open_.values())
        over = [s for s, share in open_.items() if share * scale >= most[s] * (1 - 1e-12)]
        if not over:
            want |= {s: share * scale for s, share in open_.items()}
            break
        for s in over:
            want[s] = float(most[s])
            rest -= most[s]
            del open_[s]
    return [Goal(s, share, cap, want[s], want[s] >= most[s] * (1 - 1e-12)) for s, share, cap in usable]


def _rate(level: Column, tilt: Column, x: Column, cap: Column) -> Column:
    return cap / (F.lit(1.0) + F.exp(-(level + tilt * x)))


def balance(sizes: DataFrame, wanted: list[Goal], held: dict[str, int], docs: dict[str, int]) -> dict[str, tuple[float, float]]:
    """The dual's solution (level, tilt) of each source by Newton steps; sums are taken over all rows of ``sizes`` each step.

    The steps begin at the solution over binned lengths, so that few are left.

    ``sizes`` has ``source``, ``n_tokens`` and the ``count`` of such documents. Rates of greatest entropy between 0 and the
    cap, given the source's tokens and mean length, are ``cap / (1 + exp(-level - tilt * length))``, lengths in units of
    the mean.
    """
    spark = sizes.sparkSession
    of = {g.source: g for g in wanted}
    mean, goal = {s: held[s] / docs[s] for s in of}, {s: of[s].tokens * docs[s] / held[s] for s in of}  # in mean lengths; as many documents
    bins = sizes.groupBy("source", F.floor(F.log2("n_tokens") * GRAIN).alias("bin")).agg(F.sum("count").alias("n"),
        F.sum(F.col("count") * F.col("n_tokens")).alias("t"))
    coarse: dict[str, list] = {s: [] for s in of}
    for r in bins.collect():  # sources times 64 powers times GRAIN at most
        if r["source"] in of:
            coarse[r["source"]].append((r["n"], r["t"] / r["n"] / mean[r["source"]]))
    dual = {s: _coarse_dual(np.array(coarse[s]), float(of[s].cap), goal[s]) for s in of if not of[s].full}
    open_ = set(dual)
    for _ in range(STEPS):
        if not open_:
            break
        rows = [(s, float(dual[s][0]), float(dual[s][1]), float(of[s].cap), mean[s]) for s in sorted(open_)]
        now = spark.createDataFrame(rows, "source string, level double, tilt double, cap double, mean double")
        x = F.col("n_tokens") / F.col("mean")
        r = _rate(F.col("level"), F.col("tilt"), x, F.col("cap"))
        slope = r * (1 - r / F.col("cap"))
        c = F.col("count")
        terms = {"g0": c * r, "g1": c * r * x, "h0": c * slope, "h1": c * slope * x, "h2": c * slope * x * x}
        for s in sizes.join(F.broadcast(now), "source").groupBy("source").agg(*[F.sum(v).alias(k) for k, v in terms.items()]).collect():
            step = _step(*[s[k] for k in terms], goal[s["source"]])
            if step is None:
                open_.discard(s["source"])
            else:
                dual[s["source"]] = dual[s["source"]] - step
    return {s: (float(a), float(b)) for s, (a, b) in dual.items()}


def _step(g0: float, g1: float, h0: float, h1: float, h2: float, goal: float) -> np.ndarray | None:
    """A bounded Newton step from the sums of rates and slopes; null where the tokens are close to the goal."""
    off = np.array([g0 - goal, g1 - goal])
    if abs(off[1]) <= CLOSE * goal:
        return None
    hess = np.array([[h0, h1], [h1, h2]])
    hess += np.eye(2) * 1e-9 * np.trace(hess)
    step = np.linalg.solve(hess, off)
    return step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))


def _coarse_dual(bins: np.ndarray, cap: float, goal: float) -> np.ndarray:
    """Where the iterations over all rows begin: the solution over bins (documents, mean length) of one source."""
    dual, (c, x) = np.zeros(2), bins.T
    for _ in range(STEPS):
        r = cap / (1 + np.exp(-np.clip(dual[0] + dual[1] * x, -500, 500)))
        slope = r * (1 - r / cap)
        step = _step((c * r).sum(), (c * r * x).sum(), (c * slope).sum(), (c * slope * x).sum(), (c * slope * x * x).sum(), goal)
        if step is None:
            break
        dual = dual - step
    return dual if np.isfinite(dual).all() else np.zeros(2)


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``rate`` and ``copies`` of every document.

    ``docs`` has ``doc_id``, ``source`` and ``n_tokens``; ``targets`` has ``source``, ``target_share`` and ``max_repeats``
    and one row a source (it is collected: a list of settings that does not grow with the data). Sources are compared
    trimmed and in lower case.

    Rates come from :func:`balance`. Copies are the rate rounded down or up by a hash of ``doc_id`` against a threshold
    that is set for each source so that its tokens come near to the goal; what is then short is filled up with documents
    behind the threshold whose sizes fit (see :func:`_fill`). No document has more copies than ``max_repeats``. Documents without tokens, of a null source or of one without target have rate and copies 0. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
        .alias("n_tokens")))
    aims = [(r["source"], float(r["share"]), int(r["cap"])) for r in targets.groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        .filter("source is not null and share is not null and cap is not null").orderBy("source").collect()]
    known = spark.createDataFrame([(s,) for s, _, _ in aims], "source string")
    sizes = cut_lineage(sized.filter("n_tokens > 0").join(F.broadcast(known), "source").groupBy("source", "n_tokens").count())
    sums = {r["source"]: (r["tokens"], r["docs"]) for r in sizes.groupBy("source")
        .agg(F.sum(F.col("n_tokens") * F.col("count")).alias("tokens"), F.sum("count").alias("docs")).collect()}
    held, number = {s: v[0] for s, v in sums.items()}, {s: v[1] for s, v in sums.items()}
    wanted = goals(aims, held, total)
    dual = balance(sizes, wanted, held, number)

    rows = [(g.source, float(g.cap), *(dual.get(g.source, (0.0, 0.0))), held[g.source] / number[g.source], g.full) for g in wanted]
    solved = F.broadcast(spark.createDataFrame(rows, "source string, cap double, level double, tilt double, mean double, full boolean"))
    tilted = F.when(F.col("full"), F.col("cap")).otherwise(_rate(F.col("level"), F.col("tilt"), F.col("n_tokens") / F.col("mean"), F.col("cap")))
    rated = sized.join(solved, "source", "left").withColumn("rate", F.when((F.col("n_tokens") > 0) & F.col("cap").isNotNull(), tilted).otherwise(0.0))
    low = F.least(F.floor("rate"), F.col("cap").cast("bigint"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = rated.withColumn("low", F.coalesce(low, F.lit(0))).withColumn("z", chance - (F.col("rate") - F.col("low"))).withColumn("may",
        (F.col("low") < F.col("cap")) & (F.col("rate") > F.col("low")))
    rated = cut_lineage(rated.drop("level", "tilt", "mean", "full"))
    edges, short = _thresholds(rated, {g.source: g.tokens for g in wanted})
    cut = F.broadcast(spark.createDataFrame([(s, float(e), float(short[s])) for s, e in edges.items()], "source string, edge double, short double"))
    rated = rated.join(cut, "source", "left")
    behind = rated.filter("may and z >= edge")
    picks = [(s, size, n) for s, sizes in _fill(behind, short).items() for size, n in sizes]
    up = F.coalesce(F.col("may") & (F.col("z") < F.col("edge")), F.lit(False))
    if picks:
        chosen = F.broadcast(spark.createDataFrame(picks, "source string, n_tokens bigint, most int"))
        place = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("z", "doc_id"))
        extra = behind.join(chosen, ["source", "n_tokens"]).withColumn("place",
            place).filter((F.col("place") <= max(n for *_, n in picks)) & (F.col("place") <= F.col("most"))).select(F.col("doc_id").alias("_id"),
                F.lit(True)
            .alias("_extra"))
        rated = rated.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        up = up | F.coalesce("_extra", F.lit(False))
    return rated.select("doc_id", "source", "n_tokens", "rate", (F.col("low") + up.cast("bigint")).cast("int").alias("copies"))


def _thresholds(rated: DataFrame, goal: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """For each source, where to cut ``z`` so that the tokens come near to the goal without exceeding it, and how many are
    then short: sums by bins, then within one bin."""
    spark = rated.sparkSession
    base = {r["source"]: r["t"] for r in rated.filter("cap is not null").groupBy("source").agg(F.sum(F.col("low") * F.col("n_tokens")).alias("t"))
        .collect()}
    span = {s: (-1.0, 2.0 / BINS) for s in goal}
    left = {s: goal[s] - base.get(s, 0) for s in goal}
    edges = dict.fromkeys(goal, 0.0)
    for last in (False, True):
        bounds = F.broadcast(spark.createDataFrame([(s, lo, w) for s, (lo, w) in span.items()], "source string, lo double, w double"))
        binned = rated.filter("may").join(bounds, "source").withColumn("bin", F.floor((F.col("z") - F.col("lo")) / F.col("w"))).filter(F.col("bin")
            .between(0, BINS - 1))
        found: dict[str, np.ndarray] = {s: np.zeros(BINS) for s in goal}
        for r in binned.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).collect():  # sources times bins at most
            found[r["source"]][r["bin"]] = r["t"]
        for s, (lo, w) in span.items():
            through = np.concatenate([[0.0], np.cumsum(found[s])])
            k = int(np.clip(np.searchsorted(through, left[s] + 1e-6, "right") - 1, 0, BINS if last else BINS - 1))
            left[s] -= through[k]
            edges[s], span[s] = lo + k * w, (lo + k * w, w / BINS)
    return edges, left


def _fill(behind: DataFrame, short: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """For each source, (size, documents) of those ``behind`` the threshold that make up for the tokens that are ``short``.

    Greedy by falling size, then one more document if that comes nearer. The sizes come from a histogram of the documents
    that are not larger than twice what is short: of each power of two the ``SIZES`` most frequent sizes.
    """
    place = F.row_number().over(Window.partitionBy("source", F.floor(F.log2("n_tokens"))).orderBy(F.desc("count"), "n_tokens"))
    usable = behind.filter((F.col("short") >= 0.5) & (F.col("n_tokens") <= 2 * F.col("short"))).groupBy("source", "n_tokens").count()
    have: dict[str, dict[int, int]] = {}
    for r in usable.withColumn("place", place).filter(F.col("place") <= SIZES).collect():  # sources times 64 powers times SIZES at most
        have.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    out = {}
    for s, sizes in have.items():
        rest, taken = short[s], {}
        for size in sorted(sizes, reverse=True):
            if n := min(sizes[size], int(rest // size)):
                taken[size] = n
                rest -= n * size
        one = min((z for z in sizes if sizes[z] > taken.get(z, 0)), key=lambda z: (abs(z - rest), z), default=None)
        if one is not None and abs(one - rest) < rest:
            taken[one] = taken.get(one, 0) + 1
        out[s] = sorted(taken.items())
    return out


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``documents`` and ``tokens`` held, ``copies``, ``mixed_tokens``, ``actual_share`` and ``target_share``.

    Sources of the targets without documents, and sources without target (null too), have their row.
    """
    have = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    aim = targets.groupBy(source_name(F.col("source")).alias("s")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats")
        .alias("max_repeats"))
    both = have.join(aim, F.col("source").eqNullSafe(F.col("s")), "full_outer")
    whole = mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.when(F.col("whole") > 0, F.coalesce(F.col("mixed_tokens"), F.lit(0)) / F.col("whole")).otherwise(0.0)
    return both.join(F.broadcast(whole)).select(F.coalesce("source", "s").alias("source"), zero("documents"), zero("tokens"), zero("copies"),
        zero("mixed_tokens"), share.alias("actual_share"), "target_share", "max_repeats")
