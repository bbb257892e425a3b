"""Operators on ranked candidate lists: ``list_id``, ``rank`` (from 1), ``source_type``, ``similarity`` and other columns.

Every list is the bounded result of a search, so that a list fits one task; lists are spread by ``list_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# filters' constants, boosts, and source types by intent (first, then, how many of the latter).
RATIO, FLOOR, KEEP, GAP = 0.7, 0.05, 3, 0.05
SLOTS = {
    "bill_focused": (["bill", "vote_question"], ["hansard", "committee"], 2),
    "vote_focused": (["vote_question", "vote_member", "vote_party", "bill"], ["hansard"], 1),
    "mp_statement": (["hansard", "politician", "riding"], ["bill", "vote_question"], 2),
    "mp_info": (["politician", "riding", "party"], [], 0),
    "committee_focused": (["committee", "committee_report", "committee_meeting"], ["bill"], 2),
}
ALLOWED = {
    "bill_focused": ["bill", "vote_question"],
    "vote_focused": ["vote_question", "vote_party", "vote_member", "bill"],
    "mp_statement": ["hansard", "politician"],
    "mp_info": ["politician", "riding", "party"],
    "committee_focused": ["committee", "committee_report", "committee_meeting"],
    "general": None,
}


def by_list():
    return Window.partitionBy("list_id")


def in_order():
    return by_list().orderBy("rank")


def reranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rank`` again from 1 in the given order."""
    return df.withColumn("rank", F.row_number().over(by_list().orderBy(*order)))


def dedup_first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key of a list, ranks closed up."""
    first = F.row_number().over(Window.partitionBy("list_id", *keys).orderBy("rank"))
    return reranked(df.withColumn("_first", first).filter("_first = 1").drop("_first"), F.col("rank"))


def dedup_best(df: DataFrame, *keys: str) -> DataFrame:
    """The most similar row of each key, of equals the first; in order of similarity."""
    best = F.row_number().over(Window.partitionBy("list_id", *keys).orderBy(F.desc("similarity"), "rank"))
    return reranked(df.withColumn("_best", best).filter("_best = 1").drop("_best"), F.desc("similarity"), F.col("rank"))


def score_gaps(df: DataFrame) -> DataFrame:
    """``gap``: similarity less that of the next row; null in the last."""
    return df.withColumn("gap", F.col("similarity") - F.lead("similarity").over(in_order()))


def natural_cutoff(df: DataFrame, least: int = KEEP, gap: float = GAP) -> DataFrame:
    """Rows up to the list's largest gap from row ``least`` on, if that exceeds ``gap``; all rows else. Of equal gaps the first."""
    eligible = F.when((F.col("rank") >= least) & F.col("gap").isNotNull(), F.struct(F.col("gap"), (-F.col("rank")).alias("r")))
    cut = score_gaps(df).withColumn("_top", F.max(eligible).over(by_list()))
    keep = F.col("_top").isNull() | (F.col("_top.gap") <= gap) | (F.col("rank") <= -F.col("_top.r"))
    return cut.filter(keep).drop("_top", "gap")


def adaptive_filter(df: DataFrame, ratio: float = RATIO, floor: float = FLOOR, keep: int = KEEP) -> DataFrame:
    """Rows of at least ``ratio`` times the first row's similarity (and ``floor``); the first ``keep`` if fewer remain."""
    top = F.first("similarity").over(in_order())
    marked = df.withColumn("_in", F.col("similarity") >= F.greatest(top * ratio, F.lit(floor)))
    marked = marked.withColumn("_n", F.count_if("_in").over(by_list())).withColumn("_all", F.count(F.lit(1)).over(by_list()))
    few = F.col("_n") < F.least(F.lit(keep), F.col("_all"))
    return reranked(marked.filter(F.when(few, F.col("rank") <= keep).otherwise(F.col("_in"))).drop("_in", "_n", "_all"), F.col("rank"))


def smart_filter(df: DataFrame) -> DataFrame:
    return natural_cutoff(adaptive_filter(df))


def balance(df: DataFrame, limit: int, ratio: float = 0.4) -> DataFrame:
    """At most a share of ``limit`` per source type, in order; places left over go to the rows that were passed over."""
    place = F.row_number().over(Window.partitionBy("list_id", "source_type").orderBy("rank"))
    over = df.withColumn("_over", (place > int(limit * ratio)).cast("int"))
    return reranked(over, F.col("_over"), F.col("rank")).filter(F.col("rank") <= limit).drop("_over")


def slots(df: DataFrame, primary: list[str], secondary: list[str], cap: int, limit: int) -> DataFrame:
    """Primary types first, then up to ``cap`` of the secondary ones, then the rest of both; other types are left out."""
    if not primary:
        return balance(df, limit)
    kind = F.when(F.col("source_type").isin(primary), 0).when(F.col("source_type").isin(secondary), 1)
    own = df.withColumn("_kind", kind).filter("_kind is not null")
    place = F.row_number().over(Window.partitionBy("list_id", "_kind").orderBy("rank"))
    bucket = F.when(F.col("_kind") == 0, F.when(place <= max(0, limit - cap), 0).otherwise(2)).otherwise(F.when(place <= cap, 1).otherwise(3))
    ordered = reranked(own.withColumn("_bucket", bucket), F.col("_bucket"), F.col("rank"))
    return ordered.filter(F.col("rank") <= limit).drop("_kind", "_bucket")


def diversify(results: DataFrame, candidates: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """``results`` followed by the best unseen candidates of each type that has fewer than ``least`` rows there.

    Added rows get 0.9 times the last result's similarity, at least 0.1; types come in the order of their first candidate.
    """
    columns = results.columns
    have = results.groupBy("list_id", "source_type").agg(F.count(F.lit(1)).alias("_have"))
    tail = results.groupBy("list_id").agg(F.max("rank").alias("_len"), F.max_by("similarity", "rank").alias("_last"))
    entry = F.min("rank").over(Window.partitionBy("list_id", "source_type"))
    unseen = dedup_first(candidates.withColumn("_entry", entry), *keys).join(results.select("list_id", *keys), ["list_id", *keys], "left_anti")
    place = F.row_number().over(Window.partitionBy("list_id", "source_type").orderBy("rank"))
    extra = unseen.withColumn("_place", place).join(have, ["list_id", "source_type"],
        "left").filter(F.col("_place") <= least - F.coalesce(F.col("_have"), F.lit(0)))
    extra = extra.join(tail, "list_id", "left").withColumn("similarity", F.greatest(F.coalesce(F.col("_last"), F.lit(0.0)) * 0.9, F.lit(0.1)))
    extra = reranked(extra, F.col("_entry"), F.col("rank")).withColumn("rank", F.col("rank") + F.coalesce(F.col("_len"), F.lit(0)))
    return results.unionByName(extra.select(*columns))


def heuristic_scores(df: DataFrame, lang: Column, factual: Column, says_debate: Column, says_committee: Column, date: Column) -> DataFrame:
    """Similarity with small boosts for language, first chunks of factual questions, named source kinds and recent dates."""
    boost = lambda when, by: F.when(F.coalesce(when, F.lit(False)), by).otherwise(0.0)
    committee = F.col("source_type").isin("committee", "committee_report", "committee_meeting")
    total = F.col("similarity") + boost(F.col("language") == lang, 0.12) + boost(factual & (F.col("chunk_index") == 0), 0.03) + boost(says_debate
        & (F.col("source_type") == "hansard"), 0.03) + boost(says_committee & committee, 0.03) + boost(date >= "2022-01-01", 0.01)
    return reranked(df.withColumn("similarity", F.round(total, 6)), F.desc("similarity"), F.col("rank"))


def rerank_pipeline(candidates: DataFrame, keys: list[str], limit: int, intent: str = "general", scorer: Column | None = None) -> DataFrame:
    """First-wins dedup, scores (``scorer``, else the similarity), best ``3 * limit``, diversity, slots of the intent, filter."""
    unique = dedup_first(candidates, *keys)
    scored = unique if scorer is None else reranked(unique.withColumn("similarity", scorer), F.desc("similarity"), F.col("rank"))
    out = diversify(scored.filter(F.col("rank") <= 3 * limit), scored, keys)
    if intent != "general":
        out = slots(out, *SLOTS[intent], limit * 2)
    return adaptive_filter(out, floor=0.1).filter(F.col("rank") <= limit)


def top_per_type(df: DataFrame, usable: Column) -> DataFrame:
    """The first usable row of each source type."""
    first = F.row_number().over(Window.partitionBy("list_id", "source_type").orderBy("rank"))
    return df.filter(usable).withColumn("_first", first).filter("_first = 1").drop("_first")


def top_per_type_of_document(df: DataFrame, types: list[str], owners: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """The first usable row of each of ``types``; a row of a document's type must name it.

    ``owners``: for each column that names a document, the type that a row made up for it has, and all types that show it.
    Where a list shows none of those but some row names a document, the first such row stands for it, as that type.
    """
    usable = F.col("source_type").isin(types)
    for column, (_, own) in owners.items():
        usable = usable & (~F.col("source_type").isin(own) | F.col(column).isNotNull())
    out = top_per_type(df, F.coalesce(usable, F.lit(False)))
    for column, (made, own) in owners.items():
        shown = out.filter(F.col("source_type").isin(own)).select("list_id").distinct()
        first = F.row_number().over(in_order())
        named = df.filter(F.col(column).isNotNull()).withColumn("_first", first).filter("_first = 1").drop("_first")
        out = out.unionByName(named.join(shown, "list_id", "left_anti").withColumn("source_type", F.lit(made)))
    return out


def boosted_merge(definitions: DataFrame, sections: DataFrame, limit: int, boost: float = 0.15) -> DataFrame:
    """Definitions with a boost (1 at most) together with sections, best of each resource, in order."""
    lifted = definitions.withColumn("similarity", F.least(F.lit(1.0), F.col("similarity") + boost))
    both = lifted.withColumn("_side", F.lit(0)).unionByName(sections.withColumn("_side", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("list_id", "resource_id").orderBy(F.desc("similarity"), "_side"))
    kept = both.withColumn("_best", best).filter("_best = 1")
    return reranked(kept, F.desc("similarity"), F.col("resource_id")).filter(F.col("rank") <= limit).drop("_best", "_side")


def citations(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """One row per different snippet (first wins, letter case aside) with ``snippet`` and dense ids such as P1."""
    cut = df.withColumn("snippet", text)
    first = F.row_number().over(Window.partitionBy("list_id", F.lower("snippet")).orderBy("rank"))
    kept = reranked(cut.withColumn("_first", first).filter("_first = 1").drop("_first"), F.col("rank"))
    return kept.withColumn("citation_id", F.concat(F.lit(prefix), F.col("rank").cast("string")))
