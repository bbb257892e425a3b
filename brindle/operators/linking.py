"""Linking of records across languages, near-matching names, and checks of a table's integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import LANGUAGE_ONLY, folded_term


def match_candidates(term: Column) -> Column:
    """The whole term, then its alternatives joined by or, ou or commas."""
    fixed = term.contains("Version") | term.contains("version only")
    parts = F.filter(F.transform(F.split(term, r"(?i)\s+(?:or|ou)\s+|,\s*"), F.trim), lambda p: (p != "") & (p != term))
    return F.when(fixed, F.array(term)).otherwise(F.concat(F.array(term), parts))


def link_terms(terms: DataFrame) -> DataFrame:
    """``id``, ``linked_id``, ``pass``: three passes of pairing terms of the two languages.

    ``terms``: ``id``, ``language`` (en, fr), ``doc`` (the same for both languages), ``section``, ``term``, ``paired_term``.
    Pass 1 matches a candidate of the paired term in the same document and section (the first candidate wins, of equal
    targets the greatest id); pass 2 in the same document where both folded terms are unique in document and language;
    pass 3 pairs what is left without a paired term where a section has exactly one term in each language. Markers that a
    term has no translation are skipped. Null documents or sections match nothing.
    """
    base = terms.select("id", "language", "doc", "section", folded_term(F.col("term")).alias("norm"), F.trim("paired_term").alias("paired"))
    base = base.withColumn("other", F.when(F.col("language") == "en", "fr").otherwise("en"))
    only = F.coalesce(F.col("paired").rlike(LANGUAGE_ONLY), F.lit(False))
    told = base.filter(F.col("paired").isNotNull() & (F.col("paired") != "") & ~only)
    tried = told.select("id", "other", "doc", "section", F.posexplode(match_candidates(F.col("paired")))
        .alias("place", "candidate")).withColumn("key", folded_term(F.col("candidate"))).filter("key <> ''")
    target = base.groupBy(F.col("language").alias("tl"), F.col("doc").alias("td"), F.col("section").alias("ts"), F.col("norm")
        .alias("tn")).agg(F.max("id").alias("linked_id"))
    first = tried.join(target, (F.col("other") == F.col("tl")) & (F.col("doc") == F.col("td")) & (F.col("section") == F.col("ts"))
        & (F.col("key") == F.col("tn")))
    pass1 = first.groupBy("id").agg(F.min_by("linked_id", "place").alias("linked_id")).withColumn("pass", F.lit(1))

    unique = base.groupBy("language", "doc", "norm").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("uid")).filter("n = 1")
    single_source = told.join(unique.select(F.col("uid")), F.col("id") == F.col("uid"), "left_semi").join(pass1, "id", "left_anti").withColumn("key",
        folded_term(F.col("paired")))
    pool = unique.select(F.col("language").alias("tl"), F.col("doc").alias("td"), F.col("norm").alias("tn"), F.col("uid").alias("linked_id"))
    pass2 = single_source.join(pool, (F.col("other") == F.col("tl")) & (F.col("doc") == F.col("td")) & (F.col("key") == F.col("tn"))).select("id",
        "linked_id").withColumn("pass", F.lit(2))

    done = pass1.unionByName(pass2)
    quiet = base.filter(F.col("paired").isNull() | (F.col("paired") == "")).join(done, "id",
        "left_anti").filter("doc is not null and section is not null")
    count = lambda code: F.count_if(F.col("language") == code)
    alone = quiet.groupBy("doc", "section").agg(count("en").alias("en"), count("fr").alias("fr"),
        F.max(F.when(F.col("language") == "en", F.col("id"))).alias("a"), F.max(F.when(F.col("language") == "fr", F.col("id")))
        .alias("b")).filter("en = 1 and fr = 1")
    pass3 = alone.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("linked_id")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("linked_id")))).alias("p")).select("p.*").withColumn("pass", F.lit(3))
    return done.unionByName(pass3)


#: Names are cut into pieces of ``PIECE_CHARS`` characters; longer ones where that gives over ``PIECES`` pieces, shorter ones in short names.
PIECES, PIECE_CHARS = 12, 4


def near_matches(df: DataFrame, id_col: str, group: str, name: str, most: int = 3) -> DataFrame:
    """Pairs of different names of a group within a small edit distance: the group, ``name_a``, ``name_b``, ``distance``.

    Names of five letters and more, of about the same length; the distance may be a quarter of the first name's length, 2 at
    least and ``most`` at most. Names are reduced to distinct ones first.

    With ``k`` edits at most, the shorter name is cut into pieces of one length and its ``k + 1`` rarest are looked up, so that
    a beginning that many names share is no hot key. Of these, one stands whole in the longer name, the one at place ``i``
    (from 0) with ``i`` edits before it and ``k - i`` at most behind: it has moved by ``i`` characters at most, and by all but
    ``k - i`` of those by which the names' lengths differ. Only names that share such a piece are compared.

    Both sides of a join are many rows a name, of which Spark's estimates know nothing: they are merged, never broadcast.
    """
    names = df.select(F.col(group).alias("g"), F.lower(name).alias("s")).filter("length(s) >= 5").distinct()
    size = F.length("s")
    edits = lambda n: F.greatest(F.lit(2), F.least(F.lit(most), F.floor(n / 3))).cast("int")  # noqa: E731  # from a quarter of n + edits
    chars = lambda n: F.floor(n / F.greatest(edits(n) + 1, F.least(F.lit(PIECES), F.floor(n / PIECE_CHARS)))).cast("int")
    piece = F.substring(F.col("s"), F.col("at") + 1, F.col("q"))
    cut = names.withColumn("len", size).withColumn("q", chars(size)).withColumn("at",
        F.explode(F.sequence(F.lit(0), size - F.col("q"), F.col("q")))).withColumn("piece", piece)
    often = cut.groupBy("g", "len", "at", "piece").agg(F.count(F.lit(1)).alias("often")).hint("merge")
    some = cut.join(often, ["g", "len", "at", "piece"]).groupBy("g", "s").agg(F.sort_array(F.collect_list(F.struct("often", "at",
        "piece"))).alias("all"))  # a dozen or so a name
    k, i, more = edits(size), F.col("i"), F.col("more")
    rarest = F.array_sort(F.transform(F.slice("all", F.lit(1), k + 1), lambda x: F.struct(x["at"].alias("lo"), x["piece"].alias("piece"))))
    short = some.select("g", "s", F.posexplode(rarest).alias("i", "x")).withColumn("more", F.explode(F.sequence(F.lit(0), k))).withColumn("moved",
        F.explode(F.sequence(F.greatest(-i, more + i - k), F.least(i, more + k - i)))).select("g", chars(size).alias("q"),
        (size + more).alias("len"), (F.col("x.lo") + F.col("moved")).alias("at"), F.col("x.piece").alias("piece"), "s").filter("at >= 0")
    lengths = F.array_distinct(F.transform(F.sequence(F.greatest(F.lit(5), size - most), size), chars))
    long_ = names.withColumn("len", size).withColumn("q", F.explode(lengths)).withColumn("at",
        F.explode(F.sequence(F.lit(0), size - F.col("q")))).select("g", "q", "len", "at", piece.alias("piece"), F.col("s").alias("t"))
    pairs = short.join(long_.hint("merge"), ["g", "q", "len", "at", "piece"]).filter((F.col("s") != F.col("t"))
        & ((F.length("s") < F.length("t")) | (F.col("s") < F.col("t")))).select("g", "s", "t").distinct()
    both = pairs.withColumn("distance", F.levenshtein("s", "t", most)).withColumn("name_a", F.least("s", "t")).withColumn("name_b",
        F.greatest("s", "t"))
    allowed = F.greatest(F.least(F.lit(most), F.floor(F.length("name_a") / 4)), F.lit(2))
    return both.filter(F.col("distance").between(0, allowed)).select(F.col("g").alias(group), "name_a", "name_b", "distance")


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct keys of ``child`` that ``parent`` lacks, with how many rows use them; null keys do not count."""
    used = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(parent, used["key"] == parent[parent_key], "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def sequence_breaks(df: DataFrame, group: str, order: list[str], value: str, stretch: Column | None = None) -> DataFrame:
    """Rows whose ``value`` does not exceed the one before in the group, with that as ``before``.

    ``stretch`` cuts a group into parts that follow each other in ``order`` (the day of a time), so that no task sorts a
    whole group; the last value of a part is carried into the next one.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(group).alias("_g"),
        (F.lit(0) if stretch is None else stretch).alias("_s"), F.struct(*order).alias("_o"), F.col(value).alias("_v"))
    inner = Window.partitionBy("_g", "_s").orderBy("_o")
    placed = rows.withColumn("_b", F.lag("_v").over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    ends = rows.groupBy("_g", "_s").agg(F.max_by("_v", "_o").alias("_end"))
    carried = ends.select(F.col("_g").alias("_eg"), F.col("_s").alias("_es"), F.lag("_end").over(Window.partitionBy("_g").orderBy("_s"))
        .alias("_into"))
    joined = placed.join(carried, F.col("_g").eqNullSafe(F.col("_eg")) & F.col("_s").eqNullSafe(F.col("_es")), "left")
    return joined.withColumn("before", F.when(F.col("_first"), F.col("_into"))
        .otherwise(F.col("_b"))).filter(F.col("_v") <= F.col("before")).select("_row.*", "before")


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """How many rows break each named rule (a rule that is null is not broken), in one pass."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("rows")) for name in rules])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


