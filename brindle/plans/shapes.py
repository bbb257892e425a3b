"""Queries on filters, joins, aggregates, scalars and bookkeeping that the other plans leave out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import checks as ck
from brindle.functions import jsonb as js
from brindle.functions import provisions as pv
from brindle.functions import text as tx
from brindle.functions.keys import norm_key, standing
from brindle.operators import linking as ln
from brindle.operators import ranking as rk
from brindle.operators import records as rec
from brindle.operators import relational as rel
from brindle.operators.diff import diff_copies
from brindle.plans.data_quality import _sql_key
from brindle.plans.retrieval import _lists, candidates
from brindle.sources import loading
from brindle.streaming.messages import recent
from brindle.tables import TABLES, load


def _latest_resources(spark: SparkSession, base: str) -> DataFrame:
    return standing(load(spark, base, "leg_resources").select("id", "updated_at", "language", "source_type", "metadata"), ["id"], "updated_at")


def array_filters(spark: SparkSession, base: str) -> DataFrame:
    """Resources with amendments, or one of some citation, or of a kind that covers the whole document."""
    meta = F.col("metadata")
    cited = js.has_element(meta, "recentAmendments", "2021, c. 25, s. 198", "citation")
    wide = F.col("source_type").isin("act", "regulation") | cited
    r = _latest_resources(spark, base).select("id", js.array_length(meta, "recentAmendments").alias("amendments"), cited.alias("cited"),
        wide.alias("wide"))
    return r.filter((F.col("amendments") > 0) | F.col("wide"))


def json_containment(spark: SparkSession, base: str) -> DataFrame:
    """Resources whose metadata contain some members."""
    return _latest_resources(spark, base).filter(js.contains(F.col("metadata"), {"language": "fr", "targetType": "act", "chunkIndex": 0})).select(
        "id", "source_type")


def json_members(spark: SparkSession, base: str) -> DataFrame:
    """Metadata with a member set: the model's version, read again with the other members."""
    r = _latest_resources(spark, base).select("id", js.with_member(F.col("metadata"), "embeddingVersion", F.lit('v"2')).alias("m"), F.col("metadata")
        .alias("old"))
    get = lambda c, name: F.get_json_object(c, f"$.{name}")
    return r.select("id", get("m", "embeddingVersion").alias("version"), get("m", "sourceType").alias("kind"), get("m", "documentTitle")
        .eqNullSafe(get("old", "documentTitle")).alias("same_title"))


def json_array_explode(spark: SparkSession, base: str) -> DataFrame:
    """Each amendment of a resource with its place, citation's parts and date."""
    r = _latest_resources(spark, base).select("id", F.posexplode(js.array_at(F.col("metadata"), "recentAmendments")).alias("pos", "x"))
    get = lambda name: F.try_variant_get("x", f"$.{name}", "string")
    parts = r.select("id", "pos", get("citation").alias("citation"), get("date").alias("day")).withColumn("a", ck.amendment(F.col("citation")))
    return parts.select("id", "pos", "citation", "a.year", "a.chapter", "a.section", "day")


def json_equality(spark: SparkSession, base: str) -> DataFrame:
    """Whether two JSON texts of a document are equal: members in another order, null members aside."""
    d = load(spark, base, "documents").select("doc_id", F.to_json(F.struct("lang", "source")).alias("a"),
        F.to_json(F.struct("source", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("lang"))).alias("b"))
    return d.select("doc_id", pv.comparable_json("a").eqNullSafe(pv.comparable_json("b")).alias("equal"))


def entity_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Each act in French, else in English."""
    acts = load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id",
        "title").filter("key is not null and language in ('en', 'fr')")
    return rel.preferred(standing(acts, ["key", "language"], "updated_at", "id"), ["key"], F.col("language") == "fr", "language").select("key",
        "language", "title")


def valid_inputs(spark: SparkSession, base: str) -> DataFrame:
    """Which ids, labels and languages of resources are valid, and their numbers."""
    r = _latest_resources(spark, base)
    get = lambda name: F.get_json_object("metadata", f"$.{name}")
    return r.select("id", ck.valid_act_id(get("actId")).alias("act"), ck.valid_regulation_id(get("regulationId")).alias("regulation"),
        ck.valid_label(get("sectionLabel")).alias("label"), ck.valid_language(F.col("language")).alias("language"),
        ck.positive_integer(get("sectionLabel")).alias("number"))


WANTED = ["SOR-2017-2", "SI-78-259", "SOR-2001-1"]


def instrument_ids(spark: SparkSession, base: str) -> DataFrame:
    """Instruments' numbers as ids, keys and names of files, and those asked for, in whatever form."""
    r = load(spark, base, "regulations").select("id", "instrument_number").distinct().filter("instrument_number is not null")
    own = ck.regulation_id(F.col("instrument_number"))
    return r.select("id", own.alias("regulation_id"), ck.alpha_number(F.col("instrument_number")).alias("alpha"),
        ck.file_name(F.col("instrument_number")).alias("file"), own.isin([w for w in WANTED]).alias("wanted")).distinct()


def cache_keys(spark: SparkSession, base: str) -> DataFrame:
    """Keys of cached searches for the documents as queries."""
    d = load(spark, base, "documents").filter("text is not null")
    return d.select("doc_id", ck.cache_key("bill", F.col("text"), F.col("lang"), 0.4, ck.clamped(500), billNumber=tx.bill_number(F.col("text")))
        .alias("key"))


def cached_values(spark: SparkSession, base: str) -> DataFrame:
    """Each user's last event as a cached value that holds for two days, seen at one moment."""
    e = load(spark, base, "events").select("user_id", "ts", "event_id", "value")
    return loading.cached(e, "user_id", "ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 172_800)


def event_lines(spark: SparkSession, base: str) -> DataFrame:
    return loading.event_lines(load(spark, base, "events"), F.concat(F.lit("data-"), F.col("event_type")), "event_id", "user_id")


def replayed_events(spark: SparkSession, base: str) -> DataFrame:
    """Events of the last hours before a moment."""
    return recent(load(spark, base, "events").select("event_id", "ts"), "ts", "2024-01-30 00:00:00", 36_000)


def display_dates(spark: SparkSession, base: str) -> DataFrame:
    """Day and time of statements as text, and dates from parts of which some are missing."""
    h = load(spark, base, "hansards_statement").select("id", "statement_time").distinct()
    part = lambda f, every: F.when(F.col("id") % every > 0, F.date_format("statement_time", f))
    return h.select("id", F.date_format("statement_time", "yyyy-MM-dd").alias("day"), F.date_format("statement_time", "HH:mm").alias("time"),
        ck.date_of_parts(part("yyyy", 7), F.col("id").cast("string").substr(1, 1), part("dd", 3)).alias("from_parts")).distinct()


def term_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Words of English titles with those of the French ones at their place, or with the only one."""
    acts = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id", "title"),
        ["key", "language"], "updated_at", "id").filter("key is not null")
    side = lambda code: F.max(F.when(F.col("language") == code, F.col("title")))
    both = acts.groupBy("key").agg(side("en").alias("en"), side("fr").alias("fr")).filter("en is not null and fr is not null")
    few = F.when(F.length("key") % 2 == 0, F.slice(F.split("fr", " "), 1, 1)).otherwise(F.split("fr", " "))
    return both.select("key", F.explode(ck.paired(F.split("en", " "), few)).alias("p")).select("key", "p.*")


def provision_scopes(spark: SparkSession, base: str) -> DataFrame:
    """What wordings made from resources cover, with the sections that they name."""
    r = _latest_resources(spark, base).select("id", F.length("metadata").alias("n"), F.get_json_object("metadata", "$.sectionLabel").alias("label"))
    n = F.col("n") % 50 + 1
    words = F.when(F.col("n") % 4 == 0, "In this Act,").when(F.col("n") % 4 == 1,
        F.format_string("The definitions apply in this section and in sections %d to %d.", n, n + 3)).when(F.col("n") % 4 == 2,
        F.format_string("apply in sections %d to %d", n, n + 1)).otherwise("dans la présente partie")
    return r.select("id", pv.scope(words, F.col("label")).alias("s")).select("id", "s.kind", F.array_join("s.sections", ",").alias("sections"))


def corrected_titles(spark: SparkSession, base: str) -> DataFrame:
    """Titles with their language's corrections, each in the letter case of what it replaces."""
    acts = load(spark, base, "acts").select("id", "language", "title").distinct().filter("title is not null")
    fixes = {"en": [("act", "statute"), ("levy", "duty")], "fr": [("loi", "texte")]}
    return acts.select("id", pv.corrected(F.col("language"), F.col("title"), fixes).alias("title")).distinct()


def top_orders(spark: SparkSession, base: str) -> DataFrame:
    """The twenty largest orders with customer, nation and region where they are known."""
    o, c, n, r = (load(spark, base, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r,
        n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.coalesce("c_name", F.lit("Unknown"))
        .alias("customer"), F.coalesce("n_name", F.lit("?")).alias("nation"), "r_name", "o_totalprice")


def line_details(spark: SparkSession, base: str) -> DataFrame:
    """Every line with its order, customer, part and supplier."""
    l, o, c, p, s = (load(spark, base, t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, l["l_partkey"] == p["p_partkey"]).join(s,
        l["l_suppkey"] == s["s_suppkey"])
    return joined.select("l_orderkey", "l_linenumber", "o_orderdate", "c_name", "p_name", "s_name")


def dissenting_lines(spark: SparkSession, base: str) -> DataFrame:
    """Returned lines of urgent orders with their supplier: an equi-join, a semi-join in place of a list, a flag."""
    l, s = load(spark, base, "lineitem"), load(spark, base, "supplier")
    urgent = load(spark, base, "orders").filter("o_orderpriority = '1-URGENT'")
    return l.filter("l_returnflag = 'R'").join(urgent, l["l_orderkey"] == urgent["o_orderkey"], "left_semi").join(s,
        l["l_suppkey"] == s["s_suppkey"]).select("l_orderkey", "l_linenumber", "s_name")


def referenced_acts(spark: SparkSession, base: str) -> DataFrame:
    """References with the English act that they come from: child and parent."""
    x = load(spark, base, "cross_references").select("id", norm_key(F.col("source_act_id")).alias("key"), "source_section_label").distinct()
    acts = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id", "title", "status"),
        ["key", "language"], "updated_at", "id").filter("language = 'en'").drop("id")
    return x.join(acts, "key").select("id", "key", "source_section_label", "title", "status")


def bill_votes(spark: SparkSession, base: str) -> DataFrame:
    """Bills with their votes, also bills without any; results as labels."""
    b = standing(load(spark, base, "bills_bill").select("id", "bill_number", "session_id"), ["id"], None)
    v = standing(load(spark, base, "bills_votequestion").select("id", "bill_id", "vote_number", "result"), ["id"], None).withColumnRenamed("id",
        "vote_id")
    return b.join(v, b["id"] == v["bill_id"], "left").select(b["id"], "bill_number", "session_id", "vote_number",
        tx.label(F.col("result"), tx.RESULTS).alias("outcome"))


def members_in_range(spark: SparkSession, base: str) -> DataFrame:
    """Orders that are open or whose time touches a month, with customer and nation; of several a year the last one."""
    o, c, n = load(spark, base, "orders"), load(spark, base, "customer"), load(spark, base, "nation")
    ended = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 60 days"))
    low, high = F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz")
    open_ = o.select("o_orderkey", "o_custkey", "o_orderdate",
        ended.alias("ended")).filter(rel.overlaps(F.col("o_orderdate"), F.col("ended"), low, high))
    return open_.join(c, open_["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "c_name", "n_name",
        F.col("ended").isNull().alias("current"))


def sorted_members(spark: SparkSession, base: str) -> DataFrame:
    """Titles in the order of a reader: by language, then without regard to accents and letter case; places within stretches
    of names of one first letter plus those before, so that no task sorts a whole language."""
    t = load(spark, base, "acts").filter("title is not null").select("language", "title").distinct()
    named = t.withColumn("folded", tx.folded_term(F.col("title"))).withColumn("stretch", F.left("folded", F.lit(1)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("language").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = named.groupBy("language", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).drop("n")  # a row a letter
    within = F.row_number().over(Window.partitionBy("language", "stretch").orderBy("folded", "title"))
    return named.withColumn("within", within).join(F.broadcast(starts), ["language", "stretch"]).select("language", "title",
        (F.col("within") + F.col("before")).alias("place"))


def act_statistics(spark: SparkSession, base: str) -> DataFrame:
    """English acts with how many resources and regulations name them, 0 without any, and totals over all, listed or not."""
    r = _latest_resources(spark, base).select("source_type",
        *[norm_key(F.get_json_object("metadata", f"$.{m}")).alias(m) for m in ("actId", "enablingActId")])
    sections, regulations = r.filter("source_type = 'act_section' and actId is not null"), r.filter("enablingActId is not null")
    acts = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id"), ["key", "language"],
        "updated_at", "id").filter("language = 'en' and key is not null").select("key")
    counted = rel.zero_filled(acts, "key", sections=(sections, "actId"), regulations=(regulations, "enablingActId"))
    totals = sections.agg(F.count(F.lit(1)).alias("all_sections")).join(regulations.agg(F.count(F.lit(1)).alias("all_regulations")))  # one row each
    return counted.join(F.broadcast(totals))


def stored_totals(spark: SparkSession, base: str) -> DataFrame:
    """Orders whose stored number of lines is ten or more off the lines counted by flag."""
    l = load(spark, base, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == x).alias(x.lower()) for x in "ANR"])
    o = load(spark, base, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 20_000).cast("long").alias("stored"))
    both = o.join(l, o["o_orderkey"] == l["l_orderkey"], "left")
    counted = sum((F.coalesce(F.col(x), F.lit(0)) for x in "anr"), F.lit(0))
    return both.withColumn("counted", counted).filter(F.abs(F.col("stored") - F.col("counted")) >= 10).select("o_orderkey", "stored", "counted")


def categories(spark: SparkSession, base: str) -> DataFrame:
    """Kinds of resources: which of those known are handled, which are in no category."""
    kinds = load(spark, base, "leg_resources").select(F.col("source_type").alias("name"))
    handled = spark.createDataFrame([("act",), ("act_section",), ("regulation",), ("treaty",)], "name string")
    grouped = spark.createDataFrame([("act", "documents"), ("regulation", "documents"), ("defined_term", "terms")], "name string, category string")
    return rec.coverage(kinds, handled, "name").join(F.broadcast(grouped), "name", "left").select("name", "status",
        F.coalesce("category", F.lit("uncategorised")).alias("category"))


def top_of_documents(spark: SparkSession, base: str) -> DataFrame:
    """The first row of each kind in a list; a row made up where a list names an act but shows none."""
    refs = load(spark, base, "documents").select(F.col("doc_id").alias("resource_id"), "act_ref")
    c = candidates(spark, base).join(refs, "resource_id", "left")
    out = rk.top_per_type_of_document(c, ["gazette_notice", "legal_section", "hansard"], {"act_ref": ("legal_section", ["legal_section"])})
    return out.select("list_id", "resource_id", "source_type", "act_ref", "rank")


def mention_checks(spark: SparkSession, base: str) -> DataFrame:
    """Whether texts say what they must, and how large a part of it; which kinds of source they name."""
    must = ["bill", "house", "committee"]
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((F.when(low.contains(m), 1).otherwise(0) for m in must), F.lit(0))
    kinds = F.array_join(F.array_compact(F.array(*[F.when(low.contains(k), k) for k in ("vote", "committee", "session")])), ",")
    return load(spark, base, "documents").select("doc_id", hits.alias("hits"), (hits == len(must)).alias("all_said"), kinds.alias("kinds"))


def verification(spark: SparkSession, base: str) -> DataFrame:
    """Acts against their copy by key and language: missing and unequal fields are errors, extra rows warnings; white space
    aside."""
    side = lambda t: standing(load(spark, base, t).select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at",
        *[F.trim(F.regexp_replace(c, r"\s+", " ")).alias(c) for c in ("title", "status")]), ["key", "language"],
        "updated_at").filter("key is not null")
    d = diff_copies(side("acts"), side("acts_copy"), ["key", "language"], ["title", "status"])
    severity = F.when(F.col("difference") == "missing_in_left", "warning").otherwise("error")
    return d.groupBy("difference", severity.alias("severity")).agg(F.sum("copies").alias("rows"))


RULES = {
    "bills_bill": {"added_not_before_introduced": "added >= introduced", "institution_known": "institution IN ('C', 'S')",
        "number_given": "bill_number IS NOT NULL", "session_form": "session_id LIKE '%-%'"},
    "bills_votequestion": {"number_positive": "vote_number >= 0", "paired_not_negative": "paired_total >= 0",
        "result_known": "result IN ('Y', 'N', 'T')", "day_reasonable": "vote_date BETWEEN DATE '1990-01-01' AND DATE '2030-01-01'"},
    "hansards_statement": {"words_positive": "procedural OR wordcount > 0", "sequence_positive": "sequence >= 0",
        "time_given": "statement_time IS NOT NULL", "text_given": "content_en <> ''"},
    "acts": {"deleted_after_created": "deleted_at IS NULL OR deleted_at >= created_at", "updated_after_created": "updated_at >= created_at",
        "language_known": "language IN ('en', 'fr')", "title_given": "title <> ''"},
    "regulations": {"type_given": "regulation_type IS NOT NULL", "deleted_after_created": "deleted_at IS NULL OR deleted_at >= created_at",
        "gazette_known": "gazette_part IN ('I', 'II', 'III')"},
    "documents": {"chars_true": "n_chars = length(text)", "source_given": "source IS NOT NULL",
        "day_reasonable": "published_on BETWEEN DATE '1990-01-01' AND DATE '2030-01-01'"},
    "message_v2": {"chat_given": "chat_id IS NOT NULL", "role_known": "role IN ('user', 'assistant', 'system')",
        "time_given": "created_at IS NOT NULL"},
}
KEYS = [("acts", ["id"]), ("regulations", ["id"]), ("bills_bill", ["bill_number", "session_id"]),
    ("bills_votequestion", ["session_id", "vote_number"]), ("hansards_statement", ["document_id", "slug"]), ("message_v2", ["id"]),
    ("documents", ["doc_id"])]
FOREIGN = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("abuse_labels", "doc_id", "documents", "doc_id"),
    ("bills_votequestion", "bill_id", "bills_bill", "id"), ("events", "user_id", "customer", "c_custkey")]


def integrity_rules(spark: SparkSession, base: str) -> DataFrame:
    """How many rows break each rule on a table's values."""
    found = [ln.violations(load(spark, base, t), **{name: F.expr(rule) for name, rule in rules.items()})
        .select(F.lit(t).alias("table_name"), "rule", "rows") for t, rules in RULES.items()]
    return reduce(DataFrame.unionByName, found)


def integrity_keys(spark: SparkSession, base: str) -> DataFrame:
    """How many keys occur more than once, and how many keys have no parent."""
    repeated = [ln.repeated_keys(load(spark, base, t), *keys).agg(F.count(F.lit(1)).alias("keys"))
        .select(F.lit(f"{t}({','.join(keys)}) repeated").alias("rule"), "keys") for t, keys in KEYS]
    lost = [ln.missing_parents(load(spark, base, c), k, load(spark, base, p), pk).agg(F.count(F.lit(1)).alias("keys"))
        .select(F.lit(f"{c}.{k} without {p}").alias("rule"), "keys") for c, k, p, pk in FOREIGN]
    return reduce(DataFrame.unionByName, repeated + lost)


def sequence_breaks(spark: SparkSession, base: str) -> DataFrame:
    """Events of a user whose value does not exceed the one before."""
    e = load(spark, base, "events").select("event_id", "user_id", "ts", "value")
    return ln.sequence_breaks(e, "user_id", ["ts", "event_id"], "value", F.date_trunc("day", "ts")).select("event_id", "user_id", "value", "before")


def new_model(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of one model replaced by new ones where there are any."""
    e = load(spark, base, "embeddings").select("vec_id", F.col("label").cast("string").alias("model"), F.col("embedding").cast("array<double>")
        .alias("vector"))
    fresh = e.filter("vec_id % 2 = 0").select("vec_id", F.transform("vector", lambda x: x * 2).alias("vector"))
    return loading.reembed(e, fresh, "vec_id", "2", "next").select("vec_id", "model", F.round(F.element_at("vector", 1), 6).alias("first"))


def named_subset(spark: SparkSession, base: str) -> DataFrame:
    """Acts asked for, regulations made under them, explicit ids; ids that are not known are marked."""
    acts = load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("act_id")).distinct()
    regs = _latest_resources(spark, base).select(norm_key(F.get_json_object("metadata", "$.regulationId")).alias("regulation_id"),
        norm_key(F.get_json_object("metadata", "$.enablingActId")).alias("enabling_act_id")).filter("regulation_id is not null").distinct()
    return loading.resolve_subset(acts, regs, ["D-1", "H-1.2", "NO-SUCH-1"], ["SOR-2017-2", "NO-SUCH-2"])


def _dump(spark: SparkSession, base: str) -> DataFrame:
    """Lines of a dump of three tables, as a database writes them."""
    lines = []
    for k, (table, columns) in enumerate((("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("part", ["p_partkey", "p_name", "p_brand"]),
        ("region", ["r_regionkey", "r_name"]))):
        row = F.concat_ws("\t", *[F.replace(F.coalesce(F.when(F.col(columns[0]) % 5 == 0, None).otherwise(F.col(c)).cast("string") if i else F.col(c)
            .cast("string"), F.lit("\\N")), F.lit(" "), F.lit("\\t")) for i, c in enumerate(columns)])
        own = load(spark, base, table).select(F.struct(F.lit(k).alias("t"), F.lit(1).alias("part"), F.col(columns[0]).cast("long").alias("i"))
            .alias("place"), row.alias("line"))
        edge = lambda part, text: spark.createDataFrame([((k, part, 0), text)], own.schema)  # noqa: B023, E731
        lines += [edge(0, f"COPY public.{table} ({', '.join(columns)}) FROM stdin;"), own, edge(2, "\\.")]
    return reduce(DataFrame.unionByName, lines)


def dump_tables(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the tables that a list keeps, under a schema of their own."""
    rows = loading.dump_rows(_dump(spark, base), "parliament", ["nation", "part"])
    parts = loading.dump_table(rows, "parliament.part", ["p_partkey", "p_name", "p_brand"])
    nations = loading.dump_table(rows, "parliament.nation", ["n_nationkey", "n_name", "n_regionkey"])
    kept = rows.select("table_name").distinct()
    named = lambda df, t: df.select(F.lit(t).alias("table_name"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return named(parts, "parliament.part").unionByName(named(nations, "parliament.nation")).join(kept, "table_name", "left_semi")


def progress_counts(spark: SparkSession, base: str) -> DataFrame:
    """Keys of resources done by kind: how many there are, and how many stay when the French regulations are to be done again."""
    done = load(spark, base, "leg_resources").select("resource_key").distinct()
    kept = loading.without_prefix(done, "resource_key", "regulation:")
    count = lambda df, name: df.groupBy(F.substring_index("resource_key", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias(name))
    again = loading.keys_with_prefix(done, "resource_key", "regulation:").filter(F.col("resource_key").contains(":fr:"))
    return count(done, "keys").join(count(kept, "kept"), "kind", "left").join(count(again, "again"), "kind", "left").na.fill(0)


def table_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Rows and columns of every table."""
    return reduce(DataFrame.unionByName, [load(spark, base, t).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(t).alias("table_name"), "n_rows", F.lit(len(load(spark, base, t).columns)).alias("n_columns")) for t in TABLES])


def date_filters(spark: SparkSession, base: str) -> DataFrame:
    """Orders before, after, on and between days, by their ISO text."""
    o, day = load(spark, base, "orders").select("o_orderkey", "o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd")
    cases = {"before": {"before": "1992-02-01"}, "after": {"after": "1998-07-01"}, "on": {"on": "1995-05-05"},
        "between": {"between": ("1994-01-01", "1994-01-10")}}
    hits = F.filter(F.array(*[F.when(rel.date_condition(day, **case), name) for name, case in cases.items()]), lambda x: x.isNotNull())
    return o.select("o_orderkey", F.explode(hits).alias("filter"))


def law_search(spark: SparkSession, base: str) -> DataFrame:
    """Resources by kind, language and document, newest first, the third page of twenty; with how many there are."""
    r = standing(load(spark, base, "leg_resources").select("id", "updated_at", "language", "source_type", "metadata", "resource_key"), ["id"],
        "updated_at")
    hit = rel.all_of(F.col("source_type").isin("act_section", "act"), F.col("language") == "en", None,
        js.contains(F.col("metadata"), {"language": "en"}))
    found = r.filter(hit)
    page = found.orderBy(F.desc("updated_at"), "id").offset(40).limit(ck.clamped(20)).select("id", "resource_key", "updated_at")
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))  # one row


def latest_vote(spark: SparkSession, base: str) -> DataFrame:
    """Each bill's latest vote in its latest session: a join, then the greatest."""
    b = standing(load(spark, base, "bills_bill").select("id", "bill_number", "session_id"), ["id"], None)
    v = load(spark, base, "bills_votequestion").select("bill_id", "vote_date", F.col("id").alias("vote_id"), "result")
    joined = b.join(v, b["id"] == v["bill_id"]).select("bill_number", "session_id", "vote_date", "vote_id", "result")
    return rel.latest(joined, ["bill_number"], "session_id", "vote_date", "vote_id")


def enumerated_members(spark: SparkSession, base: str) -> DataFrame:
    """Customers by region and nation: complete lists with places, the largest nation of a region first."""
    c, n, r = (load(spark, base, t) for t in ("customer", "nation", "region"))
    sizes = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"))
    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("members"), "n_name"))
    nations = n.join(sizes, n["n_nationkey"] == sizes["c_nationkey"]).withColumn("nation_place", order).join(r,
        n["n_regionkey"] == r["r_regionkey"])  # a row a nation
    numbered = rel.placed(c.select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_name", "c_custkey"], "member_place")
    return numbered.join(F.broadcast(nations.select("n_nationkey", "n_name", "r_name", "members", "nation_place")),
        F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "nation_place", "members", "c_name", "member_place")


def dimension_names(spark: SparkSession, base: str) -> DataFrame:
    """Suppliers and customers of one nation and segment with names looked up; a missing one shows its id."""
    o, c = load(spark, base, "orders").select("o_orderkey", "o_custkey"), load(spark, base, "customer").filter("c_mktsegment = 'BUILDING'")
    return o.join(c.select("c_custkey", "c_name"), o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey",
        F.coalesce("c_name", F.concat(F.lit("#"), F.col("o_custkey").cast("string"))).alias("who"))


def message_limits(spark: SparkSession, base: str) -> DataFrame:
    """How many user messages each chat has had in the day up to each of them, with the chat's first message: a join, then
    trailing counts."""
    m = standing(load(spark, base, "message_v2").select("id", "chat_id", F.lower(F.trim("role")).alias("role"), "created_at"), ["id"],
        None).filter("chat_id is not null and created_at is not null")
    chats = m.groupBy("chat_id").agg(F.min("created_at").alias("begun"))
    asked = m.filter("role = 'user'").join(chats, "chat_id")
    return rel.trailing_count(asked, "chat_id", "created_at", 24).select("id", "chat_id", "begun", "trailing")


def mock_types(spark: SparkSession, base: str) -> DataFrame:
    """The kind of question that a text is, by its words; the first that fits."""
    low = F.lower(F.coalesce("text", F.lit("")))
    kinds = [("vote", "vote|voted|voix"), ("bill", "bill|projet de loi"), ("committee", "committee|comité"), ("member", "member|député")]
    out = F.lit("general")
    for name, pattern in reversed(kinds):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return load(spark, base, "documents").select("doc_id", out.alias("kind"))


def note_texts(spark: SparkSession, base: str) -> DataFrame:
    """Amendments of a resource as a closing paragraph of historical notes, in its language."""
    r = _latest_resources(spark, base).select("id", "language", js.array_at(F.col("metadata"), "recentAmendments").alias("a")).filter("size(a) > 0")
    get = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    notes = F.transform("a", lambda x: F.struct(F.coalesce(get(x, "citation"), F.lit("")).alias("text"), get(x, "date").alias("made")))
    return r.select("id", tx.historical_notes(notes, F.col("language")).alias("notes"))


QUERIES = {f.__name__: f for f in (array_filters, json_containment, json_members, json_array_explode, json_equality, entity_fallback, valid_inputs,
    instrument_ids, cache_keys, cached_values, event_lines, replayed_events, display_dates, term_pairs, provision_scopes, corrected_titles,
    top_orders, line_details, dissenting_lines, referenced_acts, bill_votes, members_in_range, sorted_members, act_statistics, stored_totals,
    categories, top_of_documents, mention_checks, verification, integrity_rules, integrity_keys, sequence_breaks, new_model, named_subset,
    dump_tables, progress_counts, table_sizes, date_filters, law_search, latest_vote, enumerated_members, dimension_names, message_limits, mock_types,
        note_texts)}

_L = "r AS (SELECT * FROM leg_resources QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_IS_ARRAY = "json_type(metadata, '$.recentAmendments') = 'ARRAY'"
_CITED = f"({_IS_ARRAY} AND list_contains(json_extract_string(metadata, '$.recentAmendments[*].citation'), '2021, c. 25, s. 198'))"
_ACT_ROWS = (
    f"a AS (SELECT {_sql_key('act_id')} AS key, language, title, status, id, updated_at FROM acts QUALIFY row_number() OVER (PARTITION "
    f"BY {_sql_key('act_id')}, language ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"
)
_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(lower(title), 'œ', 'oe'), 'æ', 'ae'), '" + tx.ACCENTED + "', '" + tx.PLAIN + r"'), '[\x{0300}-\x{036F}]', '', 'g'), '[–—-]', ' ', 'g'), '[^a-z0-9\s\x0B]', '', 'g'), '[\s\x0B]+', ' ', 'g'))"


def _cased(x: str, wrong: str, right: str) -> str:
    """Replacement in the letter case of what is replaced, by a pass for each case."""
    return f"replace(replace(replace({x}, '{wrong.upper()}', '{right.upper()}'), '{wrong.title()}', '{right.title()}'), '{wrong}', '{right}')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B]+', ' ', 'g'), ' ')"


def _verify_sql() -> str:
    side = lambda t: (
        f"SELECT {_sql_key('act_id')} AS key, language, {_squeeze('title')} AS title, {_squeeze('status')} AS status FROM {t} WHERE "
        f"{_sql_key('act_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_sql_key('act_id')}, language ORDER BY updated_at DESC "
        f"NULLS LAST) = 1"
    )
    cases = [("missing_in_right", "error", "c.key IS NULL"), ("missing_in_left", "warning", "m.key IS NULL"),
        *[(f, "error", f"m.key IS NOT NULL AND c.key IS NOT NULL AND m.{f} IS DISTINCT FROM c.{f}") for f in ("title", "status")]]
    return f"WITH m AS ({side('acts')}), c AS ({side('acts_copy')}), j AS (" + " UNION ALL ".join((
        f"SELECT '{d}' AS difference, '{s}' AS severity FROM m FULL JOIN c ON m.key = c.key AND m.language IS NOT DISTINCT FROM c.language "
        f"WHERE {w}"
    ) for d, s, w in cases) + ") SELECT difference, severity, count(*) AS rows FROM j GROUP BY ALL"


ORACLE = {
    "array_filters": (
        f"WITH {_L} SELECT * FROM (SELECT id, CASE WHEN {_IS_ARRAY} THEN CAST(json_array_length(metadata, '$.recentAmendments') AS INT) END "
        f"AS amendments, coalesce({_CITED}, false) AS cited, coalesce(source_type IN ('act', 'regulation') OR {_CITED}, false) AS wide FROM "
        f"r) WHERE amendments > 0 OR wide"
    ),
    "json_containment": (
        f"WITH {_L} SELECT id, source_type FROM r WHERE json_contains(metadata, '{{\"language\": \"fr\", \"targetType\": \"act\", "
        f"\"chunkIndex\": 0}}')"
    ),
    "json_members": f"WITH {_L} SELECT id, 'v\"2' AS version, metadata->>'sourceType' AS kind, true AS same_title FROM r",
    "json_array_explode": (
        f"WITH {_L}, x AS (SELECT id, unnest(range(0, CAST(json_array_length(metadata, '$.recentAmendments') AS INT)))::INT AS pos, metadata "
        f"FROM r WHERE {_IS_ARRAY}), y AS (SELECT id, pos, json_extract_string(metadata, '$.recentAmendments[' || pos || '].citation') AS "
        f"citation, json_extract_string(metadata, '$.recentAmendments[' || pos || '].date') AS day FROM x), z AS (SELECT *, "
        f"regexp_extract(citation, '(?i)(\\d{{4}}),\\s*c\\.\\s*(\\d+)(?:,\\s*s\\.\\s*(\\d+))?', ['year', 'chapter', 'section']) AS a FROM y) "
        f"SELECT id, pos, citation, TRY_CAST(a.year AS INT) AS year, TRY_CAST(a.chapter AS INT) AS chapter, TRY_CAST(a.section AS INT) AS "
        f"section, day FROM z"
    ),
    "json_equality": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang IS NOT DISTINCT FROM 'en' ELSE true END AS equal FROM documents",
    "entity_fallback": (
        f"WITH {_ACT_ROWS} SELECT key, language, title FROM a WHERE key IS NOT NULL AND language IN ('en', 'fr') QUALIFY row_number() OVER "
        f"(PARTITION BY key ORDER BY language = 'fr' DESC) = 1"
    ),
    "valid_inputs": (
        f"WITH {_L} SELECT id, coalesce(regexp_matches(metadata->>'actId', '(?i)^[A-Z]+-\\d+(\\.\\d+)?$'), false) AS act, "
        f"coalesce(regexp_matches(metadata->>'regulationId', '(?i)^(SOR|SI|CRC|DORS)-[A-Za-z0-9_.\\-]+$'), false) AS regulation, "
        f"coalesce(regexp_matches(metadata->>'sectionLabel', '^[A-Za-z0-9_\\s.\\-–—]+$') AND length(metadata->>'sectionLabel') <= 100, "
        f"false) AS label, coalesce(language IN ('en', 'fr'), false) AS language, CASE WHEN "
        f"TRY_CAST(regexp_extract(metadata->>'sectionLabel', '^\\s*\\+?(\\d+)', 1) AS BIGINT) BETWEEN 1 AND 1000000 THEN "
        f"TRY_CAST(regexp_extract(metadata->>'sectionLabel', '^\\s*\\+?(\\d+)', 1) AS INT) END AS number FROM r"
    ),
    "instrument_ids": (
        f"SELECT DISTINCT id, regexp_replace(replace(instrument_number, '/', '-'), ',\\s*', '_', 'g') AS regulation_id, "
        f"replace(instrument_number, '/', '-') AS alpha, replace(replace(instrument_number, '/', '-'), ' ', '_') AS file, "
        f"regexp_replace(replace(instrument_number, '/', '-'), ',\\s*', '_', 'g') IN ({', '.join(map(repr, WANTED))}) AS wanted FROM "
        f"regulations WHERE instrument_number IS NOT NULL"
    ),
    "cache_keys": (
        r"SELECT doc_id, 'bill:' || coalesce(lang, 'any') || ':0.4:100:billNumber:' || coalesce(nullif(upper(regexp_extract(text, "
        r"'\b([CScs]-\d+)\b', 1)), ''), 'NA') || ':' || sha1(text) AS key FROM documents WHERE text IS NOT NULL"
    ),
    "cached_values": (
        "SELECT user_id, ts, event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-18 12:00:00' AND TIMESTAMP '2024-01-20 "
        "12:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
    ),
    "event_lines": "SELECT '{\"type\":\"data-' || event_type || '\",\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS event FROM events",
    "replayed_events": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29 14:00:00'",
    "display_dates": (
        "SELECT DISTINCT id, strftime(statement_time, '%Y-%m-%d') AS day, strftime(statement_time, '%H:%M') AS time, CASE WHEN id % 7 > 0 "
        "AND statement_time IS NOT NULL THEN strftime(statement_time, '%Y') || '-' || lpad(left(CAST(id AS VARCHAR), 1), 2, '0') || '-' || "
        "CASE WHEN id % 3 > 0 THEN strftime(statement_time, '%d') ELSE '01' END END AS from_parts FROM hansards_statement"
    ),
    "term_pairs": (
        f"WITH {_ACT_ROWS}, b AS (SELECT key, max(title) FILTER (language = 'en') AS en, max(title) FILTER (language = 'fr') AS fr FROM a "
        f"WHERE key IS NOT NULL GROUP BY key), w AS (SELECT key, string_split(en, ' ') AS e, CASE WHEN length(key) % 2 = 0 THEN "
        f"string_split(fr, ' ')[1:1] ELSE string_split(fr, ' ') END AS f FROM b WHERE en IS NOT NULL AND fr IS NOT NULL), x AS (SELECT key, "
        f"e, f, unnest(range(0, len(e)))::INT AS pos FROM w) SELECT key, pos, e[pos + 1] AS term, coalesce(f[pos + 1], CASE WHEN len(f) = 1 "
        f"THEN f[1] END) AS paired FROM x"
    ),
    "provision_scopes": (
        f"WITH {_L}, x AS (SELECT id, length(metadata) AS n, length(metadata) % 50 + 1 AS s, metadata->>'sectionLabel' AS label FROM r) "
        f"SELECT id, ['act', 'section', 'section', 'part'][n % 4 + 1] AS kind, CASE n % 4 WHEN 1 THEN array_to_string(list_concat(CASE WHEN "
        f"label <> '' THEN [label] ELSE [] END, list_filter(list_transform(range(s, s + 4), lambda i: CAST(i AS VARCHAR)), lambda i: i IS "
        f"DISTINCT FROM label)), ',') WHEN 2 THEN s || ',' || (s + 1) END AS sections FROM x"
    ),
    "corrected_titles": (
        f"SELECT DISTINCT id, CASE language WHEN 'en' THEN {_cased(_cased('title', 'act', 'statute'), 'levy', 'duty')} WHEN 'fr' THEN "
        f"{_cased('title', 'loi', 'texte')} ELSE title END AS title FROM acts WHERE title IS NOT NULL"
    ),
    "top_orders": (
        "SELECT o_orderkey, coalesce(c_name, 'Unknown') AS customer, coalesce(n_name, '?') AS nation, r_name, o_totalprice FROM orders LEFT "
        "JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey "
        "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"
    ),
    "line_details": (
        "SELECT l_orderkey, l_linenumber, o_orderdate, c_name, p_name, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN "
        "customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    ),
    "dissenting_lines": (
        "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND "
        "l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"
    ),
    "referenced_acts": (
        f"WITH {_ACT_ROWS}, x AS (SELECT DISTINCT id, {_sql_key('source_act_id')} AS key, source_section_label FROM cross_references) SELECT "
        f"x.id, key, source_section_label, title, status FROM x JOIN a USING (key) WHERE language = 'en'"
    ),
    "bill_votes": (
        "WITH b AS (SELECT id, bill_number, session_id FROM bills_bill QUALIFY row_number() OVER (PARTITION BY id ORDER BY bill_number DESC "
        "NULLS LAST, session_id DESC NULLS LAST) = 1), v AS (SELECT bill_id, vote_number, result FROM bills_votequestion QUALIFY "
        "row_number() OVER (PARTITION BY id ORDER BY bill_id DESC NULLS LAST, vote_number DESC NULLS LAST, result DESC NULLS LAST) = 1) "
        "SELECT id, bill_number, session_id, vote_number, CASE result WHEN 'Y' THEN 'Passed' WHEN 'N' THEN 'Failed' WHEN 'T' THEN 'Tie' "
        "ELSE result END AS outcome FROM b LEFT JOIN v ON id = bill_id"
    ),
    "members_in_range": (
        "SELECT o_orderkey, c_name, n_name, o_orderstatus = 'O' AS current FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation "
        "ON c_nationkey = n_nationkey WHERE o_orderdate <= TIMESTAMP '1996-03-31' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 60 "
        "DAYS >= TIMESTAMP '1996-03-01')"
    ),
    "sorted_members": (
        f"SELECT language, title, row_number() OVER (PARTITION BY language ORDER BY {_FOLD}, title) AS place FROM (SELECT DISTINCT language, "
        f"title FROM acts WHERE title IS NOT NULL)"
    ),
    "act_statistics": (
        f"WITH {_L}, {_ACT_ROWS}, k AS (SELECT source_type, {_sql_key('metadata->>' + chr(39) + 'actId' + chr(39))} AS act, "
        f"{_sql_key('metadata->>' + chr(39) + 'enablingActId' + chr(39))} AS enabling FROM r) SELECT key, (SELECT count(*) FROM k WHERE act "
        f"= a.key AND source_type = 'act_section') AS sections, (SELECT count(*) FROM k WHERE enabling = a.key) AS regulations, (SELECT "
        f"count(*) FROM k WHERE act IS NOT NULL AND source_type = 'act_section') AS all_sections, (SELECT count(*) FROM k WHERE enabling IS "
        f"NOT NULL) AS all_regulations FROM a WHERE language = 'en' AND key IS NOT NULL"
    ),
    "stored_totals": (
        "SELECT o_orderkey, CAST(floor(o_totalprice / 20000) AS BIGINT) AS stored, coalesce(n, 0) AS counted FROM orders LEFT JOIN (SELECT "
        "l_orderkey, count(*) FILTER (l_returnflag IN ('A', 'N', 'R')) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE "
        "abs(CAST(floor(o_totalprice / 20000) AS BIGINT) - coalesce(n, 0)) >= 10"
    ),
    "categories": (
        "WITH k AS (SELECT DISTINCT source_type AS name FROM leg_resources), h AS (SELECT unnest(['act', 'act_section', 'regulation', "
        "'treaty']) AS name) SELECT coalesce(k.name, h.name) AS name, CASE WHEN h.name IS NULL THEN 'gap' WHEN k.name IS NULL THEN 'extra' "
        "ELSE 'covered' END AS status, CASE WHEN coalesce(k.name, h.name) IN ('act', 'regulation') THEN 'documents' WHEN coalesce(k.name, "
        "h.name) = 'defined_term' THEN 'terms' ELSE 'uncategorised' END AS category FROM k FULL JOIN h ON k.name = h.name"
    ),
    "top_of_documents": (
        f"{_lists()}, n AS (SELECT c.*, d.act_ref FROM c LEFT JOIN documents d ON d.doc_id = c.resource_id), t AS (SELECT * FROM n WHERE "
        f"source_type IN ('gazette_notice', 'hansard') OR (source_type = 'legal_section' AND act_ref IS NOT NULL) QUALIFY row_number() OVER "
        f"(PARTITION BY list_id, source_type ORDER BY rank) = 1), m AS (SELECT * FROM n WHERE act_ref IS NOT NULL AND list_id NOT IN (SELECT "
        f"list_id FROM t WHERE source_type = 'legal_section') QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY rank) = 1) SELECT "
        f"list_id, resource_id, source_type, act_ref, rank FROM t UNION ALL SELECT list_id, resource_id, 'legal_section', act_ref, rank FROM "
        f"m"
    ),
    "mention_checks": (
        "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), h AS (SELECT doc_id, t, contains(t, 'bill')::INT + "
        "contains(t, 'house')::INT + contains(t, 'committee')::INT AS hits FROM d) SELECT doc_id, hits, hits = 3 AS all_said, "
        "concat_ws(',', CASE WHEN contains(t, 'vote') THEN 'vote' END, CASE WHEN contains(t, 'committee') THEN 'committee' END, CASE WHEN "
        "contains(t, 'session') THEN 'session' END) AS kinds FROM h"
    ),
    "verification": _verify_sql(),
    "integrity_rules": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{name}' AS rule, count(*) FILTER (NOT ({rule})) AS rows FROM {t}" for t,
        rules in RULES.items() for name, rule in rules.items()),
    "integrity_keys": " UNION ALL ".join(
        [f"SELECT '{t}({','.join(k)}) repeated' AS rule, count(*) AS keys FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t,
        k in KEYS] + [f"SELECT '{c}.{k} without {p}', count(DISTINCT {k}) FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for c,
        k, p, pk in FOREIGN]),
    "sequence_breaks": (
        "SELECT * FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM "
        "events) WHERE value <= before"
    ),
    "new_model": (
        "SELECT vec_id, CASE WHEN label = 2 AND vec_id % 2 = 0 THEN 'next' ELSE CAST(label AS VARCHAR) END AS model, "
        "round(CAST(embedding[1] AS DOUBLE) * CASE WHEN label = 2 AND vec_id % 2 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings"
    ),
    "named_subset": (
        f"WITH {_L}, ac AS (SELECT DISTINCT {_sql_key('act_id')} AS id FROM acts), rg AS (SELECT DISTINCT "
        f"{_sql_key('metadata->>' + chr(39) + 'regulationId' + chr(39))} AS id, "
        f"{_sql_key('metadata->>' + chr(39) + 'enablingActId' + chr(39))} AS act FROM r), w AS (SELECT unnest(['D-1', 'H-1.2', 'NO-SUCH-1', "
        f"'SOR-2017-2', 'NO-SUCH-2']) AS id UNION SELECT id FROM rg WHERE act IN ('D-1', 'H-1.2', 'NO-SUCH-1', 'SOR-2017-2', 'NO-SUCH-2') "
        f"AND id IS NOT NULL) SELECT id, id IN (SELECT id FROM ac WHERE id IS NOT NULL UNION SELECT id FROM rg WHERE id IS NOT NULL) AS "
        f"known FROM w"
    ),
    "dump_tables": (
        "SELECT 'parliament.part' AS table_name, CAST(p_partkey AS VARCHAR) AS c0, CASE WHEN p_partkey % 5 <> 0 THEN replace(p_name, ' ', "
        "chr(9)) END AS c1, CASE WHEN p_partkey % 5 <> 0 THEN replace(p_brand, ' ', chr(9)) END AS c2 FROM part UNION ALL SELECT "
        "'parliament.nation', CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 <> 0 THEN replace(n_name, ' ', chr(9)) END, CASE WHEN "
        "n_nationkey % 5 <> 0 THEN CAST(n_regionkey AS VARCHAR) END FROM nation"
    ),
    "date_filters": " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS filter FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') {c}" for n,
        c in (("before", "< '1992-02-01'"), ("after", "> '1998-07-01'"), ("on", "= '1995-05-05'"),
        ("between", "BETWEEN '1994-01-01' AND '1994-01-10'"))),
    "law_search": (
        f"WITH {_L}, f AS (SELECT * FROM r WHERE source_type IN ('act_section', 'act') AND language = 'en' AND metadata->>'language' = 'en') "
        f"SELECT id, resource_key, updated_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_at DESC, id LIMIT 20 OFFSET 40"
    ),
    "latest_vote": (
        "WITH b AS (SELECT id, bill_number, session_id FROM bills_bill QUALIFY row_number() OVER (PARTITION BY id ORDER BY bill_number DESC "
        "NULLS LAST, session_id DESC NULLS LAST) = 1) SELECT bill_number, b.session_id, vote_date, v.id AS vote_id, result FROM b JOIN "
        "bills_votequestion v ON b.id = v.bill_id QUALIFY row_number() OVER (PARTITION BY bill_number ORDER BY b.session_id DESC NULLS "
        "LAST, vote_date DESC NULLS LAST, v.id DESC, result DESC NULLS LAST) = 1"
    ),
    "enumerated_members": (
        "WITH s AS (SELECT n_nationkey, n_name, r_name, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN "
        "region ON n_regionkey = r_regionkey GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY members DESC, "
        "n_name) AS nation_place FROM s) SELECT r_name, n_name, nation_place, members, c_name, row_number() OVER (PARTITION BY n_nationkey "
        "ORDER BY c_name, c_custkey) AS member_place FROM customer JOIN o ON c_nationkey = n_nationkey"
    ),
    "dimension_names": (
        "SELECT o_orderkey, coalesce(c_name, '#' || o_custkey) AS who FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = "
        "'BUILDING') ON o_custkey = c_custkey"
    ),
    "message_limits": (
        "WITH m AS (SELECT id, chat_id, lower(trim(role, ' ')) AS role, created_at FROM message_v2 QUALIFY row_number() OVER (PARTITION BY "
        "id ORDER BY chat_id DESC NULLS LAST, lower(trim(role, ' ')) DESC NULLS LAST, created_at DESC NULLS LAST) = 1), k AS (SELECT *, "
        "min(created_at) OVER (PARTITION BY chat_id) AS begun FROM m WHERE chat_id IS NOT NULL AND created_at IS NOT NULL) SELECT id, "
        "chat_id, begun, count(*) OVER (PARTITION BY chat_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) "
        "AS trailing FROM k WHERE role = 'user'"
    ),
    "mock_types": (
        "SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'vote|voted|voix') THEN 'vote' WHEN regexp_matches(lower(text), "
        "'bill|projet de loi') THEN 'bill' WHEN regexp_matches(lower(text), 'committee|comité') THEN 'committee' WHEN "
        "regexp_matches(lower(text), 'member|député') THEN 'member' ELSE 'general' END AS kind FROM documents"
    ),
    "note_texts": (
        f"WITH {_L}, x AS (SELECT id, language, unnest(range(0, CAST(json_array_length(metadata, '$.recentAmendments') AS INT)))::INT AS "
        f"pos, metadata FROM r WHERE {_IS_ARRAY}), y AS (SELECT id, language, pos, coalesce(json_extract_string(metadata, "
        f"'$.recentAmendments[' || pos || '].citation'), '') AS c, json_extract_string(metadata, '$.recentAmendments[' || pos || '].date') "
        f"AS d FROM x) SELECT id, chr(10) || chr(10) || CASE WHEN language = 'fr' THEN 'Historique: ' ELSE 'History: ' END || string_agg(c "
        f"|| CASE WHEN d <> '' AND NOT contains(c, d) THEN CASE WHEN language = 'fr' THEN ' (édicté: ' ELSE ' (enacted: ' END || d || ')' "
        f"ELSE '' END, '; ' ORDER BY pos) AS notes FROM y GROUP BY id, language"
    ),
    "progress_counts": (
        "WITH d AS (SELECT DISTINCT resource_key AS r FROM leg_resources) SELECT split_part(r, ':', 1) AS kind, count(*) AS keys, "
        "count(*) FILTER (NOT starts_with(r, 'regulation:')) AS kept, count(*) FILTER (starts_with(r, 'regulation:') AND contains(r, ':fr:')) "
        "AS again FROM d GROUP BY 1"
    ),
    "table_sizes": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t}))::INT AS n_columns" for t in TABLES),
}
