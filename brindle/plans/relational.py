"""Relational queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import RESULTS, either, label
from brindle.operators import records as rec
from brindle.operators import relational as rel
from brindle.tables import TABLES, load


def metadata_search(spark: SparkSession, base: str) -> DataFrame:
    o = load(spark, base, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    hit = rel.all_of(F.col("o_orderstatus") == "F", rel.date_condition(day, between=("1995-01-01", "1996-06-30")), None)
    return o.filter(hit).orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").offset(20).limit(100).select("o_orderkey", "o_orderstatus",
        "o_orderdate")


def metadata_count(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if(k >= 50).alias("large"), F.count_if(k.isNull()).alias("unset"))


def metadata_distinct(spark: SparkSession, base: str) -> DataFrame:
    m = F.get_json_object("metadata", "$.documentTitle").alias("title")
    return load(spark, base, "leg_resources").select(m).filter("title is not null and title <> ''").distinct().orderBy("title")


def json_filters(spark: SparkSession, base: str) -> DataFrame:
    r = load(spark, base, "leg_resources")
    meta = lambda f: F.get_json_object("metadata", f"$.{f}")
    hit = (meta("language") == "fr") & F.col("source_type").isin("regulation", "act") & meta("actId").isNotNull()
    return r.filter(hit).select("id", "source_type", meta("actId").alias("act_id")).distinct()


def enumerate_members(spark: SparkSession, base: str) -> DataFrame:
    """Every line of each nation's customers' urgent orders, counted by party-like groups, with the group's size order."""
    l, o, c, n = (load(spark, base, t) for t in ("lineitem", "orders", "customer", "nation"))
    urgent = o.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")
    joined = l.select("l_orderkey", "l_quantity").join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")).orderBy(F.desc("lines"),
        "n_name")


def grouped_lists(spark: SparkSession, base: str) -> DataFrame:
    """Nations of each region as an ordered list."""
    n, r = load(spark, base, "nation"), load(spark, base, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",")
        .alias("nations"))


def latest_per_entity(spark: SparkSession, base: str) -> DataFrame:
    return rel.latest(load(spark, base, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderdate",
        "o_orderkey")


def current_rows(spark: SparkSession, base: str) -> DataFrame:
    a = load(spark, base, "acts").select("act_id", "created_at", "deleted_at").distinct()
    return rel.current_or_last(a, ["act_id"], "created_at", "deleted_at")


def interval_overlap(spark: SparkSession, base: str) -> DataFrame:
    o, l = load(spark, base, "orders"), load(spark, base, "lineitem")
    ship = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    low, high = F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz")
    joined = o.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.filter(rel.overlaps(F.col("o_orderdate"), F.col("last_ship"), low, high)).select("o_orderkey", "o_orderdate", "last_ship")


def left_join_labels(spark: SparkSession, base: str) -> DataFrame:
    """Every document with its majority label, ``none`` over null; composite precedence by coalesce."""
    votes = load(spark, base, "abuse_labels").filter("label is not null").groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", "label")).alias("b")).select("doc_id", F.col("b.label").alias("label"))
    docs = load(spark, base, "documents").select("doc_id", "source")
    return docs.join(best, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit("unlabelled")).alias("label"))


def star_join(spark: SparkSession, base: str) -> DataFrame:
    """Statements with their politician's latest statement number and the document's size; left joins on reduced sides."""
    h = load(spark, base, "hansards_statement").select("id", "document_id", "politician_id", "sequence").distinct()
    per_doc = h.groupBy("document_id").agg(F.count(F.lit(1)).alias("statements"))
    last = h.groupBy("politician_id").agg(F.max("id").alias("last_id"))
    return h.join(per_doc, "document_id", "left").join(last, "politician_id", "left").select("id", "document_id", "statements", "last_id")


def anti_join_new_keys(spark: SparkSession, base: str) -> DataFrame:
    d, e = load(spark, base, "documents"), load(spark, base, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left_anti").select("doc_id")


def semi_join_keys(spark: SparkSession, base: str) -> DataFrame:
    d, e = load(spark, base, "documents"), load(spark, base, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"], "left_semi").select("doc_id", "n_chars")


def group_zero_fill(spark: SparkSession, base: str) -> DataFrame:
    n = load(spark, base, "nation").select("n_nationkey", "n_name")
    return rel.zero_filled(n, "n_nationkey", customers=(load(spark, base, "customer"), "c_nationkey"),
        suppliers=(load(spark, base, "supplier"), "s_nationkey"))


def group_by_model(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def distinct_union_ids(spark: SparkSession, base: str) -> DataFrame:
    d, e = load(spark, base, "documents").select(F.col("doc_id").alias("id")), load(spark, base, "embeddings").select(F.col("vec_id").alias("id"))
    return d.union(e).distinct()


def set_difference(spark: SparkSession, base: str) -> DataFrame:
    d, e = load(spark, base, "documents").select(F.col("doc_id").alias("id")), load(spark, base, "embeddings").select(F.col("vec_id").alias("id"))
    return e.subtract(d)


def asof_latest_before(spark: SparkSession, base: str) -> DataFrame:
    """Events with the price of the same user's (customer's) latest order at or before their time."""
    e = load(spark, base, "events").select("event_id", "user_id", "ts")
    shift = F.expr("o_orderdate + interval 10000 days")
    o = load(spark, base, "orders").select(F.col("o_custkey").alias("user_id"), shift.alias("ot"), "o_totalprice", "o_orderkey")
    return rel.as_of(e, o, "user_id", "ts", "ot", ["o_totalprice", "o_orderkey"]).select("event_id", "o_totalprice")


def keyset_page(spark: SparkSession, base: str) -> DataFrame:
    return rel.keyset_page(load(spark, base, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 100)


def batch_bound(spark: SparkSession, base: str) -> DataFrame:
    page = rel.keyset_page(load(spark, base, "orders").select("o_orderkey"), "o_orderkey", 500, 100)
    return page.agg(F.max("o_orderkey").alias("last_id")).crossJoin(load(spark, base, "orders").agg(F.max("o_orderkey").alias("max_id")))


def cursor_page_has_more(spark: SparkSession, base: str) -> DataFrame:
    o = load(spark, base, "orders").select("o_orderkey", "o_orderdate")
    at = o.filter("o_orderkey = 1000").agg(F.max("o_orderdate").alias("at"))
    older = o.join(F.broadcast(at), F.col("o_orderdate") < F.col("at")).select("o_orderkey", "o_orderdate")  # one row
    return rel.cursor_page(older, [F.desc("o_orderdate"), F.asc("o_orderkey")], 20)


def range_window_cap(spark: SparkSession, base: str) -> DataFrame:
    start, end = 1000, 1500
    return load(spark, base, "lineitem").filter(F.col("l_orderkey").between(start, min(end, start + 99))).select("l_orderkey", "l_linenumber",
        "l_quantity")


def trailing_24h_count(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "events").select("event_id", "user_id", "ts")
    return rel.trailing_count(e, "user_id", "ts", 24).withColumn("limited", F.col("trailing") > 20).select("event_id", "trailing", "limited")


def running_size_cap(spark: SparkSession, base: str) -> DataFrame:
    h = load(spark, base, "hansards_statement").select("id", "document_id", F.length("content_en").alias("n")).distinct().filter("n is not null")
    return rel.running_size(h, "document_id", "id", F.col("n"), 20_000, 15).select("id", "document_id", "running")


def catalog_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of every table, and of all together."""
    counts = reduce(DataFrame.unionByName, [load(spark, base, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t in TABLES])
    return counts.unionByName(counts.agg(F.lit("all").alias("table_name"), F.sum("n").alias("n")))


def sort_nulls_last(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").select("doc_id", "published_on")
    return d.orderBy(F.col("published_on").asc_nulls_last(), "doc_id").limit(200)


def or_fallback_columns(spark: SparkSession, base: str) -> DataFrame:
    """French names with the English ones where they are null or empty."""
    b = load(spark, base, "bills_bill").select("id", either(F.col("short_title_fr"), either(F.col("short_title_en"), F.col("name_en")))
        .alias("title")).distinct()
    v = load(spark, base, "bills_votequestion").select(F.col("bill_id"), label(F.col("result"), RESULTS).alias("outcome")).distinct()
    return b.join(v, b["id"] == v["bill_id"]).select("id", "title", "outcome")


def upsert_latest(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "events").select("user_id", "ts", "event_id", "value")
    return rec.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "ts")


def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    gone = load(spark, base, "orders").filter("o_orderstatus = 'F'")
    return rec.without_parents(load(spark, base, "lineitem"), "l_orderkey", gone, "o_orderkey").select("l_orderkey", "l_linenumber")


def backfill(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").select("doc_id", "lang", "text")
    return rec.filled_in(d, "lang", F.when(F.length("text") > 500, "long").otherwise("short")).select("doc_id", "lang")


def name_coverage(spark: SparkSession, base: str) -> DataFrame:
    clean = lambda t: load(spark, base, t).select(F.lower(F.trim("source")).alias("source")).filter("source is not null")
    return rec.coverage(clean("source_targets"), clean("documents"), "source")


def evaluation_summary(spark: SparkSession, base: str) -> DataFrame:
    return rec.evaluation(load(spark, base, "events"), "value", 10.0).withColumn("mean_score", F.round("mean_score", 4))


QUERIES = {f.__name__: f for f in (upsert_latest, cascade_delete, backfill, name_coverage, evaluation_summary, metadata_search, metadata_count,
    metadata_distinct, json_filters, enumerate_members, grouped_lists, latest_per_entity, current_rows, interval_overlap, left_join_labels, star_join,
    anti_join_new_keys, semi_join_keys, group_zero_fill, group_by_model, distinct_union_ids, set_difference, asof_latest_before, keyset_page,
    batch_bound, cursor_page_has_more, range_window_cap, trailing_24h_count, running_size_cap, catalog_counts, sort_nulls_last, or_fallback_columns)}

ORACLE = {
    "upsert_latest": "SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "cascade_delete": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "backfill": "SELECT doc_id, coalesce(lang, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END) AS lang FROM documents",
    "name_coverage": (
        "WITH a AS (SELECT DISTINCT lower(trim(source)) AS source FROM source_targets), b AS (SELECT DISTINCT lower(trim(source)) AS source "
        "FROM documents WHERE source IS NOT NULL) SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'gap' WHEN "
        "a.source IS NULL THEN 'extra' ELSE 'covered' END AS status FROM a FULL JOIN b ON a.source = b.source"
    ),
    "evaluation_summary": "SELECT count(*) AS cases, count(*) FILTER (value >= 10.0) AS passed, round(avg(value), 4) AS mean_score FROM events",
    "metadata_search": (
        "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN "
        "'1995-01-01' AND '1996-06-30' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 20"
    ),
    "metadata_count": (
        "SELECT event_type, count(*) AS events, count(*) FILTER (CAST(props->>'k' AS INT) >= 50) AS large, count(*) FILTER (props->>'k' IS "
        "NULL) AS unset FROM events GROUP BY event_type"
    ),
    "metadata_distinct": "SELECT DISTINCT metadata->>'documentTitle' AS title FROM leg_resources WHERE metadata->>'documentTitle' <> ''",
    "json_filters": (
        "SELECT DISTINCT id, source_type, metadata->>'actId' AS act_id FROM leg_resources WHERE metadata->>'language' = 'fr' AND "
        "source_type IN ('regulation', 'act') AND metadata->>'actId' IS NOT NULL"
    ),
    "enumerate_members": (
        "SELECT n_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN "
        "customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY n_name"
    ),
    "grouped_lists": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "latest_per_entity": (
        "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY "
        "o_orderdate DESC, o_orderkey DESC) = 1"
    ),
    "current_rows": (
        "SELECT act_id, created_at, deleted_at, deleted_at IS NULL AS is_current FROM (SELECT DISTINCT act_id, created_at, deleted_at FROM "
        "acts) QUALIFY row_number() OVER (PARTITION BY act_id ORDER BY deleted_at IS NULL DESC, created_at DESC, deleted_at DESC) = 1"
    ),
    "interval_overlap": (
        "SELECT o_orderkey, o_orderdate, s AS last_ship FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP "
        "BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1996-03-31' AND (s IS NULL OR s >= TIMESTAMP '1996-03-01')"
    ),
    "left_join_labels": (
        "WITH v AS (SELECT doc_id, label, count(*) AS n FROM abuse_labels WHERE label IS NOT NULL GROUP BY ALL), b AS (SELECT doc_id, label "
        "FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label DESC) = 1) SELECT d.doc_id, coalesce(b.label, "
        "'unlabelled') AS label FROM documents d LEFT JOIN b USING (doc_id)"
    ),
    "star_join": (
        "WITH h AS (SELECT DISTINCT id, document_id, politician_id, sequence FROM hansards_statement) SELECT h.id, h.document_id, d.n AS "
        "statements, p.m AS last_id FROM h LEFT JOIN (SELECT document_id, count(*) AS n FROM h GROUP BY 1) d USING (document_id) LEFT JOIN "
        "(SELECT politician_id, max(id) AS m FROM h GROUP BY 1) p ON h.politician_id = p.politician_id"
    ),
    "anti_join_new_keys": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)",
    "semi_join_keys": "SELECT doc_id, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)",
    "group_zero_fill": (
        "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM "
        "supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"
    ),
    "group_by_model": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "distinct_union_ids": "SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings",
    "set_difference": "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM documents",
    "asof_latest_before": (
        "WITH o AS (SELECT o_custkey, o_orderdate + INTERVAL 10000 DAYS AS ot, o_totalprice FROM orders QUALIFY row_number() OVER "
        "(PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice DESC, o_orderkey DESC) = 1) SELECT e.event_id, o.o_totalprice FROM "
        "events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.ot"
    ),
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100",
    "batch_bound": (
        "SELECT (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100)) AS "
        "last_id, (SELECT max(o_orderkey) FROM orders) AS max_id"
    ),
    "cursor_page_has_more": (
        "WITH p AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < (SELECT o_orderdate FROM orders WHERE o_orderkey = 1000) "
        "ORDER BY o_orderdate DESC, o_orderkey LIMIT 21) SELECT o_orderkey, o_orderdate, (SELECT count(*) > 20 FROM p) AS has_more FROM p "
        "ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"
    ),
    "range_window_cap": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 1000 AND least(1500, 1099)",
    "trailing_24h_count": (
        "SELECT event_id, count(*) OVER w AS trailing, count(*) OVER w > 20 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER "
        "BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"
    ),
    "running_size_cap": (
        "WITH h AS (SELECT DISTINCT id, document_id, length(content_en) AS n FROM hansards_statement WHERE content_en IS NOT NULL) SELECT "
        "id, document_id, sum(n) OVER w AS running FROM h WINDOW w AS (PARTITION BY document_id ORDER BY id) QUALIFY sum(n) OVER w <= 20000 "
        "AND row_number() OVER w <= 15"
    ),
    "catalog_counts": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)
        + ") SELECT * FROM c UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM c",
    "sort_nulls_last": "SELECT doc_id, published_on FROM documents ORDER BY published_on ASC NULLS LAST, doc_id LIMIT 200",
    "or_fallback_columns": (
        "SELECT b.id, b.title, v.outcome FROM (SELECT DISTINCT id, coalesce(nullif(short_title_fr, ''), nullif(short_title_en, ''), "
        "name_en) AS title FROM bills_bill) b JOIN (SELECT DISTINCT bill_id, CASE result WHEN 'Y' THEN 'Passed' WHEN 'N' THEN 'Failed' WHEN "
        "'T' THEN 'Tie' ELSE result END AS outcome FROM bills_votequestion) v ON b.id = v.bill_id"
    ),
}
