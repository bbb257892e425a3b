"""Retrieval and ranking queries. Every row whose id is divisible by 100 is a query against all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions.vector import is_valid
from brindle.operators import ranking as rk
from brindle.operators.retrieval import SOURCES, search, search_by_reference, search_source
from brindle.session import cut_lineage
from brindle.tables import load


def _resources(spark: SparkSession, base: str) -> DataFrame:
    docs, vectors = load(spark, base, "documents"), load(spark, base, "embeddings")
    joined = docs.join(vectors, docs["doc_id"] == vectors["vec_id"])
    return joined.select(F.col("doc_id").alias("resource_id"), F.lower(F.trim("source")).alias("source_type"), F.lower(F.trim("lang"))
        .alias("language"), F.col("embedding").alias("vector"), "text")


def _queries(resources: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 is a query, with up to three words of its own text as terms."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{8,}"), 0)
    terms = F.slice(F.array_distinct(words), 1, (F.col("resource_id") / 100 % 3).cast("int") + 1)
    return resources.filter("resource_id % 100 = 0").select(F.col("resource_id").alias("query_id"), "vector", "language", terms.alias("terms"))


def _plain(found: DataFrame) -> DataFrame:
    return found.select("query_id", "resource_id", "source_type", "language", "cosine", "keyword", "score", "rank")


def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    r = _resources(spark, base)
    return _plain(search(_queries(r), r, 10, 0.2))


def hybrid_lang_fallback(spark: SparkSession, base: str) -> DataFrame:
    r = _resources(spark, base)
    q = _queries(r).withColumn("language", F.when(F.col("query_id") % 200 == 0, "xx").otherwise(F.col("language")))
    return _plain(search(q, r, 10, 0.2, fallback=True))


def per_source_topk(spark: SparkSession, base: str) -> DataFrame:
    r = _resources(spark, base)
    return _plain(search(_queries(r), r, 3, 0.0, per_source=True))


def _numbered(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Queries and resources with the bill number that their text names; sources as parliament's kinds, by id."""
    r = _resources(spark, base)
    kind = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("resource_id") % len(SOURCES)).cast("int") + 1)
    r = r.withColumn("source_type", kind).withColumn("reference", tx.bill_number(F.col("text")))
    q = _queries(r).join(r.select(F.col("resource_id").alias("query_id"), "reference"), "query_id")
    return q.withColumn("terms", F.array().cast("array<string>")), r


def source_searches(spark: SparkSession, base: str) -> DataFrame:
    """Each query within each of parliament's source types; bills and vote questions by the number that a query names."""
    q, r = _numbered(spark, base)
    q, r = cut_lineage(q), cut_lineage(r)
    return reduce(DataFrame.unionByName, [search_source(q, r, source, 3, 0.1).withColumn("source_type", F.lit(source)) for source in SOURCES])


def reference_search(spark: SparkSession, base: str) -> DataFrame:
    """Resources that name the same bill as the query, in English, the ten nearest."""
    q, r = _numbered(spark, base)
    return search_by_reference(q, r.filter("language = 'en'"), 10, -0.2)


def filtered_search(spark: SparkSession, base: str) -> DataFrame:
    """A search with a further condition on resources, in the query's language if it has any there."""
    q, r = _numbered(spark, base)
    return search_source(q, r, "hansard", 5, 0.0, F.length("text") > 300, fallback=True)


def variant_search(spark: SparkSession, base: str) -> DataFrame:
    """Each query with its two reformulations, whose words take the place of its terms; the best row of each resource."""
    r = _resources(spark, base)
    q = _queries(r).join(r.select(F.col("resource_id").alias("query_id"), "text"), "query_id")
    wordings = F.concat(F.array(F.array_join("terms", " ")), tx.reformulations(F.coalesce("text", F.lit("")), F.col("language")))
    words = F.filter(F.split(F.lower("wording"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    v = q.select("query_id", "vector", "language", F.posexplode(wordings)
        .alias("variant", "wording")).select((F.col("query_id") * 3 + F.col("variant")).alias("query_id"), "vector", "language", words.alias("terms"))
    found = search(v, r, 10, 0.2).withColumn("list_id", F.floor(F.col("query_id") / 3)).withColumn("similarity", F.col("score"))
    best = found.groupBy("list_id", "resource_id").agg(F.max("similarity").alias("similarity"))
    return rk.reranked(best, F.desc("similarity"), F.col("resource_id")).filter("rank <= 10").select("list_id", "resource_id", "similarity", "rank")


def scored_rerank(spark: SparkSession, base: str) -> DataFrame:
    """The chain of ranking with a scorer of one's own in place of the similarity, and a least score."""
    c = candidates(spark, base).withColumn("similarity", F.col("similarity"))
    out = rk.rerank_pipeline(c, ["resource_id"], 8, scorer=F.round(F.lit(1.0) / (F.lit(1) + F.col("resource_id") % 17), 6))
    return out.filter(F.col("similarity") >= 0.1).withColumn("similarity", F.round("similarity", 6)).select(*COLUMNS)


def cosine_topk(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings").select(F.col("vec_id").alias("resource_id"), F.lit(None).cast("string").alias("source_type"), F.lit(None)
        .cast("string").alias("language"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("text"))
    q = e.filter("resource_id % 100 = 0").select(F.col("resource_id").alias("query_id"), "vector", "language", F.array().cast("array<string>")
        .alias("terms"))
    return search(q, e, 10, -1.0).select("query_id", "resource_id", "cosine", "rank")


def candidates(spark: SparkSession, base: str, k: int = 30) -> DataFrame:
    """The best ``k`` resources of each query as ranked lists."""
    r = _resources(spark, base)
    found = search(_queries(r), r, k, -1.0)
    return found.select(F.col("query_id").alias("list_id"), "resource_id", "source_type", "language", F.col("score").alias("similarity"), "rank")


COLUMNS = ["list_id", "resource_id", "source_type", "similarity", "rank"]


def _ranking(operator):
    return lambda spark, base: operator(candidates(spark, base)).select(*COLUMNS)


def multi_query_union_dedup(spark: SparkSession, base: str) -> DataFrame:
    """The lists of all queries merged into one, the best row of each resource, the first fifty."""
    merged = candidates(spark, base, 10).withColumn("list_id", F.lit(0).cast("bigint"))
    best = merged.groupBy("list_id", "resource_id").agg(F.max(F.struct("similarity", "source_type")).alias("b")).select("list_id", "resource_id",
        "b.*")
    top = best.orderBy(F.desc("similarity"), "resource_id").limit(50).withColumn("rank", F.lit(0))
    return rk.reranked(top, F.desc("similarity"), F.col("resource_id")).select(*COLUMNS)


def source_diversity(spark: SparkSession, base: str) -> DataFrame:
    c = candidates(spark, base)
    return rk.diversify(c.filter("rank <= 5"), c, ["resource_id"]).withColumn("similarity", F.round("similarity", 6)).select(*COLUMNS)


def heuristic_rerank(spark: SparkSession, base: str) -> DataFrame:
    c = candidates(spark, base).withColumn("chunk_index", (F.col("resource_id") % 3).cast("int"))
    dates = load(spark, base, "documents").select(F.col("doc_id").alias("resource_id"), F.col("published_on").cast("string").alias("date"))
    dated = c.join(dates, "resource_id", "left")
    true = F.lit(True)
    return rk.adaptive_filter(rk.heuristic_scores(dated, F.lit("fr"), true, true, true, F.col("date"))).filter("rank <= 10").select(*COLUMNS)


def rerank_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """Dedup, scores, diversity, slots and filter as one chain; six rows a list."""
    return rk.rerank_pipeline(candidates(spark, base), ["resource_id"], 6, "mp_statement").withColumn("similarity",
        F.round("similarity", 6)).select(*COLUMNS)


def definition_boost(spark: SparkSession, base: str) -> DataFrame:
    c = candidates(spark, base)
    merged = rk.boosted_merge(c.filter("language = 'fr'"), c.filter("language = 'en'"), 10)
    return merged.withColumn("similarity", F.round("similarity", 6)).select(*COLUMNS)


def snippet_citations(spark: SparkSession, base: str) -> DataFrame:
    c = candidates(spark, base, 10).join(load(spark, base, "documents").select(F.col("doc_id").alias("resource_id"), "text"), "resource_id")
    return rk.citations(c, F.coalesce(tx.snippet(F.col("text")), F.lit("")), "P").select("list_id", "resource_id", "snippet", "citation_id")


def top_per_type(spark: SparkSession, base: str) -> DataFrame:
    return rk.top_per_type(candidates(spark, base), F.col("source_type").isNotNull()).select(*COLUMNS)


def allowed_citations(spark: SparkSession, base: str) -> DataFrame:
    c = candidates(spark, base)
    return c.filter(F.col("source_type").isin(rk.ALLOWED["mp_statement"])).select(*COLUMNS)


def valid_vectors(spark: SparkSession, base: str) -> DataFrame:
    e = load(spark, base, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(is_valid(F.col("embedding"), 64)).alias("valid"))


QUERIES = {
    "hybrid_search": hybrid_search, "hybrid_lang_fallback": hybrid_lang_fallback, "per_source_topk": per_source_topk, "cosine_topk": cosine_topk,
    "score_gaps": lambda s, b: rk.score_gaps(candidates(s, b)).select("list_id", "resource_id", "rank", F.round("gap", 6).alias("gap")),
    "natural_cutoff": _ranking(lambda c: rk.natural_cutoff(c, gap=0.005)),
    "adaptive_filter": _ranking(rk.adaptive_filter),
    "smart_filter": _ranking(lambda c: rk.natural_cutoff(rk.adaptive_filter(c, ratio=0.5), gap=0.02)),
    "balance_sources": _ranking(lambda c: rk.balance(c, 10)),
    "slot_allocation": _ranking(lambda c: rk.slots(c, ["legal_section", "bill_summary"], ["hansard"], 2, 8)),
    "multi_query_union_dedup": multi_query_union_dedup, "source_diversity": source_diversity, "heuristic_rerank": heuristic_rerank,
    "rerank_pipeline": rerank_pipeline, "definition_boost": definition_boost, "snippet_citations": snippet_citations,
    "source_searches": source_searches, "reference_search": reference_search, "filtered_search": filtered_search, "variant_search": variant_search,
        "scored_rerank": scored_rerank,
    "top_per_type": top_per_type, "allowed_citations": allowed_citations, "valid_vectors": valid_vectors,
}

_R = (
    r"r AS (SELECT d.doc_id AS id, lower(trim(d.source)) AS source_type, lower(trim(d.lang)) AS language, CAST(e.embedding AS DOUBLE[]) "
    r"AS v, regexp_extract_all(lower(coalesce(d.text, '')), '[\p{L}\p{N}]+') AS tokens, d.text FROM documents d JOIN embeddings e ON "
    r"d.doc_id = e.vec_id)"
)
_TERMS = (
    "(WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}')) AS t, "
    "generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}'), 1) AS i) SELECT list(t ORDER BY i) FROM (SELECT t, "
    "min(i) AS i FROM w GROUP BY t ORDER BY i LIMIT 3))"
)
_Q = f"q AS (SELECT id AS query_id, v, language, coalesce({_TERMS}[1:(id // 100) % 3 + 1], []) AS terms FROM r WHERE id % 100 = 0)"
_PAIRS = (
    "p1 AS (SELECT q.query_id, r.id AS resource_id, r.source_type, r.language, list_cosine_similarity(q.v, r.v) AS c, "
    "list_transform(q.terms, lambda t: len(list_filter(r.tokens, lambda w: w = t))) AS tfs, coalesce({lang} = r.language, false) AS own "
    "FROM q CROSS JOIN r), p0 AS (SELECT *, CASE WHEN len(tfs) > 0 AND len(list_filter(tfs, lambda n: n = 0)) = 0 THEN "
    "list_avg(list_transform(tfs, lambda n: n / (n + 1.0))) ELSE 0 END AS kw FROM p1), p AS (SELECT *, round(c, 6) AS cosine, round(kw, "
    "6) AS keyword, round(0.7 * c + 0.3 * kw, 6) AS score FROM p0)"
)


def _search_sql(k: int, threshold: float, by: str = "query_id", lang: str = "q.language", fallback: bool = False) -> str:
    keep = "f AS (SELECT *, max(CAST(own AS INT)) OVER (PARTITION BY query_id) AS any_own FROM p WHERE round(c, 6) >= {t} OR kw > 0)".format(
        t=threshold)
    where = "WHERE own OR any_own = 0" if fallback else ""
    return (
        f"{_R}, {_Q}, {_PAIRS.format(lang=lang)}, {keep}, s AS (SELECT query_id, resource_id, source_type, language, cosine, keyword, score, "
        f"row_number() OVER (PARTITION BY {by} ORDER BY score DESC, resource_id) AS rank FROM f {where} QUALIFY rank <= {k})"
    )


def _lists(k: int = 30) -> str:
    return f"WITH {_search_sql(k, -1.0)}, c AS (SELECT query_id AS list_id, resource_id, source_type, language, score AS similarity, rank FROM s)"


_OUT = "list_id, resource_id, source_type, similarity, rank"
_ADAPT = (
    "SELECT {o}, row_number() OVER (PARTITION BY list_id ORDER BY rank) AS rank FROM (SELECT *, count(*) FILTER (inside) OVER "
    "(PARTITION BY list_id) AS n, count(*) OVER (PARTITION BY list_id) AS total FROM (SELECT *, similarity >= greatest({ratio} * "
    "first_value(similarity) OVER (PARTITION BY list_id ORDER BY rank), {floor}) AS inside FROM {of})) WHERE CASE WHEN n < least(3, "
    "total) THEN rank <= 3 ELSE inside END"
)
_O = "list_id, resource_id, source_type, language, similarity"


def _cut(of: str, gap: float) -> str:
    gaps = f"SELECT *, similarity - lead(similarity) OVER (PARTITION BY list_id ORDER BY rank) AS gap FROM {of}"
    best = f"SELECT list_id, arg_max(rank, (gap, -rank)) AS at, max(gap) AS gap FROM ({gaps}) WHERE rank >= 3 AND gap IS NOT NULL GROUP BY list_id"
    return (
        f"SELECT {', '.join('a.' + x.strip() for x in _OUT.split(','))} FROM ({of}) a LEFT JOIN ({best}) b USING (list_id) WHERE b.at IS "
        f"NULL OR b.gap <= {gap} OR a.rank <= b.at"
    ) if of.startswith("SELECT") else (
        f"SELECT {', '.join('a.' + x.strip() for x in _OUT.split(','))} FROM {of} a LEFT JOIN ({best}) b USING (list_id) WHERE b.at IS NULL "
        f"OR b.gap <= {gap} OR a.rank <= b.at"
    )


def _diverse(of: str, first: str) -> str:
    """Rows of ``first`` and the additions from ``of``."""
    return (
        f"have AS (SELECT list_id, source_type, count(*) AS n FROM {first} GROUP BY ALL), tail AS (SELECT list_id, max(rank) AS len, "
            f"arg_max(similarity, rank) AS last FROM {first} GROUP BY ALL), "
        f"x AS (SELECT o.*, min(o.rank) OVER (PARTITION BY o.list_id, o.source_type) AS entry FROM {of} o), "
        f"u AS (SELECT x.*, row_number() OVER (PARTITION BY x.list_id, x.source_type ORDER BY x.rank) AS place FROM x WHERE NOT EXISTS "
            f"(SELECT 1 FROM {first} f WHERE f.list_id = x.list_id AND f.resource_id = x.resource_id)), "
        "add AS (SELECT u.list_id, u.resource_id, u.source_type, round(greatest(0.9 * tail.last, 0.1), 6) AS similarity, tail.len + "
            "row_number() OVER (PARTITION BY u.list_id ORDER BY u.entry, u.rank) AS rank FROM u LEFT JOIN have USING (list_id, source_type) "
            "JOIN tail USING (list_id) WHERE u.place <= 2 - coalesce(have.n, 0)), "
        f"d AS (SELECT {_OUT} FROM {first} UNION ALL SELECT {_OUT} FROM add)"
    )


def _slots_sql(of: str, primary: str, secondary: str, cap: int, limit: int) -> str:
    kind = f"SELECT *, CASE WHEN source_type IN ({primary}) THEN 0 WHEN source_type IN ({secondary}) THEN 1 END AS kind FROM {of}"
    place = f"SELECT *, row_number() OVER (PARTITION BY list_id, kind ORDER BY rank) AS place FROM ({kind}) WHERE kind IS NOT NULL"
    bucket = (
        f"SELECT *, CASE WHEN kind = 0 THEN CASE WHEN place <= {max(0, limit - cap)} THEN 0 ELSE 2 END ELSE CASE WHEN place <= {cap} THEN 1 "
        f"ELSE 3 END END AS bucket FROM ({place})"
    )
    return (
        f"SELECT * EXCLUDE (rank, kind, place, bucket), row_number() OVER (PARTITION BY list_id ORDER BY bucket, rank) AS new_rank FROM "
        f"({bucket}) QUALIFY new_rank <= {limit}"
    )


_SEARCHED = "SELECT query_id, resource_id, source_type, language, cosine, keyword, score, rank FROM s"
_SNIPPET = r"""WITH_SNIP AS (SELECT c.list_id, c.resource_id, c.rank, trim(regexp_replace(coalesce(d.text, ''), '[\s\x0B]+', ' ', 'g')) AS t FROM c JOIN documents d ON d.doc_id = c.resource_id), h AS (SELECT *, left(t, 480) AS head FROM WITH_SNIP), e AS (SELECT *, greatest(CASE WHEN instr(head, '. ') > 0 THEN length(head) - instr(reverse(head), ' .') ELSE 0 END, CASE WHEN instr(head, '? ') > 0 THEN length(head) - instr(reverse(head), ' ?') ELSE 0 END, CASE WHEN instr(head, '! ') > 0 THEN length(head) - instr(reverse(head), ' !') ELSE 0 END) AS last FROM h), sn AS (SELECT list_id, resource_id, rank, CASE WHEN length(t) <= 480 THEN t WHEN last > 200 THEN left(head, last) ELSE rtrim(head) || '…' END AS snippet FROM e)"""

_NUMBERED = (
    f"WITH {_R}, n AS (SELECT id, v, language, text, [{', '.join(repr(x) for x in SOURCES)}][id % {len(SOURCES)} + 1] AS kind, "
    f"nullif(upper(regexp_extract(text, '\\b([CScs]-\\d+)\\b', 1)), '') AS ref FROM r), x AS (SELECT q.id AS query_id, n.id AS "
    f"resource_id, n.kind, n.text, n.language, q.language AS own, q.ref AS qref, n.ref, round(list_cosine_similarity(q.v, n.v), 6) AS "
    f"cosine FROM n q CROSS JOIN n WHERE q.id % 100 = 0)"
)
_BEST = "row_number() OVER (PARTITION BY query_id, kind ORDER BY round(0.7 * cosine, 6) DESC, resource_id)"
_WORDED = "list_filter(regexp_split_to_array(lower(wording), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_VARIANTS = (
    "v0 AS (SELECT query_id, v, language, terms, nullif(upper(regexp_extract(coalesce((SELECT text FROM documents WHERE doc_id = "
    "query_id), ''), '\\b([CScs]-\\d+)\\b', 1)), '') AS bill FROM q), v1 AS (SELECT query_id, v, unnest([array_to_string(terms, ' '), "
    "CASE WHEN bill IS NULL THEN CASE WHEN coalesce(language, '') = 'fr' THEN 'Contexte parlementaire lié' ELSE 'Related parliamentary "
    "context' END WHEN coalesce(language, '') = 'fr' THEN 'Résumé du projet de loi ' || bill ELSE 'Summary of Bill ' || bill END, CASE "
    "WHEN bill IS NULL THEN CASE WHEN coalesce(language, '') = 'fr' THEN 'Informations officielles pertinentes' ELSE 'Relevant official "
    "information' END WHEN coalesce(language, '') = 'fr' THEN 'Contexte et statut du projet de loi ' || bill ELSE 'Context and status "
    "of Bill ' || bill END]) AS wording, unnest([0, 1, 2]) AS variant FROM v0), v2 AS (SELECT query_id, variant, v, list_distinct({w}) "
    "AS terms FROM v1), vp AS (SELECT v2.query_id, variant, r.id AS resource_id, list_cosine_similarity(v2.v, r.v) AS c, "
    "list_transform(v2.terms, lambda t: len(list_filter(r.tokens, lambda w: w = t))) AS tfs FROM v2 CROSS JOIN r), vs AS (SELECT *, "
    "CASE WHEN len(tfs) > 0 AND len(list_filter(tfs, lambda n: n = 0)) = 0 THEN list_avg(list_transform(tfs, lambda n: n / (n + 1.0))) "
    "ELSE 0 END AS kw FROM vp), vk AS (SELECT query_id, variant, resource_id, round(0.7 * c + 0.3 * kw, 6) AS score FROM vs WHERE "
    "round(c, 6) >= 0.2 OR kw > 0 QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, resource_id) <= 10)"
).format(w=_WORDED)

ORACLE = {
    "source_searches": (
        f"{_NUMBERED}, g AS (SELECT query_id, resource_id, cosine, kind AS source_type, CASE WHEN kind IN ('bill', 'vote_question') AND qref "
        f"IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, kind ORDER BY cosine DESC, resource_id) ELSE {_BEST} END AS rank FROM x "
        f"WHERE CASE WHEN kind IN ('bill', 'vote_question') AND qref IS NOT NULL THEN ref = qref AND cosine >= CASE kind WHEN 'bill' THEN "
        f"0.5 ELSE 0.1 END ELSE cosine >= 0.1 END) SELECT * FROM g WHERE rank <= 3"
    ),
    "reference_search": (
        f"{_NUMBERED} SELECT query_id, resource_id, ref AS reference, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, "
        f"resource_id) AS rank FROM x WHERE language = 'en' AND ref = qref AND cosine >= -0.2 QUALIFY rank <= 10"
    ),
    "filtered_search": (
        f"{_NUMBERED}, h AS (SELECT *, coalesce(own = language, false) AS mine FROM x WHERE kind = 'hansard' AND length(text) > 300 AND "
        f"cosine >= 0), a AS (SELECT *, max(mine::INT) OVER (PARTITION BY query_id) AS any_mine FROM h) SELECT query_id, resource_id, "
        f"cosine, {_BEST} AS rank FROM a WHERE mine OR any_mine = 0 QUALIFY rank <= 5"
    ),
    "variant_search": (
        f"WITH {_R}, {_Q}, {_VARIANTS} SELECT query_id AS list_id, resource_id, max(score) AS similarity, row_number() OVER (PARTITION BY "
        f"query_id ORDER BY max(score) DESC, resource_id) AS rank FROM vk GROUP BY query_id, resource_id QUALIFY rank <= 10"
    ),
    "scored_rerank": (
        f"{_lists()}, sc AS (SELECT list_id, resource_id, source_type, round(1.0 / (1 + resource_id % 17), 6) AS similarity, rank AS old "
        f"FROM c), sr AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY similarity DESC, old) AS rank FROM sc), f24 AS (SELECT "
        f"* FROM sr WHERE rank <= 24), {_diverse('sr', 'f24')} SELECT {_OUT} FROM "
        f"({_ADAPT.format(o='list_id, resource_id, source_type, similarity', ratio=0.7, floor=0.1, of='d')}) WHERE rank <= 8 AND similarity "
        f">= 0.1"
    ),
    "hybrid_search": f"WITH {_search_sql(10, 0.2)} {_SEARCHED}",
    "hybrid_lang_fallback": (
        f"WITH "
        f"{_search_sql(10, 0.2, lang=chr(40) + 'CASE WHEN q.query_id % 200 = 0 THEN ' + chr(39) + 'xx' + chr(39) + ' ELSE q.language END' + chr(41), fallback=True)} "
        f"{_SEARCHED}"
    ),
    "per_source_topk": f"WITH {_search_sql(3, 0.0, by='query_id, source_type')} {_SEARCHED}",
    "cosine_topk": (
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, r.vec_id AS "
        "resource_id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine, round(0.7 * list_cosine_similarity(q.v, r.v), 6) AS score FROM "
        "e q CROSS JOIN e r WHERE q.vec_id % 100 = 0) SELECT query_id, resource_id, cosine, row_number() OVER (PARTITION BY query_id ORDER "
        "BY score DESC, resource_id) AS rank FROM p QUALIFY rank <= 10"
    ),
    "score_gaps": (
        f"{_lists()} SELECT list_id, resource_id, rank, round(similarity - lead(similarity) OVER (PARTITION BY list_id ORDER BY rank), 6) AS "
        f"gap FROM c"
    ),
    "natural_cutoff": f"{_lists()} {_cut('c', 0.005)}",
    "adaptive_filter": f"{_lists()} SELECT {_OUT} FROM ({_ADAPT.format(o=_O, ratio=0.7, floor=0.05, of='c')})",
    "smart_filter": f"{_lists()}, a1 AS ({_ADAPT.format(o=_O, ratio=0.5, floor=0.05, of='c')}) {_cut('a1', 0.02)}",
    "balance_sources": (
        f"{_lists()} SELECT list_id, resource_id, source_type, similarity, row_number() OVER (PARTITION BY list_id ORDER BY over, rank) AS "
        f"rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY list_id, source_type ORDER BY rank) > 4 AS INT) AS over FROM c) QUALIFY "
        f"row_number() OVER (PARTITION BY list_id ORDER BY over, rank) <= 10"
    ),
    "slot_allocation": (
        f"{_lists()}, z AS "
        f"({_slots_sql('c', chr(39) + 'legal_section' + chr(39) + ', ' + chr(39) + 'bill_summary' + chr(39), chr(39) + 'hansard' + chr(39), 2, 8)}) "
        f"SELECT list_id, resource_id, source_type, similarity, new_rank AS rank FROM z"
    ),
    "multi_query_union_dedup": (
        f"{_lists(10)}, b AS (SELECT 0 AS list_id, resource_id, max(similarity) AS similarity, any_value(source_type) AS source_type FROM c "
        f"GROUP BY resource_id) SELECT list_id, resource_id, source_type, similarity, row_number() OVER (ORDER BY similarity DESC, "
        f"resource_id) AS rank FROM b QUALIFY rank <= 50"
    ),
    "source_diversity": f"{_lists()}, f5 AS (SELECT * FROM c WHERE rank <= 5), {_diverse('c', 'f5')} SELECT {_OUT} FROM d",
    "heuristic_rerank": (
        f"{_lists()}, hs AS (SELECT c.list_id, c.resource_id, c.source_type, c.language, c.rank AS old, round(c.similarity + CASE WHEN "
        f"c.language = 'fr' THEN 0.12 ELSE 0 END + CASE WHEN c.resource_id % 3 = 0 THEN 0.03 ELSE 0 END + CASE WHEN c.source_type = "
        f"'hansard' THEN 0.03 ELSE 0 END + CASE WHEN c.source_type IN ('committee', 'committee_report', 'committee_meeting') THEN 0.03 ELSE "
        f"0 END + CASE WHEN CAST(d.published_on AS VARCHAR) >= '2022-01-01' THEN 0.01 ELSE 0 END, 6) AS similarity FROM c JOIN documents d "
        f"ON d.doc_id = c.resource_id), hr AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY similarity DESC, old) AS rank FROM "
        f"hs) SELECT {_OUT} FROM ({_ADAPT.format(o=_O, ratio=0.7, floor=0.05, of='hr')}) WHERE rank <= 10"
    ),
    "rerank_pipeline": (
        f"{_lists()}, f18 AS (SELECT * FROM c WHERE rank <= 18), {_diverse('c', 'f18')}, z AS "
        f"({_slots_sql('d', chr(39) + 'hansard' + chr(39) + ', ' + chr(39) + 'politician' + chr(39) + ', ' + chr(39) + 'riding' + chr(39), chr(39) + 'bill' + chr(39) + ', ' + chr(39) + 'vote_question' + chr(39), 2, 12)}), "
        f"zz AS (SELECT list_id, resource_id, source_type, similarity, new_rank AS rank FROM z) SELECT {_OUT} FROM "
        f"({_ADAPT.format(o='list_id, resource_id, source_type, similarity', ratio=0.7, floor=0.1, of='zz')}) WHERE rank <= 6"
    ),
    "definition_boost": (
        f"{_lists()}, m AS (SELECT list_id, resource_id, source_type, round(CASE WHEN language = 'fr' THEN least(1.0, similarity + 0.15) "
        f"ELSE similarity END, 6) AS similarity FROM c WHERE language IN ('fr', 'en')) SELECT list_id, resource_id, source_type, similarity, "
        f"row_number() OVER (PARTITION BY list_id ORDER BY similarity DESC, resource_id) AS rank FROM m QUALIFY rank <= 10"
    ),
    "snippet_citations": (
        f"{_lists(10)}, {_SNIPPET}, u AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY list_id, lower(snippet) ORDER BY rank) = "
        f"1) SELECT list_id, resource_id, snippet, 'P' || row_number() OVER (PARTITION BY list_id ORDER BY rank) AS citation_id FROM u"
    ),
    "top_per_type": (
        f"{_lists()} SELECT {_OUT} FROM c WHERE source_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY list_id, source_type ORDER "
        f"BY rank) = 1"
    ),
    "allowed_citations": f"{_lists()} SELECT {_OUT} FROM c WHERE source_type IN ('hansard', 'politician')",
    "valid_vectors": (
        "SELECT label, count(*) AS vectors, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR "
        "isnan(x) OR isinf(x))) = 0) AS valid FROM embeddings GROUP BY label"
    ),
}
