"""Queries on texts, chunks, linked terms and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions.keys import norm_key, standing
from brindle.operators import chunking as ch
from brindle.operators import linking as ln
from brindle.operators.diff import diff_copies
from brindle.tables import load


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents")


def language_detect(spark: SparkSession, base: str) -> DataFrame:
    d = _docs(spark, base).select("doc_id", tx.language(F.col("text")).alias("language"))
    return d


def ref_number_extract(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", tx.bill_number(F.col("text")).alias("bill")).filter("bill is not null")


def normalize_terms(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "acts").select("id", tx.folded_term(F.col("title")).alias("term")).filter("term is not null").distinct()


def sentence_split(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).filter("text is not null").select("doc_id", F.size(tx.sentence_array(F.col("text"))).alias("sentences"))


def estimate_tokens(spark: SparkSession, base: str) -> DataFrame:
    return _docs(spark, base).select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


def scalar_functions(spark: SparkSession, base: str) -> DataFrame:
    """Ordinals, translated ids, dates and repeal marks over regulations."""
    r = load(spark, base, "regulations").select("regulation_id", F.length("title").alias("n"), "status", "title", F.col("registration_date")
        .cast("string").alias("d"), "id").distinct()
    return r.select("id", "regulation_id", tx.ordinal(F.col("n")).alias("place"), tx.translated_regulation_id(F.col("regulation_id"), "fr")
        .alias("other_id"), tx.parsed_date(F.col("d")).alias("day"), tx.is_repealed(F.col("status"), F.col("title")).alias("repealed")).distinct()


def query_reformulations(spark: SparkSession, base: str) -> DataFrame:
    d = _docs(spark, base)
    return d.select("doc_id", F.posexplode(tx.reformulations(F.coalesce("text", F.lit("")), F.col("lang"))).alias("place", "query"))


def mention_flags(spark: SparkSession, base: str) -> DataFrame:
    """Documents by the kinds of thing that they name."""
    low = F.lower("text")
    d = _docs(spark, base).filter("text is not null")
    return d.select("doc_id", low.rlike("bill|projet de loi").alias("bill"), low.rlike("vote|voix").alias("vote"), low.rlike("committee|comité")
        .alias("committee"), low.contains("minist").alias("minister"))


def _chunks(chunk):
    def query(spark: SparkSession, base: str) -> DataFrame:
        rows = ch.chunk_rows(_docs(spark, base), "doc_id", "text", chunk)
        return rows.select(F.col("item_id").alias("doc_id"), "chunk_index", "content", "kind", "marker")

    return query


def unit_counts(spark: SparkSession, base: str) -> DataFrame:
    """How many provisions of each kind the sections hold, by plain patterns."""
    d = _docs(spark, base).filter("text is not null")
    marks = F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\s)(\(\d+\))(?=\s|[A-Z])"), 1)).alias("marker")
    return d.select("doc_id", marks).groupBy("doc_id").agg(F.count(F.lit(1)).alias("subsections"))


def bilingual_expand(spark: SparkSession, base: str) -> DataFrame:
    b = load(spark, base, "bills_bill").select("id", "bill_number", "name_en", "name_fr", "short_title_en", "short_title_fr").distinct()
    side = lambda code: F.struct(F.lit(code).alias("language"),
        F.concat_ws("\n", F.concat(F.lit("Bill " if code == "en" else "Projet de loi "), F.col("bill_number")), tx.filled(F.col(f"name_{code}")),
        tx.filled(F.col(f"short_title_{code}"))).alias("content"))
    return b.select("id", F.explode(F.array(side("en"), side("fr"))).alias("r")).select("id", "r.*").withColumn("resource_key",
        F.concat_ws(":", F.lit("bill"), F.col("id").cast("string"), "language", F.lit("0")))


def citation_links(spark: SparkSession, base: str) -> DataFrame:
    """Bilingual citation text and address of each reference, the target's address for references to acts and regulations."""
    x = load(spark, base, "cross_references").select("id", "target_type", norm_key(F.col("target_ref")).alias("ref"),
        "source_section_label").distinct().filter("ref is not null")
    anchor = F.regexp_replace(F.coalesce("source_section_label", F.lit("")), "[^a-zA-Z0-9.]", "")
    folder = lambda act, reg: F.when(F.col("target_type") == "act", act).otherwise(reg)
    url = lambda lang, act, reg: F.concat(F.lit(f"https://laws.example/{lang}/"), folder(act, reg), F.lit("/"), F.col("ref"),
        F.when(anchor != "", F.concat(F.lit("#sec"), anchor)).otherwise(""))
    return x.select("id", F.concat(F.col("ref"), F.when(anchor != "", F.concat(F.lit(", s "), anchor)).otherwise("")).alias("text_en"),
        F.concat(F.col("ref"), F.when(anchor != "", F.concat(F.lit(", art "), anchor)).otherwise("")).alias("text_fr"),
        url("eng", "acts", "regulations").alias("url_en"), url("fra", "lois", "reglements").alias("url_fr"))


def paired_resources(spark: SparkSession, base: str) -> DataFrame:
    """Each resource with its counterpart in the other language, if there is one."""
    r = standing(load(spark, base, "leg_resources").select("resource_key", "paired_resource_key", "language", "updated_at", "id"), ["resource_key"],
        "updated_at")
    other = r.select(F.col("resource_key").alias("ok"), F.col("language").alias("other_language"), F.col("id").alias("other_id"))
    return r.join(other, F.col("paired_resource_key") == F.col("ok"), "left").select("resource_key", "language", "other_language", "other_id")


def _terms(spark: SparkSession, base: str) -> DataFrame:
    """Acts' titles as terms with the other language's title as paired term, for some; sections by year."""
    a = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("doc"), "language", "updated_at", "id", "title", "enacted_date"),
        ["doc", "language"], "updated_at", "id")
    named = a.filter("title is not null and title <> ''")
    other = named.select(F.col("doc").alias("d2"), F.col("language").alias("l2"), F.col("title").alias("t2"))
    both = named.join(other, (F.col("doc") == F.col("d2")) & (F.col("language") != F.col("l2")), "left")
    told = F.ascii(F.right("id", F.lit(1))) % 3
    paired = F.when(told == 0, F.col("t2")).when(told == 1, F.concat(F.lit("x or "), F.col("t2")))
    return both.select("id", "language", F.substring("doc", 1, 1).alias("doc"), F.year("enacted_date").cast("string").alias("section"), F.col("title")
        .alias("term"), paired.alias("paired_term"))


def three_pass_link(spark: SparkSession, base: str) -> DataFrame:
    return ln.link_terms(_terms(spark, base))


def near_match_levenshtein(spark: SparkSession, base: str) -> DataFrame:
    a = load(spark, base, "acts").select("act_id", "language", "title").filter("title is not null")
    return ln.near_matches(a, "act_id", "language", "title")


def verify_diff(spark: SparkSession, base: str) -> DataFrame:
    """Documents against a changed copy: rows that lack or differ, field by field."""
    d = _docs(spark, base).select("doc_id", "lang", "source", "act_ref")
    copy = d.filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "zz").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 15 == 0, F.lit(None)).otherwise(F.col("source")).alias("source"), "act_ref")
    left = d.filter("doc_id % 11 <> 0")
    return diff_copies(left, copy, ["doc_id"], ["lang", "source", "act_ref"]).select("doc_id", "difference", "left_value", "right_value")


def integrity_fk(spark: SparkSession, base: str) -> DataFrame:
    pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("bills_votequestion", "bill_id", "bills_bill", "id")]
    found = [ln.missing_parents(load(spark, base, c), k, load(spark, base, p), pk)
        .select(F.lit(c).alias("table_name"), F.col("key").cast("string").alias("key"), "rows") for c, k, p, pk in pairs]
    return reduce(DataFrame.unionByName, found)


def integrity_totals(spark: SparkSession, base: str) -> DataFrame:
    v = load(spark, base, "bills_votequestion").distinct()
    return ln.violations(v, result_known=F.col("result").isin("Y", "N", "T"), totals_not_negative=(F.col("yea_total") >= 0)
        & (F.col("nay_total") >= 0), passed_has_majority=(F.col("result") != "Y") | (F.col("yea_total") > F.col("nay_total")),
        bill_given=F.col("bill_id").isNotNull())


def vote_sums(spark: SparkSession, base: str) -> DataFrame:
    """Orders whose number of lines by flag is far from what a row of totals says (conditional counts)."""
    l = load(spark, base, "lineitem")
    return l.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("r")).filter("a + n + r >= 7 and abs(a - r) < 2")


def unique_keys(spark: SparkSession, base: str) -> DataFrame:
    return ln.repeated_keys(load(spark, base, "hansards_statement"), "document_id", "sequence")


def sequence_gaps(spark: SparkSession, base: str) -> DataFrame:
    """Statements whose length does not exceed that of the one before in their document."""
    h = load(spark, base, "hansards_statement").select("id", "document_id", F.col("wordcount").alias("sequence"), "statement_time").distinct()
    return ln.sequence_breaks(h, "document_id", ["statement_time", "id"], "sequence", F.date_trunc("hour", "statement_time")).select("id",
        "document_id", "sequence", "before")


QUERIES = {f.__name__: f for f in (language_detect, ref_number_extract, normalize_terms, sentence_split, estimate_tokens, scalar_functions,
    query_reformulations, mention_flags, unit_counts, bilingual_expand, citation_links, paired_resources, three_pass_link, near_match_levenshtein,
    verify_diff, integrity_fk, integrity_totals, vote_sums, unique_keys, sequence_gaps)}
QUERIES |= {
    "chunk_text": _chunks(lambda t: ch.by_chars(t, 600, 100)), "chunk_tokens": _chunks(lambda t: ch.by_tokens(t, 100, 20)),
        "legal_units": _chunks(ch.legal_units),
    "legal_chunks": _chunks(lambda t: ch.legal_chunks(t, 100, 20, "§ ")),
        "paragraph_chunks": _chunks(lambda t: ch.paragraph_chunks(t, ("Speaker: A",), 600, 100)),
}


def bill_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Documents as bills: every third line that stands alone in capitals or begins a part is a heading."""
    marked = _docs(spark, base).withColumn("text", BILL_TEXT(F.col("text")))
    rows = ch.chunk_rows(marked, "doc_id", "text", lambda t: ch.bill_chunks(t, ("Bill C-1", "Session: 44-1"), 600, 100))
    return rows.select(F.col("item_id").alias("doc_id"), "chunk_index", "content", "kind", "marker")


def BILL_TEXT(col):  # noqa: N802
    """A text with headings put before its sentences that begin with a few words, so that there are sections to find."""
    for word, heading in (("The ", "SUMMARY"), ("We ", "PART 1 Fees"), ("Le ", "SCHEDULE"), ("Nous ", "DIVISION 2 Rules")):
        col = F.regexp_replace(col, rf"([.!?]) {word}", f"$1\n{heading}\n{word}")
    return col


def marker_types(spark: SparkSession, base: str) -> DataFrame:
    """Markers of provisions in the documents with their level, and how often each occurs."""
    marks = F.explode(F.regexp_extract_all("text", F.lit(r"\([0-9A-Za-z]{1,6}\)"), 0)).alias("marker")
    found = _docs(spark, base).filter("text is not null").select(marks).groupBy("marker").agg(F.count(F.lit(1)).alias("n"))
    return found.select("marker", "n", tx.marker_type(F.col("marker")).alias("level"))


QUERIES |= {"bill_chunks": bill_chunks, "marker_types": marker_types,
    "header_chunks": _chunks(lambda t: ch.with_header(t, "Gazette | Part I", 600, 100))}

_FR = "|".join(tx.FRENCH_WORDS + tx.FRENCH_PHRASES)
_FOLD = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'), '" + tx.ACCENTED + "', '" + tx.PLAIN + r"'), '[\x{{0300}}-\x{{036F}}]', '', 'g'), '[–—-]', ' ', 'g'), '[^a-z0-9\s\x0B]', '', 'g'), '[\s\x0B]+', ' ', 'g'))"
_WSQ = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_KEY = lambda x: (
    rf"nullif(regexp_replace(upper(regexp_replace({x}, '^[{_WSQ}]+|[{_WSQ}]+$', '', 'g')), '[{_WSQ}/\-\x{{2010}}-\x{{2015}}\x{{2212}}]+', "
    rf"'-', 'g'), '')"
)
_CHECKS = {"result_known": "result IN ('Y', 'N', 'T')", "totals_not_negative": "yea_total >= 0 AND nay_total >= 0",
    "passed_has_majority": "result <> 'Y' OR yea_total > nay_total", "bill_given": "bill_id IS NOT NULL"}
_ANCHOR = "regexp_replace(coalesce(source_section_label, ''), '[^a-zA-Z0-9.]', '', 'g')"

_TERMS = (
    f"t0 AS (SELECT {_KEY('act_id')} AS d, language, id, title, enacted_date FROM acts QUALIFY row_number() OVER (PARTITION BY "
    f"{_KEY('act_id')}, language ORDER BY updated_at DESC NULLS LAST, id DESC, title DESC NULLS LAST, enacted_date DESC NULLS LAST) = "
    f"1), n AS (SELECT * FROM t0 WHERE title <> ''), t AS (SELECT a.id, a.language, CASE a.language WHEN 'en' THEN 'fr' ELSE 'en' END AS "
    f"other, left(a.d, 1) AS doc, CAST(year(a.enacted_date) AS VARCHAR) AS section, {_FOLD.format(x='a.title')} AS norm, CASE "
    f"ascii(right(a.id, 1)) % 3 WHEN 0 THEN trim(b.title) WHEN 1 THEN trim('x or ' || b.title) END AS paired FROM n a LEFT JOIN n b ON "
    f"a.d = b.d AND a.language <> b.language)"
)
_LINKS = (
    f"told AS (SELECT * FROM t WHERE paired <> '' AND NOT regexp_matches(paired, '(?i)^((Version (anglaise|française) "
    f"seulement)|((English|French) version only))$')), parts AS (SELECT id, other, doc, section, paired, "
    f"list_filter(list_transform(regexp_split_to_array(paired, '(?i)\\s+(?:or|ou)\\s+|,\\s*'), lambda x: trim(x)), lambda x: x <> '' AND "
    f"x <> paired) AS p FROM told), cand AS (SELECT id, other, doc, section, unnest(CASE WHEN contains(paired, 'Version') OR "
    f"contains(paired, 'version only') THEN [paired] ELSE list_concat([paired], p) END) AS c, generate_subscripts(CASE WHEN "
    f"contains(paired, 'Version') OR contains(paired, 'version only') THEN [paired] ELSE list_concat([paired], p) END, 1) AS place FROM "
    f"parts), target AS (SELECT language, doc, section, norm, max(id) AS linked FROM t GROUP BY ALL), p1 AS (SELECT c.id, "
    f"arg_min(g.linked, c.place) AS linked_id FROM cand c JOIN target g ON c.other = g.language AND c.doc = g.doc AND c.section = "
    f"g.section AND g.norm = {_FOLD.format(x='c.c')} WHERE g.norm <> '' GROUP BY c.id), u AS (SELECT language, doc, norm, max(id) AS uid "
    f"FROM t GROUP BY ALL HAVING count(*) = 1), p2 AS (SELECT s.id, u.uid AS linked_id FROM told s JOIN u ON s.other = u.language AND "
    f"s.doc = u.doc AND u.norm = {_FOLD.format(x='s.paired')} WHERE s.id IN (SELECT uid FROM u) AND s.id NOT IN (SELECT id FROM p1)), q "
    f"AS (SELECT * FROM t WHERE coalesce(paired, '') = '' AND id NOT IN (SELECT id FROM p1) AND id NOT IN (SELECT id FROM p2) AND doc IS "
    f"NOT NULL AND section IS NOT NULL), one AS (SELECT doc, section, max(id) FILTER (language = 'en') AS a, max(id) FILTER (language = "
    f"'fr') AS b FROM q GROUP BY ALL HAVING count(*) FILTER (language = 'en') = 1 AND count(*) FILTER (language = 'fr') = 1)"
)

#: White space of Python's texts, in a class of the SQL engine's patterns.
_SPACES = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STRIP = lambda x: f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"
_TIDY = lambda x: _STRIP(f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _windows_sql(source: str, size: str, overlap: int) -> str:
    """Windows of the texts ``x`` of ``source`` (``k``, ``x``, ``n`` characters, and ``size``) as ``w``: start ``s``, end ``e``."""
    end = lambda s: (
        f"CASE WHEN {s} + {size} >= t.n THEN t.n ELSE greatest({s}, {s} + {size} - 200) + coalesce(nullif(length(regexp_extract(substr(t.x, "
        f"CAST(greatest({s}, {s} + {size} - 200) + 1 AS BIGINT), CAST({s} + {size} + 200 - greatest({s}, {s} + {size} - 200) AS BIGINT)), "
        f"'(?s)^(.*[.!?])[{_SPACES}]', 1)), 0), {s} + {size} - greatest({s}, {s} + {size} - 200)) END"
    )
    first = f"SELECT t.k, 0 AS i, 0 AS s, CASE WHEN t.n <= {size} THEN t.n ELSE {end('0')} END AS e FROM {source} t"
    more = f"SELECT t.k, w.i + 1, w.e - {overlap}, {end(f'(w.e - {overlap})')} FROM w JOIN {source} t ON w.k = t.k WHERE t.n > {size} AND w.e - {overlap} > w.s"
    return f"w(k, i, s, e) AS ({first} UNION ALL {more})"


def _pack_sql(source: str, most: str, overlap: int, whole_rest: bool = False) -> str:
    """Chunks of the pieces of ``source`` (``k``, ``pieces``, ``sizes`` and the places ``breaks`` that begin a chunk) as ``c``:
    first piece ``a`` (with the overlap), first new piece ``f``, last piece ``b``."""
    last = lambda a, f: (
        f"greatest({f}, least(coalesce(list_filter(p.breaks, lambda y: y > {f})[1] - 1, len(p.pieces)), len(list_filter(p.sums, lambda y: y "
        f"<= p.sums[{a}] + {most})) - 1))"
    )
    first = f"SELECT p.k, 1 AS a, 1 AS f, {last('1', '1')} AS b FROM {source} p"
    tail = (
        f"CASE WHEN list_contains(p.breaks, c.b + 1) THEN c.b + 1 ELSE greatest(c.a, len(list_filter(p.sums, lambda y: y < p.sums[c.b + 1] - "
        f"{overlap})) + 1) END"
    )
    whole = "CASE WHEN q <= o AND ends[q] <= o AND q > greatest(old, firsts[q]) THEN ends[q] + 1 ELSE q END"  # what a cut unit leaves is one piece
    more = (
        f"SELECT k, a, f, {last('a', 'f')} FROM (SELECT *, {whole if whole_rest else 'q'} AS a, o + 1 AS f FROM (SELECT p.*, {tail} AS q, "
        f"c.b AS o, c.a AS old FROM c JOIN {source} p ON c.k = p.k WHERE c.b < len(p.pieces))) p"
    )
    return f"c(k, a, f, b) AS ({first} UNION ALL {more})"


_TEXTS = (
    f"t AS (SELECT doc_id AS k, x, length(x) AS n, raw FROM (SELECT doc_id, {_TIDY('text')} AS x, text AS raw FROM documents WHERE text "
    f"IS NOT NULL) WHERE x <> '')"
)
_SENTENCES = f"list_filter(string_split(regexp_replace(x, '([.!?])[{_SPACES}]+', '\\1' || chr(57585), 'g'), chr(57585)), lambda y: {_STRIP('y')} <> '')"
_WORDS = f"list_filter(regexp_split_to_array(y, '[{_SPACES}]+'), lambda z: z <> '')"
_MARKER = r"(\(\d+\)|\([a-z]\)|\([ivxlcdm]+\)|\([A-Z]\))"
_MARKED = f"regexp_replace(x, '(^|[{_SPACES}]){_MARKER}([{_SPACES}A-Z])', '\\1' || chr(57585) || '\\2\\3', 'g')"
_PARTS = f"string_split({_MARKED.replace('(x,', '(' + _MARKED + ',')}, chr(57585))"
_KIND = (
    r"CASE WHEN regexp_matches(m, '^\(\d+\)$') THEN 'subsection' WHEN regexp_matches(m, '^\((?i:[ivx]{2,}|[ivx])\)$') THEN "
    r"'subparagraph' WHEN regexp_matches(m, '^\([a-z]\)$') THEN 'paragraph' WHEN regexp_matches(m, '^\([A-Z]\)$') THEN 'clause' END"
)
_SUMS = "list_concat([0], list_transform(range(1, len(sizes) + 1), lambda i: CAST(list_sum(sizes[1:i]) AS BIGINT)))"
_CHUNKS = (
    "SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS chunk_index, content, CAST(NULL AS VARCHAR) "
    "AS kind, CAST(NULL AS VARCHAR) AS marker FROM ({rows}) WHERE content <> ''"
)


def _packed_sql(units: str, most: str, overlap: int, whole: str, prefix: str, body: str = "x", whole_rest: bool = False) -> str:
    """Chunks of the list ``units`` over the texts, those beyond ``most`` by words; ``whole`` tells which texts stay whole."""
    pieces = (
        f"SELECT k, pos, CASE WHEN ceil(length(y) / 4) > {most} THEN {_WORDS} ELSE [y] END AS own, ceil(length(y) / 4) > {most} AS cut FROM "
        f"(SELECT k, unnest(u) AS y, generate_subscripts(u, 1) AS pos FROM (SELECT k, {units} AS u FROM t WHERE NOT {whole}))"
    )
    sized = (
        "SELECT k, flatten(list(own ORDER BY pos)) AS pieces, flatten(list(CASE WHEN cut THEN list_transform(own, lambda z: "
        "CAST(ceil((length(z) + 1) / 4) AS BIGINT)) ELSE [CAST(ceil(length(own[1]) / 4) AS BIGINT)] END ORDER BY pos)) AS sizes, "
        "flatten(list(list_transform(own, lambda z, i: cut AND i = 1) ORDER BY pos)) AS starts, flatten(list(list_transform(own, lambda z: "
        "upto - len(own) + 1) ORDER BY pos)) AS firsts, flatten(list(list_transform(own, lambda z: upto) ORDER BY pos)) AS ends FROM "
        "(SELECT *, CAST(sum(len(own)) OVER (PARTITION BY k ORDER BY pos) AS BIGINT) AS upto FROM pc) GROUP BY k"
    )
    source = f"SELECT k, pieces, {_SUMS} AS sums, list_filter(range(1, len(pieces) + 1), lambda i: starts[i]) AS breaks, firsts, ends FROM sz"
    rows = (
        f"SELECT k, 0 AS i, {prefix} || {body} AS content FROM t WHERE {whole} UNION ALL SELECT c.k, c.f, {prefix} || "
        f"{_STRIP(chr(39).join(['array_to_string(pc2.pieces[c.a:c.b], ', ' ', ')']))} FROM c JOIN pc2 ON c.k = pc2.k"
    )
    return (
        f"WITH RECURSIVE {_TEXTS}, pc AS ({pieces}), sz AS ({sized}), pc2 AS ({source}), {_pack_sql('pc2', most, overlap, whole_rest)} "
        f"{_CHUNKS.format(rows=rows)}"
    )


def _under_sql(source: str, order: str, size: int, overlap: int) -> str:
    """The texts ``body`` of ``source`` (``k``, ``ord``, ``head``, ``body``) under their heads, by windows if they do not fit."""
    rows = f"SELECT k, ord, head, body AS x, length(body) AS n, {size} - length(head) AS sz FROM {source}"
    long = f"SELECT k * 100000 + ord AS k, {_TIDY('x')} AS x, length({_TIDY('x')}) AS n, sz, head FROM un WHERE n > sz"
    cut = _STRIP("substr(l.x, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))")
    out = (
        f"SELECT k, ord * 100000 AS i, head || x AS content FROM un WHERE n <= sz UNION ALL SELECT l.k // 100000, (l.k % 100000) * 100000 + "
        f"w.i, l.head || {cut} FROM w JOIN lg l ON w.k = l.k WHERE {cut} <> ''"
    )
    return f"un AS ({rows}), lg AS ({long}), {_windows_sql('lg', 't.sz', overlap)}, o AS ({out}) {order}"


_HEADS = "'Speaker: A' || chr(10) || chr(10)"
_PLAIN_SPEECH = _STRIP((
    "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), "
    "'</?p>', chr(10), 'g'), '<[^>]+>', '', 'g')"
))
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(x, '\\n\\n+'), lambda y: {_STRIP('y')}), lambda y: y <> '')"
_SPEECHES = (
    f"t AS (SELECT doc_id AS k, {_PLAIN_SPEECH} AS x FROM documents WHERE text IS NOT NULL), p0 AS (SELECT *, {_PARAGRAPHS} AS ps FROM t "
    f"WHERE x <> ''), sz AS (SELECT k, ps AS pieces, list_transform(ps, lambda y: length(y) + 2) AS sizes FROM p0 WHERE len(ps) > 1 AND "
    f"length(x) > 588), pc2 AS (SELECT k, pieces, {_SUMS} AS sums, list_filter(range(1, len(pieces) + 1), lambda i: sizes[i] > 590 OR (i "
    f"> 1 AND sizes[i - 1] > 590)) AS breaks FROM sz)"
)
_BILL = "CASE WHEN text IS NOT NULL THEN " + "regexp_replace(" * 4 + "text" + "".join(
    f", '([.!?]) {word}', '\\1' || chr(10) || '{heading}' || chr(10) || '{word}', 'g')" for word,
    heading in (("The ", "SUMMARY"), ("We ", "PART 1 Fees"), ("Le ", "SCHEDULE"), ("Nous ", "DIVISION 2 Rules"))) + " END"
_BILLS = (
    f"t AS (SELECT doc_id AS k, regexp_replace(replace({_BILL}, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x "
    f"FROM documents WHERE text IS NOT NULL), p AS (SELECT k, string_split(regexp_replace(x, '(?m)^(PART +\\d+(?: +.+)?|DIVISION "
    f"+\\d+(?: +.+)?|(?i:SCHEDULE) *\\d*|SUMMARY|RECOMMENDATION|TABLE OF PROVISIONS|SHORT TITLE|INTERPRETATION) *$', chr(57585) || "
    f"'\\1', 'g'), chr(57585)) AS ps FROM t WHERE {_STRIP('x')} <> ''), u AS (SELECT k, len(ps) AS parts, unnest(ps) AS part, "
    f"generate_subscripts(ps, 1) AS ord FROM p), src AS (SELECT k, ord, 'Bill C-1 | Session: 44-1' || CASE WHEN parts = 1 THEN '' WHEN "
    f"ord = 1 THEN ' | PREAMBLE' ELSE ' | ' || string_split(part, chr(10))[1] END || chr(10) || chr(10) AS head, CASE WHEN parts = 1 "
    f"THEN part ELSE {_STRIP('part')} END AS body FROM u WHERE parts = 1 OR ({_STRIP('part')} <> '' AND (ord > 1 OR length(part) > "
    f"100)))"
)

ORACLE = {
    "legal_chunks": _packed_sql(f"list_filter(list_transform({_PARTS}, lambda y: {_STRIP('y')}), lambda y: y <> '')", "89", 20,
        "(ceil((length(raw) + 2) / 4) <= 100 OR ceil(n / 4) <= 89)", "'§ '", "CASE WHEN ceil((length(raw) + 2) / 4) <= 100 THEN raw ELSE x END",
        whole_rest=True),
    "marker_types": (
        r"WITH t AS (SELECT unnest(regexp_extract_all(text, '\([0-9A-Za-z]{1,6}\)')) AS m FROM documents WHERE text IS NOT NULL) "
        f"SELECT m AS marker, count(*) AS n, {_KIND} AS level FROM t GROUP BY m"
    ),
    "header_chunks": (
        f"WITH RECURSIVE {_TEXTS}, src AS (SELECT k, 0 AS ord, 'Gazette | Part I' || chr(10) || chr(10) AS head, x AS body FROM t), "
        f"{_under_sql('src', _CHUNKS.format(rows='FROM o'), 600, 100)}"
    ),
    "paragraph_chunks": (
        f"WITH RECURSIVE {_SPEECHES}, {_pack_sql('pc2', '590', 0)}, src AS (SELECT k, 0 AS ord, {_HEADS} AS head, x AS body FROM p0 WHERE "
        f"NOT (len(ps) > 1 AND length(x) > 588) UNION ALL SELECT c.k, c.f, {_HEADS}, array_to_string(pc2.pieces[c.a:c.b], chr(10) || "
        f"chr(10)) FROM c JOIN pc2 ON c.k = pc2.k), {_under_sql('src', _CHUNKS.format(rows='FROM o'), 600, 100)}"
    ),
    "bill_chunks": f"WITH RECURSIVE {_BILLS}, {_under_sql('src', _CHUNKS.format(rows='FROM o'), 600, 100)}",
    "chunk_text": (
        f"WITH RECURSIVE {_TEXTS}, {_windows_sql('t', '600', 100)} "
        f"{_CHUNKS.format(rows='SELECT w.k, i, ' + _STRIP('substr(t.x, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))') + ' AS content FROM w JOIN t ON w.k = t.k')}"
    ),
    "chunk_tokens": _packed_sql(_SENTENCES, "100", 20, "ceil(n / 4) <= 100", "''"),
    "legal_units": (
        f"WITH t AS (SELECT doc_id AS k, text AS x FROM documents WHERE text IS NOT NULL), u AS (SELECT k, unnest(p) AS part, "
        f"generate_subscripts(p, 1) AS pos, len(p) AS parts FROM (SELECT k, {_PARTS} AS p FROM t WHERE x <> '')), v AS (SELECT k, pos, "
        f"parts, {_STRIP('part')} AS content, CASE WHEN pos > 1 THEN regexp_extract(part, '^{_MARKER}', 1) END AS m FROM u) SELECT k AS "
        f"doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS INT) AS chunk_index, content, {_KIND} AS kind, m AS marker "
        f"FROM v WHERE content <> '' OR parts = 1"
    ),
    "three_pass_link": (
        f"WITH {_TERMS}, {_LINKS} SELECT id, linked_id, 1 AS pass FROM p1 UNION ALL SELECT id, linked_id, 2 FROM p2 UNION ALL SELECT a, b, 3 "
        f"FROM one UNION ALL SELECT b, a, 3 FROM one"
    ),
    "ref_number_extract": (
        r"SELECT doc_id, upper(regexp_extract(text, '\b([CScs]-\d+)\b', 1)) AS bill FROM documents WHERE regexp_extract(text, "
        r"'\b([CScs]-\d+)\b', 1) <> ''"
    ),
    "language_detect": (
        rf"SELECT doc_id, CASE WHEN n >= 2 OR (n >= 1 AND regexp_matches(lower(text), '[àâäéèêëïîôùûüÿœæç]')) THEN 'fr' ELSE 'en' END AS "
        rf"language FROM (SELECT doc_id, text, len(list_filter(regexp_extract_all(replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', ' "
        rf" ', 'g'), 'projet  de  loi', 'projetdeloi'), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({', '.join(repr(w) for w in tx.FRENCH_WORDS)}, "
        rf"'projetdeloi'))) AS n FROM documents)"
    ),
    "normalize_terms": f"SELECT DISTINCT id, {_FOLD.format(x='title')} AS term FROM acts WHERE title IS NOT NULL",
    "sentence_split": (
        r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda s: "
        r"trim(s, ' ') <> '')) AS sentences FROM documents WHERE text IS NOT NULL"
    ),
    "estimate_tokens": "SELECT doc_id, CAST(ceil(length(text) / 4) AS INT) AS tokens FROM documents",
    "scalar_functions": (
        r"SELECT DISTINCT id, regulation_id, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 "
        r"THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS place, CASE WHEN starts_with(regulation_id, 'C.R.C._c. ') THEN 'C.R.C._ch. ' "
        r"|| substr(regulation_id, 11) WHEN starts_with(regulation_id, 'SOR-') THEN 'DORS-' || substr(regulation_id, 5) WHEN "
        r"starts_with(regulation_id, 'SI-') THEN 'TR-' || substr(regulation_id, 4) ELSE regulation_id END AS other_id, registration_date AS "
        r"day, coalesce(status = 'repealed', false) OR coalesce(regexp_matches(title, '(?i)^\d+(\.\d+)?\s*\[(Repealed|Abrogé)'), false) AS "
        r"repealed FROM (SELECT *, length(title) AS n FROM regulations)"
    ),
    "query_reformulations": (
        r"WITH b AS (SELECT doc_id, lang, nullif(upper(regexp_extract(coalesce(text, ''), '\b([CScs]-\d+)\b', 1)), '') AS bill FROM "
        r"documents) SELECT doc_id, place, CASE WHEN bill IS NULL AND coalesce(lang, '') = 'fr' THEN ['Contexte parlementaire lié', "
        r"'Informations officielles pertinentes'][place + 1] WHEN bill IS NULL THEN ['Related parliamentary context', 'Relevant official "
        r"information'][place + 1] WHEN coalesce(lang, '') = 'fr' THEN ['Résumé du projet de loi ', 'Contexte et statut du projet de loi "
        r"'][place + 1] || bill ELSE ['Summary of Bill ', 'Context and status of Bill '][place + 1] || bill END AS query FROM b CROSS JOIN "
        r"(SELECT unnest([0, 1])::INT AS place)"
    ),
    "mention_flags": (
        "SELECT doc_id, regexp_matches(lower(text), 'bill|projet de loi') AS bill, regexp_matches(lower(text), 'vote|voix') AS vote, "
        "regexp_matches(lower(text), 'committee|comité') AS committee, contains(lower(text), 'minist') AS minister FROM documents WHERE "
        "text IS NOT NULL"
    ),
    "unit_counts": (
        r"SELECT doc_id, n AS subsections FROM (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '(\(\d+\))', '\1 ', 'g'), "
        r"'(^|[\s\x0B])\(\d+\) [\s\x0BA-Z]')) AS n FROM documents) WHERE n > 0"
    ),
    "bilingual_expand": (
        "WITH b AS (SELECT DISTINCT id, bill_number, name_en, name_fr, short_title_en, short_title_fr FROM bills_bill) SELECT id, language, "
        "concat_ws(chr(10), head || bill_number, nullif(name, ''), nullif(short, '')) AS content, 'bill:' || id || ':' || language || ':0' "
        "AS resource_key FROM (SELECT id, bill_number, 'en' AS language, 'Bill ' AS head, name_en AS name, short_title_en AS short FROM b "
        "UNION ALL SELECT id, bill_number, 'fr', 'Projet de loi ', name_fr, short_title_fr FROM b)"
    ),
    "citation_links": (
        f"WITH x AS (SELECT DISTINCT id, target_type, {_KEY('target_ref')} AS ref, {_ANCHOR} AS a, source_section_label FROM "
        f"cross_references) SELECT id, ref || CASE WHEN a <> '' THEN ', s ' || a ELSE '' END AS text_en, ref || CASE WHEN a <> '' THEN ', "
        f"art ' || a ELSE '' END AS text_fr, 'https://laws.example/eng/' || CASE WHEN coalesce(target_type, '') = 'act' THEN 'acts' ELSE "
        f"'regulations' END || '/' || ref || CASE WHEN a <> '' THEN '#sec' || a ELSE '' END AS url_en, 'https://laws.example/fra/' || CASE "
        f"WHEN coalesce(target_type, '') = 'act' THEN 'lois' ELSE 'reglements' END || '/' || ref || CASE WHEN a <> '' THEN '#sec' || a ELSE "
        f"'' END AS url_fr FROM x WHERE ref IS NOT NULL"
    ),
    "paired_resources": (
        "WITH r AS (SELECT resource_key, paired_resource_key, language, id FROM leg_resources QUALIFY row_number() OVER (PARTITION BY "
        "resource_key ORDER BY updated_at DESC, paired_resource_key DESC NULLS LAST, language DESC NULLS LAST, id DESC) = 1) SELECT "
        "r.resource_key, r.language, o.language AS other_language, o.id AS other_id FROM r LEFT JOIN r o ON r.paired_resource_key = "
        "o.resource_key"
    ),
    # the engine's distance counts bytes: every other sign is first written as one that the names in lower case do not use
    "near_match_levenshtein": (
        "WITH n AS (SELECT DISTINCT language, lower(title) AS s FROM acts WHERE length(title) >= 5), "
        "c AS (SELECT DISTINCT unnest(string_split(s, '')) AS c FROM n), "
        "m AS (SELECT map(list(c ORDER BY c), list(chr((CASE WHEN i <= 31 THEN i ELSE i + 33 END)::INT) ORDER BY c)) AS m "
        "FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM c WHERE unicode(c) >= 128)), "
        "e AS (SELECT language, s, array_to_string(list_transform(string_split(s, ''), lambda x: coalesce(m.m[x], x)), '') AS t FROM n, m) "
        "SELECT a.language, a.s AS name_a, b.s AS name_b, levenshtein(a.t, b.t) AS distance FROM e a JOIN e b ON a.language = b.language "
        "AND a.s < b.s AND abs(length(a.s) - length(b.s)) <= 3 WHERE levenshtein(a.t, b.t) <= greatest(least(3, length(a.s) // 4), 2)"
    ),
    "verify_diff": (
        "WITH l AS (SELECT doc_id, lang, source, act_ref FROM documents WHERE doc_id % 11 <> 0), c AS (SELECT doc_id, CASE WHEN doc_id % 10 "
        "= 0 THEN 'zz' ELSE lang END AS lang, CASE WHEN doc_id % 15 = 0 THEN NULL ELSE source END AS source, act_ref FROM documents WHERE "
        "doc_id % 7 <> 0), j AS (SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, l.doc_id AS a, c.doc_id AS b, l.lang AS l1, c.lang AS l2, "
        "l.source AS s1, c.source AS s2 FROM l FULL JOIN c ON l.doc_id = c.doc_id) SELECT doc_id, CASE WHEN a IS NULL THEN "
        "'missing_in_left' ELSE 'missing_in_right' END AS difference, NULL AS left_value, NULL AS right_value FROM j WHERE a IS NULL OR b "
        "IS NULL UNION ALL SELECT doc_id, 'lang', l1, l2 FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND l1 IS DISTINCT FROM l2 UNION ALL "
        "SELECT doc_id, 'source', s1, s2 FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND s1 IS DISTINCT FROM s2"
    ),
    "integrity_fk": " UNION ALL ".join((
        f"SELECT '{c}' AS table_name, CAST({k} AS VARCHAR) AS key, count(*) AS rows FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT "
        f"{pk} FROM {p}) GROUP BY {k}"
    ) for c, k, p, pk in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("bills_votequestion", "bill_id", "bills_bill", "id"))),
    "integrity_totals": "WITH v AS (SELECT DISTINCT * FROM bills_votequestion) "
        + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({r})) AS rows FROM v" for n, r in _CHECKS.items()),
    "vote_sums": (
        "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER "
        "(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1 HAVING a + n + r >= 7 AND abs(a - r) < 2"
    ),
    "unique_keys": "SELECT document_id, sequence, count(*) AS rows FROM hansards_statement GROUP BY ALL HAVING count(*) > 1",
    "sequence_gaps": (
        "WITH h AS (SELECT DISTINCT id, document_id, wordcount AS sequence, statement_time FROM hansards_statement), w AS (SELECT *, "
        "lag(sequence) OVER (PARTITION BY document_id ORDER BY statement_time NULLS FIRST, id) AS before FROM h) SELECT id, document_id, "
        "sequence, before FROM w WHERE sequence <= before"
    ),
}
