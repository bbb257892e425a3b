"""Queries on XML and HTML that is made from the tables, and on incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.keys import norm_key, standing
from brindle.plans.data_quality import _sql_key
from brindle.sources import html, loading, xml
from brindle.tables import load


def _escaped(col: Column) -> Column:
    out = F.regexp_replace(F.coalesce(col, F.lit("")), "[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _statements_xml(spark: SparkSession, base: str) -> DataFrame:
    """One document a sitting: its statements, in order, as labelled sections under two levels of headings."""
    h = load(spark, base, "hansards_statement").select("id", "document_id", "sequence", "h1_en", "h2_en", "who_en", "content_en").distinct()
    section = F.concat(F.lit('<Heading level="1">'), _escaped(F.col("h1_en")), F.lit('</Heading><Heading level="2">'), _escaped(F.col("h2_en")),
        F.lit('</Heading><Section id="'), F.col("id").cast("string"), F.lit('"><MarginalNote>'), _escaped(F.col("who_en")),
        F.lit("</MarginalNote><Label>"), F.col("sequence").cast("string"), F.lit("</Label><Text>"), _escaped(F.col("content_en")),
        F.lit("</Text></Section>"))
    parts = h.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "id", section.alias("x")))).alias("p"))
    return parts.select("document_id", F.concat(F.lit("<Statute><Body>"), F.array_join(F.transform("p", lambda s: s["x"]), ""),
        F.lit("</Body></Statute>")).alias("xml"))


def xml_sections(spark: SparkSession, base: str) -> DataFrame:
    rows = xml.document_table(_statements_xml(spark, base), "document_id", "xml").filter("kind = 'section'")
    return rows.select("doc_id", "ordinal", "label", F.length("text").alias("chars"), F.array_join("path", "|").alias("path"))


def xml_audit(spark: SparkSession, base: str) -> DataFrame:
    """What elements, attributes, children and paths the documents have, with samples of each."""
    found = xml.element_audit(_statements_xml(spark, base), "xml")
    return found.select("tag", "elements", "n_paths", "n_children", *[F.array_join(c, ",").alias(c) for c in ("attrs", "children", "paths")])


def html_links(spark: SparkSession, base: str) -> DataFrame:
    x = load(spark, base, "cross_references").select("id", "target_ref").distinct().filter("target_ref is not null")
    page = x.select("id", F.concat(F.lit('<nav><a href="/laws/'), F.col("target_ref"), F.lit('">x</a><a href="/laws/'), F.col("target_ref"),
        F.lit('">again</a><a href="/home">h</a></nav>')).alias("page"))
    return html.page_links(page, "id", "page", "/laws/")


def html_strip(spark: SparkSession, base: str) -> DataFrame:
    d = load(spark, base, "documents").filter("text is not null").select("doc_id",
        F.concat(F.lit("<html><script>if (a<b) x();</script><p class='t'>"), F.regexp_replace("text", "[<>&]", ""), F.lit("</p></html>"))
        .alias("page"))
    return d.select("doc_id", html.plain_text(F.col("page")).alias("text"))


def incremental_rows(spark: SparkSession, base: str) -> DataFrame:
    """Resources of which a load has not yet done the key."""
    r = load(spark, base, "leg_resources").select("resource_key", "language")
    return loading.new_rows(r.select("resource_key"), r.filter("language = 'fr'").select("resource_key").distinct(), "resource_key")


def changed_pages(spark: SparkSession, base: str) -> DataFrame:
    now = load(spark, base, "acts").select("id", F.coalesce("title", F.lit("")).alias("title")).distinct()
    before = now.withColumn("title", F.when(F.length("title") % 4 == 0, F.upper("title")).otherwise(F.col("title"))).select("id",
        html.content_hash(F.col("title")).alias("hash"))
    return html.changed_pages(now, before, "id", "title").select("id", "hash")


def row_reconciliation(spark: SparkSession, base: str) -> DataFrame:
    return loading.reconcile(spark, {t: (load(spark, base, t), load(spark, base, f"{t}_copy")) for t in ("acts", "regulations")})


def _acts_xml(spark: SparkSession, base: str) -> DataFrame:
    """One document an act's standing row: what identifies it, a section with a footnote and a historical note, amendments."""
    a = standing(load(spark, base, "acts").select("id", "updated_at", "act_id", "title", "long_title", "status", "bill_origin", "consolidated_number",
        "enacted_date"), ["id"], "updated_at")
    tag = lambda name, value, more="": F.when(value.isNotNull(),
        F.concat(F.lit(f"<{name}{more}>"), _escaped(value), F.lit(f"</{name}>"))).otherwise("")
    some = lambda every, text: F.when(F.ascii(F.right("id", F.lit(1))) % every == 0, text).otherwise("")
    day = F.date_format("enacted_date", "yyyyMMdd")
    body = F.concat(
        F.lit('<Statute xmlns:lims="http://lims.example/lims" bill-type="govt-public" in-force="'), F.when(F.col("status") == "in-force", "yes")
            .otherwise("no"), F.lit('"'),
        F.when(F.col("bill_origin").isNotNull(), F.concat(F.lit(' bill-origin="'), _escaped(F.col("bill_origin")), F.lit('"'))).otherwise(""),
            F.when(day.isNotNull(), F.concat(F.lit(' lims:enacted-date="'), day, F.lit('"'))).otherwise(""),
        F.lit("><Identification>"), tag("ShortTitle", F.col("title"), ' status="official"'), tag("LongTitle", F.col("long_title")),
            F.lit('<Chapter><ConsolidatedNumber official="yes">'), _escaped(F.trim("act_id")), F.lit("</ConsolidatedNumber></Chapter>"),
        some(2, '<BillHistory><Stages stage="assented-to"><Date><YYYY>2001</YYYY><MM>2</MM></Date></Stages></BillHistory>'),
            F.lit("</Identification>"), some(3, "<Repealed>x</Repealed>"),
        F.lit('<Body><Section change="ins"><Label>1</Label><Text>'), _escaped(F.col("long_title")),
            F.lit('<Footnote id="f1" status="editorial"><Label>*</Label><Text>See above</Text></Footnote></Text>'), some(2, "<TableGroup/>"),
        F.lit('<HistoricalNote><HistoricalNoteSubItem lims:enacted-date="20010203">2001, c. 2</HistoricalNoteSubItem></HistoricalNote></Section></Body>'),
        some(5, (
            '<RecentAmendments><Amendment><AmendmentCitation link="2023_8">2023, c. '
            '8</AmendmentCitation><AmendmentDate>2023-01-01</AmendmentDate></Amendment></RecentAmendments>'
        )), F.lit("</Statute>"),
    )
    return a.select("id", body.alias("xml"))


def xml_documents(spark: SparkSession, base: str) -> DataFrame:
    """What the acts' documents say of themselves."""
    facts = xml.document_facts(xml.document_table(_acts_xml(spark, base), "id", "xml"))
    return facts.select("doc_id", "kind", "title", "long_title", "status", "title_status", "enacted", "number_official", "origin", "bill_type")


def xml_parts(spark: SparkSession, base: str) -> DataFrame:
    """Footnotes, historical notes, stages, amendments and flagged sections of the acts' documents."""
    rows = xml.document_table(_acts_xml(spark, base), "id",
        "xml").filter("kind in ('footnote', 'historical_note', 'bill_stage', 'amendment', 'section')")
    return rows.select("doc_id", "kind", "ordinal", "label", F.when(F.col("kind") == "section", F.array_join("flags", ",")).otherwise(F.col("title"))
        .alias("title"), F.when(F.col("kind").isin("footnote", "historical_note", "amendment"), F.col("text")).alias("text"), "section")


def xml_positions(spark: SparkSession, base: str) -> DataFrame:
    """Sections of the sittings' documents joined by place with the statements in order; those on either side only."""
    rows = xml.document_table(_statements_xml(spark, base), "document_id", "xml").filter("kind = 'section'").select(F.col("doc_id").cast("int")
        .alias("document_id"), F.col("ordinal").alias("place"), "label")
    h = load(spark, base, "hansards_statement").select("id", "document_id", "sequence").distinct()
    ordered = h.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "id"))).alias("s")).select("document_id",
        F.posexplode("s").alias("i", "x")).select("document_id", (F.col("i") + 1).alias("place"), "x.id", "x.sequence").filter("sequence % 5 <> 0")
    both = rows.join(ordered, ["document_id", "place"], "full_outer")
    return both.select("document_id", "place", F.coalesce(F.col("sequence").cast("string"), "label").alias("label"), F.col("id").isNotNull()
        .alias("placed"))


def lookup_tables(spark: SparkSession, base: str) -> DataFrame:
    """Regulations with the act that they are made under, from records in XML: the number by relationship and language."""
    field = lambda name, value: F.concat(F.lit(f"<{name}>"), _escaped(value.cast("string")), F.lit(f"</{name}>"))
    a = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id", "title"),
        ["key", "language"], "updated_at", "id").filter("key is not null and language in ('en', 'fr')")
    r = standing(load(spark, base, "regulations").select(norm_key(F.col("regulation_id")).alias("key"), "language", "updated_at", "id", "title"),
        ["key", "language"], "updated_at", "id").filter("key is not null and language in ('en', 'fr')")
    one = a.filter("left(key, 1) = 'D'").groupBy("language", F.right("key", F.lit(1)).alias("n")).agg(F.min_by("id", "key")
        .alias("aid"))  # an act for each last digit
    under = r.select(F.col("id").alias("rid"), F.right("key", F.lit(1)).alias("n"), "language").join(one, ["language", "n"])
    links = under.groupBy("aid").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<Relationship rid="'), "rid", F.lit('"/>')))), "")
        .alias("rel"))
    statutes = a.join(links, a["id"] == links["aid"],
        "left").select(F.concat(F.lit('<Statute id="'), "id", F.lit('">'), field("ChapterNumber", F.col("key")), field("Language", F.col("language")),
        field("ShortTitle", F.col("title")), F.lit("<ConsolidateFlag>True</ConsolidateFlag><Relationships>"), F.coalesce("rel", F.lit("")),
        F.lit("</Relationships></Statute>")).alias("xml"))
    regulations = r.select(F.concat(F.lit('<Regulation id="'), "id", F.lit('" olid="x">'), field("AlphaNumber", F.col("key")),
        field("Language", F.col("language")), field("ShortTitle", F.col("title")), F.lit("</Regulation>")).alias("xml"))
    return xml.enabling_acts(xml.lookup_maps(statutes, regulations))


QUERIES = {f.__name__: f for f in (xml_sections, xml_documents, xml_parts, xml_positions, lookup_tables, xml_audit, html_links, html_strip,
    incremental_rows, changed_pages, row_reconciliation)}

_H = "h AS (SELECT DISTINCT id, document_id, sequence, h1_en, h2_en, who_en, content_en FROM hansards_statement)"


def _audit_sql() -> str:
    """Each kind of element that the documents are made of: how many, where, and with what attributes and children."""
    first = lambda what: f"array_to_string(list_sort(list_distinct(list({what})))[1:5], ',')"
    docs, rows = "SELECT {c} FROM (SELECT DISTINCT document_id FROM h)", "SELECT {c} FROM h"
    parts = [
        docs.format(c="'Statute' AS tag, count(*) AS elements, 1 AS n_paths, 1 AS n_children, '' AS attrs, 'Body' AS children, '/Statute' AS paths"),
        docs.format(c="'Body', count(*), 1, 2, '', 'Heading,Section', '/Statute/Body'"),
        rows.format(c=f"'Heading', 2 * count(*), 1, 0, 'level=1,level=2', '', '/Statute/Body/Heading'"),
        rows.format(c=f"'Section', count(*), 1, 3, {first(chr(39) + 'id=' + chr(39) + ' || id')}, 'Label,MarginalNote,Text', '/Statute/Body/Section'"),
    ]
    parts += [rows.format(c=f"'{x}', count(*), 1, 0, '', '', '/Statute/Body/Section/{x}'") for x in ("Label", "MarginalNote", "Text")]
    return f"WITH {_H} " + " UNION ALL ".join(parts)


_XML_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FLAT = lambda x: f"nullif(trim(regexp_replace({x}, '{_XML_WS}', ' ', 'g')), '')"
_A = "a AS (SELECT *, ascii(right(id, 1)) AS m FROM acts QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_KEYED = lambda table, id_col: (
    f"(SELECT {_sql_key(id_col)} AS key, language, id FROM {table} WHERE {_sql_key(id_col)} IS NOT NULL QUALIFY row_number() OVER "
    f"(PARTITION BY {_sql_key(id_col)}, language ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"
)

ORACLE = {
    "xml_documents": (
        f"WITH {_A} SELECT id AS doc_id, 'act' AS kind, {_FLAT('title')} AS title, {_FLAT('long_title')} AS long_title, CASE WHEN m % 3 = 0 "
        f"THEN 'repealed' WHEN status = 'in-force' THEN 'in-force' ELSE 'not-in-force' END AS status, CASE WHEN title IS NOT NULL THEN "
        f"'official' END AS title_status, strftime(enacted_date, '%Y-%m-%d') AS enacted, 'yes' AS number_official, bill_origin AS origin, "
        f"'govt-public' AS bill_type FROM a"
    ),
    "xml_parts": (
        f"WITH {_A} SELECT id AS doc_id, 'section' AS kind, 1 AS ordinal, '1' AS label, CASE WHEN m % 2 = 0 THEN 'has_footnote,has_table' "
        f"ELSE 'has_footnote' END AS title, NULL AS text, NULL AS section FROM a UNION ALL SELECT id, 'footnote', 1, '*', 'editorial', 'See "
        f"above', '1' FROM a UNION ALL SELECT id, 'historical_note', 1, NULL, '2001-02-03', '2001, c. 2', '1' FROM a UNION ALL SELECT id, "
        f"'bill_stage', 1, 'assented-to', '2001-02-01', NULL, NULL FROM a WHERE m % 2 = 0 UNION ALL SELECT id, 'amendment', 1, '2023, c. 8', "
        f"'2023-01-01', '2023_8', NULL FROM a WHERE m % 5 = 0"
    ),
    "xml_positions": (
        "WITH h AS (SELECT DISTINCT id, document_id, sequence FROM hansards_statement), p AS (SELECT *, row_number() OVER (PARTITION BY "
        "document_id ORDER BY sequence, id)::INT AS place FROM h) SELECT document_id, place, CAST(sequence AS VARCHAR) AS label, sequence % "
        "5 <> 0 AS placed FROM p"
    ),
    "lookup_tables": (
        f"WITH a AS {_KEYED('acts', 'act_id')}, r AS {_KEYED('regulations', 'regulation_id')} SELECT r.key AS number, r.language, (SELECT "
        f"min(a.key) FROM a WHERE a.language = r.language AND a.key[1] = 'D' AND a.key[-1] = r.key[-1]) AS enabling FROM r WHERE r.language "
        f"IN ('en', 'fr')"
    ),
    "xml_sections": (
        rf"WITH {_H} SELECT CAST(document_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY document_id ORDER BY sequence, id) AS "
        rf"ordinal, CAST(sequence AS VARCHAR) AS label, length(trim(regexp_replace(coalesce(content_en, ''), "
        rf"'[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' "
        rf"', 'g'))) AS chars, trim(coalesce(h1_en, '')) || '|' || trim(coalesce(h2_en, '')) AS path FROM h"
    ),
    "xml_audit": _audit_sql(),
    "html_links": "SELECT DISTINCT id, '/laws/' || target_ref AS url, 0 AS place FROM cross_references WHERE target_ref IS NOT NULL",
    "html_strip": (
        r"SELECT doc_id, trim(regexp_replace(replace(regexp_replace(text, '[<>&]', '', 'g'), chr(160), ' '), '[\s\x0B]+', ' ', 'g')) AS text "
        r"FROM documents WHERE text IS NOT NULL"
    ),
    "incremental_rows": "SELECT DISTINCT resource_key FROM leg_resources WHERE resource_key NOT IN (SELECT resource_key FROM leg_resources WHERE language = 'fr')",
    "changed_pages": (
        "SELECT DISTINCT id, sha256(replace(coalesce(title, ''), chr(160), ' ')) AS hash FROM acts WHERE length(coalesce(title, '')) % 4 = "
        "0 AND upper(coalesce(title, '')) <> coalesce(title, '')"
    ),
    "row_reconciliation": " UNION ALL ".join((
        f"SELECT '{t}' AS table_name, a AS source_rows, b AS target_rows, a = b AS agree FROM (SELECT (SELECT count(*) FROM {t}) AS a, "
        f"(SELECT count(*) FROM {t}_copy) AS b)"
    ) for t in ("acts", "regulations")),
}
