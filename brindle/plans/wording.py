"""Queries on citations, texts of records and Markdown of whole entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import citation as ct
from brindle.functions import content as cn
from brindle.functions.keys import norm_key, standing
from brindle.functions.text import RESULTS, VOTES, filled, label
from brindle.functions.wording import lined_sql, worded_sql
from brindle.operators import hydration as hy
from brindle.plans.data_quality import _sql_key
from brindle.tables import load

META = ["sourceType", "language", "actId", "regulationId", "documentTitle", "sectionLabel", "targetType", "targetRef"]


def _resources(spark: SparkSession, base: str) -> DataFrame:
    """The standing row of each resource, its metadata's members as columns."""
    r = load(spark, base, "leg_resources").select("id", "updated_at", "resource_key", "content",
        F.from_json("metadata", ", ".join(f"{m} string" for m in META)).alias("m"))
    return standing(r.select("id", "updated_at", "resource_key", "content", "m.*"), ["id"], "updated_at")


def legislation_citations(spark: SparkSession, base: str) -> DataFrame:
    """Every resource's citation by its own source type."""
    fields = ct.legislation_fields({m: F.col(m) for m in META})
    cited = ct.citation(F.col("sourceType"), fields, ct.LEGISLATION, ct.OTHER_LEGISLATION)
    return _resources(spark, base).select("id", "sourceType", cited.alias("c")).select("id", "sourceType", "c.*")


#: Members that the test tables lack, filled from others so that every wording is used: name to SQL over a resource's row.
LAW_FIELDS = {
    **{m: m for m in META},
    "term": "left(content, 12)", "treatyTitle": "CASE WHEN length(content) % 2 = 0 THEN left(content, 20) END",
        "provisionCount": "CASE WHEN length(content) % 3 = 0 THEN length(content) END",
    "signatureName": "CASE WHEN length(content) % 4 < 3 THEN 'A. Clerk' END",
        "signatureTitle": "CASE WHEN length(content) % 4 = 1 THEN 'Registrar' END",
        "relatedProvisionLabel": "CASE WHEN length(content) % 5 < 3 THEN 'Transitional' END",
    "relatedProvisionSource": "CASE WHEN length(content) % 5 = 1 THEN '2001, c. 4' END",
        "relatedSections": "CASE WHEN length(content) % 3 = 1 THEN ' (s 2)' END", "footnoteLabel": "CASE WHEN length(content) % 3 = 2 THEN '*' END",
    "footnoteStatus": "CASE WHEN length(content) % 2 = 1 THEN 'editorial' END",
        "marginalNote": "CASE WHEN length(content) % 6 < 4 THEN left(content, 9) END",
        "publicationType": "CASE WHEN length(content) % 2 = 1 THEN 'recommendation' END",
}
LAW_DERIVED = {
    "anchor": "regexp_replace(sectionLabel, '[^a-zA-Z0-9.]', '', 'g')", "targetKind": "CASE WHEN targetType = 'act' THEN 'Act' ELSE 'Regulation' END",
        "targetKindFr": "CASE WHEN targetType = 'act' THEN 'Loi' ELSE 'Règlement' END",
    "targetAct": "CASE WHEN targetType = 'act' THEN targetRef END", "targetRegulation": "CASE WHEN targetType = 'regulation' THEN targetRef END",
        "editorial": "CASE WHEN footnoteStatus = 'editorial' THEN '1' END",
    "publication": "CASE WHEN publicationType = 'recommendation' THEN 'Recommendation' ELSE 'Notice' END",
        "publicationFr": "CASE WHEN publicationType = 'recommendation' THEN 'Recommandation' ELSE 'Avis' END",
}


def legislation_citation_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Every resource's citation as if it were of each source type in turn."""
    rows = _resources(spark, base).select("id", *[F.expr(sql).alias(name) for name, sql in LAW_FIELDS.items()])
    rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, ct.LEGISLATION))))
    cited = ct.citation(F.col("kind"), ct.legislation_fields({name: F.col(name) for name in LAW_FIELDS}), ct.LEGISLATION)
    return rows.select("id", "kind", cited.alias("c")).select("id", "kind", "c.*")


#: Members of parliament's resources, from a bill's row.
HOUSE_FIELDS = {
    "billNumber": "bill_number", "sessionId": "session_id", "billTitle": "short_title_en", "committeeNameEn": "short_title_en",
        "committeeNameFr": "short_title_fr", "committeeSlug": "CASE WHEN id % 3 > 0 THEN 'FINA' END",
    "title": "CASE WHEN id % 4 = 0 THEN name_en END", "nameEn": "CASE WHEN id % 2 = 0 THEN name_en END",
        "nameFr": "CASE WHEN id % 5 > 0 THEN name_fr END", "date": "CAST(introduced AS STRING)", "meetingNumber": "CASE WHEN id % 7 > 1 THEN id END",
    "politicianName": "CASE WHEN id % 6 > 0 THEN 'P. Vale' END", "ridingNameEn": "CASE WHEN id % 4 > 1 THEN 'Ostrand East' END",
        "ridingNameFr": "CASE WHEN id % 3 = 1 THEN 'Ostrand-Est' END", "speakerNameEn": "CASE WHEN id % 4 = 2 THEN 'A. Member' END",
    "speakerNameFr": "CASE WHEN id % 3 = 2 THEN 'Une députée' END", "docNumber": "CASE WHEN id % 2 = 1 THEN id END",
        "partyNameEn": "CASE WHEN id % 3 > 0 THEN 'Blue Party' END", "partyNameFr": "CASE WHEN id % 4 > 0 THEN 'Parti bleu' END",
    "partyShortEn": "CASE WHEN id % 5 = 1 THEN 'BP' END", "partyShortFr": "CASE WHEN id % 5 = 2 THEN 'PB' END",
        "politicianSlug": "CASE WHEN id % 2 = 0 THEN 'p-vale' END", "memberId": "CASE WHEN id % 3 = 0 THEN id END",
        "province": "CASE WHEN id % 2 = 0 THEN 'QC' END",
    "sessionName": "CASE WHEN id % 6 = 0 THEN 'A session' END", "result": "CASE id % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'T' END",
        "voteNumber": "CASE WHEN id % 3 > 0 THEN id END",
}


def _sql_ordinal(x: str) -> str:
    return (
        f"(SELECT n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 "
        f"THEN 'rd' ELSE 'th' END FROM (SELECT TRY_CAST({x} AS INT) AS n))"
    )


def _sql_code(yes: str, no: str) -> str:
    return f"CASE result WHEN 'Y' THEN '{yes}' WHEN 'N' THEN '{no}' ELSE result END"


HOUSE_DERIVED = {
    "parliament": _sql_ordinal("string_split(sessionId, '-')[1]"), "session": _sql_ordinal("string_split(sessionId, '-')[2]"),
        "billLower": "lower(billNumber)", "sessionPath": "replace(sessionId, '-', '/')",
    "meetingEn": "'/DocumentViewer/en/' || nullif(sessionId, '') || '/' || committeeSlug || '/meeting-' || meetingNumber || '/evidence'",
        "meetingFr": "'/DocumentViewer/fr/' || nullif(sessionId, '') || '/' || committeeSlug || '/reunion-' || meetingNumber || '/temoignages'",
    "memberPath": "politicianSlug || '(' || memberId || ')'", "anyParty": "coalesce(partyShortEn, partyShortFr)",
        "anyRiding": "coalesce(ridingNameEn, ridingNameFr)",
    "passed": _sql_code("Passed", "Failed"), "passedFr": _sql_code("Adopté", "Rejeté"), "vote": _sql_code("Yea", "Nay"),
        "voteFr": _sql_code("Oui", "Non"),
}


def _bills(spark: SparkSession, base: str) -> DataFrame:
    return standing(load(spark, base, "bills_bill").drop("deleted_at"), ["id"], None)


def parliament_citation_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Every bill's row as a citation of each of parliament's source types in turn."""
    rows = _bills(spark, base).select("id", *[F.expr(sql).cast("string").alias(name) for name, sql in HOUSE_FIELDS.items()])
    rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, ct.PARLIAMENT))))
    cited = ct.citation(F.col("kind"), ct.parliament_fields({name: F.col(name) for name in HOUSE_FIELDS}), ct.PARLIAMENT)
    return rows.select("id", "kind", cited.alias("c")).select("id", "kind", "c.*")


#: Facts of all kinds of records, from a bill's row.
FACTS = {
    **{f"name{x}": f"name_{x.lower()}" for x in ("En", "Fr")}, **{f"shortTitle{x}": f"short_title_{x.lower()}" for x in ("En", "Fr")},
        "number": "bill_number", "sessionId": "session_id", "statusCode": "status_code", "introduced": "CAST(introduced AS STRING)",
    "statusDate": "CASE WHEN id % 3 = 0 THEN CAST(added AS STRING) END",
        "house": "CASE institution WHEN 'C' THEN 'House of Commons' WHEN 'S' THEN 'Senate' END",
        "houseFr": "CASE institution WHEN 'C' THEN 'Chambre des communes' WHEN 'S' THEN 'Sénat' END",
    "billKind": "CASE id % 3 WHEN 0 THEN 'Government Bill' WHEN 1 THEN 'Private Member''s Bill' END",
        "billKindFr": "CASE id % 3 WHEN 0 THEN 'Projet de loi du gouvernement' WHEN 1 THEN 'Projet de loi d’initiative parlementaire' END",
    "lawEn": "CASE WHEN law THEN 'Yes' WHEN NOT law THEN 'No' END", "lawFr": "CASE WHEN law THEN 'Oui' WHEN NOT law THEN 'Non' END",
        "date": "CASE WHEN id % 4 > 0 THEN CAST(added AS STRING) END", "result": "CASE WHEN id % 2 = 0 THEN 'Y' END", "vote": "'Y'",
    "yea": "id % 200", "nay": "id % 90", "paired": "id % 7", "descriptionEn": "short_title_en", "descriptionFr": "short_title_fr",
        "member": "CASE WHEN id % 5 > 0 THEN 'P. Vale' END", "memberId": "id", "slug": "CASE WHEN id % 2 = 0 THEN 'slug' END",
    "yes": "CASE WHEN id % 2 = 0 THEN 'Yes' ELSE 'No' END", "oui": "CASE WHEN id % 2 = 0 THEN 'Oui' ELSE 'Non' END",
        "yes2": "CASE WHEN id % 3 = 0 THEN 'Yes' ELSE 'No' END", "oui2": "CASE WHEN id % 3 = 0 THEN 'Oui' ELSE 'Non' END",
    "partyEn": "CASE WHEN id % 3 > 0 THEN 'Blue Party' END", "partyFr": "CASE WHEN id % 3 > 0 THEN 'Parti bleu' END",
        "partyShortEn": "CASE WHEN id % 2 = 1 THEN 'BP' END", "partyShortFr": "CASE WHEN id % 2 = 1 THEN 'PB' END",
    "adopted": "CASE WHEN law THEN CAST(introduced AS STRING) END", "sessionName": "CASE WHEN id % 2 = 0 THEN 'A session' END",
        "parliament": "left(session_id, 2)", "session": "right(session_id, 1)", "ridingEn": "CASE WHEN id % 4 > 1 THEN 'Ostrand East' END",
    "ridingFr": "CASE WHEN id % 4 > 1 THEN 'Ostrand-Est' END", "province": "'QC'", "percent": "CASE WHEN id % 2 = 0 THEN id % 100 END",
        "votes": "CASE WHEN id % 3 = 0 THEN id END", "electedEn": "CASE WHEN law THEN 'Yes' END", "electedFr": "CASE WHEN law THEN 'Oui' END",
    "title": "name_en", "longTitle": "short_title_en", "runningHead": "CASE WHEN id % 4 = 0 THEN 'Head' END",
        "shortTitleStatus": "CASE WHEN id % 4 = 1 THEN 'official' END", "shortTitleStatusFr": "CASE WHEN id % 4 = 1 THEN 'officiel' END",
        "reversed": "CASE WHEN id % 5 = 0 THEN 'Act, An' END",
    "id": "id", "status": "'in-force'", "inForce": "CAST(introduced AS STRING)", "enacted": "CASE WHEN id % 2 = 0 THEN '2001-02-03' END",
        "amended": "CASE WHEN id % 3 = 0 THEN '2011-02-03' END", "consolidation": "CASE WHEN id % 3 = 1 THEN '2012-02-03' END",
    "origin": "CASE institution WHEN 'C' THEN 'House of Commons' WHEN 'S' THEN 'Senate' END",
        "originFr": "CASE institution WHEN 'C' THEN 'Chambre des communes' WHEN 'S' THEN 'Sénat' END",
        "billType": "CASE WHEN id % 7 = 0 THEN 'govt-public' END", "consolidatedNumber": "CASE WHEN id % 7 > 3 THEN 'C-46' END",
    "billNumber": "bill_number", "assent": "CASE WHEN law THEN '2010-01-01' END",
        "amendmentsEn": "CASE WHEN id % 6 = 0 THEN 'Recent Amendments:' || chr(10) || '  - 2023, c. 8' END",
        "amendmentsFr": "CASE WHEN id % 6 = 0 THEN 'Modifications récentes:' || chr(10) || '  - 2023, c. 8' END",
    "instrument": "CASE WHEN id % 3 = 0 THEN 'SOR/2001-1' END", "kind": "CASE WHEN id % 2 = 0 THEN 'SOR' END",
        "registered": "CAST(introduced AS STRING)", "enabling": "CASE WHEN id % 5 > 2 THEN short_title_en END",
        "gazettePart": "CASE WHEN id % 3 = 0 THEN 'II' END",
    "term": "left(name_en, 10)", "paired": "CASE WHEN id % 2 = 0 THEN left(name_fr, 10) END",
        "document": "coalesce(nullif(short_title_en, ''), 'Unknown Document')", "section": "CASE WHEN id % 3 > 0 THEN '12' END",
        "scope": "CASE WHEN id % 4 = 0 THEN 'part' END",
    "scopeFr": "CASE WHEN id % 4 = 0 THEN 'partie' END", "scopeSectionsEn": "CASE WHEN id % 8 = 0 THEN 'Applicable to sections: 1, 2' END",
        "scopeSectionsFr": "CASE WHEN id % 8 = 0 THEN 'S''applique aux articles: 1, 2' END",
        "scopeTextEn": "CASE WHEN id % 12 = 0 THEN 'Scope declaration: here' END",
    "scopeTextFr": "CASE WHEN id % 12 = 0 THEN 'Déclaration de portée: ici' END", "text": "name_en", "note": "CASE WHEN id % 2 = 1 THEN 'note' END",
        "outline": "CASE WHEN id % 3 = 0 THEN 'I: One' END", "definitions": "CASE WHEN id % 4 = 0 THEN '• a: b' END", "target": "'Act'",
        "targetFr": "'Loi'",
    "reference": "bill_number", "targetTitleEn": "short_title_en", "targetTitleFr": "short_title_fr", "shownEn": "short_title_en",
        "shownFr": "short_title_fr", "witness": "CASE WHEN id % 2 = 0 THEN 'In witness' END", "doneAt": "CASE WHEN id % 3 = 0 THEN 'Ostrand' END",
    "signaturesEn": "CASE WHEN id % 5 = 0 THEN 'Signatory: A' END", "signaturesFr": "CASE WHEN id % 5 = 0 THEN 'Signataire: A' END",
        "source": "CASE WHEN id % 3 = 1 THEN '2001, c. 4' END", "sections": "CASE WHEN id % 4 = 2 THEN '1, 2' END",
        "footnoteStatus": "CASE WHEN id % 2 = 0 THEN 'editorial' END",
    "footnoteStatusFr": "CASE WHEN id % 2 = 0 THEN 'éditoriale' END", "publication": "'Notice'", "publicationFr": "'Avis'",
        "requirement": "CASE WHEN id % 3 = 2 THEN 'Statutory requirement' END", "requirementFr": "CASE WHEN id % 3 = 2 THEN 'Exigence légale' END",
}


def content_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Every bill's row as the text of each kind of record in turn, in both languages."""
    rows = _bills(spark, base).select(F.col("id").alias("row_id"), *[F.expr(sql).cast("string").alias(f"_{name}") for name, sql in FACTS.items()])
    rows = rows.withColumn("record", F.explode(F.array(*map(F.lit, cn.LINES)))).withColumn("language", F.explode(F.array(F.lit("en"), F.lit("fr"))))
    text = cn.content_by_kind(F.col("record"), F.col("language"), {name: F.col(f"_{name}") for name in FACTS})
    return rows.select(F.col("row_id").alias("id"), "record", "language", text.alias("content"))


def _titles(spark: SparkSession, base: str, table: str, id_col: str) -> DataFrame:
    """One title for each key and language of acts or regulations: the standing row's."""
    rows = load(spark, base, table).select(norm_key(F.col(id_col)).alias("key"), "language", "updated_at", "id", "title")
    return standing(rows.filter("key is not null"), ["key", "language"], "updated_at", "id").select("key", "language", "title")


def reference_contents(spark: SparkSession, base: str) -> DataFrame:
    """Texts of cross references in both languages, with the titles of source and target in each: four lookups a row as left
    joins on sides that have one row a key."""
    x = standing(load(spark, base, "cross_references")
        .select("id", "source_act_id", "source_regulation_id", "source_section_label", "target_type", "target_ref", "reference_text"), ["id"], None)
    titles = _titles(spark, base, "acts", "act_id").withColumn("of", F.lit("act")).unionByName(_titles(spark, base, "regulations", "regulation_id")
        .withColumn("of", F.lit("regulation")))
    side = titles.groupBy("of", "key").agg(*[F.max(F.when(F.col("language") == code, F.col("title"))).alias(code) for code in ("en", "fr")])
    out = x
    for name, of, key in (("act", F.lit("act"), "source_act_id"), ("reg", F.lit("regulation"), "source_regulation_id"),
        ("target", F.col("target_type"), "target_ref")):
        own = side.select(F.col("of").alias("_of"), F.col("key").alias("_key"), F.col("en").alias(f"{name}_en"), F.col("fr").alias(f"{name}_fr"))
        out = out.join(own, (of == F.col("_of")) & (norm_key(F.col(key)) == F.col("_key")), "left").drop("_of", "_key")
    rows = []
    for code, unknown in (("en", "Unknown Document"), ("fr", "Document inconnu")):
        fields = {"document": F.coalesce(f"act_{code}", f"reg_{code}", F.lit(unknown)), "section": F.col("source_section_label"),
            "target": F.when(F.col("target_type") == "act", "Act").otherwise("Regulation"), "targetFr": F.when(F.col("target_type") == "act", "Loi")
            .otherwise("Règlement"), "reference": F.col("target_ref")}
        fields |= {f"targetTitle{code.title()}": F.col(f"target_{code}"), f"shown{code.title()}": F.coalesce(f"target_{code}", "reference_text")}
        rows.append(out.select("id", F.lit(code).alias("language"), cn.content("cross_reference", code, fields).alias("content")))
    return reduce(DataFrame.unionByName, rows)


def resource_titles(spark: SparkSession, base: str) -> DataFrame:
    """Resources with the title of their act, else of their regulation, in their language: left joins on key and language."""
    r = _resources(spark, base).select("id", "language", norm_key(F.col("actId")).alias("act"), norm_key(F.col("regulationId")).alias("regulation"))
    for name, table, id_col in (("act", "acts", "act_id"), ("regulation", "regulations", "regulation_id")):
        own = _titles(spark, base, table, id_col).select(F.col("key").alias(name), "language", F.col("title").alias(f"{name}_title"))
        r = r.join(own, [name, "language"], "left")
    return r.select("id", "language", F.coalesce("act_title", "regulation_title", F.lit("Unknown Document")).alias("title"))


def hydrate_documents(spark: SparkSession, base: str) -> DataFrame:
    """Acts with the sections of their resources as Markdown."""
    acts = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("doc"), "language", "updated_at", "id", "title", "long_title",
        "status", "enacted_date").filter("doc is not null"), ["doc", "language"], "updated_at", "id")
    docs = acts.select("doc", "language", "title", "long_title", "status", F.col("enacted_date").alias("consolidated"), F.lit(None).cast("string")
        .alias("enabling"))
    r = _resources(spark, base).filter("actId is not null")
    kind = F.when(F.length("content") % 7 == 0, "heading").when(F.length("content") % 7 == 1, "schedule").otherwise("section")
    sections = r.select(norm_key(F.col("actId")).alias("doc"), "language", F.col("id").alias("ord"), F.col("sectionLabel").alias("label"),
        F.when(F.length("content") % 3 == 0, F.left("content", F.lit(15))).alias("note"), kind.alias("kind"), "content")
    return hy.document_markdown(docs, sections).select("doc", "language", F.md5("markdown").alias("digest"), F.length("markdown").alias("chars"),
        "shown", "total")


def bill_bodies(spark: SparkSession, base: str) -> DataFrame:
    """Documents as the bodies of bills in Markdown, with their tables of contents."""
    d = load(spark, base, "documents").filter("text is not null")
    marked = F.regexp_replace(F.regexp_replace("text", r"([.!?]) The ", "$1 PART 2 Fees\nThe "), r"([.!?]) (It|We) ", "$1 (a) $2 ")
    return d.select("doc_id", hy.bill_body(marked).alias("body")).withColumn("contents", hy.headings(F.col("body")))


def hydrate_bills(spark: SparkSession, base: str) -> DataFrame:
    """Bills with the text of their latest vote, in French where there is one, else in English, as Markdown."""
    votes = load(spark, base, "bills_votequestion").select("bill_id", "vote_date", "id", "description_en",
        "description_fr").filter("bill_id is not null")
    text = standing(votes, ["bill_id"], "vote_date", "id").select(F.col("bill_id").alias("id"),
        F.coalesce(filled(F.col("description_fr")), "description_en").alias("text"), F.when(filled(F.col("description_fr")).isNull(), "en")
        .otherwise("fr").alias("text_language"))
    b = _bills(spark, base).join(text, "id", "left")
    fields = {name: F.expr(FACTS[name]) for name in ("sessionId", "house", "houseFr", "introduced", "statusDate", "statusCode", "lawEn", "lawFr",
        "billKind", "billKindFr")}
    return b.select("id", "text_language", hy.bill_markdown(F.col("bill_number"), F.col("name_fr"), "fr", fields, F.coalesce("text", F.lit("")))
        .alias("markdown"))


def hydrate_votes(spark: SparkSession, base: str) -> DataFrame:
    """Bills' votes as Markdown sections, with each party's vote and members who voted otherwise."""
    b = _bills(spark, base).select(F.col("id").alias("bill"), F.col("bill_number").alias("number"), F.col("name_en").alias("name"),
        F.col("session_id").alias("session"))
    v = standing(load(spark, base, "bills_votequestion"), ["id"], None).filter("bill_id is not null")
    votes = v.select(F.col("id").alias("vote"), F.col("bill_id").alias("bill"), "vote_number", F.col("vote_date").cast("string").alias("day"),
        F.col("description_en").alias("told"), label(F.col("result"), RESULTS).alias("outcome"), F.col("yea_total").alias("yea"), F.col("nay_total")
        .alias("nay"), F.col("paired_total").alias("paired"))
    cast = lambda n: label(F.element_at(F.array(F.lit("Y"), F.lit("N"), F.lit("A")), (n % 3).cast("int") + 1), VOTES)
    r = load(spark, base, "region").withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(6))))
    parties = votes.join(r, F.col("vote") % 7 == F.col("of")).select("vote",
        F.concat(F.left("r_name", F.lit(1)), F.lower(F.substring("r_name", 2, 99))).alias("party"), F.left("r_name", F.lit(2)).alias("short"),
        cast(F.col("vote") + F.col("r_regionkey")).alias("cast"))
    dissents = votes.select("vote", (F.col("vote") % 17).alias("k")).join(load(spark, base, "supplier")
        .select("s_name", (F.col("s_suppkey") % 17).alias("k")), "k").select("vote", F.col("s_name").alias("member"), cast(F.col("vote"))
        .alias("cast"))
    return hy.vote_sections(b, votes, parties, dissents)


def hydrate_elections(spark: SparkSession, base: str) -> DataFrame:
    """A year's orders as an election in French: the twenty strongest candidates."""
    o, c, n, r = (load(spark, base, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r,
        n["n_regionkey"] == r["r_regionkey"], "left")
    rows = joined.select(F.year("o_orderdate").alias("election"), F.year("o_orderdate").cast("string").alias("day"), (F.year("o_orderdate") % 2 == 0)
        .alias("by_election"), F.col("o_orderkey").alias("candidacy"), F.col("c_name").alias("candidate"), F.left("n_name", F.lit(3)).alias("party"),
        F.col("r_name").alias("riding"), (F.col("o_totalprice") / 10_000).alias("share"), (F.col("o_orderstatus") == "F").alias("elected"))
    return hy.election_markdown(rows, "fr")


QUERIES = {f.__name__: f for f in (legislation_citations, legislation_citation_kinds, parliament_citation_kinds, content_kinds, reference_contents,
    resource_titles, hydrate_documents, bill_bodies, hydrate_bills, hydrate_votes, hydrate_elections)}

_R = "r AS (SELECT id, resource_key, content, " + ", ".join(f"metadata->>'{m}' AS {m}"
    for m in META) + " FROM leg_resources QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
_B = "b AS (SELECT * EXCLUDE (deleted_at) FROM bills_bill QUALIFY row_number() OVER (PARTITION BY id ORDER BY bill_number DESC) = 1)"


def _cited_sql(kind: str, kinds: dict[str, ct.Wordings], derived: dict[str, str], known: set[str], other: ct.Wordings | None = None) -> str:
    get = lambda name: f"({derived[name]})" if name in derived else name if name in known else "NULL"
    cells = []
    for i, name in enumerate(ct.Wordings._fields):
        cases = " ".join(f"WHEN '{code}' THEN {worded_sql(w[i], get)}" for code, w in kinds.items())
        cells.append(f"CASE {kind} {cases}{'' if other is None else ' ELSE ' + worded_sql(other[i], get)} END AS {name}")
    return ", ".join(cells)


def _kinds_sql(codes, table: str, fields: dict[str, str]) -> str:
    columns = ", ".join(f"CAST({sql.replace('AS STRING', 'AS VARCHAR')} AS VARCHAR) AS {name}" for name, sql in fields.items() if name != "id")
    return f"k AS (SELECT id, unnest([{', '.join(repr(c) for c in codes)}]) AS kind, {columns} FROM {table})"


_LINES_SQL = "CASE record " + " ".join(
    f"WHEN '{code}' THEN CASE language WHEN 'fr' THEN {lined_sql(fr, lambda n: '_' + n)} ELSE {lined_sql(en, lambda n: '_' + n)} END" for code,
    (en, fr) in cn.LINES.items()) + " END"
_FACTS_SQL = ", ".join(f"CAST({sql.replace('AS STRING', 'AS VARCHAR')} AS VARCHAR) AS _{name}" for name, sql in FACTS.items())
_T = "tt AS (" + " UNION ALL ".join((
    f"(SELECT '{of}' AS o, {_sql_key(id_col)} AS k, language, title FROM {table} WHERE {_sql_key(id_col)} IS NOT NULL QUALIFY "
    f"row_number() OVER (PARTITION BY {_sql_key(id_col)}, language ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"
) for of, table, id_col in (("act", "acts", "act_id"), ("regulation", "regulations", "regulation_id"))) + ")"


def _title_of(of: str, key: str, code: str) -> str:
    return f"(SELECT title FROM tt WHERE tt.o = {of} AND tt.k = {key} AND tt.language = '{code}')"


def _references_sql() -> str:
    parts = []
    for code, unknown in (("en", "Unknown Document"), ("fr", "Document inconnu")):
        target = _title_of("x.target_type", "x.tk", code)
        inner = (
            f"SELECT id, source_section_label AS section, target_ref AS reference, reference_text, target_type, "
            f"coalesce({_title_of(chr(39) + 'act' + chr(39), 'x.ak', code)}, {_title_of(chr(39) + 'regulation' + chr(39), 'x.rk', code)}, "
            f"'{unknown}') AS document, {target} AS t FROM x"
        )
        own = {"target": "CASE WHEN target_type = 'act' THEN 'Act' ELSE 'Regulation' END",
            "targetFr": "CASE WHEN target_type = 'act' THEN 'Loi' ELSE 'Règlement' END", f"targetTitle{code.title()}": "t",
            f"shown{code.title()}": "coalesce(t, reference_text)", "document": "document", "section": "section", "reference": "reference"}
        parts.append((
            f"SELECT id, '{code}' AS language, {lined_sql(cn.LINES['cross_reference'][code == 'fr'], lambda n: own.get(n, 'NULL'))} AS content "
            f"FROM ({inner})"
        ))
    x = (
        f"x AS (SELECT id, source_section_label, target_type, target_ref, reference_text, {_sql_key('source_act_id')} AS ak, "
        f"{_sql_key('source_regulation_id')} AS rk, {_sql_key('target_ref')} AS tk FROM cross_references QUALIFY row_number() OVER "
        f"(PARTITION BY id ORDER BY source_act_id DESC NULLS LAST, source_regulation_id DESC NULLS LAST, source_section_label DESC NULLS "
        f"LAST, target_type DESC NULLS LAST, target_ref DESC NULLS LAST, reference_text DESC NULLS LAST) = 1)"
    )
    return f"WITH {_T}, {x} " + " UNION ALL ".join(parts)


def _documents_sql() -> str:
    fr = lambda pair: "CASE WHEN language = 'fr' THEN '" + pair[1].replace("\n", "' || chr(10) || '") + "' ELSE '" + pair[0].replace("\n",
        "' || chr(10) || '") + "' END"
    nl = "chr(10)"
    acts = (
        f"a AS (SELECT {_sql_key('act_id')} AS doc, language, title, long_title, status, CAST(enacted_date AS VARCHAR) AS consolidated FROM "
        f"acts WHERE {_sql_key('act_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_sql_key('act_id')}, language ORDER BY "
        f"updated_at DESC NULLS LAST, id DESC) = 1)"
    )
    sections = (
        f"s0 AS (SELECT {_sql_key('actId')} AS doc, language, id, coalesce(sectionLabel, '') AS label, CASE WHEN length(content) % 3 = 0 "
        f"THEN nullif(left(content, 15), '') END AS note, length(content) % 7 AS m, coalesce(content, '') AS content FROM r WHERE actId IS "
        f"NOT NULL)"
    )
    dash = "CASE WHEN note IS NOT NULL THEN ' — ' || note ELSE '' END"
    head = (
        f"CASE WHEN m = 0 THEN '## ' || label || {dash} WHEN m = 1 THEN '## ' || label || CASE WHEN note IS NOT NULL THEN {nl} || '*' || "
        f"note || '*' ELSE '' END ELSE {fr(hy.LABELS['section'])} || label || {dash} END"
    )
    s1 = (
        f"s1 AS (SELECT *, count(*) OVER (PARTITION BY doc, language) AS total, row_number() OVER (PARTITION BY doc, language ORDER BY id) "
        f"AS n, {head} || {nl} || {nl} || content || {nl} AS text, CASE WHEN m = 0 THEN trim('- **' || label || '** ' || coalesce(note, ''), "
        f"' ') ELSE '- ' || label || {dash} END AS entry FROM s0)"
    )
    s2 = f"s2 AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc, language ORDER BY n) AS upto FROM s1 WHERE n <= {hy.MOST_SECTIONS})"
    agg = (
        f"g AS (SELECT doc, language, max(total) AS total, count(*) AS c, string_agg(entry, {nl} ORDER BY n) FILTER (n <= {hy.CONTENTS}) AS "
        f"entries FROM s2 GROUP BY ALL)"
    )
    fact = lambda name: f"CASE WHEN {name} <> '' THEN '- **' || {fr(hy.LABELS[name])} || ':** ' || {name} END"
    facts = f"concat_ws({nl}, {fact('status')}, {fact('consolidated')})"
    shown = f"replace(replace({fr(hy.SHOWN)}, '{{a}}', CAST(c AS VARCHAR)), '{{b}}', CAST(total AS VARCHAR))"
    h = (
        f"h AS (SELECT *, '# ' || coalesce(title, '') || CASE WHEN long_title <> '' AND long_title IS DISTINCT FROM title THEN {nl} || {nl} "
        f"|| '*' || long_title || '*' ELSE '' END || {nl} || CASE WHEN total > c THEN {nl} || {shown} || {nl} ELSE '' END || CASE WHEN "
        f"{facts} <> '' THEN {nl} || {facts} || {nl} ELSE '' END || CASE WHEN c > {hy.CONTENTS_FROM} THEN {nl} || '## ' || "
        f"{fr(hy.LABELS['contents'])} || {nl} || {nl} || entries || CASE WHEN c > {hy.CONTENTS} THEN {nl} || '- ... (' || (c - "
        f"{hy.CONTENTS}) || ' more sections)' ELSE '' END || {nl} ELSE '' END AS head FROM (SELECT a.*, coalesce(total, 0) AS total, "
        f"coalesce(c, 0) AS c, entries FROM a LEFT JOIN g USING (doc, language)))"
    )
    body = (
        f"f AS (SELECT h.doc, h.language, h.total, h.c, h.head, count(s2.n) AS kept, string_agg(s2.text, {nl} ORDER BY s2.n) AS body FROM h "
        f"LEFT JOIN s2 ON h.doc = s2.doc AND h.language = s2.language AND length(h.head) + s2.upto <= {hy.MOST_CHARS} GROUP BY ALL)"
    )
    out = (
        f"SELECT doc, language, md5(m) AS digest, length(m) AS chars, kept AS shown, total FROM (SELECT *, concat_ws({nl}, head, body, CASE "
        f"WHEN kept < c THEN {fr(hy.CUT)} END) AS m FROM f)"
    )
    return f"WITH {_R}, {acts}, {sections}, {s1}, {s2}, {agg}, {h}, {body} {out}"


_WS = r"[\s\x0B]"


def _body_sql(x: str) -> str:
    """Lines of a bill's body as Markdown; the engine's patterns cannot look ahead, so markers side by side take two passes."""
    t = (
        f"trim(regexp_replace(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(160), ' '), '[ \\t]{{2,}}', ' ', 'g'), "
        f"'\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    )
    for mark in (r"(PART\s+\d+(?:\s+[A-Z][A-Za-z0-9 ,''''()-]+)?)", r"(Short Title)\b", r"(Definitions)\b", r"(Enactment(?: of Act)?)\b",
        r"(\d+\s*\(\d+\)\s+)"):
        t = f"regexp_replace({t}, '{_WS}+{mark}', chr(10) || chr(10) || '\\1', 'g')"
    lines = f"string_split(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    line = "trim(y, ' ' || chr(9) || chr(13))"
    cut = lambda letters, flags: (
        f"replace(regexp_replace(regexp_replace({line}, '{flags}{_WS}(\\({letters}\\){_WS})', chr(57585) || '\\1', 'g'), "
        f"'{flags}{_WS}(\\({letters}\\){_WS})', chr(57585) || '\\1', 'g'), chr(57585), chr(10))"
    )
    listed = lambda letters, dash, flags: f"regexp_replace({cut(letters, flags)}, '(?m{flags[2:-1] if flags else ''})^\\(({letters})\\)[^\\S\\n]*', '{dash}(\\1) ', 'g')"
    means = r"^([A-Za-z][A-Za-z -]{1,60})\s+means\s+(.+)$"
    one = (
        f"CASE WHEN regexp_matches({line}, '^PART\\s+(\\d+)(?:\\s+(.+))?$') THEN '## Part ' || regexp_extract({line}, '^PART\\s+(\\d+)', 1) "
            f"|| CASE WHEN regexp_extract({line}, '^PART\\s+(\\d+)(?:\\s+(.+))?$', 2) <> '' THEN ' — ' || trim(regexp_extract({line}, "
            f"'^PART\\s+(\\d+)(?:\\s+(.+))?$', 2)) ELSE '' END "
        f"WHEN regexp_matches({line}, '(?i)^(Short Title|Definitions|Enactment(?: of Act)?)\\b') THEN '### ' || regexp_replace({line}, '{_WS}+', ' ', 'g') "
        f"WHEN regexp_matches({line}, '{_WS}\\([a-z]\\){_WS}') THEN {listed('[a-z]', '- ', '')} WHEN regexp_matches({line}, "
            f"'(?i){_WS}\\([ivx]+\\){_WS}') THEN {listed('[ivx]+', '  - ', '(?i)')} "
        f"WHEN regexp_matches({line}, '{means}') THEN '- **' || trim(regexp_extract({line}, '{means}', 1)) || '** — ' || "
            f"trim(regexp_extract({line}, '{means}', 2)) ELSE {line} END"
    )
    return f"array_to_string(list_transform({lines}, lambda y: {one}), chr(10))"


_CONTENTS = (
    "CASE WHEN len(list_filter(string_split(body, chr(10)), lambda y: starts_with(y, '## '))) > 0 THEN chr(10) || '## Table of "
    "Contents' || chr(10) || array_to_string(list_transform(list_filter(string_split(body, chr(10)), lambda y: starts_with(y, '## ')), "
    "lambda y: '- ' || regexp_replace(y, '^##\\s+', '')), chr(10)) END"
)
_MARKED = r"regexp_replace(regexp_replace(text, '([.!?]) The ', '\1 PART 2 Fees' || chr(10) || 'The ', 'g'), '([.!?]) (It|We) ', '\1 (a) \2 ', 'g')"
_BILL = (
    f"SELECT id, text_language, concat_ws(chr(10), rtrim('# Bill ' || coalesce(bill_number, '') || ': ' || coalesce(name_fr, '')), "
    f"nullif({lined_sql(hy.BILL_FACTS[1], lambda n: '(' + FACTS[n].replace('AS STRING', 'AS VARCHAR') + ')')}, ''), {_CONTENTS}, "
    f"nullif(body, '')) AS markdown"
)


def _votes_sql() -> str:
    nl = "chr(10)"
    label = lambda x: f"(CASE ({x}) % 3 WHEN 0 THEN 'Yea' WHEN 1 THEN 'Nay' ELSE 'Abstain' END)"
    votes = (
        "v AS (SELECT id AS vote, bill_id AS bill, * EXCLUDE (id, bill_id) FROM bills_votequestion WHERE true QUALIFY row_number() OVER "
        "(PARTITION BY id ORDER BY bill_id DESC NULLS LAST) = 1)"
    )
    parties = (
        f"p AS (SELECT vote, string_agg('| ' || upper(r_name[1]) || lower(r_name[2:]) || ' (' || left(r_name, 2) || ') | ' || "
        f"{label('vote + r_regionkey')} || ' |', {nl} ORDER BY r_name) AS rows FROM v CROSS JOIN region GROUP BY vote)"
    )
    dissent = (
        f"d0 AS (SELECT vote, s_name, row_number() OVER (PARTITION BY vote ORDER BY s_name) AS n, count(*) OVER (PARTITION BY vote) AS c "
        f"FROM v JOIN supplier ON s_suppkey % 17 = vote % 17), d AS (SELECT vote, any_value(c) AS c, string_agg('- ' || s_name || ': ' || "
        f"{label('vote')}, {nl} ORDER BY n) AS rows FROM d0 WHERE n <= 5 GROUP BY vote)"
    )
    outcome = "CASE result WHEN 'Y' THEN 'Passed' WHEN 'N' THEN 'Failed' WHEN 'T' THEN 'Tie' ELSE coalesce(result, '') END"
    t = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    rows = [f"'## Vote #' || {t('vote_number')}", f"'**Date:** ' || {t('vote_date')}", f"'**Description:** ' || {t('description_en')}",
        f"'**Result:** ' || {outcome}", "''", "'| Yea | Nay | Paired |'", "'|------|-----|--------|'",
        f"'| ' || {t('yea_total')} || ' | ' || {t('nay_total')} || ' | ' || {t('paired_total')} || ' |'", "''"]
    text = f" || {nl} || ".join(
        rows) + f" || {nl} || '### Party Breakdown' || {nl} || '| Party | Vote |' || {nl} || '|-------|------|' || {nl} || p.rows || {nl}"
    text += (
        f" || CASE WHEN d.c > 0 THEN {nl} || '### Notable Dissenters' || {nl} || d.rows || CASE WHEN d.c > 5 THEN {nl} || '- and ' || (d.c - "
        f"5) || ' more...' ELSE '' END || {nl} ELSE '' END"
    )
    sections = (
        f"SELECT v.bill, row_number() OVER (PARTITION BY v.bill ORDER BY vote_date NULLS FIRST, vote) AS place, {text} AS markdown FROM v "
        f"JOIN p USING (vote) LEFT JOIN d USING (vote) WHERE v.bill IN (SELECT id FROM b)"
    )
    heads = (
        f"SELECT id, 0, '# Votes on Bill ' || {t('bill_number')} || {nl} || {nl} || '**' || {t('name_en')} || '**' || {nl} || 'Session: ' || "
        f"{t('session_id')} || {nl} FROM b WHERE id IN (SELECT bill FROM v WHERE bill IS NOT NULL)"
    )
    return f"WITH {_B}, {votes}, {parties}, {dissent} {sections} UNION ALL {heads}"


ORACLE = {
    "legislation_citations": (
        f"WITH {_R} SELECT id, sourceType, "
        f"{_cited_sql('sourceType', ct.LEGISLATION, LAW_DERIVED | {'editorial': 'NULL', 'publication': repr('Notice'), 'publicationFr': repr('Avis')}, set(META), ct.OTHER_LEGISLATION)} "
        f"FROM r"
    ),
    "legislation_citation_kinds": (
        f"WITH {_R}, {_kinds_sql(ct.LEGISLATION, 'r', LAW_FIELDS)} SELECT id, kind, "
        f"{_cited_sql('kind', ct.LEGISLATION, LAW_DERIVED, set(LAW_FIELDS))} FROM k"
    ),
    "parliament_citation_kinds": (
        f"WITH {_B}, {_kinds_sql(ct.PARLIAMENT, 'b', HOUSE_FIELDS)} SELECT id, kind, "
        f"{_cited_sql('kind', ct.PARLIAMENT, HOUSE_DERIVED, set(HOUSE_FIELDS))} FROM k"
    ),
    "content_kinds": (
        f"WITH {_B}, k0 AS (SELECT id AS row_id, {_FACTS_SQL} FROM b), k1 AS (SELECT *, unnest([{', '.join(repr(c) for c in cn.LINES)}]) AS "
        f"record FROM k0), k AS (SELECT *, unnest(['en', 'fr']) AS language FROM k1) SELECT row_id AS id, record, language, {_LINES_SQL} AS "
        f"content FROM k"
    ),
    "reference_contents": _references_sql(),
    "resource_titles": (
        f"WITH {_T}, {_R} SELECT r.id, r.language, coalesce(a.title, g.title, 'Unknown Document') AS title FROM r LEFT JOIN tt a ON a.o = "
        f"'act' AND a.k = {_sql_key('r.actId')} AND a.language = r.language LEFT JOIN tt g ON g.o = 'regulation' AND g.k = "
        f"{_sql_key('r.regulationId')} AND g.language = r.language"
    ),
    "hydrate_documents": _documents_sql(),
    "hydrate_votes": _votes_sql(),
    "hydrate_elections": (
        "WITH o AS (SELECT year(o_orderdate)::INT AS election, o_totalprice, o_orderkey, '| ' || coalesce(c_name, 'Unknown') || ' | ' || "
        "coalesce(left(n_name, 3), '?') || ' | ' || coalesce(r_name, 'Unknown') || ' | ' || round(o_totalprice / 10000, 1) || '% | ' || "
        "CASE WHEN o_orderstatus = 'F' THEN 'Oui' ELSE 'Non' END || ' |' AS row, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY "
        "o_totalprice DESC, o_orderkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = "
        "n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey) SELECT election, '# ' || CASE WHEN election % 2 = 0 THEN 'Élection "
        "partielle' ELSE 'Élection générale' END || ' - ' || election || chr(10) || chr(10) || '## Résultats' || chr(10) || chr(10) || '| "
        "Candidat | Parti | Circonscription | % | Élu |' || chr(10) || '|----------|-------|---------|------|---------|' || chr(10) || "
        "string_agg(row, chr(10) ORDER BY n) || chr(10) AS markdown FROM o WHERE n <= 20 GROUP BY election"
    ),
    "bill_bodies": f"SELECT doc_id, body, {_CONTENTS} AS contents FROM (SELECT doc_id, {_body_sql(_MARKED)} AS body FROM documents WHERE text IS NOT NULL)",
    "hydrate_bills": (
        f"WITH {_B}, v AS (SELECT bill_id, CASE WHEN coalesce(description_fr, '') <> '' THEN description_fr ELSE description_en END AS text, "
        f"CASE WHEN coalesce(description_fr, '') = '' THEN 'en' ELSE 'fr' END AS text_language FROM bills_votequestion WHERE bill_id IS NOT "
        f"NULL QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY vote_date DESC NULLS LAST, id DESC) = 1), j AS (SELECT b.*, "
        f"v.text_language, {_body_sql(chr(99) + 'oalesce(v.text, ' + chr(39) * 2 + ')')} AS body FROM b LEFT JOIN v ON b.id = v.bill_id) "
        f"{_BILL} FROM j"
    ),
}
