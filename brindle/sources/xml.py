"""XML documents as flat tables, in document order."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.keys import standing

# Elements that are captured whole, that count as one section inside a schedule, and that are looked through.
WHOLE = {"Preamble": "preamble", "Enacts": "enacting_clause", "Order": "enabling_authority", "ConventionAgreementTreaty": "treaty",
    "Convention": "treaty", "Agreement": "treaty", "Treaty": "treaty", "SignatureBlock": "signature_block", "RecentAmendments": "amendments",
    "BillHistory": "bill_history"}
IN_SCHEDULE = {"Item", "FormGroup", "TableGroup", "Provision", "Section"}
FLAGS = {
    "TableGroup": "has_table", "FormulaGroup": "has_formula", "MathML": "has_formula", "ImageGroup": "has_image", "Image": "has_image",
        "Repealed": "has_repealed", "EditorialNote": "has_editorial_note", "Reserved": "has_reserved",
    "ExplanatoryNote": "has_explanatory_note", "SignatureBlock": "has_signature_block", "BilingualGroup": "has_bilingual_group",
        "QuotedText": "has_quoted_text", "ReadAsText": "has_read_as_text", "AmendedText": "has_amended_text",
    "AlternateText": "has_alternate_text", "FormGroup": "has_form_group", "Oath": "has_oath", "Caption": "has_caption", "Footnote": "has_footnote",
        "List": "has_list",
}
CHANGES = {"ins", "del", "off", "alt"}


def discover(spark: SparkSession, base: str, pattern: str = r"/(eng|fra)/(acts|regulations)/[^/]+\.xml$", limit: int | None = None) -> DataFrame:
    """``path``, ``content``, ``language`` and ``kind`` of the XML files under ``base`` whose path fits; file names give the id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(base)
    found = files.filter(F.col("path").rlike(pattern)).select("path", "content", F.when(F.regexp_extract("path", pattern, 1) == "fra", "fr")
        .otherwise("en").alias("language"), F.regexp_extract("path", pattern, 2).alias("kind"), F.regexp_extract("path", r"([^/]+)\.xml$", 1)
        .alias("doc_id"))
    return found if limit is None else found.orderBy("path").limit(limit)


def flat_text(node: ET.Element, skip: frozenset[str] = frozenset()) -> str:
    parts: list[str] = []

    def walk(n: ET.Element) -> None:
        parts.append(n.text or "")
        for child in n:
            if child.tag not in skip:
                walk(child)
                parts.append(" " if child.tag not in ("XRefExternal", "XRefInternal", "Emphasis", "DefinedTermEn", "DefinedTermFr", "Sup", "Sub")
                    else "")
            parts.append(child.tail or "")

    walk(node)
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def attribute(node: ET.Element, name: str) -> str | None:
    """An attribute by its local name, whatever its prefix."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def day(text: str | None) -> str | None:
    """YYYYMMDD or ISO text as ISO text; null for anything else."""
    if text and re.fullmatch(r"\d{8}", text):
        return f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return text if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None


def day_of(node: ET.Element | None) -> str | None:
    """The date of an element of year, month and day; a missing month or day is the first."""
    part = lambda name: (node.findtext(name) or "").strip()
    return f"{part('YYYY')}-{(part('MM') or '01').zfill(2)}-{(part('DD') or '01').zfill(2)}" if node is not None and part("YYYY") else None


def facts_of(root: ET.Element) -> dict[str, str | None]:
    """What a document says of itself: ids, titles, status, dates and where it comes from."""
    own, is_act = root.find("Identification"), root.tag == "Statute"
    own = ET.Element("Identification") if own is None else own
    said = lambda path: flat_text(e) or None if (e := own.find(path)) is not None else None
    mark = lambda path, name, known: v if (e := own.find(path)) is not None and (v := attribute(e, name)) in known else None
    status = "repealed" if root.find("Repealed") is not None else "not-in-force" if attribute(root, "in-force") == "no" else "in-force"
    facts = {"kind": "act" if is_act else "regulation", "title": said("ShortTitle"), "long_title": said("LongTitle"),
        "running_head": said("RunningHead"), "status": status, "title_status": mark("ShortTitle", "status", ("official", "unofficial"))}
    facts |= {"in_force": day(attribute(root, "inforce-start-date")), "consolidated": day(attribute(root, "current-date")),
        "last_amended": day(attribute(root, "lastAmendedDate")), "enacted": day(attribute(root, "enacted-date"))}
    if is_act:
        facts |= {"id": said("Chapter/ConsolidatedNumber") or said("Chapter/OfficialNumber"),
            "number_official": mark("Chapter/ConsolidatedNumber", "official", ("yes", "no")), "origin": attribute(root, "bill-origin"),
            "bill_type": attribute(root, "bill-type"), "bill": said("BillHistory/BillNumber") or said("BillNumber")}
    else:
        number = said("InstrumentNumber")
        facts |= {"id": re.sub(r",\s*", "_", number.replace("/", "-")) if number else None, "instrument": number,
            "enabling": said("EnablingAuthority/XRefExternal"), "gazette_part": attribute(root, "gazette-part"),
            "regulation_type": attribute(root, "regulation-type"), "maker": said("RegulationMakerOrder/RegulationMaker")}
    return facts


def document_rows(text: str) -> list[dict]:
    """Sections, definitions, references and captured parts of one document by a single walk.

    ``kind`` is section, definition, reference or a captured part; ``ordinal`` counts within its kind from 1 (the enacting
    clause is section 0); ``path`` are the headings above. Sections count if they have a label; in a schedule each item,
    form, table, provision and section counts, nested ones too. What an enabling order holds is not walked.
    """
    root, rows, count, stack = ET.fromstring(text), [], {}, []
    named = lambda node, *names: json.dumps({n: v for n in names if (v := attribute(node, n)) is not None}, sort_keys=True,
        ensure_ascii=False)

    def emit(kind: str, node: ET.Element, **more) -> dict:
        count[kind] = count.get(kind, 0) + 1
        row = {"kind": kind, "ordinal": count[kind], "label": None, "title": None, "text": "", "path": [h for _, h in stack], "section": None,
            "attributes": json.dumps(node.attrib, sort_keys=True, ensure_ascii=False)} | more
        rows.append(row)
        return row

    def walk(node: ET.Element, schedule: bool, section: str | None) -> None:
        tag = node.tag
        if tag == "Heading":
            level = int(node.get("level", "1"))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, flat_text(node)))
            return
        if tag in WHOLE:
            emit(WHOLE[tag], node, text=flat_text(node), **({"ordinal": 0} if tag == "Enacts" else {}))
            if tag in ("Order", "Enacts"):
                return
            for stage in node.iter("Stages"):
                emit("bill_stage", stage, label=attribute(stage, "stage"), title=day_of(stage.find("Date")))
            for change in node.iter("Amendment"):
                cited = change.find("AmendmentCitation")
                emit("amendment", change, label=None if cited is None else flat_text(cited), title=(change.findtext("AmendmentDate") or "").strip()
                    or None, text="" if cited is None else attribute(cited, "link") or "")
            for line in node.iter("SignatureLine"):
                emit("signature_line", line, label=(line.findtext("SignatureName") or "").strip() or None,
                    title=(line.findtext("SignatureTitle") or "").strip() or None, text=flat_text(line))
        if tag == "Provision" and node.find("TitleText") is not None and not schedule:
            emit("provision_entry", node, label=(node.findtext("Label") or "").strip() or None, title=flat_text(node.find("TitleText")))
        label = (node.findtext("Label") or "").strip() or None
        if (tag == "Section" and label) or (schedule and tag in IN_SCHEDULE):
            flags = sorted({name for element, name in FLAGS.items() if node.find(f".//{element}") is not None})
            emit("section", node, label=label, title=(node.findtext("MarginalNote") or "").strip() or None,
                text=flat_text(node, frozenset({"Label", "MarginalNote", "HistoricalNote"})), flags=flags)
            section = label or section
            changed = attribute(node, "change")
            rows[-1]["attributes"] = json.dumps(node.attrib | ({"change_type": changed} if changed in CHANGES else {}), sort_keys=True,
                ensure_ascii=False)
        if tag == "Footnote" and attribute(node, "id"):
            body = node.find("Text")
            emit("footnote", node, label=(node.findtext("Label") or "").strip() or None, title=attribute(node, "status"),
                text=flat_text(node if body is None else body), section=section, attributes=named(node, "id", "placement", "status"))
        if tag == "HistoricalNote":
            items = node.findall("HistoricalNoteSubItem")
            for item in items or [node]:
                if told := flat_text(item):
                    emit("historical_note", item, label=attribute(item, "type"), title=day(attribute(item, "enacted-date")), text=told,
                        section=section, attributes=named(item, "type", "enacted-date", "inforce-start-date", "enactId"))
        if tag == "Definition":
            terms = {t: flat_text(e) for t in ("DefinedTermEn", "DefinedTermFr") if (e := node.find(f".//{t}")) is not None}
            emit("definition", node, label=terms.get("DefinedTermEn"), title=terms.get("DefinedTermFr"), text=flat_text(node), section=section)
        if tag in ("XRefExternal", "XRefInternal"):
            emit("reference", node, label=node.get("link"), title=node.get("reference-type"), text=flat_text(node), section=section)
        kept = len(stack)
        for child in node:
            walk(child, schedule or tag == "Schedule", section)
        if tag == "Schedule":
            del stack[kept:]

    emit("document", root, label=(facts := facts_of(root))["id"], title=facts["title"],
        attributes=json.dumps({k: v for k, v in facts.items() if v is not None}, sort_keys=True, ensure_ascii=False))
    walk(root, False, None)
    return rows


FACTS = ["kind", "id", "title", "long_title", "running_head", "status", "title_status", "in_force", "consolidated", "last_amended", "enacted",
    "number_official", "origin", "bill_type", "bill", "instrument", "enabling", "gazette_part", "regulation_type", "maker"]


def document_facts(rows: DataFrame) -> DataFrame:
    """One row a document, of the rows of :func:`document_table`: ``doc_id`` and what it says of itself."""
    facts = F.from_json("attributes", ", ".join(f"{f} string" for f in FACTS))
    return rows.filter("kind = 'document'").select("doc_id", facts.alias("f")).select("doc_id", "f.*")


def lookup_maps(statutes: DataFrame, regulations: DataFrame) -> dict[str, DataFrame]:
    """Four tables of lookups from records of statutes and regulations (``xml``, a text each): ``statutes`` and ``regulations``
    by number and language, ``numbers`` of regulations by id, and ``related`` regulations of a statute.

    Records without id, number or language are left out; of several with one key the last id stands.
    """
    said = lambda tag, path: F.nullif(F.trim(F.xpath_string("xml", F.lit(f"/{tag}/{path}"))), F.lit(""))
    yes = lambda tag: F.lower(F.coalesce(said(tag, "ConsolidateFlag"), F.lit(""))).isin("true", "1")
    language = lambda tag: F.when(said(tag, "Language").isNull(), None).when(F.lower(said(tag, "Language")) == "fr",
        "fr").otherwise("en")
    common = lambda tag: [language(tag).alias("language"), F.coalesce(said(tag, "ShortTitle"), F.lit("")).alias("title"),
        F.coalesce(said(tag, "ReversedShortTitle"), said(tag, "ShortTitle"), F.lit("")).alias("reversed_title"), said(tag, "LastConsolidationDate")
        .alias("consolidated"), yes(tag).alias("consolidate")]
    s = statutes.select(said("Statute", "@id").alias("id"), said("Statute", "ChapterNumber").alias("number"),
        F.coalesce(said("Statute", "OfficialNumber"), said("Statute", "ChapterNumber")).alias("official"), *common("Statute"),
        F.xpath("xml", F.lit("/Statute/Relationships/Relationship/@rid")).alias("rids")).filter(
        "id is not null and number is not null and language is not null")
    r = regulations.select(said("Regulation", "@id").alias("id"), said("Regulation", "@olid").alias("other_id"), said("Regulation", "AlphaNumber")
        .alias("number"), *common("Regulation")).filter("id is not null and number is not null and language is not null")
    return {
        "statutes": standing(s.drop("rids"), ["number", "language"], "id"), "regulations": standing(r, ["number", "language"], "id"),
        "numbers": r.groupBy("id").agg(F.max("number").alias("number")), "related": s.select("id", F.explode("rids").alias("regulation_id"))
            .distinct(),
    }


def enabling_acts(maps: dict[str, DataFrame]) -> DataFrame:
    """``number``, ``language``, ``enabling``: the number of the statute that relates to a regulation, in its language."""
    r = maps["regulations"].select(F.col("id").alias("regulation_id"), F.col("number").alias("regulation_number"), "language")
    s = maps["statutes"].select("id", "language", F.col("number").alias("enabling"))
    found = r.join(maps["related"], "regulation_id").join(s, ["id", "language"]).groupBy("regulation_number", "language").agg(F.min("enabling")
        .alias("enabling"))
    return r.select("regulation_number", "language").join(found, ["regulation_number", "language"], "left").withColumnRenamed("regulation_number",
        "number")


ROWS = (
    "doc_id string, kind string, ordinal int, label string, title string, text string, path array<string>, section string, flags "
    "array<string>, attributes string, error string"
)


def document_table(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """The rows of every document; one that cannot be read gives one row with ``error``, a null one none. One parse a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ROWS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(),
            pa.list_(pa.string()), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    rows += [{"doc_id": doc} | r for r in document_rows(text)]
                except ET.ParseError as e:
                    rows.append({"doc_id": doc, "error": str(e)})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(run, ROWS)


def lookup_table(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Record-like XML (statutes, regulations) by the built-in reader."""
    return spark.read.option("rowTag", row_tag).xml(path)


def element_audit(docs: DataFrame, xml_col: str, samples: int = 5) -> DataFrame:
    """Per element name: how often it occurs, the first ``samples`` of its attributes' values, of the names of its children and
    of the paths it stands at, and how many children and paths there are.

    Distinct values are ranked and cut before they are gathered, so that no task holds all values of a frequent element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()  # (element, kind, value) of the batch
            for text in batch.column(0).to_pylist():
                try:
                    todo = [(ET.fromstring(text), "")] if text else []
                except ET.ParseError:
                    continue
                while todo:
                    node, above = todo.pop()
                    path = f"{above}/{node.tag}"
                    seen[node.tag, "elements", ""] += 1
                    seen[node.tag, "paths", path] += 1
                    for k, v in node.attrib.items():
                        seen[node.tag, "attrs", f"{k}={v[:100]}"] += 1
                    for child in node:
                        seen[node.tag, "children", child.tag] += 1
                        todo.append((child, path))
            columns = list(zip(*seen)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.string()) for c in columns], pa.array(list(seen.values()), pa.int64())],
                ["tag", "kind", "value", "n"])

    found = docs.select(F.col(xml_col).cast("string").alias("xml")).mapInArrow(run, "tag string, kind string, value string, n bigint")
    values = found.groupBy("tag", "kind", "value").agg(F.sum("n").alias("n"))
    counts = values.groupBy("tag").agg(F.sum(F.when(F.col("kind") == "elements", F.col("n"))).alias("elements"), F.count_if(F.col("kind") == "paths")
        .alias("n_paths"), F.count_if(F.col("kind") == "children").alias("n_children"))
    place = F.row_number().over(Window.partitionBy("tag", "kind").orderBy("value"))
    first = values.filter("kind <> 'elements'").withColumn("place", place).filter(F.col("place") <= samples)
    gather = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
    return counts.join(first.groupBy("tag").agg(gather("attrs"), gather("children"), gather("paths")), "tag", "left")
