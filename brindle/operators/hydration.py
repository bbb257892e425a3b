"""Entities with what belongs to them as one Markdown text each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import filled
from brindle.functions.wording import lined
from brindle.operators.relational import placed

# Most sections and characters of a text, and from how many sections on it has a table of contents of how many.
MOST_SECTIONS, MOST_CHARS, CONTENTS_FROM, CONTENTS = 150, 100_000, 10, 30
# In English and French.
SHOWN = ("> *Showing {a} of {b} sections. See Justice Canada website for full text.*",
    "> *Affichage de {a} sur {b} sections. Consultez le site Justice Canada pour le texte complet.*")
CUT = ("\n\n---\n*Content truncated. See Justice Canada website for full text.*",
    "\n\n---\n*Contenu tronqué. Consultez le site Justice Canada pour le texte complet.*")
LABELS = {"status": ("Status", "Statut"), "consolidated": ("Consolidation Date", "Date de consolidation"),
    "enabling": ("Enabling Act", "Loi habilitante"), "contents": ("Table of Contents", "Table des matières"),
    "section": ("### Section ", "### Article ")}


def document_markdown(docs: DataFrame, sections: DataFrame, most: int = MOST_SECTIONS, chars: int = MOST_CHARS) -> DataFrame:
    """``doc``, ``language``, ``markdown``, ``shown`` and ``total`` sections of every document.

    ``docs``: ``doc``, ``language``, ``title``, ``long_title``, ``status``, ``consolidated``, ``enabling``, one row each;
    ``sections``: ``doc``, ``language``, ``ord``, ``label``, ``note``, ``kind``, ``content``. A text shows the first ``most``
    sections while it has up to ``chars`` characters, and says so where it shows fewer. A document with very many sections
    is cut to its first ones before the shuffle, and no text beyond the size is gathered. Documents without sections have
    their heading only.
    """
    by = Window.partitionBy("doc", "language").orderBy("ord")
    totals = sections.groupBy("doc", "language").agg(F.count(F.lit(1)).alias("total"))
    first = sections.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most)
    fr = F.col("language") == "fr"
    either = lambda pair: F.when(fr, pair[1]).otherwise(pair[0])
    label, note = F.coalesce("label", F.lit("")), filled(F.col("note"))
    dash = F.when(note.isNotNull(), F.concat(F.lit(" — "), note)).otherwise("")
    head = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), label, dash)).when(F.col("kind") == "schedule",
        F.concat(F.lit("## "), label, F.when(note.isNotNull(), F.concat(F.lit("\n*"), note, F.lit("*"))).otherwise(""))).otherwise(
        F.concat(either(LABELS["section"]), label, dash))
    entry = F.when(F.col("kind") == "heading", F.trim(F.concat(F.lit("- **"), label, F.lit("** "), F.coalesce(note, F.lit(""))))).otherwise(
        F.concat(F.lit("- "), label, dash))
    texts = first.withColumn("entry", entry).withColumn("text", F.concat(head, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")))
    sized = texts.withColumn("upto", F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    bounded = F.struct("n", "entry", "upto", F.when(F.col("upto") <= chars, F.col("text")).alias("text"))
    held = sized.groupBy("doc", "language").agg(F.sort_array(F.collect_list(bounded)).alias("s"))  # ``most`` rows at most

    both = docs.join(held, ["doc", "language"], "left").join(totals, ["doc", "language"], "left").withColumn("s",
        F.coalesce("s", F.array().cast(held.schema["s"].dataType))).withColumn("total", F.coalesce("total", F.lit(0)))
    count = F.size("s")
    fact = lambda name: F.when(filled(F.col(name).cast("string")).isNotNull(),
        F.concat(F.lit("- **"), either(LABELS[name]), F.lit(":** "), F.col(name).cast("string")))
    facts = F.array_compact(F.array(*[fact(name) for name in ("status", "consolidated", "enabling")]))
    none = F.array().cast("array<string>")
    shown = F.replace(F.replace(either(SHOWN), F.lit("{a}"), count.cast("string")), F.lit("{b}"), F.col("total").cast("string"))
    entries = F.transform(F.slice("s", 1, CONTENTS), lambda x: x["entry"])
    rest = F.when(count > CONTENTS, F.array(F.concat(F.lit("- ... ("), (count - CONTENTS).cast("string"), F.lit(" more sections)")))).otherwise(none)
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce("title", F.lit("")))),
        F.when((filled(F.col("long_title")).isNotNull()) & ~F.col("long_title").eqNullSafe(F.col("title")),
            F.array(F.concat(F.lit("\n*"), F.col("long_title"), F.lit("*")))).otherwise(none),
        F.array(F.lit("")),
        F.when(F.col("total") > count, F.array(shown, F.lit(""))).otherwise(none),
        F.when(F.size(facts) > 0, F.concat(facts, F.array(F.lit("")))).otherwise(none),
        F.when(count > CONTENTS_FROM, F.concat(F.array(F.concat(F.lit("## "), either(LABELS["contents"])), F.lit("")), entries, rest,
            F.array(F.lit("")))).otherwise(none),
    )
    built = both.withColumn("head", F.array_join(lines, "\n")).withColumn("kept", F.filter("s", lambda x: F.length("head") + x["upto"] <= chars))
    body = F.concat(F.array(F.col("head")), F.transform("kept", lambda x: x["text"]), F.when(F.size("kept") < count, F.array(either(CUT)))
        .otherwise(none))
    return built.select("doc", "language", F.array_join(body, "\n").alias("markdown"), F.size("kept").alias("shown"), "total")


# What begins a paragraph of a bill's text; lines that are headings of parts, other headings and definitions; the
# letters of an enumeration and of one within it.
BODY_MARKS = [
    r"(PART\s+\d+(?:\s+[A-Z][A-Za-z0-9 ,''()-]+)?)",
    r"(Short Title)\b",
    r"(Definitions)\b",
    r"(Enactment(?: of Act)?)\b",
    r"(\d+\s*\(\d+\)\s+)",
]
PART_LINE = r"^PART\s+(\d+)(?:\s+(.+))?$"
HEADING_LINE = r"(?i)^(Short Title|Definitions|Enactment(?: of Act)?)\b"
DEFINITION_LINE = r"^([A-Za-z][A-Za-z -]{1,60})\s+means\s+(.+)$"
LETTERS, NUMERALS = "[a-z]", "[ivx]+"


def bill_body(text: Column) -> Column:
    """The plain text of a bill as Markdown: headings of parts, of short titles, definitions and enactments; enumerations and
    definitions as lists. Line by line, without leaving the JVM."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(plain, "[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    t = F.trim(t, F.lit(" \t\n\r"))
    for mark in BODY_MARKS:
        t = F.regexp_replace(t, r"\s+" + mark, "\n\n$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")

    def listed(line: Column, letters: str, dash: str, flags: str = "") -> Column:
        cut = F.regexp_replace(line, rf"(?d{flags})\s(?=\({letters}\)\s)", "\n")
        return F.regexp_replace(cut, rf"(?dm{flags})^\(({letters})\)[^\S\n]*", f"{dash}($1) ")

    def one(raw: Column) -> Column:
        line = F.trim(raw, F.lit(" \t\r"))
        part, title = F.regexp_extract(line, PART_LINE, 1), F.trim(F.regexp_extract(line, PART_LINE, 2))
        term, meaning = (F.trim(F.regexp_extract(line, DEFINITION_LINE, i)) for i in (1, 2))
        return (
            F.when(part != "", F.concat(F.lit("## Part "), part, F.when(title != "", F.concat(F.lit(" — "), title)).otherwise("")))
            .when(line.rlike(HEADING_LINE), F.concat(F.lit("### "), F.regexp_replace(line, r"\s+", " ")))
            .when(line.rlike(rf"\s\({LETTERS}\)\s"), listed(line, LETTERS, "- "))
            .when(line.rlike(rf"(?i)\s\({NUMERALS}\)\s"), listed(line, NUMERALS, "  - ", "i"))
            .when(line.rlike(DEFINITION_LINE), F.concat(F.lit("- **"), term, F.lit("** — "), meaning))
            .otherwise(line)
        )

    return F.array_join(F.transform(F.split(t, "\n"), one), "\n")


def headings(markdown: Column, title: str = "Table of Contents") -> Column:
    """The table of contents of a Markdown text's second-level headings; null without any."""
    found = F.filter(F.split(markdown, "\n"), lambda x: x.startswith("## "))
    rows = F.transform(found, lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"^##\s+", "")))
    return F.when(F.size(found) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(rows, "\n")))


# Facts of a bill in English and French.
BILL_FACTS = (
    ["- Session: {sessionId}", "?- Institution: {house}", "?- Introduced: {introduced}", "?- Status Date: {statusDate}", "?- Status: {statusCode}",
        "?- Became Law: {lawEn}", "?- Type: {billKind}"],
    ["- Session: {sessionId}", "?- Institution: {houseFr}", "?- Présenté: {introduced}", "?- Date du statut: {statusDate}", "?- Statut: {statusCode}",
        "?- Devenu loi: {lawFr}", "?- Type: {billKindFr}"],
)


def bill_markdown(number: Column, title: Column, language: str, fields: dict[str, Column], body: Column) -> Column:
    """A bill's heading, facts, table of contents and body."""
    text = bill_body(body)
    head = F.rtrim(F.concat(F.lit("# Bill "), F.coalesce(number, F.lit("")), F.lit(": "), F.coalesce(title, F.lit(""))))
    return F.concat_ws("\n", head, filled(lined(BILL_FACTS[language == "fr"], fields)), headings(text), filled(text))


# Labels of votes and elections in English and French.
VOTES = {"title": ("# Votes on Bill ", "# Votes sur le projet de loi "), "yea": ("Yea", "Pour"), "nay": ("Nay", "Contre"),
    "paired": ("Paired", "Jumelés"), "result": ("Result", "Résultat"),
         "breakdown": ("### Party Breakdown", "### Vote par parti"), "party": ("Party", "Parti"),
             "dissent": ("### Notable Dissenters", "### Dissidents notables"), "and": ("and", "et"), "more": ("more", "autres")}
ELECTIONS = {"general": ("General Election", "Élection générale"), "by": ("By-election", "Élection partielle"), "results": ("Results", "Résultats"),
    "candidate": ("Candidate", "Candidat"), "party": ("Party", "Parti"),
             "riding": ("Riding", "Circonscription"), "elected": ("Elected", "Élu"), "yes": ("Yes", "Oui"), "no": ("No", "Non")}
#: Dissenters that a vote shows, candidates that an election shows.
DISSENTERS, CANDIDATES = 5, 20


def vote_sections(bills: DataFrame, votes: DataFrame, parties: DataFrame, dissents: DataFrame, lang: str = "en") -> DataFrame:
    """``bill``, ``place`` and ``markdown``: the heading of each bill with votes (place 0) and a section for each vote, by day.

    ``bills``: ``bill``, ``number``, ``name``, ``session``; ``votes``: ``vote``, ``bill``, ``vote_number``, ``day``, ``told``,
    ``outcome``, ``yea``, ``nay``, ``paired``; ``parties``: ``vote``, ``party``, ``short``, ``cast`` (a few rows a vote);
    ``dissents``: ``vote``, ``member``, ``cast``. Sections stay rows, so that a bill with very many votes is no single text;
    of a vote's dissenters only the first leave a task, and their number.
    """
    i = int(lang == "fr")
    by = Window.partitionBy("vote").orderBy("member")
    first = dissents.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= DISSENTERS)
    against = first.groupBy("vote").agg(F.sort_array(F.collect_list(F.struct("_n", "member", "cast"))).alias("d")).join(dissents.groupBy("vote")
        .agg(F.count(F.lit(1)).alias("against")), "vote")
    split = parties.groupBy("vote").agg(F.sort_array(F.collect_list(F.struct("party", "short", "cast"))).alias("p"))
    full = votes.join(split, "vote", "left").join(against, "vote", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.concat(F.lit("## Vote #"), text("vote_number")), F.concat(F.lit("**Date:** "), text("day")),
                F.concat(F.lit("**Description:** "), text("told")),
            F.concat(F.lit(f"**{VOTES['result'][i]}:** "), text("outcome")), F.lit(""),
                F.lit(f"| {VOTES['yea'][i]} | {VOTES['nay'][i]} | {VOTES['paired'][i]} |"),
            F.lit("|------|-----|--------|"), F.concat(F.lit("| "), text("yea"), F.lit(" | "), text("nay"), F.lit(" | "), text("paired"),
                F.lit(" |")), F.lit(""),
        ),
        F.when(
            F.size("p") > 0,
            F.concat(
                F.array(F.lit(VOTES["breakdown"][i]), F.lit(f"| {VOTES['party'][i]} | Vote |"), F.lit("|-------|------|")),
                F.transform("p", lambda x: F.concat(F.lit("| "), x["party"], F.lit(" ("), x["short"], F.lit(") | "), x["cast"], F.lit(" |"))),
                    F.array(F.lit("")),
            ),
        ).otherwise(none),
        F.when(
            F.col("against") > 0,
            F.concat(
                F.array(F.lit(VOTES["dissent"][i])), F.transform("d", lambda x: F.concat(F.lit("- "), x["member"], F.lit(": "), x["cast"])),
                F.when(F.col("against") > DISSENTERS,
                    F.array(F.concat(F.lit(f"- {VOTES['and'][i]} "), (F.col("against") - DISSENTERS).cast("string"),
                    F.lit(f" {VOTES['more'][i]}...")))).otherwise(none),
                F.array(F.lit("")),
            ),
        ).otherwise(none),
    )
    sections = placed(full.join(bills.select("bill"), "bill", "left_semi").withColumn("markdown", F.array_join(lines, "\n"))
        .select("bill", "day", "vote", "markdown"), ["bill"], ["day", "vote"], "place")
    head = F.concat(F.lit(VOTES["title"][i]), text("number"), F.lit("\n\n**"), text("name"), F.lit("**\nSession: "), text("session"), F.lit("\n"))
    heads = bills.join(votes.select("bill"), "bill", "left_semi").select("bill", F.lit(0).cast("bigint").alias("place"), head.alias("markdown"))
    return heads.unionByName(sections.select("bill", "place", "markdown"))


def election_markdown(candidacies: DataFrame, lang: str = "en", most: int = CANDIDATES) -> DataFrame:
    """``election`` and ``markdown``: the results of each election, its ``most`` strongest candidates.

    ``candidacies``: ``election``, ``day``, ``by_election``, ``candidacy``, ``candidate``, ``party``, ``riding``, ``share``,
    ``elected``. An election is cut to its strongest candidates before the shuffle.
    """
    i = int(lang == "fr")
    best = Window.partitionBy("election").orderBy(F.desc_nulls_last("share"), "candidacy")
    first = candidacies.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
    share = F.when(F.col("share").isNotNull(), F.concat(F.round("share", 1).cast("string"), F.lit("%"))).otherwise("-")
    cells = [F.coalesce("candidate", F.lit("Unknown")), F.coalesce("party", F.lit("?")), F.coalesce("riding", F.lit("Unknown")), share,
        F.when(F.col("elected"), ELECTIONS["yes"][i]).otherwise(ELECTIONS["no"][i])]
    rows = first.withColumn("row", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
    held = rows.groupBy("election").agg(F.max("day").alias("day"), F.bool_or("by_election").alias("by"),
        F.sort_array(F.collect_list(F.struct("_n", "row"))).alias("rows"))  # ``most`` rows
    kind = F.when(F.coalesce("by", F.lit(False)), ELECTIONS["by"][i]).otherwise(ELECTIONS["general"][i])
    table = (
        f"## {ELECTIONS['results'][i]}\n\n| {ELECTIONS['candidate'][i]} | {ELECTIONS['party'][i]} | {ELECTIONS['riding'][i]} | % | "
        f"{ELECTIONS['elected'][i]} |\n|----------|-------|---------|------|---------|\n"
    )
    return held.select("election", F.concat(F.lit("# "), kind, F.lit(" - "), F.coalesce("day", F.lit("Unknown Date")), F.lit("\n\n" + table),
        F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("\n")).alias("markdown"))
