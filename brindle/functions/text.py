"""Column functions on texts and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French function words, accents and accent folding.
FRENCH_WORDS = ["le", "la", "les", "de", "du", "des", "un", "une", "que", "qui", "est", "sont", "pour", "dans", "avec", "sur", "par", "ce", "cette",
    "ces", "au", "aux", "en", "et", "ou", "mais", "donc", "parlement", "député", "gouvernement", "ministre"]
FRENCH_PHRASES = ["projet de loi"]
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
BILL_NUMBER = r"(?i)\b([CS]-\d+)\b"
LANGUAGE_ONLY = r"(?i)^(?:Version (?:anglaise|française) seulement|(?:English|French) version only)$"
VOTES = {"Y": "Yea", "N": "Nay", "A": "Abstain", "P": "Paired"}
RESULTS = {"Y": "Passed", "N": "Failed", "T": "Tie"}


def filled(col: Column) -> Column:
    """The value, with the empty string as null."""
    return F.nullif(col, F.lit(""))


def either(first: Column, second: Column) -> Column:
    """``first`` unless null or empty, else ``second``."""
    return F.coalesce(filled(first), second)


def squeezed(col: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def estimated_tokens(col: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(col) / 4).cast("int")


def sentence_array(col: Column) -> Column:
    """Pieces split at white space after a full stop, exclamation or question mark; blank pieces left out."""
    return F.filter(F.split(col, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def language(col: Column) -> Column:
    """``fr`` with two French words, or one and an accent; else ``en``, also for null and blank texts."""
    words = F.regexp_count(col, F.lit(r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(FRENCH_WORDS + FRENCH_PHRASES) + r")(?![\p{L}\p{N}_])"))
    accents = col.rlike("(?iu)[àâäéèêëïîôùûüÿœæç]")
    return F.when((words >= 2) | ((words >= 1) & accents), "fr").otherwise("en")


def bill_number(col: Column) -> Column:
    """The first bill number, in upper case; null without any."""
    return filled(F.upper(F.regexp_extract(col, BILL_NUMBER, 1)))


def folded_term(col: Column) -> Column:
    """Lower case without accents, ligatures, dashes and punctuation, for matching terms across languages."""
    lower = F.regexp_replace(F.regexp_replace(F.lower(col), "œ", "oe"), "æ", "ae")
    plain = F.regexp_replace(F.translate(lower, ACCENTED, PLAIN), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[–—-]", " "), r"[^a-z0-9\s]", ""), r"\s+", " "))


def translated_regulation_id(col: Column, to: str) -> Column:
    """The other language's form of a regulation's id; unknown forms stay."""
    pairs = [("C.R.C._c. ", "C.R.C._ch. "), ("SOR-", "DORS-"), ("SI-", "TR-")]
    statute = ("_c. ", "_s. ", "_ch. ", "_art. ")
    if to == "en":
        pairs, statute = [(b, a) for a, b in pairs], statute[2:] + statute[:2]
    out = F.when(col.contains(statute[0]) & col.contains(statute[1]),
        F.replace(F.replace(col, F.lit(statute[0]), F.lit(statute[2])), F.lit(statute[1]), F.lit(statute[3]))).otherwise(col)
    for a, b in reversed(pairs):
        out = F.when(col.startswith(a), F.concat(F.lit(b), F.substring(col, len(a) + 1, 1_000_000))).otherwise(out)
    return out


def ordinal(col: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th."""
    teen = (col % 100).between(11, 13)
    end = F.when(teen, "th").when(col % 10 == 1, "st").when(col % 10 == 2, "nd").when(col % 10 == 3, "rd").otherwise("th")
    return F.concat(col.cast("string"), end)


def without_tags(col: Column) -> Column:
    return squeezed(F.regexp_replace(col, "<[^>]+>", ""))


def snippet(col: Column, size: int = 480, least: int = 200) -> Column:
    """The first ``size`` characters, cut behind the last sentence end if that lies beyond ``least``, else with an ellipsis."""
    text = squeezed(col)
    head = F.substring(text, 1, size)
    ends = [F.when(F.instr(head, mark) > 0, F.length(head) - F.instr(F.reverse(head), mark[::-1])).otherwise(0) for mark in (". ", "? ", "! ")]
    last = F.greatest(*ends)  # characters up to the mark, with it
    return F.when(F.length(text) <= size, text).when(last > least, F.left(head, last)).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def label(col: Column, names: dict[str, str]) -> Column:
    """Codes as labels; unknown codes stay."""
    out = col
    for code, name in reversed(names.items()):
        out = F.when(col == code, name).otherwise(out)
    return out


def parsed_date(col: Column) -> Column:
    """YYYYMMDD or ISO text as a date; null for anything else."""
    return F.when(col.rlike(r"^\d{8}$"), F.try_to_date(col, "yyyyMMdd")).when(col.rlike(r"^\d{4}-\d{2}-\d{2}"),
        F.try_to_date(F.left(col, F.lit(10)), "yyyy-MM-dd"))


def reformulations(query: Column, lang: Column) -> Column:
    """Two other wordings of a query, by its bill number if it has one."""
    bill = bill_number(query)
    fr = F.array(F.concat(F.lit("Résumé du projet de loi "), bill), F.concat(F.lit("Contexte et statut du projet de loi "), bill))
    en = F.array(F.concat(F.lit("Summary of Bill "), bill), F.concat(F.lit("Context and status of Bill "), bill))
    fixed_fr = F.array(F.lit("Contexte parlementaire lié"), F.lit("Informations officielles pertinentes"))
    fixed_en = F.array(F.lit("Related parliamentary context"), F.lit("Relevant official information"))
    return F.when(bill.isNotNull(), F.when(lang == "fr", fr).otherwise(en)).otherwise(F.when(lang == "fr", fixed_fr).otherwise(fixed_en))


def historical_notes(notes: Column, lang: Column) -> Column:
    """Notes (``text``, ``made``) as one closing paragraph; the date follows a note whose text does not give it."""
    either = lambda en, fr: F.when(lang == "fr", fr).otherwise(en)
    told = lambda n: F.coalesce((n["made"] != "") & ~n["text"].contains(n["made"]), F.lit(False))
    parts = F.transform(notes, lambda n: F.concat(n["text"], F.when(told(n), F.concat(either(" (enacted: ", " (édicté: "), n["made"], F.lit(")")))
        .otherwise("")))
    return F.when(F.size(notes) > 0, F.concat(F.lit("\n\n"), either("History: ", "Historique: "), F.array_join(parts, "; ")))


def marker_type(marker: Column) -> Column:
    """The level of a provision's marker such as ``(1)``, ``(a)``, ``(ii)`` or ``(A)``; null for other texts."""
    inner = F.substring(marker, 2, 1_000_000)
    inner = F.left(inner, F.length(inner) - 1)
    roman = inner.rlike(r"(?i)^(?:[ivx]{2,}|i|v|x)$")
    return F.when(inner.rlike(r"^\d+$"), "subsection").when(roman, "subparagraph").when(inner.rlike("^[a-z]$"),
        "paragraph").when(inner.rlike("^[A-Z]$"), "clause")


def is_repealed(status: Column, content: Column) -> Column:
    return F.coalesce(status == "repealed", F.lit(False)) | F.coalesce(content.rlike(r"(?i)^\d+(?:\.\d+)?\s*\[(?:Repealed|Abrogé)"), F.lit(False))
