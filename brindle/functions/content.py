"""Texts of records for retrieval, by source type and language: one line a fact, facts that are missing left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.wording import lined

# The lines of each kind in English and French; a line that begins with ``?`` needs all it names.
LINES: dict[str, tuple[list[str], list[str]]] = {
    "bill": (
        ["Bill {number}", "Session: {sessionId}", "?Title: {nameEn}", "?Short Title: {shortTitleEn}", "?Status: {statusCode}",
            "?Introduced: {introduced}", "?Status Date: {statusDate}", "Institution: {house}", "?Type: {billKind}", "?Law: {lawEn}"],
        ["Projet de loi {number}", "Session: {sessionId}", "?Titre: {nameFr}", "?Titre abrégé: {shortTitleFr}", "?Statut: {statusCode}",
            "?Présenté: {introduced}", "?Date du statut: {statusDate}", "Institution: {houseFr}", "?Type: {billKindFr}", "?Devenu loi: {lawFr}"],
    ),
    "vote_question": (
        ["Vote Question #{number}", "?Description: {descriptionEn}", "?Date: {date}", "?Result: {result}", "Yea: {yea} Nay: {nay} Paired: {paired}"],
        ["Question de vote n° {number}", "?Description: {descriptionFr}", "?Date: {date}", "?Résultat: {result}",
            "Pour: {yea} Contre: {nay} Jumelés: {paired}"],
    ),
    "vote_party": (
        ["Party vote: {partyEn} ({partyShortEn})", "Vote: {vote}", "Question #{number}", "?Description: {descriptionEn}", "?Date: {date}"],
        ["Vote du parti: {partyFr} ({partyShortFr})", "Vote: {vote}", "Question n° {number}", "?Description: {descriptionFr}", "?Date: {date}"],
    ),
    "vote_member": (
        ["Member vote: {member}", "Vote: {vote}", "Question #{number}", "?Description: {descriptionEn}", "?Date: {date}"],
        ["Vote du député/de la députée: {member}", "Vote: {vote}", "Question n° {number}", "?Description: {descriptionFr}", "?Date: {date}"],
    ),
    "committee": (["Committee: {nameEn}", "?Short: {shortTitleEn}", "Slug: {slug}", "Joint: {yes}"],
        ["Comité: {nameFr}", "?Abrégé: {shortTitleFr}", "Identifiant: {slug}", "Mixte: {oui}"]),
    "committee_report": (["Committee Report: {nameEn}", "?Number: {number}", "?Session: {sessionId}", "?Adopted: {adopted}", "?Presented: {date}"],
        ["Rapport de comité: {nameFr}", "?Numéro: {number}", "?Session: {sessionId}", "?Adopté: {adopted}", "?Présenté: {date}"]),
    "committee_meeting": (["Committee Meeting #{number}", "?Date: {date}", "?Session: {sessionId}", "Webcast: {yes}", "Televised: {yes2}"],
        ["Réunion du comité n° {number}", "?Date: {date}", "?Session: {sessionId}", "Diffusé sur le Web: {oui}", "Télévisé: {oui2}"]),
    "politician": (["Politician: {member}", "?Slug: {slug}"], ["Politicien/ne: {member}", "?Identifiant: {slug}"]),
    "party": (["Party: {partyEn}", "?Short: {partyShortEn}", "?Slug: {slug}"],
        ["Parti: {partyFr}", "?Abrégé: {partyShortFr}", "?Identifiant: {slug}"]),
    "election": (["Election", "?Date: {date}", "By-election: {yes}"], ["Élection", "?Date: {date}", "Élection partielle: {oui}"]),
    "session": (["Session {sessionId} – {sessionName}", "?Start: {date}", "?End: {adopted}", "?Parliament: {parliament}", "?Session #: {session}"],
        ["Session {sessionId} – {sessionName}", "?Début: {date}", "?Fin: {adopted}", "?Législature: {parliament}", "?Session n°: {session}"]),
    "riding": (["Riding: {ridingEn}", "Province: {province}", "Current: {yes}"],
        ["Circonscription: {ridingFr}", "Province: {province}", "Actuelle: {oui}"]),
    "candidacy": (
        ["Candidacy: {member|{memberId}}", "?Party: {partyEn}", "?Riding: {ridingEn}, {province}", "?Election Date: {date}", "?Vote %: {percent}",
            "?Votes: {votes}", "?Elected: {electedEn}"],
        ["Candidature: {member|{memberId}}", "?Parti: {partyFr}", "?Circonscription: {ridingFr}, {province}", "?Date de l'élection: {date}",
            "?Pourcentage de votes: {percent}", "?Votes: {votes}", "?Élu(e): {electedFr}"],
    ),
    "act": (
        ["Act: {title}", "?Long Title: {longTitle}", "?Short Title: {runningHead}", "?Short Title Status: {shortTitleStatus}",
            "?Alphabetical Index: {reversed}", "ID: {id}", "Status: {status}", "?In Force: {inForce}", "?Enacted: {enacted}",
            "?Last Amended: {amended}", "?Consolidation: {consolidation}", "?Origin: {origin}", "?Bill Type: {billType}",
            "?Consolidated Number: {consolidatedNumber}", "?Bill Number: {billNumber}", "?Royal Assent: {assent}", "?{amendmentsEn}"],
        ["Loi: {title}", "?Titre complet: {longTitle}", "?Titre abrégé: {runningHead}", "?Statut du titre abrégé: {shortTitleStatusFr}",
            "?Index alphabétique: {reversed}", "Identifiant: {id}", "Statut: {status}", "?En vigueur: {inForce}", "?Sanctionnée: {enacted}",
            "?Dernière modification: {amended}", "?Consolidation: {consolidation}", "?Origine: {originFr}", "?Type de projet de loi: {billType}",
            "?Numéro de consolidation: {consolidatedNumber}", "?Numéro du projet de loi: {billNumber}", "?Sanction royale: {assent}",
            "?{amendmentsFr}"],
    ),
    "regulation": (
        ["Regulation: {title}", "?Long Title: {longTitle}", "?Alphabetical Index: {reversed}", "ID: {id}", "?Instrument Number: {instrument}",
            "Status: {status}", "?Type: {kind}", "?Registration Date: {registered}", "?Enabling Act: {enabling}", "?Consolidation: {consolidation}",
            "?Last Amended: {amended}", "?Gazette Part: {gazettePart}", "?{amendmentsEn}"],
        ["Règlement: {title}", "?Titre complet: {longTitle}", "?Index alphabétique: {reversed}", "Identifiant: {id}",
            "?Numéro d'instrument: {instrument}", "Statut: {status}", "?Type: {kind}", "?Date d'enregistrement: {registered}",
            "?Loi habilitante: {enabling}", "?Consolidation: {consolidation}", "?Dernière modification: {amended}",
            "?Partie de la Gazette: {gazettePart}", "?{amendmentsFr}"],
    ),
    "defined_term": (
        ["Defined Term: {term}", "?French term: {paired}", "Source: {document}", "?Section: {section}", "?Scope: {scope}", "?{scopeSectionsEn}",
            "?{scopeTextEn}", "\nDefinition:\n{text}"],
        ["Terme défini: {term}", "?Terme anglais: {paired}", "Source: {document}", "?Article: {section}", "?Portée: {scopeFr}", "?{scopeSectionsFr}",
            "?{scopeTextFr}", "\nDéfinition:\n{text}"],
    ),
    "preamble": (["Preamble of: {document}", "?Note: {note}", "\n{text}"], ["Préambule de: {document}", "?Note: {note}", "\n{text}"]),
    "treaty": (["?Treaty/Convention: {title}", "Source: {document}", "?\n\nTreaty Structure:\n{outline}", "\n{text}",
        "?\n\nTreaty Definitions:\n{definitions}"], ["?Traité/Convention: {title}", "Source: {document}", "?\n\nStructure du traité:\n{outline}",
        "\n{text}", "?\n\nDéfinitions du traité:\n{definitions}"]),
    "cross_reference": (
        ["Cross-reference", "Source: {document}", "?Source section: {section}", "Target type: {target}", "Reference: {reference}",
            "?Target document: {targetTitleEn}", "?Text: {shownEn}"],
        ["Référence croisée", "Source: {document}", "?Article source: {section}", "Type de cible: {targetFr}", "Référence: {reference}",
            "?Document cible: {targetTitleFr}", "?Texte: {shownFr}"],
    ),
    "table_of_provisions": (["Table of Provisions of: {document}", "", "{outline}"], ["Table des dispositions de: {document}", "", "{outline}"]),
    "signature_block": (["Signature block of: {document}", "?Witness clause: {witness}", "?Done at: {doneAt}", "?{signaturesEn}"],
        ["Bloc de signature de: {document}", "?Clause de témoin: {witness}", "?Fait à: {doneAt}", "?{signaturesFr}"]),
    "related_provisions": (["Related provisions of: {document}", "?Label: {note}", "?Source: {source}", "?Sections: {sections}", "?\n{text}"],
        ["Dispositions connexes de: {document}", "?Étiquette: {note}", "?Source: {source}", "?Articles: {sections}", "?\n{text}"]),
    "footnote": (["Footnote from: {document}", "Section: {section}", "?Label: {note}", "?Type: {footnoteStatus}", "\n{text}"],
        ["Note de bas de page de: {document}", "Article: {section}", "?Étiquette: {note}", "?Type: {footnoteStatusFr}", "\n{text}"]),
    "marginal_note": (["Marginal Note: {note}", "Act/Regulation: {document}", "Section: {section}"],
        ["Note marginale: {note}", "Loi/Règlement: {document}", "Article: {section}"]),
    "publication_item": (["{publication} from: {document}", "?Publication type: {requirement}", "?Source sections: {sections}", "\n{text}"],
        ["{publicationFr} de: {document}", "?Type de publication: {requirementFr}", "?Articles sources: {sections}", "\n{text}"]),
}
SIGNATURE = (["?Signatory: {signatureName}", "?Title: {signatureTitle}", "?Date: {signatureDate}", "?Location: {signatureLocation}"],
    ["?Signataire: {signatureName}", "?Titre: {signatureTitle}", "?Date: {signatureDate}", "?Lieu: {signatureLocation}"])
AMENDMENTS = ("Recent Amendments:", "Modifications récentes:")


def content(kind: str, language: str, fields: Mapping[str, Column]) -> Column:
    """The text of a record of one kind."""
    return lined(LINES[kind][language == "fr"], fields)


def content_by_kind(kind: Column, language: Column, fields: Mapping[str, Column]) -> Column:
    """The same where rows are of several kinds and languages; null for an unknown kind."""
    out = F.lit(None).cast("string")
    for code in LINES:
        out = F.when(kind == code, F.when(language == "fr", content(code, "fr", fields)).otherwise(content(code, "en", fields))).otherwise(out)
    return out


def listed(items: Column, lines: list[str], names: list[str]) -> Column:
    """The lines of each struct in an array, one after the other; null without any."""
    texts = F.filter(F.transform(items, lambda x: lined(lines, {n: x[n] for n in names})), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def amendments(items: Column, language: str) -> Column:
    """Recent amendments (``citation``, ``date``) under their heading, each as a dash, its citation and date."""
    rows = F.transform(items, lambda x: F.concat(F.lit("  - "), F.coalesce(x["citation"], F.lit("")),
        F.when(F.coalesce(x["date"], F.lit("")) != "", F.concat(F.lit(" ("), x["date"], F.lit(")"))).otherwise("")))
    return F.when(F.size(items) > 0, F.concat(F.lit(AMENDMENTS[language == "fr"] + "\n"), F.array_join(rows, "\n")))
