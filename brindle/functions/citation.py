"""Citations of resources in both languages: text, address and title by source type."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import filled, ordinal
from brindle.functions.wording import worded

# Addresses and wordings of citations.
LAWS = "https://laws-lois.justice.gc.ca"
HOUSE = "https://www.ourcommons.ca"
FOLDERS = {"en": ("eng", "acts", "regulations"), "fr": ("fra", "lois", "reglements")}


class Wordings(NamedTuple):
    text_en: str
    text_fr: str
    title_en: str
    title_fr: str
    url_en: str
    url_fr: str


def _page(lang: str, folder: int, field: str) -> str:
    return f"{LAWS}/{FOLDERS[lang][0]}/{FOLDERS[lang][folder]}/{field}/page-1.html"


def _own(lang: str, folder: int) -> str:
    return _page(lang, folder, "{actId|unknown}" if folder == 1 else "{regulationId|unknown}")


def _parent(lang: str) -> str:
    """The act's page, else the regulation's, else the site's."""
    return f"<actId:{_page(lang, 1, '{actId}')}><!actId:<regulationId:{_page(lang, 2, '{regulationId}')}><!regulationId:{LAWS}>>"


def _target(lang: str) -> str:
    return f"<targetAct:{_page(lang, 1, '{targetAct}')}><!targetAct:<targetRegulation:{_page(lang, 2, '{targetRegulation}')}><!targetRegulation:{_parent(lang)}>>"


_ANCHOR = "<sectionLabel:#sec{anchor}>"
_S_EN, _S_FR = "<sectionLabel:, s {sectionLabel}>", "<sectionLabel:, art {sectionLabel}>"
_TITLE = "{documentTitle|Legislation}"
_ACT, _REG = "{documentTitle|Act {actId|unknown}}", "{documentTitle|Regulation {regulationId|unknown}}"
_IN_PARENT = (_parent("en"), _parent("fr"))
_AT_SECTION = (_parent("en") + _ANCHOR, _parent("fr") + _ANCHOR)

LEGISLATION = {
    "act": Wordings(f"[{_ACT}]", f"[{_ACT}]", _ACT, _ACT, _own("en", 1), _own("fr", 1)),
    "act_section": Wordings(f"[{_ACT}{_S_EN}]", f"[{_ACT}{_S_FR}]", _ACT, _ACT, _own("en", 1) + _ANCHOR, _own("fr", 1) + _ANCHOR),
    "regulation": Wordings(f"[{_REG}]", f"[{_REG}]", _REG, _REG, _own("en", 2), _own("fr", 2)),
    "regulation_section": Wordings(f"[{_REG}{_S_EN}]", f"[{_REG}{_S_FR}]", _REG, _REG, _own("en", 2) + _ANCHOR, _own("fr", 2) + _ANCHOR),
    "defined_term": Wordings(f'["{{term|Term}}" - {_TITLE}{_S_EN}]', f"[« {{term|Term}} » - {_TITLE}{_S_FR}]", f'"{{term|Term}}" defined in {_TITLE}',
        f"« {{term|Term}} » défini dans {_TITLE}", *_AT_SECTION),
    "preamble": Wordings(f"[{_TITLE}, Preamble]", f"[{_TITLE}, Préambule]", f"Preamble of {_TITLE}", f"Préambule de {_TITLE}", *_IN_PARENT),
    "treaty": Wordings(f"[{{treatyTitle|Treaty in {_TITLE}}}]", f"[{{treatyTitle|Traité dans {_TITLE}}}]", f"{{treatyTitle|Treaty in {_TITLE}}}",
        f"{{treatyTitle|Traité dans {_TITLE}}}", *_IN_PARENT),
    "cross_reference": Wordings(f"[{_TITLE} → {{targetKind}} {{targetRef}}]", f"[{_TITLE} → {{targetKindFr}} {{targetRef}}]",
        f"Cross-reference from {_TITLE} to {{targetRef}}", f"Renvoi de {_TITLE} à {{targetRef}}", _target("en"), _target("fr")),
    "table_of_provisions": Wordings(f"[{_TITLE}, Table of Provisions<provisionCount: ({{provisionCount}} entries)>]",
        f"[{_TITLE}, Table des dispositions<provisionCount: ({{provisionCount}} entries)>]", f"Table of Provisions of {_TITLE}",
        f"Table des dispositions de {_TITLE}", *_IN_PARENT),
    "signature_block": Wordings(*[f"[{_TITLE}, Signature<signatureName: - {{signatureName}}<signatureTitle:, {{signatureTitle}}>>]"] * 2,
        f"Signature block of {_TITLE}", f"Bloc de signature de {_TITLE}", *_IN_PARENT),
    "related_provisions": Wordings(f"[{_TITLE}, Related Provisions<relatedProvisionLabel:: {{relatedProvisionLabel}}>{{relatedSections}}]",
        f"[{_TITLE}, Dispositions connexes<relatedProvisionLabel:: {{relatedProvisionLabel}}>{{relatedSections}}]",
        f"Related Provisions<relatedProvisionSource: ({{relatedProvisionSource}})> in {_TITLE}",
        f"Dispositions connexes<relatedProvisionSource: ({{relatedProvisionSource}})> dans {_TITLE}", *_IN_PARENT),
    "footnote": Wordings(f"[{_TITLE}{_S_EN}, Footnote<footnoteLabel: [{{footnoteLabel}}]><editorial: (editorial)>]",
        f"[{_TITLE}{_S_FR}, Note<footnoteLabel: [{{footnoteLabel}}]><editorial: (éditoriale)>]",
        f"Footnote in {_TITLE}<sectionLabel:, section {{sectionLabel}}>",
        f"Note de bas de page dans {_TITLE}<sectionLabel:, article {{sectionLabel}}>", *_AT_SECTION),
    "marginal_note": Wordings(f"[{_TITLE}{_S_EN} - {{marginalNote|Section heading}}]", f"[{_TITLE}{_S_FR} - {{marginalNote|Note marginale}}]",
        f"<sectionLabel:Section {{sectionLabel}} of >{_TITLE}: {{marginalNote|Section heading}}",
        f"<sectionLabel:Article {{sectionLabel}} de >{_TITLE}: {{marginalNote|Note marginale}}", *_AT_SECTION),
    "schedule": Wordings(*[f"[{_TITLE}, {{sectionLabel|Schedule}}]"] * 2, f"{{sectionLabel|Schedule}} of {_TITLE}",
        f"{{sectionLabel|Schedule}} de {_TITLE}", *_AT_SECTION),
    "publication_item": Wordings("[{documentTitle|Regulation}, {publication}]", "[{documentTitle|Regulation}, {publicationFr}]",
        "{publication} in {documentTitle|Regulation}", "{publicationFr} dans {documentTitle|Regulation}", *_IN_PARENT),
}
OTHER_LEGISLATION = Wordings("[{documentTitle|Legislation}]", "[{documentTitle|Législation}]", "{documentTitle|Legislation}",
    "{documentTitle|Législation}", LAWS, LAWS)

_DATE_EN, _DATE_FR = "{date|unknown date}", "{date|date inconnue}"
_COMMITTEE_EN, _COMMITTEE_FR = "{committeeNameEn|{committeeNameFr|%s}}", "{committeeNameFr|{committeeNameEn|%s}}"
_REPORT_EN, _REPORT_FR = "{title|{nameEn|{nameFr|Report}}}", "{title|{nameFr|{nameEn|Rapport}}}"
_RIDING_EN, _RIDING_FR = "{ridingNameEn|{ridingNameFr|Unknown Riding}}", "{ridingNameFr|{ridingNameEn|Circonscription inconnue}}"
_PARTY_EN, _PARTY_FR = "{partyNameEn|{partyNameFr|Unknown Party}}", "{partyNameFr|{partyNameEn|Parti inconnu}}"
_SHORT_EN, _SHORT_FR = "{partyShortEn|{partyShortFr}}", "{partyShortFr|{partyShortEn}}"
_VOTES = tuple(f"{HOUSE}/Members/{lang}/votes<voteNumber:/{{sessionPath}}/{{voteNumber}}>" for lang in ("en", "fr"))
_ELECTIONS = tuple(f"https://www.elections.ca/content.aspx?section=ele&lang={lang}" for lang in ("e", "f"))
_ANY_SHORT = "<partyShortEn: (%s)><!partyShortEn:<partyShortFr: (%s)>>"
_OF = "<committeeNameEn: (%s)><!committeeNameEn:<committeeNameFr: (%s)>>"

PARLIAMENT = {
    "bill": Wordings("[Bill {billNumber}, {parliament} Parliament, {session} Session]",
        "[Projet de loi {billNumber}, {parliament} Parlement, {session} Session]", "{billTitle|Bill {billNumber}}",
        "{billTitle|Projet de loi {billNumber}}", "https://www.parl.ca/legisinfo/en/bill/{sessionId}/{billLower}",
        "https://www.parl.ca/legisinfo/fr/projet-de-loi/{sessionId}/{billLower}"),
    "committee": Wordings(f"[Committee: {_COMMITTEE_EN % 'Unknown Committee'}]", f"[Comité: {_COMMITTEE_FR % 'Comité inconnu'}]",
        _COMMITTEE_EN % "Unknown Committee", _COMMITTEE_FR % "Comité inconnu", HOUSE + "/Committees/en/{committeeSlug}", HOUSE
        + "/Committees/fr/{committeeSlug}"),
    "committee_report": Wordings(f"[Report: {_REPORT_EN}{_OF % (('{committeeNameEn}'), ('{committeeNameFr}'))}]",
        f"[Rapport: {_REPORT_FR}<committeeNameFr: ({{committeeNameFr}})><!committeeNameFr:<committeeNameEn: ({{committeeNameEn}})>>]", _REPORT_EN,
        _REPORT_FR, HOUSE + "/Committees/en/<committeeSlug:{committeeSlug}/Work>", HOUSE + "/Committees/fr/<committeeSlug:{committeeSlug}/Work>"),
    "committee_meeting": Wordings(f"[Meeting: {_COMMITTEE_EN % 'Committee'}, {_DATE_EN}]", f"[Réunion: {_COMMITTEE_FR % 'Comité'}, {_DATE_FR}]",
        f"{_COMMITTEE_EN % 'Committee'} - {_DATE_EN}", f"{_COMMITTEE_FR % 'Comité'} - {_DATE_FR}", HOUSE
        + "<meetingEn:{meetingEn}><!meetingEn:/Committees/en/<committeeSlug:{committeeSlug}/Meetings>>", HOUSE
        + "<meetingFr:{meetingFr}><!meetingFr:/Committees/fr/<committeeSlug:{committeeSlug}/Meetings>>"),
    "election": Wordings(f"[Election: {_DATE_EN}]", f"[Élection: {_DATE_FR}]", f"{{nameEn|{{nameFr|Election {_DATE_EN}}}}}",
        f"{{nameFr|{{nameEn|Élection {_DATE_FR}}}}}", *_ELECTIONS),
    "candidacy": Wordings(f"[{{politicianName|Unknown Candidate}}, {_RIDING_EN}<date: ({{date}})>]",
        f"[{{politicianName|Candidat inconnu}}, {_RIDING_FR}<date: ({{date}})>]", f"{{politicianName|Unknown Candidate}} - {_RIDING_EN}",
        f"{{politicianName|Candidat inconnu}} - {_RIDING_FR}", *_ELECTIONS),
    "hansard": Wordings(f"[Hansard, {_DATE_EN}, {{speakerNameEn|{{speakerNameFr|Unknown Speaker}}}}]",
        f"[Hansard, {_DATE_FR}, {{speakerNameFr|{{speakerNameEn|Orateur inconnu}}}}]", "{nameEn|{nameFr|House Debate}}",
        "{nameFr|{nameEn|Débat de la Chambre}}", HOUSE + "/DocumentViewer/en/{sessionId|44-1}/house/<docNumber:sitting-{docNumber}/>hansard", HOUSE
        + "/DocumentViewer/fr/{sessionId|44-1}/chambre/<docNumber:seance-{docNumber}/>debats"),
    "party": Wordings(f"[{_PARTY_EN}{_ANY_SHORT % ('{partyShortEn}', '{partyShortFr}')}]",
        f"[{_PARTY_FR}<partyShortFr: ({{partyShortFr}})><!partyShortFr:<partyShortEn: ({{partyShortEn}})>>]", _PARTY_EN, _PARTY_FR, HOUSE
        + "/Members/en/party-standings", HOUSE + "/Members/fr/party-standings"),
    "politician": Wordings("[{politicianName|Unknown Politician}<anyParty:, " + _SHORT_EN + "><anyRiding:, {ridingNameEn|{ridingNameFr}}>]",
        "[{politicianName|Politicien inconnu}<anyParty:, " + _SHORT_FR + "><anyRiding:, {ridingNameFr|{ridingNameEn}}>]",
        "{politicianName|Unknown Politician}", "{politicianName|Politicien inconnu}", "<memberPath:" + HOUSE + "/Members/en/{memberPath}>",
        "<memberPath:" + HOUSE + "/Members/fr/{memberPath}>"),
    "riding": Wordings(f"[{_RIDING_EN}<province:, {{province}}>]", f"[{_RIDING_FR}<province:, {{province}}>]", _RIDING_EN, _RIDING_FR,
        *[f"https://www.elections.ca/content.aspx?section=res&dir=cir&lang={lang}" for lang in ("e", "f")]),
    "session": Wordings("[Session {sessionId|Unknown}]", "[Session {sessionId|Unknown}]",
        "{sessionName|<session:{parliament} Parliament, {session} Session><!session:{sessionId|Unknown}>}",
        "{sessionName|<session:{parliament} Parlement, {session} Session><!session:{sessionId|Unknown}>}",
        "https://www.parl.ca/legisinfo/en/overview/{sessionId|Unknown}", "https://www.parl.ca/legisinfo/fr/apercu/{sessionId|Unknown}"),
    "vote_question": Wordings(f"[Vote, {_DATE_EN}, {{passed}}]", f"[Vote, {_DATE_FR}, {{passedFr}}]", "{title|Vote #{voteNumber|0}}",
        "{title|Vote nº {voteNumber|0}}", *_VOTES),
    "vote_party": Wordings(f"[{_PARTY_EN} Vote, {_DATE_EN}, {{vote}}]", f"[Vote {_PARTY_FR}, {_DATE_FR}, {{voteFr}}]", f"{_PARTY_EN}: {{vote}}",
        f"{_PARTY_FR}: {{voteFr}}", *_VOTES),
    "vote_member": Wordings(f"[{{politicianName|Unknown Member}}, {_DATE_EN}, {{vote}}]",
        f"[{{politicianName|Député inconnu}}, {_DATE_FR}, {{voteFr}}]", "{politicianName|Unknown Member}: {vote}",
        "{politicianName|Député inconnu}: {voteFr}", *_VOTES),
}


def _either_code(col: Column, yes: str, no: str) -> Column:
    return F.when(col == "Y", yes).when(col == "N", no).otherwise(col)


def legislation_fields(fields: Mapping[str, Column]) -> dict[str, Column]:
    """The fields with those that follow from others."""
    none = F.lit(None).cast("string")
    get = lambda name: fields.get(name, none)
    act, known = F.coalesce(get("targetType") == "act", F.lit(False)), filled(get("targetRef"))
    return dict(fields) | {
        "anchor": F.regexp_replace(get("sectionLabel"), "[^a-zA-Z0-9.]", ""),
        "targetKind": F.when(act, "Act").otherwise("Regulation"),
        "targetKindFr": F.when(act, "Loi").otherwise("Règlement"),
        "targetAct": F.when(act, known),
        "targetRegulation": F.when(get("targetType") == "regulation", known),
        "editorial": F.when(get("footnoteStatus") == "editorial", "1"),
        "publication": F.when(get("publicationType") == "recommendation", "Recommendation").otherwise("Notice"),
        "publicationFr": F.when(get("publicationType") == "recommendation", "Recommandation").otherwise("Avis"),
    }


def parliament_fields(fields: Mapping[str, Column]) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    get = lambda name: fields.get(name, none)
    part = lambda i: ordinal(F.try_element_at(F.split(get("sessionId"), "-"), F.lit(i)).try_cast("int"))
    meeting = lambda lang, word, end: F.concat(F.lit(f"/DocumentViewer/{lang}/"), filled(get("sessionId")), F.lit("/"), filled(get("committeeSlug")),
        F.lit(f"/{word}-"), filled(get("meetingNumber")), F.lit(f"/{end}"))
    return dict(fields) | {
        "parliament": part(1),
        "session": part(2),
        "billLower": F.lower(get("billNumber")),
        "sessionPath": F.replace(get("sessionId"), F.lit("-"), F.lit("/")),
        "meetingEn": meeting("en", "meeting", "evidence"),
        "meetingFr": meeting("fr", "reunion", "temoignages"),
        "memberPath": F.concat(filled(get("politicianSlug")), F.lit("("), filled(get("memberId")), F.lit(")")),
        "anyParty": F.coalesce(filled(get("partyShortEn")), filled(get("partyShortFr"))),
        "anyRiding": F.coalesce(filled(get("ridingNameEn")), filled(get("ridingNameFr"))),
        "passed": _either_code(get("result"), "Passed", "Failed"),
        "passedFr": _either_code(get("result"), "Adopté", "Rejeté"),
        "vote": _either_code(get("result"), "Yea", "Nay"),
        "voteFr": _either_code(get("result"), "Oui", "Non"),
    }


def citation(kind: Column, fields: Mapping[str, Column], kinds: Mapping[str, Wordings], other: Wordings | None = None) -> Column:
    """A struct of ``text_en``, ``text_fr``, ``title_en``, ``title_fr``, ``url_en`` and ``url_fr`` by source type; null for an
    unknown type without ``other``."""
    parts = []
    for i, name in enumerate(Wordings._fields):
        out = F.lit(None).cast("string") if other is None else worded(other[i], fields)
        for code, wordings in kinds.items():
            out = F.when(kind == code, worded(wordings[i], fields)).otherwise(out)
        parts.append(out.alias(name))
    return F.struct(*parts)
