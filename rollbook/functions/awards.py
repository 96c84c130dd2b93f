"""Procurement awards: what was bought, by whom, and whether a line is an award at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let

ANY = "(?iU)"
#: The same where a dot takes in line breaks.
ALL = "(?isU)"
#: What tells that a text describes the award and not its object.
NO_OBJECT = [
    "attributaire", "est attributaire", "pour un montant", "non précisé", "non precise", "francs cfa", "fcfa", "htva", "publication de l'avis", "revue des marchés publics", "quotidien des marchés publics",
    "réalisation d'un marché public", "realisation d'un marche public", "réalisation d’un marché public", "précision non disponible", "lot non précisé", "non précisés",
]
#: What tells that an offer was turned down.
NO_AWARD = ["attribution non retenue", "offre non retenue", "non conforme", "non classé", "infructueux"]
#: What tells that an object was made up.
MADE_UP = ["non précisé", "non precise", "non indiqué", "non indique", "non spécifié"]
#: How the object of a contract begins.
BEGINNINGS = [
    "acquisition", "achat", "fourniture", "livraison", "approvisionnement", "construction", "réalisation", "realisation", "travaux", "aménagement", "amenagement", "réhabilitation", "rehabilitation",
    "rénovation", "renovation", "extension", "installation", "équipement", "equipement", "entretien", "maintenance", "réparation", "reparation", "prestation", "service", "étude", "etude", "contrôle",
    "controle", "suivi", "supervision", "assistance", "formation", "location", "transport", "confection", "impression", "édition", "edition", "gardiennage", "nettoyage", "restauration", "assurance",
    "audit", "élaboration", "elaboration", "mise en", "recrutement", "sécurisation", "securisation",
]
#: A form of contract whose name has "attributaire" in it.
SEVERAL = ANY + r"multi[-\s]?attributaires?"
#: Headings that aren't authorities, folded.
HEADINGS = ["ministeres, institutions et maitrises d'ouvrages deleguees", "ministeres, institutions et maitrises d'ouvrage deleguees", "maitrises d'ouvrages deleguees", "regions", "societes d'etat", "etablissements publics", "etablissements publics de l'etat", "collectivites territoriales", "autorites contractantes"]
#: Where an amount, or a confession that something is missing, follows the object.
AMOUNT_TAIL = ALL + r"\s*[-,;:]?\s*(?:\(\s*montant[^)]*\)?|pour\s+un\s+montant|d[’']un\s+montant|au\s+prix\s+de|soit\s+un\s+montant|montant\s+(?:ttc|htva|total|minimum|maximum)|attribution\s+(?:à|a|pour)|correction\s+op[ée]r[ée]e).*$"
MISSING_TAIL = ANY + r"\s*\(\s*(?:non\s+(?:pr[ée]cis|indiqu|sp[ée]cifi)|lot\s+non\s+pr[ée]cis|pr[ée]cision\s+non\s+disponible)[^)]*\)?\s*$"
#: Administrative headings after an object, headings before it, and what is none at all.
OBJECT_END = ANY + r"\s*(?:[-.;:]\s*)?\b(?:r[ée]f[ée]rences?\b|financement\b|publi(?:cation|[ée]s?)\b|avis\s+(?:publi|de\s+(?:la\s+)?(?:demande|publication)|d[e’'])|n[°o]\s+de\s+la\s+revue\b|date\s+d[e’']|dates?\s+de\b|nombre\s+de\b|convocation\b|lettre\s+de\s+convocation\b|revue\s+des\s+march[ée]s\b|quotidien\s+(?:des\s+march[ée]s|n[°o])|rmp\s*n[°o]|budget\s+pr[ée]visionnel\b|montants?\s+(?:lus|corrig|pr[ée]visionnel|minimum|maximum)|bornes?\s+(?:sup|inf)|seuil\s+de\b|moyenne\s+arithm|note\s+pond[ée]r|d[ée]lai\s+d|offre\s+anormalement\b|envelop)"
OBJECT_FIELD = ANY + r"\bobjet\s*:\s*"
PREAMBLE = ANY + r"^(?:r[ée]gion\s+d[eu]\s+[A-ZÀ-Ÿ' -]+?\s+)?(?:demande\s+de\s+prix|demande\s+de\s+cotations?|appel\s+d['’]offres?|ddp|manifestation\s+d['’]int[ée]r[êe]t)\b[^.]*?\bn[°o][^.]*?\b(?:relati[fv]e?s?\s+(?:à|aux?|au)|portant\s+sur|pour)\s+"
PLACE = ANY + r"^(?:r[ée]gion\s+d[eu]\s+[A-ZÀ-Ÿ' -]+?\s+)?(?:commun[eu]{1,2}\s+(?:de\s+|d[’'])[A-ZÀ-Ÿ' -]+?\s+)?"
NOISE = ANY + r"^(?:r[ée]f[ée]rence|marge|dates?|financement|nombre|montant|publication|convocation|lettre|bornes?|revue|quotidien|attributaire|moyenne|offre)\b"
UNKNOWN_OBJECT = "Objet non précisé (voir le Quotidien)"
#: Characters that must stand before such a heading, that a place must take and an object must keep, and that an object has at most.
BEFORE_END, PLACE_LENGTH, FROM_PREAMBLE, OBJECT_LENGTH = 8, 8, 12, 300
#: Characters of a name that is rescued from behind an object, and that a name has at most.
RESCUED, AWARDEE_LENGTH = (3, 50), 400
#: What stands before and after an awardee's name, and how an object begins that slid into its place.
AWARDEE_BEFORE = ANY + r"^\s*(?:s\s+(?=lot|provisoire|r[ée]sultat)|(?:r[ée]sultats?\s+)?provisoires?\s*:?\s*|provi(?:so|oi)re\s*:\s*|lot\s*(?:unique|n[°o]?\s*\d+|\d+)\s*:?\s*|l['’]attributaire\s+(?:provisoire\s+)?est\s+|attributaire\s*(?:provisoire\s*)?:\s*)"
AWARDEE_AFTER = ANY + r"\s+(?:est\s+(?:d[ée]clar[ée]e?\s+)?attributaire.*|attributaire(?:\s+provisoire)?\b.*|pour\s+un\s+montant.*|pour\s+(?:l['’]acquisition|l['’]installation|les\s+travaux|la\s+r[ée]alisation|la\s+fourniture|la\s+construction|le\s+march).*|,?\s*adresse\s*:.*|\d{2}\s*BP\b.*)$"
OBJECT_IN_PLACE = ANY + r"^(?:l['’])?(?:acquisition|demande|travaux|r[ée]alisation|fourniture|prestation|construction|r[ée]habilitation|entretien|achat|livraison|installation|dossier|confection|location)\b"
LOT = r"lot\s*(?:n\s*[°ºo]\s*)?0*(\d{1,2})\b"
#: Where a table begins behind a heading.
TABLE = ANY + r"\s*(?:(?<![(\d])\d{1,2}\s*[.\)]\s+\S|(?:non\s+)?conforme|(?<![(\d])\d[\d\s]{5,}|lot\s*(?:n\s*[°ºo]\s*)?\d|le\s+d[ée]lai\s+d|seuils?\s+anormaux|montant\s+(?:lu|corrig)|les\s+candidats\s+ont\s+la\s+possibilit)"
#: Characters before an award that a lot's heading may stand in.
REACH = 25_000


def _has(base: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(base, F.lit(m))
    return out


def _strip(c: Column, signs: str) -> Column:
    return F.regexp_replace(c, rf"^[{signs}]+|[{signs}]+$", "")


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def _cut_at(c: Column, pattern: str, least: int) -> Column:
    """What stands before the first match, if that begins at ``least`` or later (from 0)."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when(at > least, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def lot_number(c) -> Column:
    """The number of the first lot that an object names; null where it names none."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("")), ANY + LOT, 1).try_cast("int")


def suspect_object(c) -> Column:
    """Whether an object describes something else than what is bought. Null or empty: no."""
    base = F.coalesce(_col(c), F.lit(""))
    return (base != "") & _has(F.lower(F.regexp_replace(base, SEVERAL, "")), NO_OBJECT)


def acceptable_object(c) -> Column:
    """Whether a text can be an object: no marks of an award, 20 characters and 3 words or more, begun as objects begin."""
    base = F.lower(F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SEVERAL, "")))
    begins = F.lit(False)
    for b in BEGINNINGS:
        begins = begins | base.startswith(b)
    return ~_has(base, NO_OBJECT) & (F.length(base) >= 20) & (_words(base) >= 3) & begins


def without_tail(c) -> Column:
    """An object without the amount or the confession behind it, its lot before it; null if what is left isn't an object of 4 words or more."""
    cut = _strip(F.regexp_replace(F.regexp_replace(_col(c), MISSING_TAIL, ""), AMOUNT_TAIL, ""), r" .:\-–—;,")
    body = F.regexp_replace(cut, ANY + r"^lot\s*(?:n\s*[°ºo]\s*)?\d{0,2}\s*[:\-–—]?\s*", "")
    return F.when(acceptable_object(body) & (_words(body) >= 4), cut)


def not_an_award(c) -> Column:
    return _has(F.lower(F.coalesce(_col(c), F.lit(""))), NO_AWARD)


def made_up_object(c) -> Column:
    return _has(F.lower(F.coalesce(_col(c), F.lit(""))), MADE_UP)


def _name(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def only_repeats_company(obj, company) -> Column:
    """Whether fewer than 3 words of an object are left without the awardee's name (of 6 characters or more) and a lot or rank."""
    name = _name(company)
    rest = F.trim(F.regexp_replace(F.replace(_name(obj), name, F.lit(" ")), r"^\s*(?:lot\s*n?\s*\d{0,2}|\d{1,3})\s*", ""))
    return (F.length(name) >= 6) & (_words(rest) < 3)


def clean_object(c) -> Column:
    """A legible object: the field "Objet :" or what follows a preamble, cut at the first administrative heading, without the place before it."""
    raw = _col(c)

    def begun(text: Column) -> Column:
        field = F.regexp_instr(text, F.lit(OBJECT_FIELD))
        named = F.regexp_replace(F.substring(text, field, F.length(text)), ANY + r"^objet\s*:\s*", "")
        return F.when(field > 0, named).otherwise(let(F.regexp_replace(text, PREAMBLE, ""), lambda after: F.when(F.length(after) >= FROM_PREAMBLE, after).otherwise(text)))

    def unplaced(text: Column) -> Column:
        return let(F.regexp_replace(text, PLACE, ""), lambda rest: F.when((F.length(text) - F.length(rest) >= PLACE_LENGTH) & (F.length(rest) >= FROM_PREAMBLE), rest).otherwise(text))

    def said(text: Column) -> Column:
        text = F.when(text == "", F.trim(raw)).otherwise(text)
        return let(text, lambda x: F.when(x.rlike(NOISE), F.lit(UNKNOWN_OBJECT)).otherwise(F.substring(x, 1, OBJECT_LENGTH)))

    cut = let(let(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), begun), lambda text: _cut_at(text, OBJECT_END, BEFORE_END))
    return F.when(raw == "", raw).otherwise(let(_strip(let(cut, unplaced), r" :.,;\-"), said))


def clean_awardee(c) -> Column:
    """The company's name alone; null if an object slid into its place and no name is left."""
    raw = _col(c)
    text = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    for _ in range(4):
        text = F.trim(F.regexp_replace(text, AWARDEE_BEFORE, ""))
    text = F.trim(F.regexp_replace(text, AWARDEE_AFTER, ""))
    signs = r" :.,;\-«»<>"

    def rescued(text: Column) -> Column:
        rest = let(_strip(F.element_at(F.split(text, ":"), -1), signs), lambda x: F.when(F.length(x).between(*RESCUED) & ~x.rlike(OBJECT_IN_PLACE), x))
        return _strip(F.when(~text.rlike(OBJECT_IN_PLACE), text).when(F.contains(text, F.lit(":")), rest), signs)

    last = let(let(text, rescued), lambda x: F.when((F.length(x) >= RESCUED[0]) & ~x.rlike(OBJECT_IN_PLACE), F.substring(x, 1, AWARDEE_LENGTH)))
    return F.when(raw == "", raw).otherwise(last)


def is_heading(c) -> Column:
    """Whether a whole name is a heading of the gazette and no authority."""
    plain = F.translate(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), "éèêëàâîïôöûüç’", "eeeeaaiioouuc'")
    return _strip(plain, r" .:\-–—").isin(*HEADINGS)


def lot_heading(text, lot, position=None) -> Column:
    """What a lot's heading says: the last acceptable one in the characters before ``position``, or without a position the longest one.

    Text behind a heading that belongs to the table below it is cut off.
    """
    whole = F.coalesce(_col(text), F.lit(""))
    if position is not None:
        begin = F.greatest(_col(position) - REACH, F.lit(0))
        whole = F.when(_col(position).isNull(), whole).otherwise(F.substring(whole, begin + 1, F.least(_col(position), F.lit(REACH))))
    pattern = F.concat(F.lit(r"(?isU)lot\s*(?:n\s*[°ºo]\s*)?0*"), _col(lot).cast("string"), F.lit(r"\s*[:\-–—]\s*(.{15,300}?)(?=\n\s*\d+\s*[.\)]|\nlot\s|\n\s*\n|\z)"))
    found = F.transform(F.regexp_extract_all(whole, pattern, F.lit(1)), lambda x: _strip(_cut_at(F.regexp_replace(x, r"(?U)\s+", " "), TABLE, 0), r" .:\-–—;,"))
    found = F.filter(found, acceptable_object)
    longest = F.get(F.sort_array(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), F.lit(0))["x"]
    last = F.try_element_at(found, F.lit(-1))
    return longest if position is None else F.when(_col(position).isNull(), longest).otherwise(last)


def fingerprint_of(reference, awardee, amount, obj) -> Column:
    """What tells an award from others whichever issue publishes it: spacing and case don't count, a null amount isn't 0."""
    low = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"(?U)\s+", " ")))
    return F.concat_ws("|", low(reference), low(awardee), F.coalesce(_col(amount).cast("string"), F.lit("")), low(obj))


#: Folded texts of calls that aren't awards yet.
CALLS, BEFORE_CALLS = "%manifestation%interet%", ["%prequalification%", "%pre-qualification%"]


def _call(reference, obj, mode) -> Column:
    said = F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in (reference, obj, mode)])
    return F.translate(F.lower(said), "éèêëàâîïôöûüç’", "eeeeaaiioouuc'")


def nature_of(reference, obj, mode, amount) -> Column:
    """``preselection`` for a line without an amount that calls for interest or prequalifies, else ``attribution``. Nulls count as empty; 0 is an amount."""
    text = _call(reference, obj, mode)
    call = text.like(CALLS)
    for pattern in BEFORE_CALLS:
        call = call | text.like(pattern)
    return F.when(_col(amount).isNull() & call, "preselection").otherwise("attribution")


def status_of(reference, obj, mode, amount, status, valid: str = "valid", pending: str = "pending") -> Column:
    """An award with an amount that calls for interest goes back to review if it had passed; any other status stays."""
    doubtful = _col(amount).isNotNull() & _call(reference, obj, mode).like(CALLS) & (_col(status) == valid)
    return F.when(doubtful, pending).otherwise(_col(status))
