"""Ordered rules, first match wins, made from tables of patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = "(?iU)"
#: Sectors and the words that tell them, from the most specific to the most general.
SECTORS = [
    ("Santé", r"m[ée]dic|m[ée]dico|pharmac|hospital|ambulanc|\bcsps\b|\bchr\b|\bchu|sanitaire|\bsamu\b|dispensaire|infirm|chirurg|laboratoire|r[ée]actif|d[ée]parasit|vaccin"),
    ("Eau & assainissement", r"forage|adduction|eau potable|\beau\b|assainissement|ch[âa]teau d.eau|\bpmh\b|\bpea\b|\bonea\b|latrin|hydraulique|\bpuits\b|caniveau|\baep\b|\baeps\b|for[ée]e?s?\b"),
    ("Énergie", r"solaire|[ée]lectrif|[ée]clairage|[ée]nergie|[ée]lectrique|groupe [ée]lectrog|[ée]thanol|\bsonabhy\b|panneaux|lampadaire|photovolt|\bgaz\b|carburant|hydrocarbure|p[ée]trolier"),
    ("Éducation & formation", r"scolaire|\b[ée]coles?\b|[ée]ducation|universit|pr[ée]scolaire|p[ée]dagog|\bceep\b|kits? scolaires?|manuels?\b|enseign|lyc[ée]e|\bcollege|formation|table-?bancs?|\bedi\b|\bpdi\b"),
    ("Agriculture & élevage", r"agricole|semences?|motoculteur|motopompe|phytosanitaire|[ée]leveur|fourrag|intrant|charrue|batteuse|\bpfnl\b|coop[ée]rative|b[ée]tail|mara[îi]ch|engrais|\bvivres?\b|c[ée]r[ée]al|pisci|semenc"),
    ("Informatique & numérique", r"informatique|logiciel|serveur|licence|oracle|datacenter|r[ée]seau informatique|num[ée]rique|\bwaf\b|ordinateur|imprimante|application|\bit\b|syst[èe]me d.info|progiciel|\berp\b|c[âa]blage|t[ée]l[ée]com"),
    ("Transport & véhicules", r"v[ée]hicule|\bmotos?\b|tricycle|\bengins?\b|camion|automobile|\bpneus?\b|\bbus\b|mobilit[ée]"),
    ("Bâtiment & travaux publics", r"travaux|construction|r[ée]habilit|r[ée]fection|b[âa]timent|\bhall\b|cl[ôo]ture|\bmurs?\b|\broute|bitumage|voirie|magasin|r[ée]fectoire|am[ée]nagement|pavage|dallage|toiture|extension|\bblocs?\b|\bpont\b|g[ée]nie civil|b[ée]ton"),
    ("Fournitures & équipements", r"fourniture|mobilier|\bmat[ée]riel|[ée]quipement|imprim[ée]s|consommable|acquisition|achat|bureau|drap|habillement|tenue|effets"),
    ("Services & prestations", r"prestation|\bservices?\b|entretien|maintenance|restauration|location|gardiennage|nettoyage|communication|\b[ée]tudes?\b|consultant|assurance|audit|pause-?caf[ée]|nettoiement|surveillance|convoyage"),
]
OTHER_SECTOR = "Autres"
#: Sectors of facilities by their type.
FACILITIES = {
    "route": "Transport & mobilité", "pont": "Transport & mobilité", "aeroport": "Transport & mobilité", "usine": "Industrie", "hopital": "Santé", "centre_sante": "Santé", "ecole": "Éducation & formation",
    "universite": "Éducation & formation", "barrage": "Eau & assainissement", "adduction_eau": "Eau & assainissement", "electrification": "Énergie", "energie": "Énergie", "logement": "Habitat & urbanisme",
    "batiment_public": "Bâtiments publics", "marche_infrastructure": "Commerce", "autre": "Autres",
}
#: Acts of opening or delivering, and what may be opened.
ACTS = r"inaugur|pose\s+(?:de\s+)?(?:la\s+)?premi[eè]re\s+pierre|mise\s+en\s+service|mis\s+en\s+service|r[ée]ceptionn|livr[ée]|ouvertur|lancement\s+des?\s+travaux|construction|r[ée]habilit|bitum|[ée]lectrifi|raccord"
WORKS = r"route|pont|[ée]changeur|usine|unit[ée]\s+de\s+production|h[oô]pital|\bcsps\b|\bchr\b|\bchu\b|centre\s+de\s+sant[ée]|[ée]cole|lyc[ée]e|coll[èe]ge|universit|barrage|forage|adduction|ch[aâ]teau\s+d.eau|centrale|[ée]nergie|solaire|logement|cit[ée]|march[ée]|a[ée]roport|infrastructure|b[aâ]timent|si[èe]ge|stade|boulevard|voie|piste"


def first_match(base: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(base.rlike(ANY + pattern), F.lit(name))
    return out.otherwise(F.lit(default))


def sector(*columns: Column) -> Column:
    """The sector that the words of an object, then of an authority, tell."""
    return first_match(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]), SECTORS, OTHER_SECTOR)


def facility_sector(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FACILITIES.items() for x in pair]), kind)


def news_matters(title: Column, text: Column) -> Column:
    """Whether news speaks of an act of opening and of a facility."""
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return both.rlike(ANY + ACTS) & both.rlike(ANY + WORKS)


def project_stage(delivered: Column, works: Column, awarded: Column) -> Column:
    return F.when(delivered, "delivered").when(works, "works").when(awarded, "awarded").otherwise("announced")


def award_confidence(nature: Column, amount: Column, confidence: Column) -> Column:
    """A preselection with a price contradicts itself, and is believed by half at most."""
    return F.when((nature == "preselection") & amount.isNotNull(), F.least(confidence, F.lit(0.5))).otherwise(confidence)


def priority_pick(kind: Column, order: list[str]) -> Column:
    """Rank of a kind in a fixed order; unknown kinds come last."""
    out = F
    for k, name in enumerate(order):
        out = out.when(kind == name, F.lit(k))
    return out.otherwise(F.lit(len(order)))
