"""Office holders, institutions and regions: ordered rules over titles, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, fold, person_key, squeeze

#: Patterns are applied in any case and to all letters.
ANY = "(?iU)"
#: Kinds of institutions by the beginning of their name; the last one cares for capitals.
INSTITUTIONS = [
    ("ministere", ANY + r"^\s*minist[èe]re\b"),
    ("institution", ANY + r"^\s*(?:pr[ée]sidence|primature|premier\s+minist|assembl[ée]e|conseil\s+[ée]conomique|conseil\s+sup[ée]rieur|m[ée]diateur|grande\s+chancellerie|secr[ée]tariat\s+g[ée]n[ée]ral\s+du\s+gouvernement)"),
    ("juridiction", ANY + r"^\s*(?:cour\b|tribunal|conseil\s+constitutionnel|conseil\s+d.[ée]tat|conseil\s+sup[ée]rieur\s+de\s+la\s+magistrature|parquet|minist[èe]re\s+public)"),
    ("police", ANY + r"^\s*direction\s+(?:r[ée]gionale|provinciale)\s+de\s+la\s+police"),
    ("diplomatique", ANY + r"^\s*(?:ambassade|consulat|mission\s+diplomatique|repr[ée]sentation\s+permanente|haut\s+commissariat\s+du\s+burkina)"),
    ("territoriale", r"(?U)^\s*(?:R[ée]gion|Province|D[ée]partement|Commune)\s+(?:du|des|de\s+la|de\s+l['’]|de)\s+[A-ZÉÈ]"),
]
#: Regions before the reform and their names after it.
REFORM = {
    "boucle du mouhoun": "Bankui", "cascades": "Tannounyan", "centre": "Kadiogo", "centre est": "Nakambé", "centre nord": "Kuilsé", "centre ouest": "Nando", "centre sud": "Nazinon",
    "est": "Goulmou", "hauts bassins": "Guiriko", "nord": "Yaadga", "plateau central": "Oubri", "sahel": "Liptako", "sud ouest": "Djôrô",
}
#: Names of regions that stand without the word.
REGIONS = [*REFORM, "bankui", "djoro", "goulmou", "guiriko", "kadiogo", "kuilse", "liptako", "nakambe", "nando", "nazinon", "oubri", "sirba", "sourou", "tannounyan", "tapoa", "yaadga"]
REGION_OF = ANY + r"^r[ée]gion\s+(?:du|des|de\s+la|de\s+l|de)\s+"
#: Functions of office holders.
FUNCTIONS = [
    ("Membres du gouvernement", ANY + r"\bministres?\b|secr[ée]taire\s+d.[ée]tat|ministre\s+d.[ée]tat"),
    ("Diplomatie & représentation", ANY + r"ambassad|consul\b|consulaire|charg[ée]\s+d.affaires|mission\s+diplomatique|repr[ée]sentant\s+permanent"),
    ("Conseils d'administration", ANY + r"administrateur|conseil\s+d.administration|repr[ée]sentant.{0,25}[ée]tat"),
    ("Cabinet & conseil", ANY + r"cabinet|charg[ée]s?\s+de\s+missions?|conseiller|charg[ée]s?\s+d.[ée]tudes?|attach[ée]|secr[ée]taire\s+particulier"),
    ("Direction & encadrement", ANY + r"directeur|directrice|direction|chef\s+de\b|secr[ée]taire\s+g[ée]n[ée]ral|secr[ée]taire\s+technique|coordonnateur|coordinateur|pr[ée]sident|recteur|proviseur|gouverneur|haut-?commissaire|pr[ée]fet"),
    ("Inspection & contrôle", ANY + r"inspect|contr[ôo]le|contr[ôo]leur|v[ée]rificateur|auditeur"),
]
OTHER_FUNCTION = "Autres fonctions"
#: Titles that several people hold at once, in folded text.
COLLEGIAL = r"^(?:administrateur|administratrice|membre|conseiller|conseillere|charge|chargee|inspecteur|inspectrice|maitre|professeur|magistrat|representant|representante|assesseur|juge(?! des)|deleguee?|personne responsable des marches)\b"
#: Titles at the top of an institution, in folded text.
SUMMIT = [
    ("dga", "directeur general adjoint|directrice generale adjointe"), ("dg", "directeur general|directrice generale"), ("sga", "secretaire general adjoint|secretaire generale adjointe"),
    ("sg", "secretaire general|secretaire generale"), ("pca", "president(?:e)? du conseil d'administration"), ("dircab", "directeur de cabinet|directrice de cabinet"), ("gouverneur", "gouverneur"),
    ("haut-commissaire", "haut commissaire"), ("prefet", "prefet|prefete"), ("ambassadeur", "ambassadeur|ambassadrice"), ("recteur", "recteur|rectrice"),
    ("controleur-fin", "controleur financier|controleuse financiere"), ("agent-comptable", "agent comptable"), ("tresorier", "tresorier|tresoriere|payeur|payeuse"),
]
#: Other titles that one person holds, in folded text.
SINGLE = r"^(?:directeur|directrice|chef|president|presidente|vice president|vice presidente|coordonnateur|coordinateur|coordonnatrice|greffier en chef|premier president|proviseur|controleur|controleuse|commissaire|fonde de pouvoir)\b"
#: Words that don't tell ministries apart, leads that take a second word, and portfolios known by another lead.
ARTICLES = r"^(?:des?|du|d|l|le|la|les|et|en|aux?|chargee?s?)$"
LEADS = ["affaires", "action", "developpement", "enseignement", "fonction", "transition", "conseil", "secretariat"]
PORTFOLIOS = {"defense": "guerre", "construction": "infrastructures", "urbanisme": "infrastructures", "developpement industriel": "industrie", "serviteurs": "fonction publique", "action humanitaire": "solidarite", "famille": "solidarite"}
#: Posts that name no ministry.
NO_MINISTRY = ANY + r"d[ée]l[ée]gu[ée]|pr[ée]sident\s+du\s+faso|premier\s+minist|secr[ée]taire\s+g[ée]n[ée]ral\s+du\s+gouvernement|direct(?:eur|rice)\s+de\s+cabinet"
#: A ministry's name counts as copied if so large a share of the posts are seats on the acronym's board.
BOARD_SHARE = 0.9


def _first(rules: list[tuple[str, str]], base: Column, default: Column) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(base.rlike(pattern), F.lit(name))
    return out.otherwise(default)


def _map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _blank(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def region_key(c) -> Column:
    """Folded, lower case, apostrophes and hyphens as spaces. Null: empty."""
    return F.lower(squeeze(F.translate(fold(_blank(c)), "’'-", "   ")))


def seat_text(c) -> Column:
    """Folded, lower case, straight apostrophes, hyphens as spaces. Null: empty."""
    return person_key(_blank(c))


def region_today(c) -> Column:
    """The name after the reform of a region that is called by its old name, with or without "Région du"; else null."""
    return _map(REFORM, region_key(F.regexp_replace(_blank(c), REGION_OF, "")))


def region_label(c) -> Column:
    """The new name with the old one behind it; other names stay. Null: empty."""
    now = region_today(c)
    old = F.trim(F.regexp_replace(_blank(c), REGION_OF, ""))
    return F.when(now.isNotNull(), F.concat(F.lit("Région "), now, F.lit(" (ex-"), old, F.lit(")"))).otherwise(_blank(c))


def institution_type(name, acronym=None, board_share=None) -> Column:
    """The kind of an institution by its name; a ministry whose posts are nearly all seats on the acronym's board is the acronym's institution."""
    base = _blank(name)
    kind = _first(INSTITUTIONS, base, F.when(region_key(base).isin(*REGIONS), "territoriale").otherwise("etablissement"))
    if acronym is None or board_share is None:
        return kind
    copied = (_blank(acronym) != "") & F.coalesce(_col(board_share) >= BOARD_SHARE, F.lit(False)) & base.rlike(INSTITUTIONS[0][1])
    return F.when(copied, "etablissement").otherwise(kind)


def acronym_holds(name, acronym, board_share=None) -> Column:
    """Whether an acronym names the institution: there is one, and it doesn't stand beside a ministry's name."""
    return (_blank(acronym) != "") & (institution_type(name, acronym, board_share) != "ministere")


def function_category(c) -> Column:
    return _first(FUNCTIONS, _blank(c), F.lit(OTHER_FUNCTION))


def seat_key(post, single: Column) -> Column:
    """What a seat is known by: null for posts that several hold or that are unknown, a short key for the top of a single institution, else the folded title."""
    base = seat_text(post)
    top = [(name, rf"^(?:{pattern})\b") for name, pattern in SUMMIT]
    known = base.rlike(SINGLE)
    for _, pattern in top:
        known = known | base.rlike(pattern)
    short = F.when(single, _first(top, base, F.lit(None)))
    return F.when((base == "") | base.rlike(COLLEGIAL), None).otherwise(F.coalesce(short, F.when(known, base)))


def portfolio(name, kind: Column | None = None) -> Column:
    """The lead words that successive names of a ministry share; null for other institutions."""
    base = F.lower(fold(F.regexp_replace(_blank(name), ANY + r"^\s*minist[èe]re\s*", "")))
    words = F.filter(F.split(base, "[^a-z]+"), lambda w: (w != "") & ~w.rlike(ARTICLES))
    lead = F.get(words, F.lit(0))
    key = F.when(lead.isin(*LEADS) & (F.size(words) > 1), F.concat_ws(" ", lead, F.get(words, F.lit(1)))).otherwise(lead)
    return F.when((kind if kind is not None else institution_type(name)) == "ministere", F.coalesce(_map(PORTFOLIOS, key), key))


def official_title(post) -> Column:
    """The ministry that a member of the government heads, from the last "ministre de ..." of the post; null where it names none."""
    base = _blank(post)
    rest = F.regexp_extract(base, ANY + r"^.*\bministre\s+(?=d)(.*)$", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, ANY + r",\s*porte-parole.*$", ""), r"^[ ,]+|[ ,]+$", "")
    return F.when(~base.rlike(NO_MINISTRY) & (rest != ""), F.concat(F.lit("Ministère "), rest))


def title_key(c) -> Column:
    """Two titles are the same if these are: case, apostrophes, spacing and dots at the ends don't count."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(_blank(c)), "’", "'"), r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
