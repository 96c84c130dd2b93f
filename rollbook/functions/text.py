"""Normalising keys, as column expressions.

Each key has its own rules; they are not interchangeable.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters with marks or in compatibility forms, what is left of each, and those of which several letters are left.

    By rule: the compatibility decomposition without combining marks. The marks themselves come last, with no counterpart.
    """
    one, many = {}, {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if left != c and left.strip():
            (one if len(left) == 1 else many)[c] = left
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(one) + marks, "".join(one.values()), many


def _composing() -> dict[str, str]:
    """Letters followed by a combining mark, and the one character that is the same."""
    pairs = {}
    for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        for mark in "\u0300\u0301\u0302\u0303\u0308\u0327":
            made = unicodedata.normalize("NFC", letter + mark)
            if len(made) == 1:
                pairs[letter + mark] = made
    return pairs


FROM, TO, SEVERAL = _folding()
COMPOSED = _composing()
#: Legal forms that don't tell companies apart.
LEGAL_FORMS = ["sarl", "sarlu", "suarl", "sa", "sau", "sas", "sasu", "eurl", "eirl", "ei", "gie", "snc", "sci", "scp", "scop", "sprl", "ltd", "llc", "inc", "ste", "societe", "ets", "etp", "etablissement", "etablissements", "entreprise", "entreprises", "compagnie", "cie"]
#: Generic words and leading prepositions that a place's key leaves out.
PLACE_WORDS = ["commune", "ville", "village", "province", "region", "departement", "secteur"]
PREPOSITIONS = ["de", "du", "des", "d", "la", "le", "les", "a", "au", "aux"]
#: Words that don't identify a project, and short ones that do.
COMMON_WORDS = """construction constructions construire realisation realisations acquisition acquisitions acquerir travaux equipement
equipements fourniture fournitures livraison installation installations amenagement amenagements rehabilitation renovation extension
amelioration mise oeuvre service services prestation prestations entretien maintenance achat vente location financement attribution
attributions marche marches projet projets programme programmes lot lots unique profit compte cadre faveur titre relatif relative portant
concernant divers diverses ministere ministeres etat burkina faso burkinabe gouvernement national nationale nationaux nationales public
publics publique publiques direction generale general societe agence office conseil ministres administration budget fonds pour dans avec
les des une aux par sur sous entre chez leur leurs cette cet ces son sen est sont ont ete etre plus tout tous toute toutes autre autres
ainsi que qui dont afin""".split()
SHORT_WORDS = ["cm", "km", "mw", "kv", "r5", "r1", "chu", "chr", "csps"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(c) -> Column:
    """Without accents and compatibility forms."""
    base = _col(c)
    whole = base
    for x, y in SEVERAL.items():
        whole = F.replace(whole, F.lit(x), F.lit(y))
    folded = F.translate(F.when(base.rlike("[" + "".join(SEVERAL) + "]"), whole).otherwise(base), FROM, TO)
    # what is all ASCII has nothing to fold
    return F.when(F.octet_length(base) == F.length(base), base).otherwise(folded)


def squeeze(c: Column) -> Column:
    """White space (non-breaking too) collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def person_key(c) -> Column:
    """Folded, lower case, straight apostrophes, hyphens as spaces."""
    return F.lower(squeeze(F.translate(fold(c), "’‘-", "'' ")))


def version_key(c) -> Column:
    """What two versions of a text are compared by: accents count (however they are written), apostrophes and spacing don't. Null: empty."""
    base = F.coalesce(_col(c), F.lit(""))
    whole = base
    for x, y in COMPOSED.items():
        whole = F.replace(whole, F.lit(x), F.lit(y))
    return F.lower(squeeze(F.translate(F.when(base.rlike("[\u0300-\u0327]"), whole).otherwise(base), "’‘‛´`", "'''''")))


def place_key(c) -> Column:
    """Folded words without generic ones, leading prepositions or signs. Null: empty."""
    base = F.translate(F.lower(fold(F.coalesce(_col(c), F.lit("")))), "'-", "  ")
    base = F.regexp_replace(base, rf"(?U)\b({'|'.join(PLACE_WORDS)})\b", " ")
    base = F.trim(F.regexp_replace(F.regexp_replace(base, "[^a-z0-9 ]", " "), " +", " "))
    return F.trim(F.regexp_replace(base, f"^(?:{'|'.join(x + ' ' for x in PREPOSITIONS)})+", ""))


def company_key(c) -> Column:
    """Folded words, dotted acronyms glued, legal forms left out unless nothing else is there."""
    base = F.replace(F.translate(F.lower(fold(c)), "’‘-–—_/\\", "''      "), F.lit("&"), F.lit(" et "))
    words = F.filter(F.transform(F.split(base, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w']", "")), lambda w: w != "")
    short = F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS))
    return F.array_join(F.when(F.size(short) > 0, short).otherwise(words), " ")


def fingerprint(*columns) -> Column:
    """Columns joined by bars: spacing and case don't count, null is empty (but 0 isn't)."""
    return F.concat_ws("|", *[F.coalesce(F.lower(squeeze(_col(c).cast("string"))), F.lit("")) for c in columns])


def tokens(c) -> Column:
    """The distinct words that may identify a project: folded, without common ones, of 4 letters or more, or known short ones, or with a digit."""
    words = F.split(F.lower(fold(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9+]+")
    tells = lambda w: (w != "") & ~w.isin(*COMMON_WORDS) & ((F.length(w) >= 4) | w.isin(*SHORT_WORDS) | w.rlike("[0-9]"))
    return F.array_distinct(F.filter(words, tells))


def trigrams(c) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all, of two arrays of trigrams."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def initials(c) -> Column:
    """First letters of the first two words."""
    words = F.filter(F.split(_col(c), " +"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(w.substr(1, 1))), "")


def escape_xml(c) -> Column:
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_text(c) -> Column:
    """The text of a page: no scripts, styles or comments, a line for each piece of text, blanks collapsed, at most one empty line in a row."""
    base = F.regexp_replace(_col(c), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    base = F.regexp_replace(base, r"<[^>]*>", "\n")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        base = F.replace(base, F.lit(name), F.lit(sign))
    base = F.regexp_replace(base, r"[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(base, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def escape_html(c) -> Column:
    return F.replace(F.replace(escape_xml(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def plausible_amount(c, low: int = 100_000, high: int = 500_000_000_000) -> Column:
    """The first number of five signs or more (blanks and dots within are dropped) if it has 5 to 12 digits and may be meant."""
    digits = F.regexp_replace(F.regexp_extract(_col(c), r"\d[\d\u00a0 .]{4,}", 0), r"\D", "")
    value = F.when(F.length(digits).between(5, 12), digits.try_cast("long"))
    return F.when(value.between(low, high), value)
