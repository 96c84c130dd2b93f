"""Dates, numbers and kinds that papers carry in their titles, file names and first lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

#: Months as they are written in full, and as they are shortened.
MONTHS = {"janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
SHORT = {"janv": 1, "jan": 1, "fev": 2, "fév": 2, "mar": 3, "avr": 4, "juil": 7, "jul": 7, "sept": 9, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "déc": 12}
#: How court papers begin, and what they are.
COURT_PAPERS = [("avis", "avis_constitutionnel"), ("ordonnance", "ordonnance_constitutionnelle"), ("decision", "decision_constitutionnelle"), ("décision", "decision_constitutionnelle"), ("decison", "decision_constitutionnelle")]
PROSE = rf"(?iU)(\d{{1,2}})\s*(?:er|ᵉʳ|re)?\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
ISSUE = r"(?iU)N[°ºo]?\s*\d{3,5}\s*[–\-]\s*(?:\w+\s+)?(\d{1,2})\s+([A-Za-zéûôà]+)\s+(\d{4})"
ISSUE_NUMBER = r"(?iU)n[°ºo]?\s*0*(\d{3,5})"
OF_DAY = r"du[_\s]+(\d{1,2})[_\s]+([a-zéûôàA-ZÉÛÔÀ]+)\.?[_\s]*((?:19|20)\d{2})?"


def _month(word: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(word))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The day if there is such a one, else null."""
    number = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when((year != "") & month.isNotNull() & (day != ""), F.try_to_date(F.concat_ws("-", year, number(month), number(day)), "yyyy-MM-dd"))


def _parts(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    return tuple(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))


def prose_date(c) -> Column:
    """The first date of a text that is written in full ("1er janvier 2024"); null if there is none, or no such day."""
    day, month, year = _parts(F.coalesce(_col(c), F.lit("")), PROSE)
    return _day(year, _month(month, MONTHS), day)


def issue_date(c) -> Column:
    """The date behind an issue's number in the first 500 characters."""
    day, month, year = _parts(F.substring(F.coalesce(_col(c), F.lit("")), 1, 500), ISSUE)
    return _day(year, _month(month, MONTHS), day)


def issue_number(url, text) -> Column:
    """The number in a file's name, else that in the first 500 characters; null where there is none."""
    name = F.element_at(F.split(F.try_url_decode(F.coalesce(_col(url), F.lit(""))), "/"), -1)
    found = [F.nullif(F.regexp_extract(x, ISSUE_NUMBER, 1), F.lit("")) for x in (name, F.substring(F.coalesce(_col(text), F.lit("")), 1, 500))]
    return F.coalesce(*found)


def court_kind(title, file) -> Column:
    """What a court's paper is by the beginning of its title, else of its file's name; a decision by default."""
    out = F
    for source in (title, file):
        head = F.lower(F.regexp_replace(F.coalesce(_col(source), F.lit("")), r"^[\s_«\"'\-]+", ""))
        for begin, kind in COURT_PAPERS:
            out = out.when(head.startswith(begin), F.lit(kind))
    return out.otherwise(F.lit("decision_constitutionnelle"))


def court_reference(title, file, page_year) -> Column:
    """yyyy-nn from title or file name; a number without a year takes the page's year."""
    sources = [F.coalesce(_col(c), F.lit("")) for c in (title, file)]
    made = []
    for s in sources:
        year, number, _ = _parts(s, r"(?U)((?:19|20)\d{2})\s*[-–_]\s*0*(\d{1,3})(?!\d)()")
        made.append(F.when(year != "", F.concat(year, F.lit("-"), F.format_string("%02d", number.try_cast("int")))))
    for s in sources:
        for pattern in (r"(?iU)num[ée]ro\s*0*(\d{1,3})(?!\d)", r"(?iU)n[°ºo]?\s*_*\s*0*(\d{1,3})(?![\d\-–])"):
            number = F.regexp_extract(s, pattern, 1)
            made.append(F.when((number != "") & (F.coalesce(_col(page_year), F.lit(0)) != 0), F.concat(_col(page_year).cast("string"), F.lit("-"), F.format_string("%02d", number.try_cast("int")))))
    return F.coalesce(*made)


def court_date(title, file, page_year) -> Column:
    """The day in file name or title ("du 10 juin 2026"); a missing year is the page's."""
    out = []
    for c in (file, title):
        day, month, year = _parts(F.translate(F.coalesce(_col(c), F.lit("")), "-", "_"), OF_DAY)
        year = F.when(year != "", year).when(F.coalesce(_col(page_year), F.lit(0)) != 0, _col(page_year).cast("string")).otherwise("")
        out.append(_day(year, _month(month, MONTHS | SHORT), day))
    return F.coalesce(*out)


def iso_day(c) -> Column:
    """The date that the first ten characters are; else null."""
    return F.try_to_date(F.substring(_col(c), 1, 10), "yyyy-MM-dd")


def rfc822(c) -> Column:
    """A date at noon UTC as feeds write it."""
    return F.concat(F.date_format(_col(c), "EEE, dd MMM yyyy"), F.lit(" 12:00:00 +0000"))


def effective_date(stated, published) -> Column:
    return F.coalesce(_col(stated), _col(published))


def last_segment(url) -> Column:
    """The last part of a URL's path, decoded."""
    return F.try_url_decode(F.element_at(F.split(F.regexp_replace(_col(url), r"[?#].*$", ""), "/"), -1))
