"""Result tables of the procurement journal, as awards.

A table is an array of rows, a row an array of cells. What stands above the row that names the bidders' column tells who
buys and what; below it either a closing line names the winner with the amount in brackets, or the first bidder whose
assessment says "compliant, 1st" has won. The line with the column's name is looked for first; then each side of it is asked
only for what it can tell, and only up to the line that tells it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.awards import clean_awardee, clean_object
from ..functions.text import let, plausible_amount
from .records import fenced

#: What the header of a result table has in it.
BIDDERS, AMOUNTS = "soumissionnaire", ["montant", "appréciation"]
#: How a reference begins and how far it goes, and what stands between it and the object.
REFERENCE = r"(?iU)((?:Demande de prix|Appel d['’]offres?|Manifestation|Consultation)[^\n.]{0,90})"
FOR = r"(?iU)\bpour\b"
#: The closing line, its name and the amount in brackets, and an assessment that wins.
WINNER, UP_TO_WINNER = r"(?iU)attributaire", r"(?iU)^.*?attributaire\s*:?\s*"
NAMED, BRACKETS = r"(?iU)^(.+?)\s+pour un montant de\b", r"\(([\d  .]+)\)"
FIRST = r"(?U)conforme.{0,8}1\s*er|1\s*er.{0,8}conforme"
#: Header lines that aren't an authority, and names that aren't one.
NO_AUTHORITY = r"(?iU)^(montant|objet|demande de prix|appel d|référence|financement|n°|lot)"
NO_NAME = ["néant", "attributaire", "conforme"]
#: What stands before and behind a bidder's name.
LOT_BEFORE, ROLE_BEFORE, NUMBER_BEFORE = r"(?iU)^\s*(?:lot\s*(?:unique|n?°?\s*\d+)?\s*:?\s*)", r"(?iU)^\s*(?:provisoire|attributaire)\s*:?\s*", r"(?U)^\d{1,2}\s+"
PHONE, LOOSE_END = r"(?iU)\s*/?\s*T[ÉE]L\s*[:.]|\s*\(", r"(?U)\s*[/-]\s*$"

#: A winner and the sum.
WON = "struct<name:string,amount:bigint>"


def _cell(c: Column) -> Column:
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def _line(cells: Column) -> Column:
    return F.trim(F.array_join(F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))), " "))


def is_results(cells: Column) -> Column:
    """Whether a table's first four rows name bidders and either an amount or an assessment."""
    head = F.lower(F.array_join(F.transform(F.slice(cells, 1, 4), _line), " "))
    said = F.lit(False)
    for word in AMOUNTS:
        said = said | F.contains(head, F.lit(word))
    return F.coalesce(F.contains(head, F.lit(BIDDERS)) & said, F.lit(False))


def is_authority(line: Column) -> Column:
    """Whether a header line is an authority: 6 signs or more, mostly capitals, and no field of the header."""

    def mostly_capitals(letters: Column) -> Column:
        return (F.length(letters) > 0) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")) > 0.6 * F.length(letters))

    return (F.length(line) >= 6) & ~line.rlike(NO_AUTHORITY) & let(F.regexp_replace(line, r"[^\p{L}]+", ""), mostly_capitals)


def bidder(name: Column) -> Column:
    """A bidder's name without lot, role, number, telephone and what is left of them."""
    for pattern in (LOT_BEFORE, ROLE_BEFORE, NUMBER_BEFORE):
        name = F.regexp_replace(name, pattern, "")
    name = F.get(F.split(name, PHONE, 2), F.lit(0))
    return F.substring(F.regexp_replace(F.regexp_replace(name, LOOSE_END, ""), r"^[ :.,\-]+|[ :.,\-]+$", ""), 1, 400)


def _winner(cells: Column) -> Column:
    """(name, amount) of a bidder's line: the first cell or, where that is empty, the second, and the first plausible sum behind the first cell."""
    first, second = _cell(F.get(cells, F.lit(0))), _cell(F.get(cells, F.lit(1)))
    sums = F.array_compact(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: plausible_amount(_cell(c))))
    return F.struct(bidder(F.when(first != "", first).otherwise(second)).alias("name"), F.get(sums, F.lit(0)).alias("amount"))


def _closing(line: Column) -> Column:
    """(name, amount) of a closing line; null where the line isn't one, or has no name or no brackets."""

    def parts(rest: Column) -> Column:
        return F.struct(F.regexp_extract(rest, NAMED, 1).alias("name"), F.regexp_extract(rest, BRACKETS, 1).alias("sum"))

    def read(x: Column) -> Column:
        return F.when((x["name"] != "") & (x["sum"] != ""), F.struct(bidder(x["name"]).alias("name"), plausible_amount(x["sum"]).alias("amount")))

    return F.when(line.rlike(WINNER), let(let(F.regexp_replace(line, UP_TO_WINNER, ""), parts), read))


def _first(lines: Column, read, kind: str) -> Column:
    """``read(line)`` of the first of the lines that gives something; it isn't asked of those after."""
    return F.aggregate(lines, F.lit(None).cast(kind), lambda found, x: F.when(found.isNotNull(), found).otherwise(read(x)).cast(kind))


def awards(tables: DataFrame, *, cells: str = "cells") -> DataFrame:
    """All columns of ``tables`` but the cells, with authority, reference, object, awardee and amount; a row for each result table that names a winner and a sum.

    Tables of fewer than four lines, without a header above the bidders, without a plausible sum (see ``plausible_amount``)
    or with a winner who is the authority give none, nor do null tables. Null cells and rows count as empty.
    """
    lines = F.filter(F.transform(cells, lambda r: F.struct(_line(r).alias("line"), F.coalesce(r, F.array().cast("array<string>")).alias("cells"))), lambda x: x["line"] != "")
    rows = fenced(tables.where(is_results(F.col(cells))), __lines=lines).where(F.size("__lines") >= 4).drop(cells)
    rows = fenced(rows, __at=F.array_position(F.transform("__lines", lambda x: F.contains(F.lower(x["line"]), F.lit(BIDDERS))), F.lit(True)).cast("int"))
    # what stands above the bidders' column, the lines from its name on, and those below it
    above = F.transform(F.slice("__lines", 1, F.greatest(F.col("__at") - 1, F.lit(0))), lambda x: x["line"])
    rest = F.when(F.col("__at") > 0, F.slice("__lines", F.greatest("__at", F.lit(1)), F.size("__lines")))
    rows = fenced(rows, __above=above, __rest=rest).drop("__lines").where(F.col("__at") > 0)
    rows = fenced(rows, __header=F.trim(F.array_join("__above", " "))).where("__header <> ''")
    rows = fenced(rows, __closed=_first(F.col("__rest"), lambda x: _closing(x["line"]), WON))
    # bidders are looked at only where no closing line tells
    closed = (F.coalesce("__closed.name", F.lit("")) != "") & F.col("__closed.amount").isNotNull()
    wins = lambda x: F.when(F.lower(_cell(F.try_element_at(x["cells"], F.lit(-1)))).rlike(FIRST), _winner(x["cells"]))
    ranked = _first(F.slice("__rest", 2, F.size("__rest")), wins, WON)
    rows = fenced(rows, __won=F.when(closed, F.col("__closed")).otherwise(ranked)).drop("__rest", "__closed")
    rows = rows.where((F.coalesce("__won.name", F.lit("")) != "") & F.col("__won.amount").isNotNull())
    header = F.col("__header")
    reference = F.nullif(F.trim(F.regexp_extract(header, REFERENCE, 1)), F.lit(""))
    bought = F.when(F.col("reference").isNull(), header).otherwise(F.coalesce(F.nullif(F.trim(F.get(F.split(header, FOR, 2), F.lit(1))), F.lit("")), F.col("reference")))
    rows = fenced(rows, reference=reference)
    authority = _first(F.col("__above"), lambda line: F.when(is_authority(line), line), "string")
    rows = fenced(rows, __bought=bought, authority=F.substring(authority, 1, 400), amount=F.col("__won.amount"), awardee=clean_awardee(F.col("__won.name")))
    rows = rows.withColumn("object", clean_object("__bought")).drop("__at", "__above", "__header", "__won", "__bought")
    same = F.coalesce(F.lower(F.substring("awardee", 1, 20)) == F.lower(F.substring("authority", 1, 20)), F.lit(False))
    return rows.where((F.length("awardee") >= 3) & F.col("amount").isNotNull() & ~F.lower("awardee").isin(*NO_NAME) & ~same)


def once(rows: DataFrame, issue: str, place: str) -> DataFrame:
    """The awards of :func:`awards`, each once in its issue: of those with one winner (blanks and case don't count) and sum the first by ``place``."""
    key = F.lower(F.regexp_replace("awardee", r"(?U)\s+", ""))
    first = Window.partitionBy(issue, key, "amount").orderBy(place)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
