"""Which heading governs a record: the last one before it in the same text.

A backward as-of join without a join on ranges: headings and records of a text are put in one sequence by their places and
each takes the last heading before it. Texts are cut into stretches for that, so a text of any length is dealt to many
tasks; a stretch begins with the last heading of those before it, which few rows tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.awards import is_heading, lot_heading, lot_number

#: Characters of a text that are put in sequence together.
STRETCH = 100_000
#: From here on a found authority is written.
SURE = 0.6


def governed(records: DataFrame, headings: DataFrame, *, by: str, at: str, name: str, out: str = "heading", stretch: int = STRETCH) -> DataFrame:
    """All rows of ``records`` with ``out`` and ``out``_at: the name and place of the last of ``headings`` (by, at, name) at or before their place ``at`` in the same ``by``.

    Null where there is none, and for records without a place or a text; headings without a place or a name don't count. Of
    headings at one place the greatest name does.
    """
    place = lambda rows: F.floor(F.col(at) / stretch)
    first = headings.where(F.col(at).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(at).cast("long").alias("__at")).agg(F.max(name).alias("__name"))
    heads = first.select("__by", "__at", F.floor(F.col("__at") / stretch).alias("__part"), F.struct(F.col("__at").alias("at"), F.col("__name").alias("name")).alias("__h"))
    own = records.select(F.col(by).alias("__by"), F.col(at).cast("long").alias("__at"), place(records).alias("__part"), F.struct(*records.columns).alias("__r"))
    both = own.unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy("__by", "__part").orderBy("__at", F.col("__h").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("__own", F.last("__h", ignorenulls=True).over(within)).where("__r IS NOT NULL")
    # what each stretch begins with: the last heading of the nearest stretch before it that has one
    last = heads.groupBy("__by", "__part").agg(F.max_by("__h", "__at").alias("__last"))
    parts = own.select("__by", "__part").unionByName(heads.select("__by", "__part")).distinct().join(last, ["__by", "__part"], "left")
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("__by", "__part", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    joined = rows.join(carried, ["__by", "__part"], "left").withColumn("__h", F.coalesce("__own", "__before"))
    found = F.when(F.col("__at").isNotNull(), F.col("__h"))
    return joined.select("__r.*", found["name"].alias(out), found["at"].alias(f"{out}_at"))


def completed(records: DataFrame, headings: DataFrame, *, by: str, at: str, name: str, confidence: str, authority: str = "authority", sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """(records with authorities filled in, (outcome, n)): those that have none take the heading that governs them.

    A heading that is only a section of the journal is no authority (``rubric``), one of less ``confidence`` than ``sure`` isn't
    written (``doubt``), nor where none stands before the record (``not found``); what was written counts as ``filled``, an
    authority that was there as ``kept``. Sections don't hide an authority above them.
    """
    rubrics = headings.where(is_heading(F.col(name)))
    rows = governed(records, headings.where(~is_heading(F.col(name))).select(by, at, F.struct(F.col(confidence).alias("c"), F.col(name).alias("n")).alias(name)), by=by, at=at, name=name, out="__found")
    rows = governed(rows, rubrics, by=by, at=at, name=name, out="__rubric")
    found = F.col("__found.n").isNotNull()
    outcome = F.when(F.col(authority).isNotNull(), "kept").when(found & (F.col("__found.c") >= sure), "filled").when(found, "doubt").when(F.col("__rubric").isNotNull(), "rubric").otherwise("not found")
    rows = rows.withColumn("outcome", outcome).withColumn(authority, F.when(F.col("outcome") == "filled", F.col("__found.n")).otherwise(F.col(authority)))
    rows = rows.drop("__found", "__found_at", "__rubric", "__rubric_at")
    return rows, rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def lots_named(records: DataFrame, texts: DataFrame, *, by: str, at: str, text: str, obj: str) -> DataFrame:
    """All rows of ``records`` with ``heading``: what the text says of the lot that their object names, nearest before their place, or the longest one where they have no place."""
    rows = records.join(texts.select(F.col(by).alias("__by"), F.col(text).alias("__text")), F.col(by) == F.col("__by"), "left")
    return rows.withColumn("heading", lot_heading("__text", lot_number(obj), at)).drop("__by", "__text")


def lines_of(text: Column, mark: str) -> Column:
    """(at, line) of the stretches of a text between marks, places counted from 0."""
    parts = F.split(text, rf"\Q{mark}\E", -1)
    begin = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<at:bigint,line:string>>").alias("lines"))
    step = lambda done, x: F.struct((done["next"] + F.length(x) + len(mark)).cast("long").alias("next"), F.array_append(done["lines"], F.struct(done["next"].alias("at"), x.alias("line"))).alias("lines"))
    return F.aggregate(parts, begin, step)["lines"]
