"""Both ends of linear works, from their titles.

A title may be cut into two places in several ways, as hyphens stand within names as well as between them. The cuts come in an
order, all their names are looked up at once, each different one once, and a work takes the first cut of which both ends
are known and differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import place_key
from .linkage import geocode

#: Words of works that have two ends and what may follow them, and words between which both ends stand.
SEGMENT = r"(?iU)(?:route|tron[çc]on|autoroute|piste|liaison|axe|voie|bretelle)\s+(?:rurale?\s+|nationale?\s+|reliant\s+|de\s+|du\s+|des\s+)*([^,;:.]+)"
BETWEEN = r"(?iU)(?:reliant|entre)\s+([^,;:.]+?)\s+(?:et|à|a)\s+([^,;:.]+)"
#: What parts two places beyond doubt; the first that occurs does.
APART = ["–", "—", " à ", " a ", " et "]


def cuts(title: Column) -> Column:
    """The pairs (a, b) of places that a title may name, in order: what stands between the words of ``BETWEEN``, then the segment's cut at a sign that parts, or at each hyphen."""
    pair = lambda a, b: F.struct(F.trim(a).alias("a"), F.trim(b).alias("b"))
    first = F.when(title.rlike(BETWEEN), F.array(pair(F.regexp_extract(title, BETWEEN, 1), F.regexp_extract(title, BETWEEN, 2))))
    segment = F.trim(F.regexp_extract(title, SEGMENT, 1))
    parted = None
    for mark in APART:
        at = F.instr(segment, mark)
        cut = F.array(pair(F.substring(segment, F.lit(1), at - 1), F.substring(segment, at + len(mark), F.length(segment))))
        parted = F.when(at > 0, cut) if parted is None else parted.when(at > 0, cut)
    words = F.filter(F.split(segment, "-"), lambda w: F.trim(w) != "")
    each = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: pair(F.array_join(F.slice(words, F.lit(1), k), "-"), F.array_join(F.slice(words, k + 1, F.size(words)), "-")))
    parted = parted.when(F.size(words) > 1, each)
    none = F.array().cast("array<struct<a:string,b:string>>")
    return F.concat(F.coalesce(first, none), F.coalesce(F.when(segment != "", parted), none))


def linear_ends(works: DataFrame, gazetteer: DataFrame, id_col: str, title: str, threshold: float = 0.55) -> DataFrame:
    """(id, cut, from_id, to_id): for each work the first cut of its title whose ends are both in the gazetteer and aren't the same place.

    ``gazetteer`` has (place_id, name, population); places are looked up as :func:`linkage.geocode` does, by key, exactly or
    else by similarity. Works without such a cut, and null titles, have no row.
    """
    rows = works.select(F.col(id_col).alias("id"), F.posexplode(cuts(F.coalesce(title, F.lit("")))).alias("cut", "p"))
    rows = rows.select("id", "cut", place_key("p.a").alias("a"), place_key("p.b").alias("b"))
    names = rows.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    found = geocode(names, gazetteer.select("place_id", place_key("name").alias("key"), "population")).select("key", "place_id")
    both = rows.join(found.toDF("a", "from_id"), "a").join(found.toDF("b", "to_id"), "b").where("from_id != to_id")
    first = Window.partitionBy("id").orderBy("cut")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").select("id", "cut", "from_id", "to_id")
