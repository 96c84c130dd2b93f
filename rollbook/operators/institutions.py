"""The directory of institutions: all names of one together, with their title of today, who serves there and who has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offices import FUNCTIONS, OTHER_FUNCTION, acronym_holds, function_category, institution_type, official_title, portfolio, region_label, region_today, title_key
from .records import fenced

#: Posts on a board, and how a ministry's name begins.
BOARD, MINISTRY = "%conseil d%administration%", "minist%"


def _named(structures: DataFrame, tenures: DataFrame) -> DataFrame:
    """Tenures with their institution (id, name, acronym) over one hop of pointers."""
    known = structures.select(F.col("id").alias("structure_id"), F.coalesce("canonical_id", "id").alias("id"))
    rows = tenures.select("person_id", "structure_id", "post", "begin", "done").join(known, "structure_id")
    return rows.join(structures.select("id", "name", F.nullif("acronym", F.lit("")).alias("acronym")), "id")


def grouped(structures: DataFrame, tenures: DataFrame) -> DataFrame:
    """(key, id, name, acronym, share, kind, n, last) of every institution with a tenure.

    Successive names of one ministry have one ``key``, that of its portfolio; others have a key of their own. ``share`` is that of
    board seats among the tenures of what is called a ministry and has an acronym, ``n`` counts people in office, ``last`` is the latest beginning.
    """
    rows = _named(structures, tenures)
    board = F.col("post").ilike(BOARD) | F.contains(F.lower("post"), F.lower("acronym"))
    each = rows.groupBy("id", "name", "acronym").agg(F.count_distinct(F.when(F.col("done").isNull(), F.col("person_id"))).alias("n"), F.max("begin").alias("last"), (F.count_if(F.coalesce(board, F.lit(False))) / F.count(F.lit(1))).alias("share"))
    each = each.withColumn("share", F.when(F.col("acronym").isNotNull() & F.col("name").ilike(MINISTRY), F.col("share")))
    each = fenced(each, kind=institution_type("name", "acronym", F.col("share")))
    return fenced(each, key=F.coalesce(F.when(F.col("kind") == "ministere", portfolio("name")), F.concat(F.lit("#"), F.col("id").cast("string"))))


def index(structures: DataFrame, tenures: DataFrame, posts: DataFrame, q: str | None = None) -> DataFrame:
    """(id, name, acronym, kind, agents, titles, official, variants): an institution a row, most people in office first, then by name.

    The latest name stands for those before it, unless one of the government's ``posts`` (post) says what a portfolio is called
    today: that title comes first then, and names that only differ in signs from it are left out. A renamed region has the label
    with both names. People who serve under several names count once. With ``q`` those stay of which a title or the acronym contains it.
    """
    names = grouped(structures, tenures).checkpoint()
    people = _named(structures, tenures).where("done IS NULL").join(names.select("id", "key"), "id").groupBy("key").agg(F.count_distinct("person_id").alias("agents"))
    order = F.struct(F.coalesce(-F.unix_date("last"), F.lit(1 << 30)).alias("a"), (-F.col("n")).alias("b"), F.col("id").alias("c"), "name", "acronym", "kind", "share")
    rows = names.groupBy("key").agg(F.array_sort(F.collect_list(order)).alias("v"))  # the names of one institution
    title = official_title("post")
    today = posts.select(title.alias("official")).where("official IS NOT NULL").withColumn("key", portfolio("official")).groupBy("key").agg(F.max("official").alias("now"))
    rows = rows.join(today, "key", "left").join(people, "key", "left").withColumn("p", F.col("v")[0])
    said = F.transform("v", lambda x: x["name"])
    other = F.filter(said, lambda x: title_key(x) != title_key(F.col("now")))
    titles = F.when((F.col("p.kind") == "territoriale") & region_today(F.col("p.name")).isNotNull(), F.array(region_label(F.col("p.name")))).when(F.col("now").isNotNull(), F.concat(F.array("now"), other)).otherwise(said)
    held = F.when(acronym_holds(F.col("p.name"), F.col("p.acronym"), F.col("p.share")), F.col("p.acronym"))
    made = fenced(rows, titles=titles).select(F.col("p.c").alias("id"), F.col("titles")[0].alias("name"), held.alias("acronym"), "p.kind", F.coalesce("agents", F.lit(0)).alias("agents"), "titles", F.col("now").isNotNull().alias("official"), F.array_sort(F.transform("v", lambda x: x["c"])).alias("variants"))
    if q:
        made = made.where(F.exists("titles", lambda x: F.contains(F.lower(x), F.lit(q.lower()))) | F.coalesce(F.contains(F.lower("acronym"), F.lit(q.lower())), F.lit(False)))
    return made.orderBy(F.desc("agents"), F.lower("name"), "id")


def place_of(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c, _ in FUNCTIONS], F.lit(OTHER_FUNCTION)), category).cast("int") - 1


def staff(structures: DataFrame, tenures: DataFrame) -> DataFrame:
    """(key, category, place, person_id, now, latest): who serves or served at an institution under any of its names, by category of function, each person once a category."""
    rows = _named(structures, tenures).join(grouped(structures, tenures).select("id", "key"), "id").withColumn("category", function_category("post"))
    each = rows.groupBy("key", "category", "person_id").agg(F.bool_or(F.col("done").isNull()).alias("now"), F.max("begin").alias("latest"))
    return each.select("key", "category", place_of(F.col("category")).alias("place"), "person_id", "now", "latest")
