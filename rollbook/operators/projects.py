"""Pieces put together to projects: accepted pairs, with the projects that there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linkage import components
from .records import numbered

#: How a reviewer says yes.
ACCEPTED = ["oui", "o", "x", "1", "true"]


def assigned(pieces: DataFrame, pairs: DataFrame, kinds: list[str], announced: str) -> tuple[DataFrame, DataFrame]:
    """(pieces with their projects, projects) after the accepted ones of ``pairs`` (apply, kind_a, id_a, kind_b, id_b).

    ``pieces`` has (kind, id, project_id, label, sector, region), ``kinds`` all kinds in their order. What accepted pairs link,
    over any number of them, is one project if at least two of its pieces exist. Projects that pieces have already stay: the
    smallest of their numbers is that of the whole component, and ``conflict`` tells that there were several. Others get new
    numbers, above all given ones, in the order of their smallest pieces. A second run changes nothing.

    Projects are (project_id, title, sector, region, new, conflict, n): the title is that of the announcement (the first of
    kind ``announced``), else the longest label (of equal ones the first piece's); sector and region are those of the first piece that has any.
    """
    code = lambda kind: F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    node = lambda kind, i: (F.col(i).cast("long") * (len(kinds) + 1) + code(kind)).cast("long")
    yes = pairs.where(F.lower(F.trim("apply")).isin(*ACCEPTED) & (code("kind_a") > 0) & (code("kind_b") > 0))
    edges = yes.select(node("kind_a", "id_a").alias("a"), node("kind_b", "id_b").alias("b"))
    rows = pieces.withColumn("__node", node("kind", "id"))
    known = rows.join(components(edges), F.col("__node") == F.col("node")).drop("node")
    groups = known.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("project_id").alias("old"), (F.count_distinct("project_id") > 1).alias("conflict"), F.min("__node").alias("first")).where("n >= 2").checkpoint()
    most = pieces.agg(F.coalesce(F.max("project_id"), F.lit(0)).cast("long").alias("most"))
    fresh = numbered(groups.where("old IS NULL").select("root", "first"), ["first"], "nth").join(F.broadcast(most)).select("root", (F.col("most") + F.col("nth")).alias("given"))
    groups = groups.join(fresh, "root", "left").withColumn("__project", F.coalesce("old", "given")).drop("given").checkpoint()
    of = known.select("__node", "root").join(groups.select("root", "__project"), "root").select("__node", "__project")
    made = rows.join(of, "__node", "left").withColumn("project_id", F.coalesce("__project", "project_id")).drop("__project", "__node")
    inner = known.drop("project_id").join(groups, "root")
    place = F.struct(code("kind"), F.col("id"))
    title = F.coalesce(F.min_by(F.when(F.col("kind") == announced, F.col("label")), F.when((F.col("kind") == announced) & F.col("label").isNotNull(), place)), F.max_by("label", F.struct(F.length("label").alias("n"), -code("kind"), -F.col("id"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    projects = inner.groupBy(F.col("__project").alias("project_id")).agg(F.substring(title, 1, 500).alias("title"), first("sector"), first("region"), F.bool_and(F.col("old").isNull()).alias("new"), F.bool_or("conflict").alias("conflict"), F.count(F.lit(1)).alias("n"))
    return made, projects


def stages(pieces: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(project_id, kind, nth, id) of the pieces of projects, in the chain's order."""
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    chain = Window.partitionBy("project_id").orderBy(F.element_at(order, F.col("kind")), "id")
    return pieces.where(F.col("project_id").isNotNull()).select("project_id", "kind", F.row_number().over(chain).alias("nth"), "id")
