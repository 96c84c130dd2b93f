"""Seed files: the gazetteer and the curated facilities, read with what can't be read beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import facility_sector
from ..functions.text import place_key
from ..operators.linkage import geocode
from .feeds import not_seeded

#: The columns of both files, what curated facilities are marked with, and the column of lines that can't be read.
GAZETTEER = "nom string, type string, region string, province string, latitude double, longitude double, population long"
CURATED = "type string, titre string, description string, statut string, date date, lieu string, montant_fcfa long, source_url string"
MARK = "Référence historique (jeu curé)"
CORRUPT = "_corrupt_record"


def seed_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All lines of CSV files with a header; those that don't fit the schema have what fits, and the whole line in CORRUPT."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"').csv(path)


def gazetteer(lines: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places to add, lines that can't be read) of a seed file: places (name, key, type, region, province, latitude, longitude, population)
    whose key, type and region aren't ``there`` yet, once each; names without a key give none."""
    lines = lines.cache()  # the column of corrupt lines can't be asked for alone
    fine = lines.where(F.col(CORRUPT).isNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = fine.select(F.trim("nom").alias("name"), place_key("nom").alias("key"), "type", F.nullif(F.trim("region"), F.lit("")).alias("region"), F.nullif(F.trim("province"), F.lit("")).alias("province"), "latitude", "longitude", "population").where("key <> ''")
    return not_seeded(rows, there.select("key", "type", "region"), ["key", "type", "region"]), lines.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def curated(lines: DataFrame, there: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facilities to add, titles that were left out): those whose title isn't ``there`` (title) and whose place is known, valid at once and marked as curated.

    ``places`` has (place_id, name, key, region, latitude, longitude, population). Of lines with one title one counts.
    """
    fine = lines.cache().where(F.col(CORRUPT).isNull()).withColumn("title", F.trim("titre")).where("title <> ''").dropDuplicates(["title"])
    fresh = fine.join(there.select("title").distinct(), "title", "left_anti").withColumn("key", place_key("lieu"))
    found = geocode(fresh.select("key"), places.select("place_id", "key", "population")).select("key", "place_id")
    rows = fresh.join(found, "key", "left").join(places.select("place_id", F.col("name").alias("place"), "region", "latitude", "longitude"), "place_id", "left")
    blank = lambda c: F.nullif(c, F.lit("")).alias(c)
    made = rows.where(F.col("place_id").isNotNull()).select(F.col("type").alias("kind"), "title", blank("description"), F.col("statut").alias("state"), F.col("date").alias("day"), "place_id", "place", "region", "latitude", "longitude", facility_sector(F.col("type")).alias("sector"), F.col("montant_fcfa").alias("amount"), blank("source_url"), F.lit(MARK).alias("owner"), F.lit("valid").alias("status"))
    made = made.withColumn("sector", F.coalesce("sector", F.lit("Autres")))
    return made, rows.where(F.col("place_id").isNull()).select("title", F.col("lieu").alias("place"))
