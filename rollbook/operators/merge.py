"""Updates, deletions and insertions in a table of files, all at once or not at all.

The table's data lies in folders that are never changed; a manifest, one file a version, names the folder of each partition.
A merge reads the partitions that its changes touch, writes them anew beside the old ones and then puts the next manifest
in place, which is the only step that readers see. What stops before that leaves the old version, and of two merges that
begin from one version only one can put the next manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of a change: its kind and its kinds.
OP, PUT, DELETE = "op", "put", "delete"
#: The partition that a row is in, as the folders name it.
PART = "__part"


class Conflict(RuntimeError):
    """Another merge has put the next version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, table: str) -> int:
    """The newest version's number, 0 where there is no table."""
    fs, at = _fs(spark, f"{table}/manifests")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))], default=0)


def _manifest(spark: SparkSession, table: str, number: int) -> dict:
    if not number:
        return {"schema": None, "by": None, "parts": {}}
    row = spark.read.text(f"{table}/manifests/{number}.json", wholetext=True).collect()[0]  # a line a partition
    return json.loads(row.value)


def _put(spark: SparkSession, table: str, number: int, manifest: dict) -> None:
    """Write the manifest aside and rename it; a name that is taken is another's version."""
    fs, place = _fs(spark, f"{table}/manifests/{number}.json")
    _, aside = _fs(spark, f"{table}/manifests/_{number}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(manifest, indent=0).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, False)
        raise Conflict(f"version {number} of {table} is there already")


def _frame(spark: SparkSession, table: str, manifest: dict, parts: list[str]) -> DataFrame:
    """The rows of some partitions, with PART."""
    folders = sorted({manifest["parts"][p] for p in parts})
    rows = spark.createDataFrame([], f"{manifest['schema']}, {PART} string")
    if not parts:
        return rows
    # a folder holds the partitions that one merge has written, of which later ones may have replaced some
    for folder in folders:
        own = [p for p in parts if manifest["parts"][p] == folder]
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{table}/data/{folder}").where(F.col(PART).isin(own)))
    return rows


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The table as it is, or as it was at a version; filters on its partition column reach the folders."""
    manifest = _manifest(spark, table, version(spark, table) if number is None else number)
    if manifest["schema"] is None:
        raise FileNotFoundError(table)
    return _frame(spark, table, manifest, list(manifest["parts"])).drop(PART)


def _part(by: str):
    return F.coalesce(F.col(by).cast("string"), F.lit("__null"))


def create(rows: DataFrame, table: str, by: str) -> None:
    """The first version, with partitions by the column ``by``, of which there are to be few."""
    _write(rows.sparkSession, rows, table, by, 0, {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "by": by, "parts": {}}, [])


def _write(spark: SparkSession, rows: DataFrame, table: str, by: str, number: int, manifest: dict, touched: list[str], before_swap=None) -> None:
    folder = uuid.uuid4().hex
    rows = rows.withColumn(PART, _part(by))
    rows.repartition(PART, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(PART).parquet(f"{table}/data/{folder}")
    # the names of the partitions written, of which there are few
    made = [r[0] for r in spark.read.schema(rows.schema).parquet(f"{table}/data/{folder}").select(PART).distinct().collect()]
    parts = {p: f for p, f in manifest["parts"].items() if p not in touched} | dict.fromkeys(made, folder)
    if before_swap:
        before_swap()
    _put(spark, table, number + 1, manifest | {"parts": parts})


def merge(changes: DataFrame, table: str, keys: list[str], before_swap=None) -> dict[str, int]:
    """Apply ``changes``: the table's columns and ``op``, which puts a row (in place of that with its keys, or as a new one) or deletes it.

    Returns how many rows were ``updated``, ``inserted`` and ``deleted``. A deletion of what isn't there does nothing. Changes
    whose keys repeat or are null are refused, as are rows of the table that repeat keys which are changed. Partitions that no change touches are
    neither read nor written; a row may move to another one. ``before_swap`` is called when all is written but not yet seen.
    """
    spark = changes.sparkSession
    number = version(spark, table)
    manifest = _manifest(spark, table, number)
    by, columns = manifest["by"], [c for c in changes.columns if c != OP]
    changes = changes.withColumn("__new", F.lit(True)).checkpoint()
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    if changes.where(null).limit(1).count() or changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("keys of changes must be there and must not repeat")
    whole = _frame(spark, table, manifest, list(manifest["parts"]))
    hit = whole.select(*keys, PART).join(changes.select(*keys, OP), keys).checkpoint()
    if hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("rows of the table repeat keys that are changed")
    # partitions of rows that change or go, and those that rows come to: a name each
    left = [r[0] for r in hit.select(PART).distinct().collect()]
    come = [r[0] for r in changes.where(F.col(OP) == PUT).select(_part(by).alias("p")).distinct().collect()]
    touched = sorted({p for p in [*left, *come] if p in manifest["parts"]})
    kept = _frame(spark, table, manifest, touched).drop(PART).join(changes.select(*keys), keys, "left_anti").select(columns)
    rows = kept.unionByName(changes.where(F.col(OP) == PUT).select(columns))
    counts = {r[0]: r.n for r in hit.groupBy(OP).agg(F.count(F.lit(1)).alias("n")).collect()}
    puts = changes.where(F.col(OP) == PUT).count()
    _write(spark, rows, table, by, number, manifest, touched, before_swap)
    return {"updated": counts.get(PUT, 0), "inserted": puts - counts.get(PUT, 0), "deleted": counts.get(DELETE, 0)}


def validated(spark: SparkSession, table: str, keys: list[str], least: float, without_score: bool = False, score: str = "confidence", status: str = "status", pending: str = "pending", valid: str = "valid") -> dict[str, int]:
    """Put all pending rows of at least this score (or, on demand, without one) to valid: (validated, remaining)."""
    rows = read(spark, table)
    good = F.col(score) >= least
    good = F.coalesce(good | F.col(score).isNull() if without_score else good, F.lit(False))
    chosen = rows.where((F.col(status) == pending) & good)
    done = merge(chosen.withColumn(status, F.lit(valid)).withColumn(OP, F.lit(PUT)), table, keys)
    return {"validated": done["updated"], "remaining": read(spark, table).where(F.col(status) == pending).count()}
