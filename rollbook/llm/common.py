"""Small helpers that the operators of this subpackage share.

Everything here is about where intermediate tables live and how rows travel to
Python: scratch tables go to the shared folder that the session names in
``spark.checkpoint.dir`` and Arrow batches are kept small, because a document
may be very long.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, or one row.
BATCH_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the session's shared checkpoint folder. Where none is set, a temporary one if all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rollbook-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """What is written here isn't computed again, so its shuffle files may go when it is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.rollbook_path = path
    return made


def save_bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """The same, dealt by ``key`` into as many buckets as there are shuffle partitions: joins on it move the other side only."""
    spark = df.sparkSession
    n, path = partitions(spark), new_path(spark, name)
    table = "rollbook_" + uuid.uuid4().hex
    with _shuffles_go(spark):
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).format("parquet").saveAsTable(table)
    return spark.table(table)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*saved: DataFrame) -> None:
    """Delete tables by :func:`save` that nothing asks for any more."""
    for df in saved:
        _delete(df.sparkSession, df.rollbook_path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table that this application has written."""
    _delete(spark, scratch_dir(spark))


def small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frame of ids, to be broadcast if it has at most so many rows (some ten MB); beyond that Spark shuffles both sides."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Long texts: no Arrow batch of more than so many bytes (and one row). It only ever lowers what the session has, so lazy frames stay right."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, max_docs: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``max_docs`` labelled texts of each class, of ``max_chars`` characters or fewer, and their labels.

    Which ones is decided by a hash of the text, in a join that carries no texts; the texts of the chosen rows (their
    number is bounded) are read after that. Of repeated rows one counts.
    """
    spark = docs.sparkSession
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    whole = whole.where(F.length("t") <= max_chars).withColumn("h", F.xxhash64("t"))
    marked = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = whole.select("id", "h").join(marked, "id").distinct()
    picked = [r for c in (0, 1) for r in known.where(F.col("y") == c).orderBy("h", "id").limit(max_docs).collect()]
    chosen = spark.createDataFrame(picked, known.schema)
    texts = whole.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "y").agg(F.first("t").alias("t"))
    rows = sorted(texts.collect(), key=lambda r: (r.y, r.h, r.id))
    return [r.t for r in rows], np.array([r.y for r in rows], dtype=np.int64)


def by_group(batches, key: str, least: int = 50_000):
    """Regroup a stream of record batches sorted by ``key``: yields tables of whole groups, ``least`` rows or more."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, rows = [table], table.num_rows if cut else 0
    if held:
        yield pa.concat_tables(held)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges u-v; nodes that are their own root are left out."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
