"""Token ids in Parquet files that allow selective reads.

Rows lie in ascending id order, over the files' ``part`` numbers as within them. ``tokens`` is a list
column whose ids are dictionary encoded (or, with ``delta``, delta packed), beside a
few narrow columns; row groups and pages are kept small enough that a reader which
asks for one range of ids, or for the counts alone, touches little else. Page indexes
are written for every column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, partitions, small_batches
from .tokens import crc32, tokenizer

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5_000


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text: str = "text", delta: bool = False) -> None:
    """Encode every text, add ``end_id``, and write (doc_id, part, part_start, n_tokens, tokens) sorted by id.

    ``part`` numbers the range of ids, whatever the files are called and however many a range is written to, and
    ``part_start`` counts the ids of the part's documents before this one. A null text is empty; null ids come first;
    rows with the same id follow each other in the order of their texts. A text of any length is one row; an empty table
    writes files without rows; other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        made = tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        before = 0
        for batch in batches:
            ids = [x + end for x in made.encode([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + offsets[:-1]), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "tokens"])
            before += int(offsets[-1])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    out = rows.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    if delta:
        out = out.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#tokens.list.element", "false")
    out.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): ``start`` counts the ids of all documents before.

    The parts' totals (a row a part, so at most as many as there were write tasks) give each part its start; only the
    narrow columns are read for them.
    """
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    joined = rows.join(F.broadcast(starts), "part")
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def checksums(rows: DataFrame) -> DataFrame:
    """Replace ``tokens`` by the crc32 of the ids as little-endian uint32."""
    names = [c for c in rows.columns if c != "tokens"]

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.flatten().to_numpy().astype("<u4")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            crc = [crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield batch.select(names).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("ids_crc32", T.LongType())]))


def written(docs: DataFrame, tokenizer_path: str, *, end_id: int, **how) -> DataFrame:
    """Write to the shared folder and read back."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer_path, end_id=end_id, **how)
    return read(docs.sparkSession, path)
