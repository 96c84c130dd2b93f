"""Token counts of the documents in flat token files without an index.

A file is nothing but token ids of a fixed width, each document ended by a separator
id. Files are dealt out in blocks; within a block numpy finds all separators at once.
A document may span blocks: each block reports its last separator, and a running
maximum over the file's blocks (the prefix scan) tells where the document that a
block's first separator ends had begun.

Documents here are written with their id in front, as five tag tokens above the
vocabulary, so that a count can be traced to its document wherever the file went.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import tokenizer

BLOCK_TOKENS = 1 << 19
#: Tag tokens: a 64-bit id as five digits of TAG_BITS bits, each added to TAG_BASE.
TAG_BASE, TAG_BITS, TAG_DIGITS = 49_410, 13, 5


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """One flat file a task: for each document its tag tokens, its ids and ``end_id`` as little-endian uint16.

    Rows with a null id are left out, as nothing could be said of them; a null text is empty; repeated rows are
    written repeatedly. Where a text spells the separator's own name, its token is written as the unused TAG_BASE - 1.
    """
    small_batches(docs.sparkSession)
    separator = np.array([end_id], "<u2").tobytes()

    def run(batches):
        made = tokenizer(tokenizer_path)
        for batch in batches:
            ids = made.encode([t or "" for t in batch.column(1).to_pylist()])
            doc = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            digits = np.stack([(doc >> np.uint64(TAG_BITS * k)) & np.uint64((1 << TAG_BITS) - 1) for k in range(TAG_DIGITS)], axis=1) + np.uint64(TAG_BASE)
            tags = digits.astype("<u2")
            whole = [np.frombuffer(x, "<u4") for x in ids]
            if max((int(x.max(initial=0)) for x in whole), default=0) >= TAG_BASE - 1:
                raise ValueError(f"ids of {TAG_BASE - 1} and more don't fit files of two bytes a token with tags")
            own = [x.astype("<u2") for x in whole]
            flat = [t.tobytes() + np.where(x == end_id, np.uint16(TAG_BASE - 1), x).tobytes() for t, x in zip(tags, own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.binary())], names=["flat"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text).cast("string"))
    # the text sink writes a string's bytes as they are, and the line separator after each: a flat binary file
    rows.mapInArrow(run, "flat binary").select(F.col("flat").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)


def blocks(spark: SparkSession, path: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data): the files cut into blocks, in the JVM. A file is at most 2 GB, as Spark reads it as one value, and fails beyond; larger corpora are many files."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "content", "length")
    numbered = files.withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / size).cast("int"))))
    return numbered.select("file", "block", F.expr(f"substring(content, block * {size} + 1, {size})").alias("data"))


def scan(spark: SparkSession, path: str, *, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, head: int = 0) -> DataFrame:
    """(file, start, n_tokens, ended, head): a row for each document, ``start`` being its first token's place in the file.

    ``n_tokens`` counts the separator. Tokens after a file's last separator are a document that hasn't ``ended``. An
    empty file has no documents; two separators in a row make a document of one token. With ``head``, the document's
    first that many tokens come along, put together over blocks. Very long documents span as many blocks as they need;
    equal documents count each by itself.
    """
    kind = f"<u{width}"
    small_batches(spark)

    def find(batches):
        for batch in batches:
            for file, block, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = np.frombuffer(data, kind, len(data) // width)
                at = np.flatnonzero(tokens == end_id)
                base = block * block_tokens
                # the tokens after each separator begin the next document, those at the block's start go on with one
                begins = np.concatenate([[0], at + 1])
                begins = begins[begins < len(tokens)]
                heads = [tokens[b : b + head].astype(np.int32).tolist() for b in begins] if head else [[]] * len(begins)
                ends = np.full(len(begins), -1, np.int64)
                ends[: len(at)] = at + base
                n = len(begins)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.full(n, block, np.int32)), pa.array(begins + base), pa.array(ends), pa.array(np.full(n, base + len(tokens), np.int64)), pa.array(np.arange(n) == 0), pa.array(heads, pa.list_(pa.int32()))], names=["file", "block", "begin", "end", "block_end", "opens", "head"])

    found = blocks(spark, path, width=width, block_tokens=block_tokens).mapInArrow(find, "file string, block int, begin long, end long, block_end long, opens boolean, head array<int>")
    inner = found.where("NOT opens AND end >= 0")
    edges = found.where("opens OR end < 0")
    # of each block: its opening stretch, and the one that its last separator leaves open (the same, without separators)
    file = Window.partitionBy("file").orderBy("begin")
    stretch = edges.withColumn("new", F.coalesce((F.lag("end").over(file) >= 0) | (F.col("begin") != F.lag("block_end").over(file)), F.lit(True)))
    stretch = stretch.withColumn("nth", F.sum(F.col("new").cast("int")).over(file))
    stitched = stretch.groupBy("file", "nth").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("block_end").alias("stop"), F.flatten(F.array_sort(F.collect_list(F.struct("begin", "head"))).getField("head")).alias("head"))
    stitched = stitched.select("file", F.col("begin").alias("start"), (F.when(F.col("end") >= 0, F.col("end") + 1).otherwise(F.col("stop")) - F.col("begin")).alias("n_tokens"), (F.col("end") >= 0).alias("ended"), F.slice("head", 1, max(head, 1)).alias("head"))
    whole = inner.select("file", F.col("begin").alias("start"), (F.col("end") + 1 - F.col("begin")).alias("n_tokens"), F.lit(True).alias("ended"), "head")
    return whole.unionByName(stitched)


def counts(spark: SparkSession, path: str, *, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, file, start, n_tokens) of files by :func:`write`; ``n_tokens`` counts the text's tokens and the separator."""
    rows = scan(spark, path, end_id=end_id, block_tokens=block_tokens, head=TAG_DIGITS).where("ended")
    digit = lambda k: F.shiftleft((F.element_at("head", k + 1) - TAG_BASE).cast("long"), TAG_BITS * k)
    doc = digit(0)
    for k in range(1, TAG_DIGITS):
        doc = doc.bitwiseOR(digit(k))
    return rows.select(doc.alias("doc_id"), "file", "start", (F.col("n_tokens") - TAG_DIGITS).alias("n_tokens"))
