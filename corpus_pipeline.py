"""A corpus pipeline: toxic documents go, then near copies, repeated passages and benchmark items; what is left is packed.

Each stage takes the documents that the one before has kept, written as Parquet and read again. All but the last give the
columns of documents, whatever other columns their input has. Null texts count as empty and are kept (the last stage gives
them one token), as are rows with null ids; very long texts are read as a whole; of rows that share an id the near-copy stage
keeps one, and of equal texts under several ids the smallest id; scores that tie are equal; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import decontaminate, packing, simhash, suffix, toxicity
from rollbook.llm.common import crc_mod, load, new_path
from rollbook.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Learns from the labelled documents that aren't held out."""
    apart = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~apart), load(spark, sf_dir, "labels").where(~apart))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their runs of five words the one with the smallest id stays."""
    return simhash.deduplicate_similar(docs.select(COLUMNS))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur again anywhere are cut out of the texts; a document of which nothing is left goes."""
    cut = suffix.deduplicate(docs.select(COLUMNS), length=51, words=True)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs.select(COLUMNS), load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    return packing.pack(packing.digest(packing.cut_documents(docs, tokenizer_path(), end_id=1)))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("suffix", repeats_out),
    ("decontamination", benchmarks_out),
    ("packing", packed),
]

#: The first stage is a classifier, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
