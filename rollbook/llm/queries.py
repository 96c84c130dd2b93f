"""The corpus queries: the operators with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extraction, packing, quality, ranking, resampling, separators, simhash, suffix, token_files, toxicity, vectors, warc
from .common import crc_mod, load, new_path

TOKENIZER = "word_bpe_49k.json"
#: The separator of flat token files.
SEPARATOR = 49_407
#: Words of a passage that counts if it repeats: over 50.
PASSAGE = 51


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.written(load(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.checksums(rows)


def _scored(docs: DataFrame, labels: DataFrame, module, n: int, held: int) -> DataFrame:
    apart = crc_mod("doc_id", n) == held
    model = module.fit(docs.where(~apart), labels.where(~apart))
    scored = module.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= module.THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), toxicity, 3, 1)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flat-tokens")
    separators.write(load(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=SEPARATOR)
    return separators.counts(spark, path, end_id=SEPARATOR).select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "start", "n_tokens")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(load(spark, sf_dir, "documents"), by_id=True)
    return found.select(F.col("id").alias("doc_id"), simhash.hex16().alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(load(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return packing.pack(packing.digest(pieces))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(load(spark, sf_dir, "documents"), passage=PASSAGE).withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "responses")
    warc.write(warc.responses(load(spark, sf_dir, "pages")), path)
    records = warc.derive(warc.read(spark, path)).withColumn("page_id", F.col("page_id").cast("long"))
    return records.withColumn("n_bytes", F.octet_length("record").cast("long")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op9_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classes(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), quality, 4, 2)


def op11_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


OPERATORS = (
    op1_token_files, op2_toxicity, op3_decontamination, op4_separator_scan, op5_simhash, op6_packing, op7_suffix_dedup, op8_warc,
    op9_embedding_neighbours, op10_quality, op11_lexical_ranking, op12_resampling, op13_extraction,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """By the definitions: all pairs of a label and components by recursion, every document's score for every item, every word's bucket.

    The others can't be written in SQL.
    """
    return {"op9_embedding_neighbours": OP9, "op11_lexical_ranking": OP11, "op12_resampling": OP12}


OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND a.fine AND b.fine
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT r.node, l.v FROM reach r JOIN link l ON l.u = r.seen)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.u = v.vec_id)::BIGINT AS n_links,
       min(r.seen) AS component_id, v.vec_id = min(r.seen) AS kept
FROM v JOIN reach r ON r.node = v.vec_id GROUP BY v.vec_id
"""

#: A-Z alone in lower case, which lower() doesn't keep to.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, docs),
score AS (
  SELECT item_id, tf.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN n ON n.doc_id = tf.doc_id, total GROUP BY item_id, tf.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

#: The table of crc32 is made by its rule, 8 steps for each byte value.
OP12 = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS made),
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
run AS (SELECT doc_id, unnest(words) AS run FROM doc),
wanted AS (SELECT unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS run FROM benchmark),
bytes AS (SELECT run, hex(encode(run)) AS h FROM (SELECT run FROM run UNION SELECT run FROM wanted)),
bucket AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, made[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM run JOIN bucket USING (run) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN bucket USING (run) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM run)::DOUBLE AS a, (SELECT count(*) FROM wanted)::DOUBLE AS b),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (a + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (b + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), total),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM run JOIN bucket USING (run) JOIN gain USING (bucket) GROUP BY doc_id),
score AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN weight USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM score LEFT JOIN placed USING (doc_id)
"""
