"""Raw archives: files with a key made from their content, links found in pages, reviewed proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a reviewer writes to accept a proposal.
ACCEPTED = ["oui", "o", "x", "1", "true"]


def archive_key(slug: Column, year: Column, content: Column, ending: Column) -> Column:
    """slug/year/first 16 digits of the SHA-256/ending: the same bytes get the same key."""
    return F.concat(slug, F.lit("/"), year.cast("string"), F.lit("/"), F.substring(F.sha2(content, 256), 1, 16), F.lit("."), ending)


def raw_files(spark: SparkSession, folder: str, slug: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes, is_pdf, key) of the files below a folder; identical files have the same key. Spark reads no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    key = archive_key(F.lit(slug), F.year("modificationTime"), F.col("content"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"), key.alias("key"))


def links(html: Column, base: Column | None = None) -> Column:
    """The distinct href values in their order, in either quotes or none; with a base those that begin with / are put behind its host. Null: none."""
    each = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    found = F.array_distinct(F.transform(each, lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")))
    if base is None:
        return found
    host = F.regexp_extract(base, "^([a-z]+://[^/]+)", 1)
    return F.array_distinct(F.transform(found, lambda x: F.when(x.startswith("/") & ~x.startswith("//"), F.concat(host, x)).otherwise(x)))


def accepted(proposals: DataFrame, column: str = "apply") -> DataFrame:
    """The proposals that a reviewer has ticked."""
    return proposals.where(F.lower(F.trim(column)).isin(ACCEPTED))
