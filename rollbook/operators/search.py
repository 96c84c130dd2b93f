"""Search of words in texts: what a query asks for, how well a text answers it, and the passage that shows it.

Words are compared folded and in lower case. A query's words must all occur; ``"several words"`` must follow each other,
``a OR b`` needs one of both, ``-word`` must not occur. There is no stemming.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FROM, TO, fold


@dataclass
class Asked:
    """Each entry of ``all_of`` is a list of phrases of which one must occur; ``none_of`` are phrases that mustn't."""

    all_of: list[list[str]] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)


def _plain(text: str) -> str:
    low = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " ".join(re.findall(r"[a-z0-9]+", low))


def asked(query: str) -> Asked:
    out, either = Asked(), False
    for minus, phrase, word in re.findall(r"(-?)(?:\"([^\"]*)\"|(\S+))", query):
        if word == "OR" and out.all_of:
            either = True
            continue
        plain = _plain(phrase or word)
        if not plain:
            continue
        if minus:
            out.none_of.append(plain)
        elif either:
            out.all_of[-1].append(plain)
        else:
            out.all_of.append([plain])
        either = False
    return out


def words(c) -> Column:
    """The text as words with a space on either side of each, so that a phrase is found by its own text."""
    base = F.lower(fold(c))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(base, "[^a-z0-9]+", " ")), F.lit(" "))


def _count(base: Column, phrase: str) -> Column:
    """How often a phrase occurs; words that touch share the space between them, so spaces are doubled before counting."""
    wide = F.replace(base, F.lit(" "), F.lit("  "))
    needle = " " + phrase.replace(" ", "  ") + " "
    return (F.length(wide) - F.length(F.replace(wide, F.lit(needle), F.lit("")))) / len(needle)


def matches(df: DataFrame, text: str, query: str) -> DataFrame:
    """The rows whose text answers the query; an empty query finds nothing, nor does a null text answer any."""
    q = asked(query)
    base = words(text)
    ok = F.lit(bool(q.all_of))
    for phrases in q.all_of:
        one = F.lit(False)
        for p in phrases:
            one = one | F.contains(base, F.lit(f" {p} "))
        ok = ok & one
    for p in q.none_of:
        ok = ok & ~F.contains(base, F.lit(f" {p} "))
    return df.where(ok)


def ranked(df: DataFrame, text: str, query: str, out: str = "rank") -> DataFrame:
    """All rows with a rank: how often what is asked for occurs, by the logarithm of the text's length."""
    base = words(text)
    hits = F.lit(0.0)
    for phrases in asked(query).all_of:
        for p in phrases:
            hits = hits + _count(base, p)
    n = F.size(F.filter(F.split(base, " "), lambda w: w != ""))
    return df.withColumn(out, hits / (1 + F.log(F.greatest(n, F.lit(1)))))


def _any_marks(word: str) -> str:
    """A pattern of a folded word that its letters with marks match as well."""
    alike = {x: "".join(a for a, b in zip(FROM, TO, strict=False) if b == x) for x in set(word)}
    return "".join(f"[{x}{alike[x]}]" for x in word)


def headline(c, query: str, around: int = 90) -> Column:
    """The passage around the first word that is asked for, with the words in <mark>; the text's beginning where none occurs."""
    first = [p.split(" ")[0] for phrases in asked(query).all_of for p in phrases]
    base = F.col(c) if isinstance(c, str) else c
    if not first:
        return F.substring(base, 1, 2 * around)
    pattern = rf"(?iU)\b({'|'.join(map(_any_marks, first))})\b"
    at = F.regexp_instr(base, F.lit(pattern))
    passage = F.substring(base, F.greatest(at - around, F.lit(1)), F.lit(2 * around))
    return F.regexp_replace(passage, pattern, "<mark>$1</mark>")


#: Characters of a piece that the index of contained texts is made of, and the folders it is dealt to.
GRAM, GRAM_BUCKETS = 3, 64


def _grams(c: Column) -> Column:
    """The different stretches of GRAM characters of a text in lower case, found from left to right in one go."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def write_gram_index(df: DataFrame, path: str, id_col: str, columns: list[str]) -> None:
    """(bucket, gram, field, id) of all texts of these columns, as Parquet in folders by gram. Null texts and ids have none."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("x"))
    each = rows.where("x.text IS NOT NULL").select("id", "x.field", F.explode(_grams(F.col("x.text"))).alias("gram"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int"))
    dealt = each.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id")
    dealt.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def containing(df: DataFrame, path: str, id_col: str, columns: list[str], needle: str) -> DataFrame:
    """The rows of which one of the columns contains the needle, in any case, as ``records.contains_any`` finds them, by the index of :func:`write_gram_index`.

    Rows that have all the needle's grams in one column are candidates and are looked at. Grams are taken from between the
    wildcards % and _; a needle without any, or with letters whose case is written otherwise than by single characters, is looked for in all rows.
    """
    from .records import contains_any

    plain = [p.lower() for p in re.split(r"[%_\\]", needle)]
    grams = sorted({p[k : k + GRAM] for p in plain for k in range(len(p) - GRAM + 1)})
    if not grams or any(len(c.lower()) != 1 or len(c.upper()) != 1 for c in needle):
        return df.where(contains_any(columns, needle))
    spark = df.sparkSession
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int")).distinct().collect()]
    found = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & F.col("field").isin(columns))
    whole = found.groupBy("field", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(F.col("id").alias("__id")).distinct()
    return df.join(whole, F.col(id_col) == F.col("__id"), "left_semi").where(contains_any(columns, needle))
