"""Feeds and paged answers that have been fetched, as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, updated: string, description: string>>>"
PAGE = "array<struct<id: bigint, link: string, modified: string, date: string, title: struct<rendered: string>, content: struct<rendered: string>, categories: array<bigint>>>"
TEXTS = "struct<content: array<struct<id: bigint, title: string, type: string, lastModified: string, journal: struct<number: string, date: string>>>>"


def rss_documents(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(title, link, published, hash, description) of the entries of RSS feeds. Entries without a link are left out; the hash is that of link and title."""
    item = F.explode(F.from_xml(F.col(xml), RSS)["channel"]["item"]).alias("i")
    rows = feeds.select(item).select("i.*").where(F.coalesce(F.trim("link"), F.lit("")) != "")
    when = F.coalesce("pubDate", "updated")
    day = F.coalesce(F.try_to_timestamp(F.regexp_replace(when, r"^\w+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(when))
    return rows.select("title", "link", day.cast("date").alias("published"), F.sha2(F.concat_ws("|", "link", F.coalesce("title", F.lit(""))), 256).alias("hash"), "description")


def paged_documents(pages: DataFrame, known: DataFrame, answer: str = "json", number: str = "page", category: int | None = None) -> DataFrame:
    """(page, url, title, html, published, hash) of posts on pages (number, answer) that aren't among the ``known`` (url, hash).

    Pages are taken up to the first on which nothing is new, as later ones are older. Answers that aren't posts give none.
    """
    posts = pages.select(F.col(number).alias("page"), F.explode(F.from_json(F.col(answer), PAGE)).alias("p")).select("page", "p.*")
    if category is not None:
        posts = posts.where(F.array_contains("categories", category))
    rows = posts.select("page", F.col("link").alias("url"), F.col("title.rendered").alias("title"), F.col("content.rendered").alias("html"), F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd").alias("published"), F.sha2(F.concat_ws("|", F.col("id").cast("string"), "modified"), 256).alias("hash"))
    fresh = rows.join(known.select("url", "hash"), ["url", "hash"], "left_anti")
    # the first page without anything new; where there is none, all pages count
    last = pages.select(F.col(number).alias("page")).distinct().join(fresh.select("page").distinct(), "page", "left_anti").agg(F.min("page").alias("end"))
    return fresh.join(F.broadcast(last)).where(F.col("end").isNull() | (F.col("page") < F.col("end"))).drop("end")


def legal_texts(pages: DataFrame, kinds: dict[str, str], default: str, answer: str = "json") -> DataFrame:
    """(id, title, kind, published, hash, meta) of the texts on pages: kinds by a table, else the default; what tells of the journal goes to ``meta``."""
    texts = pages.select(F.explode(F.from_json(F.col(answer), TEXTS)["content"]).alias("t")).select("t.*")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("type")), F.lit(default))
    return texts.select("id", "title", kind.alias("kind"), F.try_to_date(F.substring("journal.date", 1, 10), "yyyy-MM-dd").alias("published"), F.sha2(F.concat_ws("|", F.col("id").cast("string"), "lastModified"), 256).alias("hash"), F.to_json("journal").alias("meta"))


def safe_key(key: Column) -> Column:
    """An archive key with single slashes; null if it is empty, absolute or leads out of the archive."""
    parts = F.filter(F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    bad = key.startswith("/") | F.exists(parts, lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def not_seeded(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a seed file that the table doesn't have yet by these columns (equal nulls count as equal), once each."""
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(there[k])
    return rows.join(there, same, "left_anti").dropDuplicates(keys)
