"""Recorded answers of a paged source, as a data source for batches and streams, and the runs that take them.

``spark.read.format("recorded_pages")`` reads pages of a folder in which ``page=K`` holds the answers to page K, an attempt a
line: a status, a tab, and what was answered. ``block=B`` holds those to BLOCK pages in their order, with the page and a tab
before each line, so that many pages are few files. The folder is one that all executors can open. Pages are taken by ranges,
and as many ranges make a task as have BLOCK pages. What a server failed to answer is asked again as often as ``retries`` says;
what it refused isn't. A page without any answer ends its range, as later ones don't exist.
"""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.papers import court_date, court_kind, court_reference
from ..operators.records import new_versions

SCHEMA = "page int, attempts int, status int, body string, error string"
#: Attempts at a page, pages of a range, and pages of a block and of a task.
RETRIES, RANGE, BLOCK = 3, 16, 256
#: Statuses from here on are the server's fault and are asked again, from there on the answer is a refusal.
FAULT, REFUSAL = 500, 400
#: Pages of a yearly archive, and entries of a list, that are visited again though they are known.
YEARS_AGAIN, ENTRIES_AGAIN = 2, 10


def _folder(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def _answer(line: str) -> list[tuple[int, str]]:
    status, tab, body = line.partition("\t")
    return [(int(status), body)] if tab and status.isdigit() else []


def _answers(folder: str, page: int) -> list[tuple[int, str]]:
    out = []
    for name in sorted(glob.glob(f"{glob.escape(folder)}/page={page}/part-*")):
        with open(name, encoding="utf-8") as lines:
            for line in lines.read().split("\n"):
                out += _answer(line)
    return out


def _in_block(folder: str, block: int):
    """(page, line) of a block's lines, in the order of pages."""
    for name in sorted(glob.glob(f"{glob.escape(folder)}/block={block}/part-*")):
        with open(name, encoding="utf-8", newline="\n") as lines:
            for line in lines:
                page, tab, rest = line.rstrip("\n").partition("\t")
                if tab and page.isdigit():
                    yield int(page), rest


def _in_blocks(folder: str, first: int, end: int):
    """(page, answers) of the pages from ``first`` to before ``end`` that blocks hold; one page's answers are held at a time."""
    for block in range(first // BLOCK, (end - 1) // BLOCK + 1):
        for page, lines in groupby(_in_block(folder, block), key=lambda x: x[0]):
            if first <= page < end:
                yield page, [a for _, line in lines for a in _answer(line)]


def fetched(page: int, answers: list[tuple[int, str]], retries: int) -> tuple | None:
    """(page, attempts, status, body, error) after as many attempts as it takes; none if the page doesn't exist."""
    if not answers:
        return None
    for k, (status, body) in enumerate(answers[:retries], 1):
        if status < REFUSAL:
            return page, k, status, body, None
        if status < FAULT:
            return page, k, status, None, f"refused: {status}"
    status = answers[min(retries, len(answers)) - 1][0]
    return page, min(retries, len(answers)), status, None, f"failed {min(retries, len(answers))} times: {status}"


@dataclass
class Ranges(InputPartition):
    """Ranges of ``width`` pages one after the other, the last of which may be shorter."""

    first: int
    end: int
    width: int


class _Pages:
    def __init__(self, options: dict):
        self.folder = _folder(options["path"])
        self.first, self.retries = int(options.get("first", 1)), int(options.get("retries", RETRIES))
        self.width = int(options.get("range", RANGE))

    def _end(self) -> int:
        """One more than the last page that there is."""
        names = os.listdir(self.folder)
        pages = [int(m[1]) for name in names if (m := re.fullmatch(r"page=(\d+)", name))]
        blocks = [int(m[1]) for name in names if (m := re.fullmatch(r"block=(\d+)", name))]
        if blocks:
            pages += [page for page, _ in _in_block(self.folder, max(blocks))]
        return max(pages, default=self.first - 1) + 1

    def _tasks(self, first: int, end: int) -> list[Ranges]:
        of_task = max(1, BLOCK // self.width) * self.width
        return [Ranges(a, min(a + of_task, end), self.width) for a in range(first, end, of_task)]

    def read(self, partition: Ranges):
        if partition.first >= partition.end:
            return
        blocks = _in_blocks(self.folder, partition.first, partition.end)
        at, held = next(blocks, (None, []))
        open_ = True
        for page in range(partition.first, partition.end):
            open_ = open_ or (page - partition.first) % partition.width == 0
            answers = []
            if page == at:
                answers = held
                at, held = next(blocks, (None, []))
            if open_:
                row = fetched(page, answers + _answers(self.folder, page), self.retries)
                open_ = row is not None
                if row is not None:
                    yield row


class PagesReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return self._tasks(self.first, self._end()) or [Ranges(self.first, self.first, self.width)]


class PagesStream(_Pages, DataSourceStreamReader):
    """Offsets are the next page to be taken; a batch takes all that there are."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.next = self.first

    def initialOffset(self) -> dict:
        return {"page": self.first}

    def latestOffset(self) -> dict:
        self.next = max(self.next, self._end())
        return {"page": self.next}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        self.next = max(self.next, end["page"])  # after a restart, offsets come from the checkpoint
        return self._tasks(start["page"], end["page"])

    def commit(self, end: dict) -> None:
        pass


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> PagesStream:
        return PagesStream(self.options)


def record(answers: DataFrame, path: str) -> None:
    """Write answers (page, attempt, status, body) as such a folder: bodies on one line, a file a block."""
    line = F.concat_ws("\t", F.col("page").cast("string"), F.col("status").cast("string"), F.regexp_replace(F.coalesce("body", F.lit("")), r"[\r\n]+", " "))
    rows = answers.select(F.floor(F.col("page") / BLOCK).alias("block"), "page", "attempt", line.alias("line")).repartition("block").sortWithinPartitions("block", "page", "attempt")
    rows.select("block", "line").write.partitionBy("block").text(path)


def pages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").options(path=path, **options).load()


def page_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format("recorded_pages").options(path=path, **options).load()


def run(source: str, taken: DataFrame, found: DataFrame, known: DataFrame, keys: list[str], began: Column, ended: Column) -> tuple[DataFrame, DataFrame]:
    """(new documents, a journal row) of a run over ``taken`` pages: of what was ``found`` on them, what isn't ``known`` by its keys.

    The row is (source, began, ended, status, n_new, n_seen, errors): a run of which a page failed is ``failed`` and names
    the pages with what was wrong; what the others held is taken all the same. A page that doesn't exist is no error.
    """
    fresh = new_versions(found, known, keys)
    wrong = taken.where(F.col("error").isNotNull()).agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "error"))).getField("error"), "; ").alias("errors"), F.array_join(F.sort_array(F.collect_list("page")).cast("array<string>"), ", ").alias("at"), F.count(F.lit(1)).alias("n"))
    counts = found.agg(F.count(F.lit(1)).alias("n_found")).join(fresh.agg(F.count(F.lit(1)).alias("n_new")))
    journal = counts.join(wrong).select(F.lit(source).alias("source"), began.alias("began"), ended.alias("ended"), F.when(F.col("n") > 0, "failed").otherwise("ok").alias("status"), "n_new", (F.col("n_found") - F.col("n_new")).alias("n_seen"), F.when(F.col("n") > 0, F.concat(F.lit("pages "), F.col("at"), F.lit(": "), F.col("errors"))).alias("errors"))
    return fresh, journal


def years_to_visit(index: DataFrame, known: DataFrame, again: int = YEARS_AGAIN) -> DataFrame:
    """Of a yearly archive's pages (source, url, year) those to be read: all of a source of which no page is ``known`` (source), else the ``again`` latest years'."""
    latest = Window.partitionBy("source").orderBy(F.desc_nulls_last("year"), "url")
    rows = index.dropDuplicates(["source", "url"]).withColumn("nth", F.row_number().over(latest))
    held = known.select("source").distinct().withColumn("held", F.lit(True))
    return rows.join(held, "source", "left").where(F.col("held").isNull() | (F.col("nth") <= again)).drop("held", "nth")


def entries_to_visit(entries: DataFrame, known: DataFrame, again: int = ENTRIES_AGAIN) -> DataFrame:
    """Entries (source, place, url) of lists, newest first, with ``visit``: those that aren't ``known`` (source, url), and the ``again`` first, which may still be corrected."""
    place = Window.partitionBy("source").orderBy("place")
    rows = entries.withColumn("nth", F.row_number().over(place))
    held = known.select("source", "url").distinct().withColumn("held", F.lit(True))
    return rows.join(held, ["source", "url"], "left").withColumn("visit", F.col("held").isNull() | (F.col("nth") <= again)).drop("held", "nth")


#: A year in a page's address, a linked file with its text, and an entry of the list of minutes.
YEAR = r"(\d{4})"
LINK = r"(?is)<a\b[^>]*href=\"([^\"]+\.pdf)\"[^>]*>(.*?)</a>"
ENTRY = r"(?s)href=\"(https://[^\"]*/\d+)\"[^>]*class=\"text-sm[^\"]*font-bold[^\"]*\"\s*>\s*(.{10,300}?)\s*</a>"


def publications(found: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(page_url, url, title, kind, reference, published, year) of the files that a yearly page of the court links to, each address once a page.

    Kind, reference and date are read from title and file name, and where those name no year from the page's.
    """
    file, title = F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(LINK), F.lit(2))
    rows = found.select(F.col(url).alias("page_url"), F.nullif(F.regexp_extract(url, YEAR, 1), F.lit("")).cast("int").alias("year"), F.explode(F.arrays_zip(file.alias("url"), title.alias("title"))).alias("l"))
    rows = rows.select("page_url", "year", "l.url", F.trim(F.regexp_replace(F.regexp_replace("l.title", "<[^>]*>", " "), r"\s+", " ")).alias("title")).dropDuplicates(["page_url", "url"])
    name = F.element_at(F.split("url", "/"), -1)
    rows = rows.withColumn("published", court_date("title", name, F.col("year")))
    return rows.select("page_url", "url", "title", court_kind("title", name).alias("kind"), court_reference("title", name, F.coalesce(F.year("published"), F.col("year"))).alias("reference"), "published", "year")


def minutes(found: DataFrame, html: str = "html", source: str = "source") -> DataFrame:
    """(source, place, url, title) of the minutes that a list names, in its order. A list without any is an error, as its layout must have changed."""
    link, title = F.regexp_extract_all(html, F.lit(ENTRY), F.lit(1)), F.regexp_extract_all(html, F.lit(ENTRY), F.lit(2))
    entries = F.arrays_zip(link.alias("url"), title.alias("title"))
    checked = F.when(F.size(entries) > 0, entries).otherwise(F.raise_error(F.lit("no minutes are listed: the layout must have changed")).cast("array<struct<url:string,title:string>>"))
    return found.select(F.col(source).alias("source"), F.posexplode(checked).alias("place", "e")).select("source", "place", "e.url", "e.title")
