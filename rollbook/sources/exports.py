"""CSV exports and RSS feeds as files: a data source that writes whole files or none.

Tasks write theirs aside; when all are done the commit puts them in their places, and a run that fails leaves what was there.
A file for each key: rows of a key must come to one task and in order, which :func:`write` sees to by a range of keys and
numbered parts, so that a large export is several files whose names are in order.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.papers import rfc822
from ..functions.text import escape_xml

#: The columns of the five exports.
NOMINATIONS = ["id", "personne", "matricule", "poste", "structure", "type", "date_conseil", "source_url"]
COMMITMENTS = ["id", "type", "objet", "beneficiaire", "ministere", "montant_fcfa", "date_conseil", "source_url"]
DECISIONS = ["id", "type", "ministere", "objet", "date_conseil", "source_url"]
TEXTS = ["id", "type", "reference", "titre", "date", "journal_officiel", "url_pdf"]
DIRECTORY = ["id", "personne", "matricule", "poste", "structure", "date_debut", "date_fin", "statut"]
#: The columns of proposals that are reviewed.
PROPOSALS = ["appliquer", "id_source", "nom_source", "id_canonique", "nom_canonique", "similarite"]
#: Rows of a numbered file, about, so that what a task writes or reads doesn't grow with the export.
ROWS = 500_000
#: Entries of the three feeds.
COUNCILS, NEWS, LAWS = 30, 40, 30


def blank(c) -> Column:
    """A value as an export has it: nulls are empty, dates in ISO form."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Files(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = urlparse(options["path"]).path if options["path"].startswith("file:") else options["path"]
        self.header = options["header"].split(",") if options.get("header") else None
        self.head, self.foot, self.ending = options.get("head", ""), options.get("foot", ""), options["ending"]
        self.aside = os.path.join(self.folder, f"_aside-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        """Rows are (file, values or a ready line): CSV with a header, or lines between a head and a foot."""
        os.makedirs(self.aside, exist_ok=True)
        made, name, out, writer = [], None, None, None
        for row in iterator:
            if row[0] != name:
                if out:
                    out.write(self.foot)
                    out.close()
                name = row[0]
                aside = os.path.join(self.aside, uuid.uuid4().hex)
                made.append((aside, f"{name}.{self.ending}"))
                out = open(aside, "w", encoding="utf-8", newline="")
                writer = csv.writer(out)
                if self.header:
                    writer.writerow(self.header)
                out.write(self.head.replace("{name}", name))
            if self.header:
                writer.writerow(row[1:])
            else:
                out.write(row[1] or "")
        if out:
            out.write(self.foot)
            out.close()
        return Written(made)

    def commit(self, messages) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file came to several tasks")
        for aside, name in files:
            os.replace(aside, os.path.join(self.folder, name))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> _Files:
        return _Files(self.options)


def write_csv(rows: DataFrame, path: str, header: list[str], order: list[Column], key: str | None = None, parts: int = 1) -> None:
    """CSV files with a header: one for each value of ``key``, or ``parts`` numbered ones of the whole export in order (more, where one would have over ROWS rows). Nulls are empty fields."""
    values = [blank(c).alias(c) for c in header]
    if key is not None:
        dealt = rows.select(blank(key).alias("__file"), *header, *[o.alias(f"__o{k}") for k, o in enumerate(order)]).repartition("__file")
        dealt = dealt.sortWithinPartitions("__file", *[f"__o{k}" for k in range(len(order))])
    else:
        parts = max(parts, -(-rows.count() // ROWS))
        sorted_ = rows.select(*header, *[o.alias(f"__o{k}") for k, o in enumerate(order)])
        by = [f"__o{k}" for k in range(len(order))]
        dealt = sorted_.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__file", F.format_string("part-%05d", F.spark_partition_id()))
    _save(dealt.select(F.col("__file").alias("file"), *values), path, ending="csv", header=",".join(header))


def _save(rows: DataFrame, path: str, **options) -> None:
    rows.sparkSession.dataSource.register(WholeFiles)
    folder = urlparse(path).path if path.startswith("file:") else path
    os.makedirs(folder, exist_ok=True)
    rows.write.format("whole_files").mode("append").options(path=path, **options).save()


def entry(title, link, guid, day, description=None) -> Column:
    """An entry of a feed, escaped; without a description or a date where there is none."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escape_xml(c), F.lit(f"</{name}>\n"))
    some = lambda name, c: F.when((c.isNotNull()) & (c != ""), tag(name, c)).otherwise("")
    said = F.lit(None).cast("string") if description is None else description
    return F.concat(F.lit("<item>\n"), tag("title", title), tag("link", link), F.lit('<guid isPermaLink="false">'), escape_xml(guid), F.lit("</guid>\n"), some("description", said), some("pubDate", rfc822(day)), F.lit("</item>\n"))


def write_feed(entries: DataFrame, path: str, about: dict[str, tuple[str, str]], base: str, order: list[Column], most: dict[str, int]) -> None:
    """RSS 2.0 files, one for each ``feed`` of the entries (feed, entry): of each the first ``most`` in order. ``about`` gives titles and descriptions.

    Feeds without an entry have no file. All that differs between feeds goes into the lines, so one write makes them all.
    """
    from pyspark.sql import Window

    limit, titles = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))]), F.create_map(*[x for k, (a, b) in about.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    rows = entries.withColumn("__n", F.row_number().over(Window.partitionBy("feed").orderBy(*order))).where(F.col("__n") <= limit[F.col("feed")])
    text = titles[F.col("feed")]
    head = F.concat(F.lit("<title>"), escape_xml(text[0]), F.lit(f"</title>\n<link>{base}/</link>\n<description>"), escape_xml(text[1]), F.lit(f'</description>\n<language>fr</language>\n<atom:link href="{base}/api/rss/'), F.col("feed"), F.lit('.xml" rel="self" type="application/rss+xml"/>\n'))
    line = F.when(F.col("__n") == 1, F.concat(head, F.col("entry"))).otherwise(F.col("entry"))
    dealt = rows.repartition("feed").sortWithinPartitions("feed", "__n").select(F.col("feed").alias("file"), line.alias("line"))
    _save(dealt, path, ending="xml", head='<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">\n<channel>\n', foot="</channel>\n</rss>\n")
