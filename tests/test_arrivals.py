"""Raw archives and streams of arriving records."""

import json
import os

from pyspark.sql import functions as F

from rollbook.sources import archive
from rollbook.streaming import arrivals

SCHEMA = "url string, hash string, at timestamp"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.writelines(json.dumps(dict(zip(("url", "hash", "at"), r, strict=True))) + "\n" for r in rows)


def test_each_version_is_stored_once(spark, new_folder):
    def run():
        stream = arrivals.arrivals(spark, f"{new_folder}/in", SCHEMA, 1)
        arrivals.store_new(stream, f"{new_folder}/table", ["url", "hash"], f"{new_folder}/marks").awaitTermination()
        return sorted((r.url, r.hash) for r in spark.read.parquet(f"{new_folder}/table").collect() if r.hash is not None)

    put(f"{new_folder}/in", "a", [("u", "1", "2024-01-01T00:10:00"), ("u", "1", "2024-01-01T00:20:00"), ("u", None, "2024-01-01T00:30:00")])
    assert run() == [("u", "1")]
    put(f"{new_folder}/in", "b", [("u", "1", "2024-01-01T01:10:00"), ("u", "2", "2024-01-01T01:20:00"), ("u", None, "2024-01-01T02:00:00")])
    assert run() == [("u", "1"), ("u", "2")]
    assert run() == [("u", "1"), ("u", "2")]
    assert spark.read.parquet(f"{new_folder}/table").where("hash is null").count() == 2


def test_windows_of_time(spark, new_folder):
    put(f"{new_folder}/in", "a", [("u", "1", "2024-01-01T00:10:00"), ("u", "2", "2024-01-01T00:50:00"), ("v", "1", "2024-01-01T01:00:00")])
    counts = arrivals.windowed_counts(arrivals.arrivals(spark, f"{new_folder}/in", SCHEMA), "at", "url")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.hour, r.url, r.n) for r in spark.table("counts").collect()) == [(0, "u", 2), (1, "v", 1)]


def test_raw_files_and_links(spark, new_folder):
    for name, content in (("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-1"), ("c.pdf", b"<html>"), ("d.pdf", b"")):
        with open(f"{new_folder}/{name}", "wb") as out:
            out.write(content)
    rows = {r.path[-5:]: r for r in archive.raw_files(spark, new_folder, "court").collect()}
    assert [rows[k].is_pdf for k in sorted(rows)] == [True, True, False]
    assert rows["a.pdf"].key == rows["b.PDF"].key != rows["c.pdf"].key and rows["a.pdf"].key.startswith("court/")
    html = spark.createDataFrame([('<a href="/x.pdf"> <a href="https://h.org/x.pdf"> <a href="//o/y">',), (None,)], "html string")
    got = [r[0] for r in html.select(archive.links(F.col("html"), F.lit("https://h.org/p/q"))).collect()]
    assert got == [["https://h.org/x.pdf", "//o/y"], []]
    ticked = spark.createDataFrame([(" OUI ", 1), ("x", 2), ("non", 3), (None, 4)], "apply string, k int")
    assert [r.k for r in archive.accepted(ticked).orderBy("k").collect()] == [1, 2]
