"""Runs, merges and writers when things go wrong."""

import glob

import pytest
from pyspark.sql import functions as F

from rollbook.operators import merge
from rollbook.sources import exports, recorded


def test_pages_end_where_there_are_none(spark, new_folder):
    rows = [(1, 0, 200, "a\tb\nc"), (2, 0, 500, None), (2, 1, 200, "d"), (4, 0, 200, "after a gap"), (9, 0, 302, "")]
    recorded.record(spark.createDataFrame(rows, "page int, attempt int, status int, body string"), f"file://{new_folder}/p")
    read = lambda **o: sorted(map(tuple, recorded.pages(spark, f"file://{new_folder}/p", **o).collect()))
    assert read() == [(1, 1, 200, "a\tb c", None), (2, 2, 200, "d", None)]
    assert read(range=1) == [*read(), (4, 1, 200, "after a gap", None), (9, 1, 302, "", None)]
    assert read(retries=1, first=2) == [(2, 1, 500, None, "failed 1 times: 500")]


def test_many_pages_are_few_files_and_tasks(spark, new_folder):
    gone, n = {40, 300, 512}, 1_000
    made = spark.range(1, n + 1).where(~F.col("id").isin(*gone)).select(F.col("id").cast("int").alias("page"), F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    made = made.select("page", "attempt", F.when(F.col("attempt") == 0, 500).otherwise(200).alias("status"), F.concat(F.lit("b\t"), "page", F.lit("\u2028")).alias("body"))
    recorded.record(made, f"file://{new_folder}/p")
    assert len(glob.glob(f"{new_folder}/p/*/part-*")) <= n // recorded.BLOCK + 1
    for width, first in ((4, 1), (4, 7), (16, 1), (7, 250), (1_000, 1), (1, 1)):
        read = recorded.pages(spark, f"file://{new_folder}/p", range=width, first=first)
        ranges = [range(a, min(a + width, n + 1)) for a in range(first, n + 1, width)]
        want = [p for r in ranges for p in r if not gone & set(range(r[0], p + 1))]
        assert sorted(map(tuple, read.collect())) == [(p, 2, 200, f"b\t{p}\u2028", None) for p in want]
        assert read.rdd.getNumPartitions() <= n // recorded.BLOCK + 2


def test_a_stream_goes_on_where_it_ended(spark, new_folder):
    some = lambda pages: spark.createDataFrame([(k, 0, 200, f"b{k}") for k in pages], "page int, attempt int, status int, body string")
    path = f"file://{new_folder}/p"

    def taken():
        out = recorded.page_stream(spark, path, range=2).writeStream.format("parquet").option("path", f"{new_folder}/out").option("checkpointLocation", f"{new_folder}/c")
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.page for r in spark.read.parquet(f"{new_folder}/out").collect())

    recorded.record(some(range(1, 6)), path)
    assert taken() == [1, 2, 3, 4, 5]
    some([6, 7]).select("page", F.concat_ws("\t", "status", "body").alias("line")).write.mode("append").partitionBy("page").text(path)
    assert taken() == [1, 2, 3, 4, 5, 6, 7]


def test_runs_that_fail_keep_what_they_have(spark):
    at = F.lit("2024-01-01").cast("date")
    pages = spark.createDataFrame([(1, None), (2, "refused: 404"), (10, "failed 3 times: 500")], "page int, error string")
    found = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", None), ("w", "2")], "url string, hash string")
    fresh, journal = recorded.run("s", pages, found, spark.createDataFrame([("w", "2")], found.schema), ["url", "hash"], at, at)
    assert sorted((r.url, r.hash or "") for r in fresh.collect()) == [("u", "1"), ("v", "")]
    row = journal.collect()[0]
    assert (row.status, row.n_new, row.n_seen, row.errors) == ("failed", 2, 2, "pages 2, 10: refused: 404; failed 3 times: 500")
    row = recorded.run("s", pages.limit(0), found.limit(0), found, ["url", "hash"], at, at)[1].collect()[0]
    assert (row.status, row.n_new, row.n_seen, row.errors) == ("ok", 0, 0, None)


def test_a_list_without_minutes_is_an_error(spark):
    with pytest.raises(Exception, match="layout must have changed"):
        recorded.minutes(spark.createDataFrame([("s", "<p>none</p>")], "source string, html string")).collect()


def table(spark, folder):
    merge.create(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b/c %", "z"), (4, None, "n"), (None, "a", "k")], "id long, p string, v string"), folder, "p")
    return lambda n=None: sorted(((r.id or 0, r.p, r.v) for r in merge.read(spark, folder, n).collect()), key=repr)


def test_merges(spark, new_folder):
    rows = table(spark, f"file://{new_folder}/t")
    changes = lambda *c: spark.createDataFrame(list(c), "id long, p string, v string, op string")
    first, files = rows(), set(glob.glob(f"{new_folder}/t/data/*/*b%2Fc*/*.parquet"))
    assert merge.merge(changes((1, "b/c %", "moved", "put"), (2, None, None, "delete"), (9, "new", "w", "put"), (8, "a", "gone", "delete")), f"file://{new_folder}/t", ["id"]) == {"updated": 1, "inserted": 1, "deleted": 1}
    now = sorted([(1, "b/c %", "moved"), (3, "b/c %", "z"), (4, None, "n"), (0, "a", "k"), (9, "new", "w")], key=repr)
    assert rows() == now and rows(1) == first and files

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        merge.merge(changes((3, "b/c %", "q", "put")), f"file://{new_folder}/t", ["id"], before_swap=fail)
    assert rows() == now
    # another merge comes first: the later one is refused, and may be run again
    with pytest.raises(merge.Conflict):
        merge.merge(changes((3, "b/c %", "q", "put")), f"file://{new_folder}/t", ["id"], before_swap=lambda: merge.merge(changes((4, None, None, "delete")), f"file://{new_folder}/t", ["id"]))
    assert rows() == [r for r in now if r[0] != 4]
    for bad in ([(1, "a", "b", "put")] * 2, [(None, "a", "b", "put")]):
        with pytest.raises(ValueError):
            merge.merge(changes(*bad), f"file://{new_folder}/t", ["id"])
    assert merge.merge(changes((77, "a", "b", "delete")), f"file://{new_folder}/t", ["id"]) == {"updated": 0, "inserted": 0, "deleted": 0}


def test_untouched_partitions_are_not_written(spark, new_folder):
    table(spark, f"{new_folder}/t")
    merge.merge(spark.createDataFrame([(1, "a", "new", "put")], "id long, p string, v string, op string"), f"{new_folder}/t", ["id"])
    assert len(glob.glob(f"{new_folder}/t/data/*/__part=a")) == 2 and len(glob.glob(f"{new_folder}/t/data/*/__part=*b*")) == 1


def test_exports_come_whole_or_not_at_all(spark, new_folder):
    rows = spark.createDataFrame([(k, f'n"{k},\n', "k" + str(k % 3)) for k in range(30)], "id long, nom string, key string")
    exports.write_csv(rows, f"{new_folder}/by", ["id", "nom"], [F.col("id")], key="key")
    import csv

    for k in range(3):
        with open(f"{new_folder}/by/k{k}.csv", newline="") as f:
            assert list(csv.reader(f)) == [["id", "nom"], *[[str(j), f'n"{j},\n'] for j in range(30) if j % 3 == k]]
    exports.write_csv(rows, f"{new_folder}/all", ["id", "nom"], [-F.col("id")], parts=4)
    found = []
    for name in sorted(glob.glob(f"{new_folder}/all/*.csv")):
        with open(name, newline="") as f:
            found += [int(r[0]) for r in list(csv.reader(f))[1:]]
    assert found == list(range(29, -1, -1)) and not glob.glob(f"{new_folder}/*/_aside*")
    broken = rows.withColumn("nom", F.when(F.col("id") == 29, F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        exports.write_csv(broken, f"{new_folder}/by", ["id", "nom"], [F.col("id")], key="key")
    assert 'n""0' in open(f"{new_folder}/by/k0.csv").read() and not glob.glob(f"{new_folder}/*/_aside*")


def test_large_exports_are_more_files(spark, new_folder, monkeypatch):
    monkeypatch.setattr(exports, "ROWS", 100)
    exports.write_csv(spark.range(2_000).select("id", F.lit("x").alias("nom")), f"{new_folder}/many", ["id", "nom"], [-F.col("id")], parts=2)
    files = [open(f).read().splitlines()[1:] for f in sorted(glob.glob(f"{new_folder}/many/*.csv"))]
    assert len(files) == 20 and max(map(len, files)) < 250
    assert [line for f in files for line in f] == [f"{k},x" for k in range(1_999, -1, -1)]
