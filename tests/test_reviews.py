"""Reviews, seeds and answers in small cases."""

import json

from pyspark.sql import functions as F

from rollbook.operators import records
from rollbook.sources import seeds


def test_reviews_of_enough_confidence(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "a"), (5, "a")], "id int, nature string")
    said = [(1, "b", 0.9), (1, "c", 0.95), (2, "b", 0.5), (3, "b", 0.85), (4, "a", 0.99), (5, None, 1.0), (5, "b", None), (9, "b", 1.0)]
    have = {r.id: (r.nature, r.outcome) for r in records.reviewed(rows, spark.createDataFrame(said, "id int, said string, confidence double"), "id", "nature").collect()}
    assert have == {1: ("c", "changed"), 2: ("a", "doubt"), 3: ("b", "changed"), 4: ("a", "kept"), 5: ("a", "doubt")}
    pairs = spark.createDataFrame([(True, 0.85), (True, 0.84), (False, 1.0), (None, 1.0), (True, None)], "verdict boolean, confidence double")
    assert [r.accepted for r in records.judged(pairs).collect()] == [True, False, False, False, False]


def test_bulk_report_and_queues(spark):
    rows = spark.createDataFrame([("pending", 0.9), ("pending", 0.4), ("pending", None), ("valid", 0.9), (None, 0.9)], "status string, confidence double")
    one = lambda **how: tuple(records.bulk_report({"x": rows}, 0.5, **how).collect()[0])
    assert one() == ("x", 1, 1, 2) and one(without_score=True) == ("x", 2, 1, 1)
    assert {r.queue: r.n for r in records.pending_queues({"x": rows, "y": rows.limit(0)}).collect()} == {"x": 3, "y": 0}


def test_answers(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else f'"{k}"') for k in range(45)], "id int, name string")
    made = {r.page: json.loads(r.body) for r in records.answers(rows, ["id", "name"], ["id"], size=20).collect()}
    assert sorted(made) == [1, 2, 3] and made[3] == {"page": 3, "pages": 3, "total": 45, "rows": [{"id": k, "name": None if k % 2 else f'"{k}"'} for k in range(40, 45)]}
    assert records.answers(rows.limit(0), ["id"], ["id"]).count() == 0


def test_entries_of_papers(spark):
    texts = ['{"d": [{"o": "x", "n": 1}, {"o": " "}, {"n": 2}, {"o": "y"}]}', '{"d": [', None, "{}", '{"d": null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [(r.id, r.nth, r.o, r.n) for r in records.exploded(df, "id", "text", "d", "o: string, n: int", ["o"]).collect()] == [(0, 0, "x", 1), (0, 3, "y", None)]


def test_seed_files(spark, new_folder):
    with open(f"{new_folder}/g.csv", "w") as f:
        f.write('nom,type,region,province,latitude,longitude,population\n"Manga, ville",commune,,P,1.5,2.5,10\nPô,commune,R,,x,2.5,10\nPô,commune,R,,1.5,2.5,\nManga ville,commune,,Q,9,9,\n,commune,,,1,1,1\nBobo,ville,R,,,1,1\n')
    places, bad = seeds.gazetteer(seeds.seed_file(spark, f"{new_folder}/g.csv", seeds.GAZETTEER), spark.createDataFrame([("po", "commune", "S")], "key string, type string, region string"))
    assert sorted((r.key, r.region, r.population) for r in places.collect()) in ([("manga", None, 10), ("po", "R", None)], [("manga", None, None), ("po", "R", None)])
    assert [r[0].startswith("Pô,commune,R,,x") for r in bad.collect()] == [True]
    with open(f"{new_folder}/c.csv", "w") as f:
        f.write('type,titre,description,statut,date,lieu,montant_fcfa,source_url\npont,Un pont,,inauguration,2020-01-02,Manga,5,\npont, Un pont ,again,inauguration,2020-01-02,Manga,5,u\nx,Autre,d,annonce,2020-01-02,Nowhere at all,,\ny,Known,,a,2020-01-02,Manga,,\nz,Bad,,a,no date,Manga,,\n')
    gazetteer = spark.createDataFrame([(1, "Manga", "manga", "r", 1.0, 2.0, 3)], "place_id long, name string, key string, region string, latitude double, longitude double, population long")
    made, left = seeds.curated(seeds.seed_file(spark, f"{new_folder}/c.csv", seeds.CURATED), spark.createDataFrame([("Known",)], "title string"), gazetteer)
    row = made.collect()
    assert len(row) == 1 and (row[0].title, row[0].place_id, row[0].sector, row[0].status, row[0].owner) == ("Un pont", 1, "Transport & mobilité", "valid", seeds.MARK)
    assert [r.title for r in left.collect()] == ["Autre"]


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "id int").repartition(5)
    assert [r.n for r in records.numbered(df, ["id"], "n").orderBy("id").collect()] == list(range(1, 1001))
    assert records.numbered(df.limit(0), ["id"], "n").count() == 0
    assert records.fenced(df, x=F.col("id") + 1).where("x = 1").count() == 1
