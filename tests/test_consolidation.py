"""Jobs that SQL doesn't express against plain versions, and searches."""

import pathlib
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollbook import queries as records
from rollbook.operators import consolidation, linkage, search
from rollbook.views import view

from .conftest import SMALL


def grams(text):
    return {f"  {w} "[k : k + 3] for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() for k in range(len(w) + 1)}


def merged(names, least):
    """The most similar first; a name is merged once, into the root of the shorter one."""
    pairs = []
    for a in names:
        for b in names:
            if a < b:
                x, y = grams(names[a]), grams(names[b])
                if len(x & y) >= least * len(x | y):
                    pairs.append((-round(len(x & y) / len(x | y), 4), a, b))
    into = {}
    for _, a, b in sorted(pairs):
        (_, target), (_, source) = sorted(((len(names[a]), a), (len(names[b]), b)))
        if source in into:
            continue
        while target in into:
            target = into[target]
        if target != source:
            into[source] = target
    return into


def test_automatic_merges(spark):
    names = {k: n for k, n in enumerate(["habib trading international", "u habib trading international", "à habib trading international", "general micro system", "à general micro system", "real services international", "rellya services international", "rellya services international", "x", ""])}
    df = spark.createDataFrame(list(names.items()), "id long, name string")
    have = {r.id: r.canonical for r in consolidation.automatic_merges(df).collect()}
    assert have == merged(names, 0.9) and have[1] == 0 and have[7] == 6 and 6 not in have
    part = {r.id: r.name for r in spark.read.parquet(f"{SMALL}/part.parquet").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name")).collect()}
    assert {r.id: r.canonical for r in records.queries()["automatic_merges"](spark, SMALL).collect()} == merged(part, 0.9)
    assert consolidation.automatic_merges(df.where("false")).count() == 0


def test_merges_of_names_in_several_lengths(spark):
    rng = random.Random(4)
    words = ["habib", "trading", "international", "micro", "u", "general"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(["", " ", "s", "!!"]) for _ in range(120)]
    names = dict(zip(rng.sample(range(1000), 120), made, strict=True))
    df = spark.createDataFrame(list(names.items()), "id long, name string")
    for least in (0.9, 0.5):
        assert {r.id: r.canonical for r in consolidation.automatic_merges(df, least).collect()} == merged(names, least)


def test_pairs_of_any_similarity(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 24))) for _ in range(150)] + ["Ab a" * 30, "Ab a" * 30 + "c"]
    df = spark.createDataFrame(list(enumerate(made)), "id long, name string")
    g = [grams(x) for x in made]
    for least in (0.3, 0.65, 0.9):
        near = {(a, b): len(g[a] & g[b]) / len(g[a] | g[b]) for a in range(len(g)) for b in range(len(g)) if g[a] and g[b] and len(g[a] & g[b]) >= least * len(g[a] | g[b])}
        one = {(r.a, r.b): r.similarity for r in linkage.trigram_join(df, None, "id", F.col("name"), least).collect()}
        assert one == pytest.approx({k: v for k, v in near.items() if k[0] < k[1]}, abs=1e-4)
        two = {(r.a, r.b): r.similarity for r in linkage.trigram_join(df.where("id % 2 = 0"), df.where("id % 3 = 0"), "id", F.col("name"), least).collect()}
        assert two == pytest.approx({k: v for k, v in near.items() if k[0] % 2 == 0 and k[1] % 3 == 0}, abs=1e-4)


def test_records_of_one_name_are_not_paired(spark):
    # as pairs these are 5 billion
    df = spark.range(100_000).select("id", F.lit("habib trading").alias("name"))
    assert linkage.trigram_components(df, "id", F.col("name"), 0.8).where("root = 0").count() == 100_000
    assert consolidation.automatic_merges(df).where("canonical = 0").count() == 99_999
    # an id under two names ties them together; a name's only record is no pair
    df = spark.createDataFrame([(1, "aaaa"), (2, "aaaa"), (2, "bbbb"), (3, "bbbb"), (4, "cccc"), (None, "cccc"), (5, None)], "id long, name string")
    assert {r.node: r.root for r in linkage.trigram_components(df, "id", F.col("name"), 0.8).collect()} == {1: 1, 2: 1, 3: 1}


def test_pairs_of_many_records_are_dealt_and_lie_closely(spark, new_folder):
    n = 4000
    df = spark.range(n).select("id", F.concat(F.lit("habib trading "), F.substring(F.lit("xyz"), (F.col("id") % 3 + 1).cast("int"), F.lit(1))).alias("name"))
    linkage.trigram_join(df, None, "id", F.col("name"), 0.7).withColumn("task", F.spark_partition_id()).write.parquet(f"{new_folder}/pairs")
    made = spark.read.parquet(f"{new_folder}/pairs")
    assert made.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first() == (n * (n - 1) // 2, sum(a * (n - 1 - a) for a in range(n)), sum(b * b for b in range(n)))
    assert made.where("similarity = 1").count() == sum(1 for a in range(n) for b in range(a + 3, n, 3)) and made.where("a >= b").count() == 0
    each = [r["count"] for r in made.groupBy("task").count().collect()]
    assert len(each) > 1 and max(each) < 0.6 * sum(each)
    assert sum(f.stat().st_size for f in pathlib.Path(new_folder, "pairs").glob("*.parquet")) < 0.5 * sum(each)


def test_pairs_of_records_that_repeat(spark):
    rows = [(1, "aaaa"), (2, "aaaa"), (2, "aaaa"), (2, "bbbb"), (3, "bbbb"), (3, "bbbb b"), (4, "cccc"), (None, "cccc"), (5, None)]
    df = spark.createDataFrame(rows, "id long, name string")
    g = [(i, grams(n)) for i, n in rows if i is not None and n]
    want = sorted((i, j) for i, x in g for j, y in g if i < j and len(x & y) >= 0.5 * len(x | y))
    assert sorted((r.a, r.b) for r in linkage.trigram_join(df, None, "id", F.col("name"), 0.5).collect()) == want and len(want) > len(set(want))


def test_proposals_come_in_order_without_a_sort_of_them(spark):
    words = ["habib", "trading", "international", "micro", "general"]
    made = {k: " ".join(words[: 2 + k % 4]) + " " + "abcdef"[k % 6] for k in range(300)}
    found = consolidation.proposals(spark.createDataFrame(list(made.items()), "id long, name string"), 0.65)
    g = {k: grams(n) for k, n in made.items()}
    want = {(a, b): round(round(len(g[a] & g[b]) / len(g[a] | g[b]), 4), 2) for a in g for b in g if a < b and 0.65 * len(g[a] | g[b]) <= len(g[a] & g[b]) < 0.9 * len(g[a] | g[b])}
    have = found.collect()
    assert {(r.a, r.b): r.similarity for r in have} == want and len(have) == len(want)
    said = [r.similarity for r in have]
    assert said == sorted(said, reverse=True) and len(set(said)) > 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("Generate") < plan.find("Sort")


def folded(rows):
    """Appointments in order: (person, structure, place, seat, post, type, day, id)."""
    tenures, seats = [], {}
    for person, structure, place, seat, post, kind, day, number in rows:
        key = (place, seat) if place is not None and seat is not None else None
        mine = [t for t in tenures if t["person"] == person and not t["closed"]]
        if kind == "start":
            holder = seats.get(key) if key else None
            if holder and holder["person"] == person:
                continue
            if not key and any(t["post"] == post and t["structure"] == structure for t in mine):
                continue
            if holder:
                holder.update(done=day, by=number, closed=True)
            new = {"person": person, "structure": structure, "post": post, "begin": day, "id": number, "done": None, "by": None, "closed": False}
            tenures.append(new)
            if key:
                seats[key] = new
        elif mine:
            there = [t for t in mine if structure is not None and t["structure"] == structure]
            last = (there or mine)[-1]
            last.update(done=day, by=number, closed=True)
            if key and seats.get(key) is last:
                del seats[key]
    return sorted((t["id"], t["person"], t["structure"], t["post"], t["begin"], t["done"], t["by"]) for t in tenures)


#: Title -> seat in a single institution and in a ministry.
SEATS = {"Directeur général": ("dg", "directeur general"), "Conseiller": (None, None), "Secrétaire général": ("sg", "secretaire general"), "Administrateur": (None, None), "Chef de service": ("chef de service", "chef de service")}


def plain_tenures(appointments, structures):
    place = {s.id: s.id if pd.isna(s.canonical_id) else int(s.canonical_id) for s in structures.itertuples()}
    ministry = {s.id: s.name.startswith("Ministère") for s in structures.itertuples()}
    rows = []
    for a in sorted((a for a in appointments if a.status == "valid"), key=lambda a: (a.published is not None, a.published or date.min, a.id)):
        at = place.get(a.structure_id)
        seat = SEATS[a.post][ministry.get(at, False)] if at is not None else None
        rows.append((a.person_id, a.structure_id, at, seat, a.post, a.type, a.day or a.published, a.id))
    return folded(rows)


def as_rows(df):
    return sorted((r.opened_by, r.person_id, r.structure_id, r.post, r.begin, r.done, r.closed_by) for r in df.collect())


def test_tenures(spark):
    structures = view(spark, SMALL, "structure").toPandas()
    rows = view(spark, SMALL, "appointment").withColumn("published", F.col("day")).collect()
    want = plain_tenures(rows, structures)
    assert as_rows(records.queries()["tenures_folded"](spark, SMALL)) == want and any(r[5] for r in want)
    rng = random.Random(3)
    made = []
    for k in range(400):
        day = None if rng.random() < 0.1 else date(2024, 1, 1) + timedelta(days=rng.randrange(300))
        made.append((k, rng.randrange(60), rng.choice([None, *range(25)]), rng.choice(list(SEATS)), rng.choice(["start", "start", "start", "end"]), None if rng.random() < 0.5 else day, day, rng.choice(["valid", "valid", "pending"])))
    df = spark.createDataFrame(made, "id long, person_id long, structure_id long, post string, type string, day date, published date, status string")
    assert as_rows(consolidation.tenures(df, view(spark, SMALL, "structure"))) == plain_tenures(df.collect(), structures)
    assert consolidation.tenures(df.where("false"), view(spark, SMALL, "structure")).count() == 0


def test_pointers_end_in_circles(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 5), (7, 7), (8, 99)], "id long, p long")
    assert {r.id: r.root for r in consolidation.resolved(rows, "id", "p").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 99}


def test_search(spark):
    texts = ["Le marché de l'École à Ouaga", "ecole école ecole", "école privée", "un marché", None, "", "l’école du marché privé"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = lambda q: sorted(r.id for r in search.matches(df, "text", q).collect())
    assert found("école") == [0, 1, 2, 6] and found("école marché") == [0, 6] and found("école -marché") == [1, 2]
    assert found('"école privée"') == [2] and found("privée OR ouaga") == [0, 2] and found("") == [] == found("-x")
    best = search.ranked(search.matches(df, "text", "école"), "text", "école").orderBy(F.desc("rank"), "id").first()
    assert best.id == 1 and abs(best.rank - 3 / (1 + 1.0986122886681098)) < 1e-9
    shown = [r[0] for r in df.where("id IN (0, 3)").orderBy("id").select(search.headline("text", "ecole", 8)).collect()]
    assert shown == ["hé de l'<mark>École</mark> à ", "un marché"]
