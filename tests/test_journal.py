"""Journal tables, headings, projects, linear works and French search where the queries' tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.functions.stems import stem
from rollbook.operators import facilities, fulltext, headings, projects, records, search, tables

HEAD = [["COMMUNE DE MANGA", None], ["Demande de prix n°2026-01/X pour la construction de deux salles Financement : budget", None]]
COLUMNS = ["Soumissionnaires", "Montants lus", "Appréciation"]


def awards(spark, *rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, cells array<array<string>>")
    return {r.id: r for r in tables.awards(df).collect()}


def test_tables(spark):
    closed = [*HEAD, COLUMNS, ["A SARL", "1 000 000", "Conforme 2e"], ["Attributaire : ETS KABORE / Tél : 70 pour un montant de deux millions (2 000 000) FCFA TTC"]]
    ranked = [*HEAD, COLUMNS, ["1 Lot 1 : ZONGO ET FILS (Ouaga)", "abc", "3 000 000", "1er\nConforme"], ["B", "9 000 000", "Conforme 1er"]]
    second = [["x"], *HEAD, COLUMNS, ["", "WATAM SA", "4 500 000", "Conforme, 1er"]]
    no_sum = [*HEAD, COLUMNS, ["A SARL", "12", "Conforme 1er"], ["B SARL", "5 000 000", "Conforme 1er"]]
    own = [["MINISTERE DE L'EAU ET DU RESTE"], ["objet"], COLUMNS, ["MINISTERE DE L'EAU ET DU RESTE", "5 000 000", "Conforme 1er"]]
    short, other, bare = [*HEAD, COLUMNS], [["a"], ["b"], ["c"], ["d"]], [COLUMNS, ["A SARL", "5 000 000", "Conforme 1er"], ["b"], ["c"]]
    empty = [HEAD[1], [None, ""], None, COLUMNS, ["", "", ""], ["C SARL", "6 000 000", "Conforme 1er"], ["D SARL", "7 000 000", "Non"]]
    made = awards(spark, closed, ranked, second, no_sum, own, short, other, bare, None, [], empty)
    assert {k: (r.awardee, r.amount) for k, r in made.items()} == {0: ("ETS KABORE", 2_000_000), 1: ("ZONGO ET FILS", 3_000_000), 2: ("WATAM SA", 4_500_000), 10: ("C SARL", 6_000_000)}
    assert made[0].authority == "COMMUNE DE MANGA" and made[0].object == "la construction de deux salles" and made[0].reference.startswith("Demande de prix n°2026-01/X pour")
    assert made[2].authority == "COMMUNE DE MANGA"


def test_lines_are_asked_once_for_each_thing(spark):
    """The patterns that lines are held against stand once in the plan, and bidders aren't looked at where a closing line tells."""
    df = spark.createDataFrame([(1, [*HEAD, COLUMNS, ["A SARL", "1 000 000", "Conforme 1er"], ["Attributaire : B SARL pour un montant de (2 000 000)"]])], "id int, cells array<array<string>>")
    made = tables.awards(df)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f", {p})") for p in (tables.WINNER, tables.FIRST, tables.NO_AUTHORITY)] == [1, 1, 1]
    assert [(r.awardee, r.amount) for r in made.collect()] == [("B SARL", 2_000_000)]


def test_headings_over_stretches(spark):
    rng = random.Random(3)
    heads = [(d, rng.randrange(3_000), f"h{k}") for d in range(3) for k in range(6)] + [(0, None, "x"), (None, 5, "y"), (1, 40, None)]
    rows = [(d, rng.randrange(4_000), k) for d in range(4) for k in range(60)] + [(0, None, 99), (None, 7, 98)]
    h, r = spark.createDataFrame(heads, "doc int, at int, name string"), spark.createDataFrame(rows, "doc int, at int, k int")
    for stretch in (10, 100_000):
        for x in headings.governed(r, h, by="doc", at="at", name="name", stretch=stretch).collect():
            before = [(a, n) for d, a, n in heads if None not in (d, a, n, x.doc, x["at"]) and d == x.doc and a <= x["at"]]
            assert (x.heading_at, x.heading) == (max(before) if before else (None, None)) or x.doc is None
    assert headings.governed(r.limit(0), h, by="doc", at="at", name="name").count() == 0
    assert headings.governed(r, h.limit(0), by="doc", at="at", name="name").where("heading IS NOT NULL").count() == 0


def test_lots(spark):
    text = "Lot 1 : Acquisition de tables et de bancs\n\nLot 1 : Acquisition de riz local blanc\n\nligne"
    texts = spark.createDataFrame([(1, text)], "doc int, text string")
    rows = spark.createDataFrame([(1, 60, "Lot 1 : x"), (1, 90, "lot n° 01"), (1, None, "Lot 1"), (1, 90, "Lot 2"), (2, 90, "Lot 1"), (1, 90, None)], "doc int, at int, object string")
    assert sorted(((r["at"] or 0, r.object or "", r.heading) for r in headings.lots_named(rows, texts, by="doc", at="at", text="text", obj="object").collect() if r.doc == 1)) == [(0, "Lot 1", "Acquisition de tables et de bancs"), (60, "Lot 1 : x", "Acquisition de tables et de bancs"), (90, "", None), (90, "Lot 2", None), (90, "lot n° 01", "Acquisition de riz local blanc")]


def test_projects_with_several_anchors(spark):
    pieces = spark.createDataFrame([("b", 1, 7, "long label", None, "r"), ("a", 1, 3, None, "s", None), ("b", 2, None, "x", "t", "q"), ("c", 9, None, "alone", None, None), ("a", 5, None, "new", None, None), ("c", 6, None, "newer one", None, None)], "kind string, id long, project_id long, label string, sector string, region string")
    pairs = spark.createDataFrame([("OUI", "a", 1, "b", 1), (" x", "b", 1, "b", 2), ("1", "a", 5, "c", 6), ("non", "c", 9, "a", 5), (None, "c", 9, "a", 5), ("oui", "c", 9, "a", 77), ("oui", "z", 1, "c", 9)], "apply string, kind_a string, id_a long, kind_b string, id_b long")
    made, found = projects.assigned(pieces, pairs, ["a", "b", "c"], "a")
    assert {(r.kind, r.id): r.project_id for r in made.collect()} == {("b", 1): 3, ("a", 1): 3, ("b", 2): 3, ("c", 9): None, ("a", 5): 8, ("c", 6): 8}
    by = {r.project_id: r for r in found.collect()}
    assert by[3].conflict and not by[3].new and by[3].title == "long label" and by[3].sector == "s" and by[3].region == "r" and by[3].n == 3
    assert by[8].new and by[8].title == "new"
    assert projects.assigned(pieces, pairs.limit(0), ["a", "b", "c"], "a")[1].count() == 0
    assert [r.nth for r in projects.stages(made, {"a": 1, "b": 2, "c": 3}).where("project_id = 3").orderBy("nth").collect()] == [1, 2, 3]


def test_cuts(spark):
    titles = ["Route Bobo-Dioulasso-Banfora, 80 km", "Pont entre Manga et Pô", "Bitumage de la route nationale Koudougou – Dédougou", "École", None, "piste A à B-C"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "id int, t string").select("id", facilities.cuts(F.coalesce("t", F.lit(""))).alias("c")).collect()
    assert {r.id: [tuple(x) for x in r.c] for r in rows} == {0: [("Bobo", "Dioulasso-Banfora"), ("Bobo-Dioulasso", "Banfora")], 1: [("Manga", "Pô")], 2: [("Koudougou", "Dédougou")], 3: [], 4: [], 5: [("A", "B-C")]}
    places = spark.createDataFrame([(1, "Bobo-Dioulasso", 10), (2, "Banfora", 5), (3, "Manga", 1), (4, "Pô", 1)], "place_id long, name string, population long")
    works = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "id int, title string")
    assert [tuple(r) for r in facilities.linear_ends(works, places, "id", "title").orderBy("id").collect()] == [(0, 1, 1, 2), (1, 0, 3, 4)]


@pytest.mark.parametrize("word,left", [x.split() for x in "continuellement continuel;continuité continu;contraction contract;contradictoirement contradictoir;maintenaient mainten;majestueusement majestu;majorités major;malades malad;maîtresses maîtress;chevaux cheval;nationaux national;bateaux bateau;mangeais mang;mangeions mangeion;finissaient fin;heureusement heureux;abondamment abond;qualités qualit".split(";")] + [("", ""), ("x", "x")])
def test_stems(word, left):
    assert stem(word) == left


def test_search_by_index_equals_a_scan_and_reads_little(spark, new_folder):
    rng = random.Random(5)
    words = "le marché marchés de construction constructions route routes nationale l'eau travaux Financement, été".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(120)] + [(200, None), (None, "route"), (201, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"file://{new_folder}/index"
    fulltext.write_index(df, path, buckets=8)
    for query in ("route", "marché construction", '"travaux de construction"', '"travaux route" OR eau', "routes -nationale", '-route', "de la", "", 'financement "marchés construction" -"l\'eau"', "inconnu"):
        found = fulltext.postings(spark, path, fulltext.asked(query).stems(), buckets=8)
        have = sorted(map(tuple, fulltext.search(found, query).collect()))
        assert have == sorted(map(tuple, fulltext.scan(df, query).collect()))
    q = fulltext.asked("route")
    plan = fulltext.postings(spark, path, q.stems(), buckets=8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200] and "term" in plan.split("PushedFilters: [")[1][:200]
    made = fulltext.headlines(fulltext.search(fulltext.postings(spark, path, q.stems(), buckets=8), "route").orderBy(F.desc("rank"), "id").limit(3), df).collect()
    assert len(made) == 3 and all("<mark>route" in r.headline for r in made)


def test_cover_density(spark):
    df = spark.createDataFrame([(1, "alpha beta x x alpha"), (2, "alpha x beta"), (3, "beta"), (4, "alpha beta alpha beta")], "doc_id long, text string")
    have = {r.id: (round(r.rank, 6), r.begin, r.end) for r in fulltext.scan(df, "alpha beta").collect()}
    # alpha-beta, and beta-alpha over two words; one stretch with a word between; three that touch
    assert have == {1: (round(0.1 + 0.1 / 3, 6), 0, 1), 2: (0.05, 0, 2), 4: (0.3, 0, 1)}


def test_contained_texts_by_index_are_those_of_a_scan(spark, new_folder):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("abÉé %_x\n") for _ in range(rng.randint(0, 30))), rng.choice(["Abc abc", "", None])) for k in range(150)] + [(None, "abc", "abc"), (500, None, None)]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    path = f"file://{new_folder}/grams"
    search.write_gram_index(df, path, "id", ["t", "u"])
    for needle in ("abc", "BÉÉ", "ab%xa", "a", "", "a_b", "éab", "%bab%", "zzz", "ß", "bc a"):
        want = {r.id for r in df.where(records.contains_any(["t", "u"], needle)).collect()} - {None}
        assert {r.id for r in search.containing(df, path, "id", ["t", "u"], needle).collect()} - {None} == want, needle


def test_facets_in_one_pass(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None)]
    df = spark.createDataFrame(rows, "p string, q string")
    have = {(r.facet, r.value): r.n for r in records.facets(df, {"p": "a", "q": "x"}).collect()}
    assert have == {("p", "a"): 1, ("p", "b"): 1, ("p", None): 1, ("q", "x"): 1, ("q", "y"): 1, ("q", None): 1}
    assert {(r.facet, r.value): r.n for r in records.facets(df, {"p": None}).collect()} == {("p", "a"): 3, ("p", "b"): 1, ("p", None): 1}


def test_postings_of_long_texts_do_not_add_up():
    import pyarrow as pa

    text = " ".join(f"mot{k}" for k in range(30_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([text] * 7 + [None])], names=["id", "text"])
    made = list(fulltext._postings([batch]))
    assert max(b.num_rows for b in made) <= 60_000 and sum(b.num_rows for b in made) == 7 * 30_000
