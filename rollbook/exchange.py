"""What comes in and goes out: recorded pages and runs, merges into a table of files, exports and feeds; queries beside their SQL.

Pages, tables and files are written from the driver's tables to the shared folder first and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions.text import html_text, place_key
from .operators import merge, records
from .operators.records import published
from .queries import ready, t
from .sources import exports, feeds, recorded, seeds
from .views import ctes, view

SPARK, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def new_folder(spark, name: str) -> str:
    ready(spark)
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def recorded_documents(spark, sf_dir: str) -> str:
    """Documents as posts, twenty a page: every third page fails once before it answers, every seventh always, every eleventh is refused."""
    d = t(spark, sf_dir, "documents")
    link = F.concat(F.lit("http://h/"), F.col("doc_id"))
    post = F.to_json(F.struct(F.col("doc_id").alias("id"), link.alias("link"), F.col("lang").alias("modified"), F.lit("2024-03-05T10:00:00").alias("date"), F.struct(F.col("source").alias("rendered")).alias("title")))
    pages = d.groupBy((F.floor(F.col("doc_id") / 20) + 1).cast("int").alias("page")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(post)), ","), F.lit("]")).alias("body"))
    attempts = F.when(F.col("page") % 7 == 0, F.array(F.lit(500), F.lit(502), F.lit(503), F.lit(200))).when(F.col("page") % 11 == 0, F.array(F.lit(404), F.lit(200))).when(F.col("page") % 3 == 0, F.array(F.lit(503), F.lit(200))).otherwise(F.array(F.lit(200)))
    path = new_folder(spark, "pages")
    recorded.record(pages.select("page", "body", F.posexplode(attempts).alias("attempt", "status")), path)
    return path


FETCHED = """WITH p AS (SELECT DISTINCT (doc_id // 20 + 1)::INT AS page FROM documents)
SELECT page, CASE WHEN page % 7 = 0 THEN 3 WHEN page % 11 = 0 THEN 1 WHEN page % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN page % 7 = 0 THEN 503 WHEN page % 11 = 0 THEN 404 ELSE 200 END AS status,
CASE WHEN page % 7 = 0 THEN 'failed 3 times: 503' WHEN page % 11 = 0 THEN 'refused: 404' END AS error FROM p"""


@query(FETCHED)
def pages_fetched(spark, sf_dir):
    return recorded.pages(spark, recorded_documents(spark, sf_dir)).drop("body")


@query(FETCHED)
def pages_streamed(spark, sf_dir):
    """The same pages by a stream, in short ranges, as a table of what arrived."""
    path, out = recorded_documents(spark, sf_dir), new_folder(spark, "streamed")
    rows = recorded.page_stream(spark, path, range=4)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("body")


def _run(spark, sf_dir):
    taken = recorded.pages(spark, recorded_documents(spark, sf_dir)).cache()
    posts = taken.where("error IS NULL").select(F.explode(F.from_json("body", feeds.PAGE)).alias("p")).select(F.col("p.link").alias("url"), F.col("p.title.rendered").alias("title"), F.sha2(F.concat_ws("|", F.col("p.id").cast("string"), "p.modified"), 256).alias("hash"))
    known = t(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("http://h/"), F.col("doc_id")).alias("url"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang"), 256).alias("hash"))
    at = F.lit("2024-03-05").cast("date")
    return recorded.run("posts", taken, posts, known, ["url", "hash"], at, at)


GOOD = "(doc_id // 20 + 1) % 7 <> 0 AND (doc_id // 20 + 1) % 11 <> 0"


@query(f"SELECT 'http://h/' || doc_id AS url, source AS title, sha256(doc_id || '|' || lang) AS hash FROM documents WHERE {GOOD} AND doc_id % 5 <> 0")
def run_documents(spark, sf_dir):
    return _run(spark, sf_dir)[0]


@query(f"""WITH b AS (SELECT DISTINCT doc_id // 20 + 1 AS page FROM documents WHERE NOT ({GOOD}))
SELECT 'posts' AS source, DATE '2024-03-05' AS began, DATE '2024-03-05' AS ended, CASE WHEN (SELECT count(*) FROM b) > 0 THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (doc_id % 5 <> 0) AS n_new, count(*) FILTER (doc_id % 5 = 0) AS n_seen,
(SELECT CASE WHEN count(*) > 0 THEN 'pages ' || string_agg(page::VARCHAR, ', ' ORDER BY page) || ': ' || string_agg(CASE WHEN page % 7 = 0 THEN 'failed 3 times: 503' ELSE 'refused: 404' END, '; ' ORDER BY page) END FROM b) AS errors FROM documents WHERE {GOOD}""")
def run_journal(spark, sf_dir):
    return _run(spark, sf_dir)[1]


@query("""WITH i AS (SELECT DISTINCT s_nationkey % 5 AS k, 1990 + s_suppkey % 30 AS year FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY year DESC) AS nth FROM i)
SELECT 'court' || k AS source, 'https://court/' || year || '/x' || k AS url, year::INT AS year FROM r WHERE k > 2 OR nth <= 2""")
def years_visited(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("k"), (F.col("s_suppkey") % 30 + 1990).cast("int").alias("year"))
    index = s.select(F.concat(F.lit("court"), "k").alias("source"), F.concat(F.lit("https://court/"), "year", F.lit("/x"), "k").alias("url"), "year")
    return recorded.years_to_visit(index, s.where("k <= 2").select(F.concat(F.lit("court"), "k").alias("source")))


@query("""SELECT 'https://court/' || y || '/page' AS page_url, 'https://court/files/' || CASE WHEN k = 0 THEN 'dec_' || y || '_' || doc_id || '.pdf' ELSE 'avis_' || doc_id || '.pdf' END AS url,
CASE WHEN k = 0 THEN 'Décision du 3 mai ' || y ELSE 'Avis n°7 du 2 juin' END AS title, CASE WHEN k = 0 THEN 'decision_constitutionnelle' ELSE 'avis_constitutionnel' END AS kind, CASE WHEN k = 1 THEN y || '-07' WHEN doc_id < 1000 THEN y || '-' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id ELSE y || '-' || left(doc_id::VARCHAR, 3) END AS reference,
CASE WHEN k = 0 THEN make_date(y::INT, 5, 3) ELSE make_date(y::INT, 6, 2) END AS published, y::INT AS year FROM (SELECT doc_id, 2000 + doc_id % 20 AS y, doc_id % 2 AS k FROM documents WHERE doc_id < 1000)""")
def court_publications(spark, sf_dir):
    """Files that yearly pages link to, laid out around the ids of documents of at most three digits, as references are."""
    d = t(spark, sf_dir, "documents").where("doc_id < 1000").select("doc_id", (F.col("doc_id") % 20 + 2000).alias("y"))
    even = F.col("doc_id") % 2 == 0
    link = F.when(even, F.format_string('<a class="f" href="https://court/files/dec_%s_%s.pdf"><b>Décision du 3 mai %s</b></a>', "y", "doc_id", "y")).otherwise(F.format_string('<A href="https://court/files/avis_%s.pdf">Avis n°7 <i>du 2 juin</i></A>', "doc_id"))
    pages = d.groupBy("y").agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("links"))
    return recorded.publications(pages.select(F.format_string("https://court/%s/page", "y").alias("url"), F.concat(F.lit('<p><a href="/x">no</a>'), "links", F.col("links")).alias("html")))


@query("""SELECT 'plenary' || b AS source, nth::INT - 1 AS place, 'https://assembly/' || o_orderkey AS url, 'Séance plénière du ' || o_orderkey AS title, o_orderkey % 2 = 1 OR nth <= 10 AS visit
FROM (SELECT o_orderkey, o_custkey % 40 AS b, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey DESC) AS nth FROM (SELECT DISTINCT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey))""")
def minutes_visited(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("c")).select("o_orderkey", F.concat(F.lit("plenary"), F.col("c") % 40).alias("source"))
    item = F.struct(-F.col("o_orderkey"), F.format_string('<a href="https://assembly/%s" class="text-sm x font-bold y" > Séance plénière du %s </a>', "o_orderkey", "o_orderkey").alias("a"))
    lists = o.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["a"]), "<hr>").alias("html"))
    known = o.where("o_orderkey % 2 = 0").select("source", F.concat(F.lit("https://assembly/"), "o_orderkey").alias("url"))
    return recorded.entries_to_visit(recorded.minutes(lists), known)


def merged_orders(spark, sf_dir, **how):
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice").dropDuplicates(["id"])
    table = new_folder(spark, "merged")
    merge.create(orders, table, "o_orderstatus")
    kind = F.col("id") % 10
    put = orders.where(kind == 0).select("id", F.when(F.col("id") % 20 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("put").alias("op"))
    more = orders.where(kind == 2).select((F.col("id") + 1_000_000_000).alias("id"), F.lit("N").alias("o_orderstatus"), "o_totalprice", F.lit("put").alias("op"))
    gone = orders.where((kind == 1) & (F.col("o_orderstatus") == "F")).withColumn("op", F.lit("delete"))
    return table, merge.merge(put.unionByName(more).unionByName(gone), table, ["id"], **how)


ONCE = "WITH o AS (SELECT o_orderkey AS id, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderkey)"


@query(f"""{ONCE} SELECT id, CASE WHEN id % 20 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN id % 10 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM o WHERE NOT (id % 10 = 1 AND o_orderstatus = 'F')
UNION ALL SELECT id + 1000000000, 'N', o_totalprice FROM o WHERE id % 10 = 2""")
def merged_table(spark, sf_dir):
    return merge.read(spark, merged_orders(spark, sf_dir)[0])


@query(f"{ONCE} SELECT count(*) FILTER (id % 10 = 0) AS updated, count(*) FILTER (id % 10 = 2) AS inserted, count(*) FILTER (id % 10 = 1 AND o_orderstatus = 'F') AS deleted FROM o")
def merged_counts(spark, sf_dir):
    done = merged_orders(spark, sf_dir)[1]
    return spark.createDataFrame([(done["updated"], done["inserted"], done["deleted"])], "updated long, inserted long, deleted long")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'F' THEN 'valid' WHEN l_discount >= 0.05 OR l_quantity < 10 THEN 'valid' ELSE 'pending' END AS status FROM
(SELECT l_orderkey, l_linenumber, any_value(l_linestatus) AS l_linestatus, any_value(l_discount) AS l_discount, any_value(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL HAVING count(*) = 1)""")
def bulk_validated(spark, sf_dir):
    one = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.any_value(c).alias(c) for c in ("l_linestatus", "l_discount", "l_quantity")], F.count(F.lit(1)).alias("n")).where("n = 1")
    rows = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("pending").alias("status"), F.when(F.col("l_quantity") >= 10, F.col("l_discount")).alias("confidence"))
    table = new_folder(spark, "reviewed")
    merge.create(rows, table, "status")
    merge.validated(spark, table, ["id"], 0.05, without_score=True)
    return merge.read(spark, table).select("id", "status")


def read_back(spark, path: str, header: list[str]):
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(header)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in header])


@query(ctes("appointment") + """ SELECT id::VARCHAR AS id, 'P "' || person_id || '"' AS personne, '' AS matricule, post || ', a' AS poste, coalesce(structure_id::VARCHAR, '') AS structure, CASE WHEN type = 'end' THEN 'fin de fonction' ELSE 'nomination' END AS type, coalesce(day::VARCHAR, '') AS date_conseil, 'u' || id AS source_url FROM appointment WHERE status = 'valid'""")
def export_nominations(spark, sf_dir):
    rows = published(view(spark, sf_dir, "appointment"))
    made = rows.select("id", F.format_string('P "%s"', "person_id").alias("personne"), F.lit(None).cast("string").alias("matricule"), F.concat("post", F.lit(", a")).alias("poste"), F.col("structure_id").alias("structure"), F.when(F.col("type") == "end", "fin de fonction").otherwise("nomination").alias("type"), F.col("day").alias("date_conseil"), F.concat(F.lit("u"), "id").alias("source_url"))
    path = new_folder(spark, "nominations")
    exports.write_csv(made, path, exports.NOMINATIONS, [F.col("date_conseil"), F.col("id")], parts=3)
    return read_back(spark, path, exports.NOMINATIONS)


@query(ctes("award") + """ SELECT id::VARCHAR AS id, nature AS type, object AS objet, awardee AS beneficiaire, authority AS ministere, amount::VARCHAR AS montant_fcfa, day::VARCHAR AS date_conseil, 'https://h/' || document_id AS source_url FROM award WHERE status = 'valid'""")
def export_commitments(spark, sf_dir):
    made = published(view(spark, sf_dir, "award")).select("id", F.col("nature").alias("type"), F.col("object").alias("objet"), F.col("awardee").alias("beneficiaire"), F.col("authority").alias("ministere"), F.col("amount").alias("montant_fcfa"), F.col("day").alias("date_conseil"), F.concat(F.lit("https://h/"), "document_id").alias("source_url"))
    path = new_folder(spark, "commitments")
    exports.write_csv(made, path, exports.COMMITMENTS, [-F.col("montant_fcfa"), F.col("id")], parts=4)
    return read_back(spark, path, exports.COMMITMENTS)


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS type, o_orderpriority AS ministere, 'Objet "' || o_custkey || '", suite' AS objet, strftime(o_orderdate, '%Y-%m-%d') AS date_conseil, 'https://h/' || o_custkey AS source_url FROM orders WHERE o_orderstatus <> 'P'""")
def export_decisions(spark, sf_dir):
    """One file for each ministry."""
    rows = t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    made = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("ministere"), F.format_string('Objet "%s", suite', "o_custkey").alias("objet"), F.col("o_orderdate").cast("date").alias("date_conseil"), F.concat(F.lit("https://h/"), "o_custkey").alias("source_url"))
    path = new_folder(spark, "decisions")
    exports.write_csv(made, path, exports.DECISIONS, [F.col("id")], key="ministere")
    return read_back(spark, path, exports.DECISIONS)


@query(ctes("paper") + """ SELECT id::VARCHAR AS id, kind AS type, '' AS reference, source AS titre, coalesce(published::VARCHAR, '') AS date, coalesce(meta ->> 'pdf', '') AS journal_officiel, url AS url_pdf FROM paper WHERE kind IN ('law', 'report')""")
def export_texts(spark, sf_dir):
    said = lambda k: F.get_json_object("meta", f"$.{k}")
    made = view(spark, sf_dir, "paper").where(F.col("kind").isin("law", "report")).select("id", F.col("kind").alias("type"), said("reference").alias("reference"), F.col("source").alias("titre"), F.col("published").alias("date"), said("pdf").alias("journal_officiel"), F.col("url").alias("url_pdf"))
    path = new_folder(spark, "texts")
    exports.write_csv(made, path, exports.TEXTS, [F.col("id")], parts=2)
    return read_back(spark, path, exports.TEXTS)


@query(ctes("tenure") + """ SELECT id::VARCHAR AS id, 'P' || person_id AS personne, '' AS matricule, post AS poste, structure_id::VARCHAR AS structure, "begin"::VARCHAR AS date_debut, coalesce(done::VARCHAR, '') AS date_fin, CASE WHEN done IS NULL THEN 'en cours' ELSE 'terminé' END AS statut FROM tenure""")
def export_directory(spark, sf_dir):
    made = view(spark, sf_dir, "tenure").select("id", F.concat(F.lit("P"), "person_id").alias("personne"), F.lit(None).cast("string").alias("matricule"), F.col("post").alias("poste"), F.col("structure_id").alias("structure"), F.col("begin").alias("date_debut"), F.col("done").alias("date_fin"), F.when(F.col("done").isNull(), "en cours").otherwise("terminé").alias("statut"))
    path = new_folder(spark, "directory")
    exports.write_csv(made, path, exports.DIRECTORY, [F.col("date_debut"), F.col("id")], parts=3)
    return read_back(spark, path, exports.DIRECTORY)


ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""{ctes("paper")}, e AS (SELECT CASE kind WHEN 'report' THEN 'conseils' WHEN 'news' THEN 'actualites' ELSE 'textes' END AS feed, id, {ESCAPED.format("source || ' & <co>'")} AS title, url AS link, published,
CASE WHEN kind <> 'report' THEN meta ->> 'description' END AS said FROM paper),
r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY published DESC NULLS LAST, id DESC) AS n FROM e)
SELECT feed, n::INT AS n, title, link, feed || '-' || id AS guid, coalesce({ESCAPED.format("said")}, '') AS description, coalesce(strftime(published, '%a, %d %b %Y 12:00:00 +0000'), '') AS date FROM r WHERE n <= CASE feed WHEN 'actualites' THEN 40 ELSE 30 END""")
def feeds_written(spark, sf_dir):
    """All three feeds by one write, read back as text."""
    p = view(spark, sf_dir, "paper")
    feed = F.when(F.col("kind") == "report", "conseils").when(F.col("kind") == "news", "actualites").otherwise("textes")
    said = F.when(F.col("kind") != "report", html_text(F.get_json_object("meta", "$.description")))
    p = p.select(feed.alias("feed"), "id", F.concat("source", F.lit(" & <co>")).alias("title"), "url", "published", said.alias("said"))
    rows = p.select("feed", "published", "id", exports.entry(F.col("title"), F.col("url"), F.concat_ws("-", "feed", F.col("id").cast("string")), F.col("published"), F.col("said")).alias("entry"))
    about = {"conseils": ("Conseils", "Comptes rendus"), "actualites": ("Actualités", "Le fil"), "textes": ("Lois & décrets", "Textes")}
    path = new_folder(spark, "feeds")
    exports.write_feed(rows, path, about, "https://h", [F.desc_nulls_last("published"), F.desc("id")], {"conseils": exports.COUNCILS, "actualites": exports.NEWS, "textes": exports.LAWS})
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(\w+)\.xml$", 1).alias("feed"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("k", "item"))
    tag = lambda name: F.regexp_extract("item", rf"<{name}[^>]*>(.*?)</{name}>", 1).alias({"pubDate": "date"}.get(name, name))
    return files.select("feed", (F.col("k") + 1).alias("n"), *map(tag, ("title", "link", "guid", "description", "pubDate")))


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'oui' ELSE '' END AS appliquer, s_suppkey::VARCHAR AS id_source, s_name AS nom_source, (s_suppkey + 1)::VARCHAR AS id_canonique, 'N, "' || s_nationkey || '"' AS nom_canonique, printf('%.2f', (s_suppkey % 100) / 100.0::DOUBLE) AS similarite FROM supplier""")
def proposals_written(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    made = s.select(F.when(F.col("s_suppkey") % 3 == 0, "oui").alias("appliquer"), F.col("s_suppkey").alias("id_source"), F.col("s_name").alias("nom_source"), (F.col("s_suppkey") + 1).alias("id_canonique"), F.format_string('N, "%s"', "s_nationkey").alias("nom_canonique"), F.format_string("%.2f", (F.col("s_suppkey") % 100) / 100.0).alias("similarite"))
    path = new_folder(spark, "proposals")
    exports.write_csv(made, path, exports.PROPOSALS, [-F.col("similarite").cast("double"), F.col("id_source")], parts=2)
    return read_back(spark, path, exports.PROPOSALS)


def gazetteer_lines(spark, sf_dir):
    """A gazetteer as CSV: a line for each part, of which every ninth has no number for its latitude."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = F.concat_ws(",", F.concat(F.lit('" Ville d\'Or'), k, F.lit(' "')), F.lit("commune"), F.when(k % 2 == 0, F.concat(F.lit("R"), k % 13)).otherwise(""), F.lit(""), F.when(k % 9 == 0, "north").otherwise((k % 90).cast("string")), F.lit("-1.5"), F.when(k % 3 == 0, "").otherwise(k.cast("string")))
    path = new_folder(spark, "gazetteer")
    head = spark.createDataFrame([("nom,type,region,province,latitude,longitude,population",)], "line string")
    head.union(p.select(line.alias("line"))).coalesce(1).write.text(path)
    return seeds.seed_file(spark, path, seeds.GAZETTEER)


@query("""SELECT 'Ville d''Or' || p_partkey AS name, 'or' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'R' || p_partkey % 13 END AS region, (p_partkey % 90)::DOUBLE AS latitude, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS population
FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 7 <> 0""")
def gazetteer_seeded(spark, sf_dir):
    there = t(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("or"), "p_partkey").alias("key"), F.lit("commune").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("R"), F.col("p_partkey") % 13)).alias("region"))
    return seeds.gazetteer(gazetteer_lines(spark, sf_dir), there)[0].select("name", "key", "region", "latitude", "population")


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 9 = 0")
def gazetteer_corrupt(spark, sf_dir):
    there = spark.createDataFrame([], "key string, type string, region string")
    return seeds.gazetteer(gazetteer_lines(spark, sf_dir), there)[1].agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'pont' ELSE 'route' END AS kind, 'Ouvrage ' || p_partkey AS title, n_name AS place, 'Transport & mobilité' AS sector, CASE WHEN p_size % 3 = 0 THEN p_partkey END AS amount, 'valid' AS status, DATE '2020-01-01' + p_size AS day
FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 5 <> 0""")
def facilities_curated(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    rows = t(spark, sf_dir, "part").join(n, F.col("n_nationkey") == F.col("p_partkey") % 25)
    lines = rows.select(F.when(F.col("p_size") % 2 == 0, "pont").otherwise("route").alias("type"), F.format_string(" Ouvrage %s", "p_partkey").alias("titre"), F.lit("").alias("description"), F.lit("inauguration").alias("statut"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("date"), F.concat(F.lit("Commune de "), "n_name").alias("lieu"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey")).alias("montant_fcfa"), F.lit("u").alias("source_url"))
    path = new_folder(spark, "curated")
    lines.write.option("header", True).option("quoteAll", True).option("nullValue", "").csv(path)
    there = rows.where("p_partkey % 5 = 0").select(F.format_string("Ouvrage %s", "p_partkey").alias("title"))
    places = n.select(F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_name").alias("name"), place_key("n_name").alias("key"), F.lit("r").alias("region"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(1).cast("long").alias("population"))
    return seeds.curated(seeds.seed_file(spark, path, seeds.CURATED), there, places)[0].select("kind", "title", "place", "sector", "amount", "status", "day")


QUEUED = {"appointments": ("events", "event_id", "value / 100"), "awards": ("lineitem", "l_orderkey", "l_discount * 10"), "people": ("customer", "c_custkey", "c_acctbal / 10000"), "decisions": ("orders", "o_orderkey", "o_totalprice / 500000"), "facilities": ("part", "p_partkey", "p_size / 50.0"), "budgets": ("supplier", "s_suppkey", "s_acctbal / 10000"), "texts": ("documents", "doc_id", "n_chars / 20000.0"), "members": ("nation", "n_nationkey", "n_nationkey / 25.0")}


def queued(spark, sf_dir) -> dict:
    """Eight kinds of facts, of which every third is valid and every fifth has no score."""
    status = lambda k: F.when(F.col(k) % 3 == 0, "valid").when(F.col(k) % 3 == 1, "pending").otherwise("rejected")
    return {name: t(spark, sf_dir, table).select(status(k).alias("status"), F.when(F.col(k) % 5 != 0, F.expr(score).cast("double")).alias("confidence")) for name, (table, k, score) in QUEUED.items()}


SIX = list(QUEUED)[:6]


@query(" UNION ALL ".join(f"SELECT '{n}' AS queue, count(*) FILTER ({QUEUED[n][1]} % 3 = 1) AS n FROM {QUEUED[n][0]}" for n in SIX))
def review_queues(spark, sf_dir):
    return records.pending_queues({n: df for n, df in queued(spark, sf_dir).items() if n in SIX})


@query(" UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) FILTER ({k} % 3 = 1 AND {k} % 5 <> 0 AND ({score})::DOUBLE >= 0.5) AS validated, count(*) FILTER ({k} % 3 = 1 AND {k} % 5 = 0) AS without_score, count(*) FILTER ({k} % 3 = 1 AND NOT coalesce({k} % 5 <> 0 AND ({score})::DOUBLE >= 0.5, false)) AS remaining FROM {table}" for n, (table, k, score) in QUEUED.items()))
def bulk_reported(spark, sf_dir):
    return records.bulk_report(queued(spark, sf_dir), 0.5)


@query("""SELECT ceil(n / 20.0)::INT AS page, ceil(total / 20.0)::INT AS pages, total, n AS place, id, name, acronym FROM (SELECT p_partkey AS id, p_name || ' "' || p_brand || '"' AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS acronym, row_number() OVER (ORDER BY p_name, p_partkey) AS n, count(*) OVER () AS total FROM part)""")
def json_answers(spark, sf_dir):
    """Every page of a listing as JSON, read back."""
    ready(spark)
    rows = t(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("id"), F.format_string('%s "%s"', "p_name", "p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("acronym"))
    made = records.answers(rows, ["id", "name", "acronym"], ["p_name", "id"])
    read = made.select(F.from_json("body", "page int, pages int, total long, rows array<struct<id: bigint, name: string, acronym: string>>").alias("b"))
    return read.select("b.page", "b.pages", "b.total", F.posexplode("b.rows").alias("k", "r")).select("page", "pages", "total", ((F.col("page") - 1) * 20 + F.col("k") + 1).cast("long").alias("place"), "r.*")
