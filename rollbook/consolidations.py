"""The consolidation jobs and sources as queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import awards as aw
from .functions import rules
from .functions import text as tx
from .operators import consolidation, linkage, records
from .queries import GRAMS, TOKENS, ready
from .sources import feeds
from .views import ctes, view

SPARK, SQL = {}, {}


def job(sql: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPELLED = "CASE l_linenumber % 3 WHEN 0 THEN concat(upper(s_name), ' SARL') WHEN 1 THEN s_name ELSE concat('Éts ', s_name) END"


@job(f"""WITH r AS (SELECT {SPELLED} AS name, lower(replace(s_name, '#', '')) AS key FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), c AS (SELECT key, name, count(*) AS n FROM r GROUP BY ALL),
d AS (SELECT key, arg_max(name, (n, length(name), name)) AS display, sum(n)::BIGINT AS n, count(*) AS spellings FROM c GROUP BY key),
k AS (SELECT s_suppkey AS id, lower(replace(s_name, '#', '')) AS key, s_name AS was, s_suppkey % 4 = 0 AS frozen FROM supplier WHERE s_suppkey % 2 = 0)
SELECT d.key, CASE WHEN k.id IS NULL OR (NOT frozen AND was <> display) THEN display ELSE was END AS name, n, spellings, k.id, CASE WHEN k.id IS NULL THEN 'new' WHEN NOT frozen AND was <> display THEN 'renamed' ELSE 'same' END AS state FROM d LEFT JOIN k USING (key)""")
def suppliers_consolidated(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    spelled = F.expr(SPELLED)
    raw = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(spelled.alias("name"))
    known = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), tx.company_key("s_name").alias("key"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 == 0).alias("frozen"))
    return consolidation.suppliers(raw, known)


#: Chains of up to seven steps, and circles.
POINTER = "CASE WHEN c_custkey % 40 = 1 THEN c_custkey + 3 WHEN c_custkey % 8 <> 0 THEN c_custkey - 1 END"


@job(f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, {POINTER} AS pointer FROM customer),
r AS (SELECT id, id AS at, [id] AS way FROM p UNION ALL SELECT r.id, p.pointer, list_append(way, p.pointer) FROM r JOIN p ON p.id = r.at WHERE p.pointer IS NOT NULL AND NOT list_contains(way, p.pointer))
SELECT r.id, coalesce(p.pointer, r.at) AS root FROM r LEFT JOIN p ON p.id = r.at WHERE p.pointer IS NULL OR list_contains(way, p.pointer)""")
def pointers_resolved(spark, sf_dir):
    ready(spark)
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(POINTER).alias("pointer"))
    return consolidation.resolved(rows, "id", "pointer")


@job()
def automatic_merges(spark, sf_dir):
    ready(spark)
    return consolidation.automatic_merges(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name")))


@job(f"""WITH g AS (SELECT p_partkey AS id, {GRAMS.format(c="p_name || ' ' || p_type")} AS g FROM part),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.id < b.id AND len(a.g) >= 0.65 * len(b.g) AND len(b.g) >= 0.65 * len(a.g))
SELECT a, b, round(round(i / (s - i), 4), 2) AS similarity FROM p WHERE i >= (s - i) * 0.65 AND round(i / (s - i), 4) < 0.9""")
def merge_proposals(spark, sf_dir):
    return consolidation.proposals(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name")), 0.65)


@job(f"""WITH c AS (SELECT c_custkey AS id, c_name AS name, {GRAMS.format(c='c_name')} AS g FROM customer), s AS (SELECT s_suppkey AS id, s_name AS name, {GRAMS.format(c='s_name')} AS g FROM supplier),
a AS (SELECT l_suppkey AS id, count(*) AS n, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS amount FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
p AS (SELECT s.id AS supplier, c.id AS person, len(list_intersect(c.g, s.g)) AS i, len(c.g) + len(s.g) AS u FROM c, s)
SELECT supplier, person, round(round(i / (u - i), 4), 2) AS similarity, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM p LEFT JOIN a ON a.id = supplier WHERE i >= (u - i) * 0.3""")
def names_alike(spark, sf_dir):
    """Suppliers whose name is like a person's, for a review: those with the largest valid awards first."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    won = records.published(view(spark, sf_dir, "award")).groupBy(F.col("supplier_id").alias("supplier")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    rows = linkage.trigram_join(s, c, "id", F.col("name"), 0.3).select(F.col("a").alias("supplier"), F.col("b").alias("person"), F.round("similarity", 2).alias("similarity"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return rows.join(won, "supplier", "left").select("supplier", "person", "similarity", zero("n"), zero("amount")).orderBy(F.desc("amount"), F.desc("similarity"), "supplier", "person")


@job(ctes("award") + """, r AS (SELECT *, max(CASE WHEN status = 'valid' THEN 1 ELSE 0 END) OVER (PARTITION BY awardee, object) AS any_valid, row_number() OVER (PARTITION BY awardee, object ORDER BY day ASC NULLS LAST, id) AS k FROM award)
SELECT id, CASE WHEN any_valid = 1 THEN 'valid' ELSE status END AS status FROM r WHERE k = 1""")
def awards_once(spark, sf_dir):
    """The first publication of each award, valid if any of them was."""
    return records.first_publication(view(spark, sf_dir, "award"), aw.fingerprint_of(F.lit(None), "awardee", F.lit(None), "object"), "day", "id", "status").select("id", "status")


@job(ctes("award") + """, k AS (SELECT DISTINCT awardee, object FROM award WHERE id % 10 = 1), r AS (SELECT * FROM award a WHERE id % 10 > 1 AND authority <> 'FRANCE' AND NOT EXISTS (SELECT 1 FROM k WHERE k.awardee = a.awardee AND k.object = a.object))
SELECT id FROM r QUALIFY row_number() OVER (PARTITION BY awardee, object ORDER BY day, id) = 1""")
def awards_admitted(spark, sf_dir):
    award = view(spark, sf_dir, "award").withColumn("object", F.when(F.col("authority") != "FRANCE", F.col("object")))
    whole = view(spark, sf_dir, "award").where("id % 10 = 1")
    return consolidation.admitted(award.where("id % 10 > 1"), whole, aw.fingerprint_of(F.lit(None), "awardee", F.lit(None), "object"), [F.col("day"), F.col("id")]).select("id")


@job(ctes("paper") + """SELECT id FROM (SELECT *, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM paper) QUALIFY row_number() OVER (PARTITION BY source, url, lang ORDER BY rank, id) = 1""")
def entities_over_versions(spark, sf_dir):
    """Of what the versions of a paper say alike, the entry with the best status."""
    rows = view(spark, sf_dir, "paper").withColumn("status", F.when(F.col("id") % 3 == 0, records.VALID).when(F.col("id") % 3 == 1, records.REJECTED).otherwise(records.PENDING))
    return records.consolidate(rows, ["source", "url"], ["lang"], "status", F.col("id")).select("id")


@job("""WITH d AS (SELECT source, 'u' || (doc_id % 300) AS url, CASE WHEN doc_id % 23 <> 0 THEN sha256(text) END AS hash, doc_id FROM documents),
k AS (SELECT * FROM d WHERE doc_id % 2 = 0), i AS (SELECT * FROM d WHERE doc_id % 2 = 1)
SELECT url, hash, count(*) AS n FROM (SELECT DISTINCT url, hash FROM i WHERE hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.url = i.url AND k.hash = i.hash) UNION ALL SELECT url, hash FROM i WHERE hash IS NULL) GROUP BY ALL""")
def versions_stored(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.concat(F.lit("u"), F.col("doc_id") % 300).alias("url"), F.when(F.col("doc_id") % 23 != 0, F.sha2("text", 256)).alias("hash"), "doc_id")
    made = records.new_versions(d.where("doc_id % 2 = 1").select("url", "hash"), d.where("doc_id % 2 = 0"), ["url", "hash"])
    return made.groupBy("url", "hash").agg(F.count(F.lit(1)).alias("n"))


@job("""WITH k AS (SELECT lower(replace(c_name, '#', ' ')) AS key, min(c_custkey) AS id, arg_min(c_name, c_custkey) AS was FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), m AS (SELECT lower(replace(c_name, '#', ' ')) AS key, min(upper(c_name)) AS said FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT m.key, k.id, coalesce(was, said) AS name FROM m LEFT JOIN k USING (key)""")
def people_found(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    said = t(spark, sf_dir, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.upper("c_name").alias("name"))
    known = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return consolidation.people(said, known, tx.person_key(F.replace("name", F.lit("#"), F.lit("-"))))


@job("""WITH s AS (SELECT c_name AS name, c_mktsegment AS role, c_custkey % 4 <> 0 AS active FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_name AS name, upper(c_mktsegment) || '!' AS role FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(s.name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.role ELSE s.role END AS role, n.name IS NOT NULL AS active,
CASE WHEN s.name IS NULL THEN 'added' WHEN n.name IS NULL AND s.active THEN 'left' WHEN n.name IS NOT NULL AND NOT s.active THEN 'back' ELSE 'none' END AS change FROM s FULL JOIN n ON s.name = n.name""")
def members_synchronised(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    state = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), (F.col("c_custkey") % 4 != 0).alias("active"))
    return consolidation.synchronised(state, c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("role")), "name")


@job()
def tenures_folded(spark, sf_dir):
    ready(spark)
    return consolidation.tenures(view(spark, sf_dir, "appointment").withColumn("published", F.col("day")), view(spark, sf_dir, "structure"))


PIECES = """SELECT item_id * 2 AS id, 'b' AS kind, 0 AS rank, text, CASE WHEN item_id % 4 <> 0 THEN length(text) * 1000 END AS amount, CASE WHEN item_id % 3 <> 0 THEN concat('s', CAST(item_id % 2 AS VARCHAR)) END AS sector, CASE WHEN item_id % 5 <> 0 THEN DATE '2024-01-01' END AS day FROM benchmark
UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, 'c', 1, text, CASE WHEN turn % 4 <> 0 THEN length(text) * 1000 END, CASE WHEN conv_id % 3 <> 0 THEN concat('s', CAST(conv_id % 2 AS VARCHAR)) END, CASE WHEN conv_id % 2 = 0 THEN DATE '2023-01-01' ELSE DATE '2025-01-01' END FROM conversations"""


@job(f"""WITH q AS ({PIECES}), p AS (SELECT id, kind, rank, amount, sector, day, {TOKENS} AS tokens FROM q),
e AS (SELECT id, kind, unnest(tokens) AS token FROM p), n AS (SELECT count(*) AS n FROM p),
w AS (SELECT token, count(*) AS df, round(ln((SELECT n FROM n) / (1 + count(*))), 6) AS idf FROM e GROUP BY token),
x AS (SELECT e.*, df, idf, greatest(idf, 0) AS w FROM e JOIN w USING (token)), m AS (SELECT id, sum(w) AS m FROM x GROUP BY id),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.token = b.token AND a.id < b.id AND a.kind <> b.kind AND a.df <= 60 AND b.df <= 60),
s AS (SELECT c.a, c.b, sum(x.w) AS s, count(*) AS common, max(x.idf) AS rarest, arg_max(x.token, (x.idf, x.token)) AS telling FROM c JOIN x ON x.id = c.a JOIN x y ON y.id = c.b AND y.token = x.token GROUP BY ALL),
f AS (SELECT s.*, round(CASE WHEN p.m + q.m > 0 THEN 2 * s / (p.m + q.m) ELSE 0 END, 4) AS base FROM s JOIN m p ON p.id = s.a JOIN m q ON q.id = s.b),
g AS (SELECT f.*, u.amount AS ma, v.amount AS mb, greatest(u.amount, v.amount) / nullif(least(u.amount, v.amount), 0) AS r, u.sector AS sa, v.sector AS sb, CASE WHEN u.rank <= v.rank THEN u.day ELSE v.day END AS early, CASE WHEN u.rank <= v.rank THEN v.day ELSE u.day END AS late FROM f JOIN p u ON u.id = f.a JOIN p v ON v.id = f.b),
h AS (SELECT *, (base + coalesce(CASE WHEN coalesce(ma, 0) = 0 OR coalesce(mb, 0) = 0 THEN NULL ELSE 0.15 * (CASE WHEN r <= 1.1 THEN 1 WHEN r >= 10 THEN 0 ELSE 1 - (r - 1.1) / 8.9 END - 0.5) END, 0) - CASE WHEN late < early THEN 0.10 ELSE 0 END
+ CASE WHEN sa IS NULL OR sb IS NULL THEN 0 WHEN sa = sb THEN 0.05 ELSE -0.10 END) * CASE WHEN rarest >= ln(1 / 0.015) THEN 1 ELSE 0.6 END AS total FROM g)
SELECT a, b, round(greatest(0, least(1, total)), 4)::DOUBLE AS score, common, CASE WHEN rarest >= ln(1 / 0.015) THEN telling END AS telling FROM h WHERE round(greatest(0, least(1, total)), 4) >= 0.05""")
def project_scores(spark, sf_dir):
    q = spark.sql(PIECES.replace("VARCHAR", "STRING").replace("FROM benchmark", "FROM {b}").replace("FROM conversations", "FROM {c}"), b=t(spark, sf_dir, "benchmark"), c=t(spark, sf_dir, "conversations"))
    pieces = q.withColumn("tokens", tx.tokens("text")).drop("text")
    return linkage.project_scores(pieces, linkage.idf(pieces), 0.05)


@job("""SELECT source AS title, 'http://h/' || doc_id AS link, DATE '2024-03-05' AS published, sha256('http://h/' || doc_id || '|' || source) AS hash FROM documents WHERE doc_id % 3 <> 0""")
def feed_documents(spark, sf_dir):
    item = F.concat(F.lit("<item><title>"), F.col("source"), F.lit("</title>"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("<link>http://h/"), F.col("doc_id").cast("string"), F.lit("</link>"))).otherwise(F.lit("")), F.when(F.col("doc_id") % 2 == 0, "<pubDate>Tue, 5 Mar 2024 10:00:00 +0000</pubDate>").otherwise("<updated>2024-03-05T10:00:00Z</updated>"), F.lit("</item>"))
    # 20 documents a feed
    rows = t(spark, sf_dir, "documents").withColumn("item", item).groupBy(F.floor(F.col("doc_id") / 20)).agg(F.array_join(F.array_sort(F.collect_list("item")), "").alias("items"))
    xml = rows.select(F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("xml"))
    return feeds.rss_documents(xml).drop("description")


@job("""WITH p AS (SELECT doc_id, doc_id // 20 AS page, 'http://h/' || doc_id AS url, source AS title, sha256(doc_id || '|' || lang) AS hash FROM documents), f AS (SELECT * FROM p WHERE doc_id % 7 <> 0 AND doc_id < 160)
SELECT page, url, title, DATE '2024-03-05' AS published, hash FROM f WHERE page < coalesce((SELECT min(page) FROM (SELECT DISTINCT doc_id // 20 AS page FROM documents) a WHERE page NOT IN (SELECT page FROM f)), 1000000)""")
def paged_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    post = F.to_json(F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("http://h/"), F.col("doc_id")).alias("link"), F.col("lang").alias("modified"), F.lit("2024-03-05T10:00:00").alias("date"), F.struct(F.col("source").alias("rendered")).alias("title"), F.struct(F.lit("x").alias("rendered")).alias("content"), F.array(F.col("doc_id") % 4).alias("categories")))
    pages = d.select(F.floor(F.col("doc_id") / 20).alias("page"), post.alias("post")).groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("post")), ","), F.lit("]")).alias("json"))
    known = d.where("doc_id % 7 = 0 OR doc_id >= 160").select(F.concat(F.lit("http://h/"), F.col("doc_id")).alias("url"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang"), 256).alias("hash"))
    return feeds.paged_documents(pages, known).select("page", "url", "title", "published", "hash")


@job("""SELECT doc_id AS id, source AS title, CASE lang WHEN 'en' THEN 'law' WHEN 'fr' THEN 'decree' ELSE 'other' END AS kind, CASE WHEN doc_id % 2 = 0 THEN DATE '2024-03-05' END AS published, sha256(doc_id || '|' || lang) AS hash, '{"number":"' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"date":"2024-03-05"' ELSE '' END || '}' AS meta FROM documents""")
def legal_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    text = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("type"), F.col("lang").alias("lastModified"), F.struct(F.col("doc_id").cast("string").alias("number"), F.when(F.col("doc_id") % 2 == 0, F.lit("2024-03-05")).alias("date")).alias("journal")))
    pages = d.select(F.floor(F.col("doc_id") / 20).alias("page"), text.alias("text")).groupBy("page").agg(F.concat(F.lit('{"content":['), F.array_join(F.collect_list("text"), ","), F.lit("]}")).alias("json"))
    return feeds.legal_texts(pages, {"en": "law", "fr": "decree"}, "other")


@job("""SELECT DISTINCT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0""")
def places_seeded(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).alias("region"), "n_nationkey")
    there = rows.where("n_nationkey % 3 = 0").select(F.col("name"), F.col("region")).withColumn("x", F.lit(1))
    return feeds.not_seeded(rows.union(rows), there, ["name", "region"]).select("name", "region")


@job("""SELECT event_id, event_type AS object, 'x' AS kind FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, 'second', 'y' FROM events WHERE event_id % 9 <> 0 AND event_id % 2 = 0""")
def decisions_exploded(spark, sf_dir):
    """The entries of structured papers; malformed ones and entries without an object give none."""
    second = F.when(F.col("event_id") % 2 == 0, "second").otherwise("")
    text = F.when(F.col("event_id") % 9 == 0, '{"decisions": [').otherwise(F.concat(F.lit('{"decisions": [{"object": "'), F.col("event_type"), F.lit('", "kind": "x"}, {"object": "'), second, F.lit('", "kind": "y"}, {"kind": "z"}]}')))
    papers = t(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return records.exploded(papers, "event_id", "text", "decisions", "object: string, kind: string", ["object"]).drop("nth")


@job("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND value >= 0.85 THEN 'attribution' WHEN value >= 0.85 THEN 'preselection' ELSE 'unchanged' END AS nature, event_type = 'purchase' AND value >= 0.85 AS accepted FROM events""")
def verdicts_applied(spark, sf_dir):
    """What reviews change, and which pairs they accept: only verdicts of enough confidence do."""
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    rows = records.judged(e.withColumn("verdict", F.col("event_type") == "purchase"), confidence="value").withColumn("nature", F.lit("unchanged"))
    said = F.when(F.col("event_type").isin("view", "click"), "attribution").otherwise("preselection")
    return records.reviewed(rows, e.select("event_id", said.alias("said"), F.col("value").alias("confidence")), "event_id", "nature").select("event_id", "nature", "accepted")


@job("""WITH f AS (SELECT p_partkey AS id, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'Commune de ' || n_name WHEN p_partkey % 3 = 1 THEN 'nowhere ' || (p_partkey % 4) END AS place, n_nationkey, CASE WHEN p_size % 5 <> 0 THEN DATE '2024-01-01' + (p_size % 3)::INT END AS day FROM part JOIN nation ON n_nationkey = p_partkey % 25),
g AS (SELECT *, CASE WHEN p.id % 3 = 0 THEN n_nationkey::VARCHAR WHEN p.id % 3 = 1 THEN '?' || place ELSE '?' END AS spot FROM f p), k AS (SELECT * FROM g WHERE id % 10 = 0 AND id % 20 <> 0), n AS (SELECT * FROM g WHERE id % 10 <> 0)
SELECT id, CASE WHEN id % 3 = 0 THEN n_nationkey::BIGINT END AS locality FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.kind = n.kind AND k.spot = n.spot AND (n.day IS NULL OR k.day = n.day)) QUALIFY row_number() OVER (PARTITION BY kind, spot, day ORDER BY id) = 1""")
def facilities_admitted(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    place = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Commune de "), F.col("n_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("nowhere "), (F.col("p_partkey") % 4).cast("string")))
    day = F.when(F.col("p_size") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 3).cast("int")))
    rows = t(spark, sf_dir, "part").join(n, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), place.alias("place"), "n_nationkey", day.alias("day"))
    there = rows.where("id % 10 = 0").select("kind", F.when(F.col("id") % 3 == 0, F.col("n_nationkey")).alias("locality"), "place", "day", F.when(F.col("id") % 20 == 0, records.REJECTED).otherwise(records.VALID).alias("status"))
    gazetteer = n.select(F.col("n_nationkey").alias("place_id"), tx.place_key("n_name").alias("key"), F.lit(1).alias("population"))
    made = consolidation.facilities_admitted(rows.where("id % 10 <> 0"), there, gazetteer)
    return made.select("id", F.col("locality").cast("long").alias("locality"))


@job("""WITH r AS (SELECT p_partkey AS id, lower(p_name) AS key, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN '' END AS acronym FROM part), g AS (SELECT key, min(id) AS canonical, arg_min(acronym, id) FILTER (acronym <> '') AS given FROM r GROUP BY key HAVING count(*) > 1)
SELECT r.id, canonical, coalesce(nullif(c.acronym, ''), given) AS acronym FROM r JOIN g USING (key) JOIN r c ON c.id = canonical WHERE r.id <> canonical""")
def structures_merged(spark, sf_dir):
    acronym = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, "")
    return consolidation.same_names(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"), acronym.alias("acronym")))


@job(ctes("appointment") + """, a AS (SELECT id, person_id, structure_id, CASE WHEN id % 3 <> 0 THEN concat('M', structure_id % 3 + id % 2 * (structure_id % 2)) END AS number FROM appointment), g AS (SELECT person_id, number, count(*) AS n FROM a WHERE number IS NOT NULL GROUP BY ALL),
m AS (SELECT person_id, number AS main FROM g QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, number) = 1), u AS (SELECT person_id, structure_id, min(number) AS single FROM a WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT number) = 1)
SELECT a.id, a.person_id, coalesce(a.number, single, main) AS identity FROM a LEFT JOIN m USING (person_id) LEFT JOIN u ON u.person_id = a.person_id AND u.structure_id = a.structure_id""")
def homonyms_split(spark, sf_dir):
    number = F.when(F.col("id") % 3 != 0, F.concat(F.lit("M"), (F.col("structure_id") % 3 + F.col("id") % 2 * (F.col("structure_id") % 2)).cast("string")))
    return consolidation.homonyms(view(spark, sf_dir, "appointment").select("id", "person_id", "structure_id", number.alias("number")))


@job("""WITH r AS (SELECT p_partkey AS id, lower(p_name) AS key, CASE WHEN p_size % 3 = 0 THEN p_brand END AS acronym FROM part WHERE p_partkey % 4 <> 1), g AS (SELECT key, min(id) AS canonical, arg_min(acronym, id) FILTER (acronym <> '') AS given FROM r GROUP BY key HAVING count(*) > 1)
SELECT r.id, canonical, coalesce(c.acronym, given) AS acronym FROM r JOIN g USING (key) JOIN r c ON c.id = canonical WHERE r.id <> canonical""")
def structures_merged_among_roots(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("acronym"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_partkey") - 1).alias("canonical_id"))
    return consolidation.same_names(rows, "canonical_id")


@job("""WITH m AS (SELECT DISTINCT c_name AS name, CASE WHEN c_custkey % 4 < 2 THEN 'A' || c_custkey % 40 END AS acronym FROM customer), k AS (SELECT c_custkey AS id, lower(c_name) AS low, CASE WHEN c_custkey % 4 = 0 THEN 'A' || c_custkey % 40 END AS acronym FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT acronym, min(id) AS x FROM k WHERE acronym IS NOT NULL GROUP BY 1), n AS (SELECT low, min(id) AS y FROM k GROUP BY 1), r AS (SELECT name, m.acronym, coalesce(x, y) AS id FROM m LEFT JOIN a ON a.acronym = m.acronym LEFT JOIN n ON n.low = lower(name)),
g AS (SELECT lower(name) AS low, min(acronym) AS shared FROM r WHERE id IS NULL AND acronym IS NOT NULL GROUP BY 1)
SELECT name, acronym, id, CASE WHEN id IS NULL THEN coalesce(acronym, shared, lower(name)) END AS new FROM r LEFT JOIN g ON g.low = lower(name)""")
def structures_found(spark, sf_dir):
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    short = F.concat(F.lit("A"), (k % 40).cast("string"))
    known = c.where(k % 3 == 0).select(k.alias("id"), F.upper("c_name").alias("name"), F.when(k % 4 == 0, short).otherwise("").alias("acronym"))
    return consolidation.structures(c.select(F.concat(F.lit(" "), "c_name").alias("name"), F.when(k % 4 < 2, short).alias("acronym")), known)


@job("""SELECT p_partkey AS id, p_partkey % 50 AS document, CASE WHEN p_size % 2 = 0 THEN 'pont' ELSE 'x' END AS kind, p_name AS title, CASE WHEN p_size % 3 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS day, CASE WHEN p_partkey % 4 <> 3 THEN a.n_nationkey END AS place_id,
CASE WHEN p_partkey % 4 = 3 THEN 'zzz' WHEN p_partkey % 4 = 2 THEN 'Région de ' || a.n_name ELSE 'Commune de ' || a.n_name END AS place, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'R' || a.n_regionkey END AS region, CASE WHEN p_partkey % 4 <> 3 THEN a.n_nationkey::DOUBLE END AS latitude,
CASE WHEN p_size % 5 = 0 THEN b.n_name END AS arrival, CASE WHEN p_size % 5 = 0 THEN b.n_nationkey::DOUBLE END AS latitude_to, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN a.n_nationkey % 2 = 0 THEN 'commune' ELSE 'region' END AS precision,
CASE WHEN p_size % 2 = 0 THEN 'Transport & mobilité' ELSE 'Autres' END AS sector, 'pending' AS status FROM part JOIN nation a ON a.n_nationkey = p_partkey % 25 JOIN nation b ON b.n_nationkey = (p_partkey + 7) % 25""")
def facilities_from_news(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    k = F.col("p_partkey")
    one = lambda c: n.select(F.col("n_nationkey").alias(f"{c}_key"), F.col("n_name").alias(c))
    p = t(spark, sf_dir, "part").join(one("a"), k % 25 == F.col("a_key")).join(one("b"), (k + 7) % 25 == F.col("b_key"))
    place = F.when(k % 4 == 3, "zzz").when(k % 4 < 2, F.concat(F.lit("Commune de "), "a"))
    entries = p.select(k.alias("id"), (k % 50).alias("document"), F.when(F.col("p_size") % 2 == 0, "pont").otherwise("x").alias("type"), F.col("p_name").alias("title"), place.alias("place"), F.when(k % 4 == 2, F.concat(F.lit("Région de "), "a")).alias("region"), F.when(F.col("p_size") % 5 == 0, F.col("b")).when(F.col("p_size") % 5 == 1, "zzz").alias("arrival"), F.when(F.col("p_size") % 3 == 0, F.lit("2024-02-01")).cast("date").alias("day"), F.lit("2024-01-01").cast("date").alias("published"))
    gazetteer = n.select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), tx.place_key("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "commune").otherwise("region").alias("type"), F.concat(F.lit("R"), "n_regionkey").alias("region"), F.col("n_nationkey").cast("double").alias("latitude"), F.lit(0.5).alias("longitude"), F.lit(1).cast("long").alias("population"))
    return consolidation.facilities_read(entries, gazetteer).drop("longitude", "longitude_to")


def _recleaned(obj, awardee, authority, status):
    """Object, awardee, sector and status of an award after another cleaning; one whose awardee can't be used goes back to the reviewers."""
    o, a = aw.clean_object(obj), aw.clean_awardee(awardee)
    s = F.when(a.isNull() & (status == records.VALID), records.PENDING).otherwise(status)
    return F.concat_ws("|", o, F.coalesce(a, awardee), rules.sector(o, authority), s)


def _repaired(obj, text, position):
    """A suspect object gives way to its lot's heading, where there is one."""
    return F.when(aw.suspect_object(obj), F.coalesce(aw.lot_heading(text, aw.lot_number(obj), position), obj)).otherwise(obj)


def _sanitised(obj, awardee, status):
    """A published award whose object says it is none, or nothing, goes back; one with a tail loses it."""
    cut = aw.without_tail(obj)
    bad = aw.not_an_award(obj) | aw.only_repeats_company(obj, awardee) | (aw.suspect_object(obj) & cut.isNull())
    keep = F.when(aw.suspect_object(obj) & ~bad, cut).otherwise(obj)
    return F.concat_ws("|", keep, F.when(bad & (status == records.VALID), records.PENDING).otherwise(status))


def _register_cases() -> None:
    from . import cases as c

    c.cases("awards_recleaned", _recleaned, [("Objet : Achat de pneus Financement : X", "Attributaire : ETS A", None, "valid", "Achat de pneus|ETS A|Transport & véhicules|valid"), ("Achat de riz", "Acquisition de riz", None, "valid", "Achat de riz|Acquisition de riz|Fournitures & équipements|pending"), ("Achat de riz", "Acquisition de riz", None, "pending", "Achat de riz|Acquisition de riz|Fournitures & équipements|pending")])
    c.cases("objects_repaired", _repaired, [("Lot 1 est attributaire", "Lot 1 : Acquisition de tables et de bancs\n\nETS A", None, "Acquisition de tables et de bancs"), ("Achat de riz", "Lot 1 : Acquisition de tables et de bancs\n\n", None, "Achat de riz"), ("Lot 4 : 5 fcfa", "rien", None, "Lot 4 : 5 fcfa")], ["string", "string", "int"])
    c.cases("objects_sanitised", _sanitised, [("Travaux de voirie urbaine pour un montant de 3 FCFA", "A", "valid", "Travaux de voirie urbaine|valid"), ("Lot 2 infructueux", "A", "valid", "Lot 2 infructueux|pending"), ("ETS YAKNABA ET FRERES", "YAKNABA ET FRERES", "valid", "ETS YAKNABA ET FRERES|pending"), ("Achat de riz local", "A", "valid", "Achat de riz local|valid")])
    c.cases("archive_key_checked", feeds.safe_key, [("a//b/./c.pdf", "a/b/c.pdf"), ("/a/b", None), ("a/../b", None), ("", None), ("a\\b", "a/b"), (None, None)])


_register_cases()
