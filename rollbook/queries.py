"""The record queries on the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules
from .functions import text as tx
from .operators import linkage, records

SPARK, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        SPARK[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from . import cases, consolidations, exchange, journal, routes, ruled

    return SPARK | cases.SPARK | consolidations.SPARK | routes.SPARK | journal.SPARK | exchange.SPARK | ruled.SPARK


def oracle_sql() -> dict[str, str]:
    from . import cases, consolidations, exchange, journal, routes, ruled

    return SQL | cases.SQL | consolidations.SQL | routes.SQL | journal.SQL | exchange.SQL | ruled.SQL


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    """An exact sum of money, as a double."""
    return F.coalesce(F.sum(F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def fold_sql(c: str) -> str:
    return f"strip_accents({c})"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, chr(160) || chr(9) || chr(13) || chr(10), '    '), ' +', ' ', 'g'))"


@query("""SELECT event_id, user_id, event_type, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def reference_version(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return records.latest(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type", "ts", "value")


@query("""SELECT user_id, event_type, count(*) AS versions, CASE WHEN count(*) > 1 THEN max(ts) END AS last_seen FROM events GROUP BY ALL""")
def version_counts(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("versions"), F.when(F.count(F.lit(1)) > 1, F.max("ts")).alias("last_seen"))


@query("""WITH o AS (SELECT year(o_orderdate)::INT AS y, count(*) AS orders FROM orders GROUP BY 1),
l AS (SELECT year(l_shipdate)::INT AS y, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT coalesce(o.y, l.y) AS y, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines FROM o FULL JOIN l ON o.y = l.y""")
def stats_by_year(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    n = t(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("lines"))
    return o.join(n, "y", "full_outer").select("y", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""SELECT n_nationkey, n_name, count(*) AS suppliers, sum(s_acctbal::DECIMAL(18,2))::DOUBLE AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY suppliers DESC, n_nationkey LIMIT 10""")
def top_structures(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), money("s_acctbal").alias("balance"))
    n = t(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("n_nationkey", "n_name", "suppliers", "balance").orderBy(F.desc("suppliers"), "n_nationkey").limit(10)


@query("""SELECT d.doc_id, d.source, d.lang, length(coalesce(d.text, '')) AS n, coalesce(l.c, 0) AS labels, coalesce(p.c, 0) AS turns
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS c FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1) p ON p.conv_id = d.doc_id
WHERE length(coalesce(d.text, '')) >= 500 ORDER BY n DESC, d.doc_id LIMIT 20""")
def listing_with_counts(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).where("n >= 500")
    top = records.page(d, [F.desc("n"), F.col("doc_id")], 1, 20)
    made = records.with_counts(top, "doc_id", labels=(t(spark, sf_dir, "labels"), "doc_id"), turns=(t(spark, sf_dir, "conversations"), "conv_id"))
    return made.select("doc_id", "source", "lang", "n", "labels", "turns")


@query("""SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source
UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE source = 'src0' GROUP BY lang""")
def facets_documents(spark, sf_dir):
    return records.facets(t(spark, sf_dir, "documents").select("source", "lang"), {"source": "src0", "lang": "en"})


@query("""SELECT 'document' AS category, doc_id AS id FROM documents WHERE text ILIKE '%idiot%'
UNION ALL SELECT 'part', p_partkey FROM part WHERE p_name ILIKE '%steel%' OR p_type ILIKE '%steel%'
UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE text ILIKE '%steel%'
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_name ILIKE '%9%' OR c_mktsegment ILIKE '%build%'""")
def federated_search(spark, sf_dir):
    found = [
        t(spark, sf_dir, "documents").where(records.contains_any(["text"], "idiot")).select(F.lit("document").alias("category"), F.col("doc_id").alias("id")),
        t(spark, sf_dir, "part").where(records.contains_any(["p_name", "p_type"], "steel")).select(F.lit("part").alias("category"), F.col("p_partkey").alias("id")),
        t(spark, sf_dir, "benchmark").where(records.contains_any(["text"], "steel")).select(F.lit("benchmark").alias("category"), F.col("item_id").alias("id")),
        t(spark, sf_dir, "customer").where(F.col("c_name").ilike("%9%") | F.col("c_mktsegment").ilike("%build%")).select(F.lit("customer").alias("category"), F.col("c_custkey").alias("id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("""SELECT o_orderkey, c_name, o_totalprice, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_name ILIKE '%1%' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20""")
def engagements_sorted(spark, sf_dir):
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).where(F.col("c_name").ilike("%1%")).select("o_orderkey", "c_name", "o_totalprice", "o_orderdate")
    return records.page(rows, [F.desc_nulls_last("o_totalprice"), F.desc("o_orderkey")], 2, 20)


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC NULLS FIRST, c_mktsegment, o_orderpriority LIMIT 10""")
def finance_ranked(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    made = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("total"))
    # as in the source of the question, a group without any amount comes first
    return made.orderBy(F.desc_nulls_first("total"), "c_mktsegment", "o_orderpriority").limit(10)


@query("""SELECT n_name, l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def awards_stats(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    l = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("a"))
    made = l.join(s, l.l_suppkey == s.s_suppkey).groupBy("n_name", "l_returnflag")
    return made.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("suppliers"), F.sum("a").cast("double").alias("amount"))


@query("""SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount,
count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY l_suppkey""")
def supplier_cards(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return l.agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), money("l_extendedprice").alias("amount"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("""SELECT o_orderpriority, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS active, count(DISTINCT o_custkey) AS everyone,
round(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) / count(*), 6) AS share FROM orders GROUP BY 1""")
def active_headcount(spark, sf_dir):
    opened = F.col("o_orderstatus") == "O"
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct(F.when(opened, F.col("o_custkey"))).alias("active"), F.count_distinct("o_custkey").alias("everyone"), F.round(F.sum(opened.cast("int")) / F.count(F.lit(1)), 6).alias("share"))


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def in_office_former(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_anti")


@query("""SELECT y, o_orderkey, score FROM (SELECT year(o_orderdate)::INT AS y, o_orderkey,
CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 20 ELSE 10 END + (o_totalprice <> 0)::INT + (o_custkey <> 0)::INT AS score FROM orders)
QUALIFY row_number() OVER (PARTITION BY y ORDER BY score DESC, o_orderkey DESC) = 1""")
def budget_consolidation(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    law = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return records.budget_years(o, "y", law, "o_totalprice", "o_custkey", "o_orderkey").select("y", "o_orderkey", "score")


@query("""WITH a AS (SELECT year(o_orderdate)::INT AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1)
SELECT y, total, round(total / sum(total) OVER (), 6) AS share, round(total / lag(total) OVER (ORDER BY y) - 1, 6) AS variation FROM a""")
def share_and_variation(spark, sf_dir):
    a = t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(money("o_totalprice").alias("total"))
    years = Window.orderBy("y")  # a row a year
    return a.select("y", "total", F.round(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 6).alias("share"), F.round(F.col("total") / F.lag("total").over(years) - 1, 6).alias("variation"))


@query(f"""WITH k AS (SELECT doc_id, source, sha256(lower({squeeze_sql('text')})) AS fp FROM documents)
SELECT doc_id, source, fp, count(*) OVER (PARTITION BY fp) AS copies FROM k QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1""")
def dedup_fingerprint(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(tx.fingerprint("text"), 256).alias("fp"))
    return d.groupBy("fp").agg(F.min(F.struct("doc_id", "source")).alias("one"), F.count(F.lit(1)).alias("copies")).select("one.doc_id", "one.source", "fp", "copies")


@query(f"""SELECT s_suppkey AS id, lower({squeeze_sql("translate(" + fold_sql('s_name') + ", '’‘-', ''''' ')")}) AS key FROM supplier
UNION ALL SELECT doc_id, lower({squeeze_sql("translate(" + fold_sql("text") + ", '’‘-', ''''' ')")}) FROM documents""")
def person_key(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), tx.person_key("s_name").alias("key"))
    return s.unionByName(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.person_key("text").alias("key")))


@query(f"""SELECT doc_id, sha256(lower({squeeze_sql("translate(nfc_normalize(text), '’‘‛´`', '''''''''''')")})) AS key FROM documents""")
def version_key(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.version_key("text"), 256).alias("key"))


@query(f"""SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({fold_sql("p_name || ' de la Commune d' || chr(39) || p_type")}), '''-', '  '),
'\\b(commune|ville|village|province|region|departement|secteur)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '^((de|du|des|d|la|le|les|a|au|aux) )+', '')) AS key FROM part""")
def place_key(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", tx.place_key(F.concat("p_name", F.lit(" de la Commune d'"), "p_type")).alias("key"))


COMPANY_WORDS = f"list_filter(list_transform(string_split(replace(translate(lower({fold_sql('s_name')}), '’-_/', '''   '), '&', ' et '), ' '), lambda w: regexp_replace(w, '[^a-z0-9'']', '', 'g')), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT s_suppkey, {COMPANY_WORDS} AS a FROM supplier), f AS (SELECT s_suppkey, a, list_filter(a, lambda w: w NOT IN ('sarl', 'sarlu', 'suarl', 'sa', 'sau', 'sas', 'sasu', 'eurl', 'eirl', 'ei', 'gie', 'snc', 'sci', 'scp', 'scop', 'sprl', 'ltd', 'llc', 'inc', 'ste', 'societe', 'ets', 'etp', 'etablissement', 'etablissements', 'entreprise', 'entreprises', 'compagnie', 'cie')) AS b FROM w)
SELECT s_suppkey, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE a END, ' ') AS key FROM f""")
def company_key(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", tx.company_key("s_name").alias("key"))


@query("""WITH c AS (SELECT p_brand AS key, p_type AS raw, count(*) AS n FROM part GROUP BY ALL)
SELECT key, arg_max(trim(raw), (n, length(raw), raw)) AS display, sum(n)::BIGINT AS n, count(*) AS spellings FROM c GROUP BY key""")
def display_form(spark, sf_dir):
    return records.display_form(t(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("raw")), "key", "raw")


@query("""SELECT user_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END) AS event_type FROM events
GROUP BY user_id""")
def priority_pick(spark, sf_dir):
    rank = rules.priority_pick(F.col("event_type"), ["purchase", "signup", "click", "view"])
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", rank).alias("event_type"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT p_partkey AS id, {GRAMS.format(c="p_name || ' ' || p_type")} AS g FROM part),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.id < b.id AND len(a.g) >= 0.8 * len(b.g) AND len(b.g) >= 0.8 * len(a.g))
SELECT a, b, round(i / (s - i), 4) AS similarity FROM p WHERE i >= (s - i) * 0.8""")
def trigram_pairs(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return linkage.trigram_join(p, None, "p_partkey", F.concat_ws(" ", "p_name", "p_type"), 0.8)


@query(f"""WITH c AS (SELECT c_custkey AS id, {GRAMS.format(c='c_name')} AS g FROM customer), s AS (SELECT s_suppkey AS id, {GRAMS.format(c='s_name')} AS g FROM supplier),
p AS (SELECT c.id AS a, s.id AS b, len(list_intersect(c.g, s.g)) AS i, len(c.g) + len(s.g) AS s FROM c, s)
SELECT a, b, round(i / (s - i), 4) AS similarity FROM p WHERE i >= (s - i) * 0.3""")
def trigram_cross(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return linkage.trigram_join(c, s, "id", F.col("name"), 0.3)


COMMON = "(" + ", ".join(f"'{w}'" for w in tx.COMMON_WORDS) + ")"
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower({fold_sql('text')}), '[^a-z0-9+]+'), lambda w: w <> '' AND w NOT IN {COMMON} AND (length(w) >= 4 OR w IN ('cm', 'km', 'mw', 'kv', 'r5', 'r1', 'chu', 'chr', 'csps') OR regexp_matches(w, '[0-9]'))))"


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents)
SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (1 + count(*))), 6) AS idf FROM w GROUP BY token""")
def idf_tokens(spark, sf_dir):
    return linkage.idf(t(spark, sf_dir, "documents").select(tx.tokens("text").alias("tokens")))


@query(f"""WITH p AS (SELECT item_id * 2 AS id, 'b' AS kind, {TOKENS} AS tokens FROM benchmark UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1, 'c', {TOKENS} FROM conversations),
e AS (SELECT id, kind, unnest(tokens) AS token FROM p), n AS (SELECT count(*) AS n FROM p),
w AS (SELECT token, count(*) AS df, greatest(round(ln((SELECT n FROM n) / (1 + count(*))), 6), 0) AS w FROM e GROUP BY token),
x AS (SELECT e.*, df, w FROM e JOIN w USING (token)), m AS (SELECT id, sum(w) AS m FROM x GROUP BY id),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.token = b.token AND a.id < b.id AND a.kind <> b.kind AND a.df <= 60 AND b.df <= 60),
s AS (SELECT c.a, c.b, sum(x.w) AS s FROM c JOIN x ON x.id = c.a JOIN x y ON y.id = c.b AND y.token = x.token GROUP BY ALL)
SELECT s.a, s.b, round(CASE WHEN p.m + q.m > 0 THEN 2 * s / (p.m + q.m) ELSE 0 END, 4) AS score FROM s JOIN m p ON p.id = s.a JOIN m q ON q.id = s.b""")
def pair_score(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("id"), F.lit("b").alias("kind"), tx.tokens("text").alias("tokens"))
    c = t(spark, sf_dir, "conversations").select(((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("id"), F.lit("c").alias("kind"), tx.tokens("text").alias("tokens"))
    pieces = b.unionByName(c)
    return linkage.pair_scores(pieces, linkage.idf(pieces))


@query(f"""WITH RECURSIVE g AS (SELECT p_partkey AS id, {GRAMS.format(c="p_name || ' ' || p_type")} AS g FROM part),
p AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND len(a.g) >= 0.8 * len(b.g) AND len(b.g) >= 0.8 * len(a.g) AND len(list_intersect(a.g, b.g)) >= (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) * 0.8),
r AS (SELECT a AS node, a AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen)
SELECT node, min(seen) AS root FROM r GROUP BY node""")
def components(spark, sf_dir):
    ready(spark)
    return linkage.trigram_components(t(spark, sf_dir, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"), 0.8)


def ready(spark: SparkSession) -> None:
    """A checkpoint folder where the session names none and all runs in one process (tests); on a cluster it must name a shared one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        import re
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)


@query("""WITH RECURSIVE h AS (SELECT doc_id AS id, length(text) AS n, lower(text) AS t, instr(lower(text), 'license') AS p FROM documents WHERE instr(lower(text), 'license') > 0
UNION ALL SELECT id, n, t, p + 6 + instr(substr(t, p + 7), 'license') FROM h WHERE instr(substr(t, p + 7), 'license') > 0),
s AS (SELECT id, p, greatest(p - 1 - 100, 0) AS s, least(p - 1 + 120, n) AS e FROM h),
i AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY p) AS island FROM i)
SELECT id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end" FROM k GROUP BY id, island""")
def keyword_windows(spark, sf_dir):
    made = linkage.keyword_windows(t(spark, sf_dir, "documents"), "doc_id", "text", "license", 100, 120)
    return made.select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH c AS (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS last FROM events)
SELECT event_type, user_id, ts AS start, lead(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS "end" FROM c WHERE last IS NULL OR last <> user_id""")
def tenures_simple(spark, sf_dir):
    return records.tenures(t(spark, sf_dir, "events"), "event_type", "user_id", "ts", "event_id").select("event_type", "user_id", "start", "end")


@query(f"""WITH g AS (SELECT n_nationkey AS place_id, lower(n_name) AS key, n_regionkey AS population FROM nation),
k AS (SELECT DISTINCT lower(n_name) AS key FROM nation UNION SELECT DISTINCT lower(n_name) || 's' FROM nation),
e AS (SELECT k.key, g.place_id, 1.0::DOUBLE AS similarity FROM k JOIN g ON g.key = k.key QUALIFY row_number() OVER (PARTITION BY k.key ORDER BY population DESC NULLS LAST, place_id) = 1),
a AS (SELECT key, {GRAMS.format(c='key')} AS g FROM k WHERE key NOT IN (SELECT key FROM e)), b AS (SELECT *, {GRAMS.format(c='key')} AS gg FROM g),
p AS (SELECT a.key, place_id, population, len(list_intersect(a.g, b.gg)) / (len(a.g) + len(b.gg) - len(list_intersect(a.g, b.gg))) AS s FROM a, b)
SELECT * FROM e UNION ALL SELECT key, place_id, round(s, 4) FROM p WHERE s >= 0.55 QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, population DESC NULLS LAST, place_id) = 1""")
def geocode(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    key = F.lower("n_name")
    places = n.select(key.alias("key")).union(n.select(F.concat(key, F.lit("s"))))
    return linkage.geocode(places, n.select(F.col("n_nationkey").alias("place_id"), key.alias("key"), F.col("n_regionkey").alias("population")))


@query("""WITH l AS (SELECT event_type AS source, max(ts) AS last_ok FROM events WHERE value > 10 GROUP BY 1), s AS (SELECT DISTINCT event_type AS source FROM events)
SELECT s.source, last_ok, coalesce(epoch(TIMESTAMP '2024-06-01 00:00:00') - floor(epoch(last_ok)) > 48 * 3600, true) AS stale FROM s LEFT JOIN l USING (source)""")
def staleness(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    runs = e.where("value > 10").select(F.col("event_type").alias("source"), F.lit("ok").alias("status"), F.col("ts").alias("end"))
    sources = e.select(F.col("event_type").alias("source")).distinct().withColumn("cadence", F.lit("daily"))
    return records.stale(runs, sources, "2024-06-01 00:00:00", {"daily": 48}).select("source", "last_ok", "stale")


@query("""SELECT 'quality' AS kind, count(*) FILTER (quality >= 1) AS validated, count(*) FILTER (quality IS NULL OR quality < 1) AS remaining FROM labels
UNION ALL SELECT 'toxic', count(*) FILTER (toxic >= 1), count(*) FILTER (toxic IS NULL OR toxic < 1) FROM labels""")
def bulk_validate(spark, sf_dir):
    rows = t(spark, sf_dir, "labels")
    one = lambda c: rows.agg(F.count_if(F.col(c) >= 1).alias("validated"), F.count_if(F.col(c).isNull() | (F.col(c) < 1)).alias("remaining")).select(F.lit(c).alias("kind"), "validated", "remaining")
    return one("quality").unionByName(one("toxic"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS queue, count(*) AS n FROM {n}" for n in ("customer", "orders", "events", "documents", "pages", "labels")))
def queue_counts(spark, sf_dir):
    out = None
    for n in ("customer", "orders", "events", "documents", "pages", "labels"):
        part = t(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("queue"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.missing') IS NULL""")
def json_keys(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("m"))
    return e.where("k IS NOT NULL AND m IS NULL").select("event_id", F.col("k").cast("long").alias("k"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def not_in_known(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT doc_id, '<item><title>' || replace(replace(replace(source || ' & ' || lang, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><description>' ||
replace(replace(replace(substr(text, 1, 280), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</description></item>' AS item FROM documents ORDER BY doc_id DESC LIMIT 30""")
def rss_items(spark, sf_dir):
    d = t(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).limit(30)
    return d.select("doc_id", F.concat(F.lit("<item><title>"), tx.escape_xml(F.concat_ws(" & ", "source", "lang")), F.lit("</title><description>"), tx.escape_xml(F.substring("text", 1, 280)), F.lit("</description></item>")).alias("item"))


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') AS day,
coalesce(o_orderpriority, '') AS priority FROM orders""")
def csv_export(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("partial")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), F.coalesce(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("")).alias("day"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b, round(CASE WHEN r <= 1.1 THEN 1 WHEN r >= 10 THEN 0 ELSE 1 - (r - 1.1) / 8.9 END, 6) AS proximity
FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey,
LATERAL (SELECT greatest(a.o_totalprice, b.o_totalprice) / least(a.o_totalprice, b.o_totalprice) AS r)""")
def amount_proximity(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    p = o.alias("x").join(o.alias("y"), (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")))
    return p.select(F.col("x.o_orderkey").alias("a"), F.col("y.o_orderkey").alias("b"), F.round(linkage.amount_proximity(F.col("x.o_totalprice"), F.col("y.o_totalprice")), 6).alias("proximity"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'delivered' WHEN bool_or(o_orderstatus = 'P') THEN 'works' WHEN bool_or(o_orderstatus = 'O') THEN 'awarded' ELSE 'announced' END AS stage, count(*) AS n
FROM orders GROUP BY 1""")
def project_stages(spark, sf_dir):
    is_ = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(rules.project_stage(is_("F"), is_("P"), is_("O")).alias("stage"), F.count(F.lit(1)).alias("n"))
