"""The procurement journal: result tables, headings and lots, natures, projects, linear works; queries beside their SQL.

Tables and titles are laid out around the values of the driver's tables as the journal prints them; their SQL says what they were made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import awards
from .operators import facilities, fulltext, headings, projects, search, tables
from .queries import ready, t
from .views import ctes, view

SPARK, SQL = {}, {}


def query(sql: str):
    def add(f):
        SPARK[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def spaced(c):
    """A sum as it is printed: digits in threes."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def journal_tables(spark, sf_dir):
    """A table for each order: its buyer and what is bought above, its suppliers as bidders, and for even orders a line that closes it."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", F.floor(F.col("l_extendedprice") * 100).cast("long").alias("sum"))
    lines = lines.join(t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    best, nth = F.struct("sum", "l_linenumber", "l_suppkey", "l_partkey"), F.struct("l_linenumber", "l_suppkey", "l_partkey")
    each = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", best.alias("bid"), "s_name"))).alias("bids"),  # an order has seven lines at most
        F.min(best).alias("least"),
        F.min_by("s_name", best).alias("winner"),
        F.min_by("n_name", nth).alias("buyer"),
        F.min_by("p_name", nth).alias("bought"),
    )
    row = lambda *c: F.array(*[(F.lit(x) if isinstance(x, str) else x).cast("string") for x in c])
    won = lambda b: b["bid"] == F.col("least")
    bids = F.transform("bids", lambda b: row(F.concat(F.lit("Lot 1 : "), b["s_name"], F.lit(" / Tél : 25 30")), spaced(b["bid"]["sum"]), F.when(won(b), "Conforme\n1er").otherwise("Non conforme")))
    head = F.array(
        row(F.concat(F.lit("MINISTERE DE "), F.upper("buyer")), F.lit(None), F.lit(None)),
        row(F.concat(F.lit("Demande de prix n°"), F.col("l_orderkey"), F.lit(" pour Acquisition de "), F.col("bought")), F.lit(None), F.lit(None)),
        row(F.lit(None), "", F.lit(None)),
        row("Soumissionnaires", "Montant lu", "Appréciation"),
    )
    closing = F.array(row(F.concat(F.lit("Attributaire : "), F.col("winner"), F.lit(" pour un montant de tant de francs ("), spaced(F.col("least.sum")), F.lit(") FCFA")), F.lit(None), F.lit(None)))
    cells = F.concat(head, bids, F.when(F.col("l_orderkey") % 2 == 0, closing).otherwise(F.array().cast("array<array<string>>")))
    return each.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 500).alias("issue"), cells.alias("cells"))


RESULTS = """WITH l AS (SELECT l_orderkey, s_name, n_name, p_name, floor(l_extendedprice * 100)::BIGINT AS s, (floor(l_extendedprice * 100)::BIGINT, l_linenumber, l_suppkey, l_partkey) AS bid, (l_linenumber, l_suppkey, l_partkey) AS nth FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey),
r AS (SELECT l_orderkey AS id, l_orderkey % 500 AS issue, 'MINISTERE DE ' || upper(arg_min(n_name, nth)) AS authority, left(trim('Demande de prix n°' || l_orderkey || ' pour Acquisition de ' || arg_min(p_name, nth)), 106) AS reference,
'Acquisition de ' || arg_min(p_name, nth) AS object, arg_min(s_name, bid) AS awardee, min(s) AS amount FROM l GROUP BY l_orderkey),
w AS (SELECT * FROM r WHERE amount BETWEEN 100000 AND 500000000000)"""


@query(RESULTS + " SELECT * FROM w")
def table_awards(spark, sf_dir):
    return tables.awards(journal_tables(spark, sf_dir))


@query(RESULTS + " SELECT issue, min(id) AS id, awardee, amount FROM w GROUP BY issue, awardee, amount")
def table_awards_once(spark, sf_dir):
    return tables.once(tables.awards(journal_tables(spark, sf_dir)), "issue", "id").select("issue", "id", "awardee", "amount")


@query("""SELECT id, CASE WHEN m IS NULL AND k IN (0, 1, 2) THEN 'preselection' ELSE 'attribution' END AS nature, CASE WHEN m IS NOT NULL AND k = 0 AND st = 'valid' THEN 'pending' ELSE st END AS status
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 6 AS k, CASE WHEN l_quantity >= 20 THEN l_partkey END AS m, CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'rejected' END AS st FROM lineitem)""")
def award_natures(spark, sf_dir):
    k = F.col("l_linenumber") % 6
    rows = t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_quantity") >= 20, F.col("l_partkey")).alias("amount"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("rejected").alias("status"),
        F.when(k == 0, "Manifestation d’INTÉRÊT n°3").when(k == 4, "Manifestation du 3 mai").alias("reference"), F.when(k == 1, F.concat(F.lit("Préqualification de "), F.col("l_comment") if "l_comment" in t(spark, sf_dir, "lineitem").columns else F.lit("bureaux"))).when(k == 5, "Qualification").alias("object"), F.when(k == 2, "avis de pré-qualification").alias("mode"),
    )
    return rows.select("id", awards.nature_of("reference", "object", "mode", "amount").alias("nature"), awards.status_of("reference", "object", "mode", "amount", "status").alias("status"))


LINES = """WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS p FROM documents)),
l AS (SELECT doc_id, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM s),
h AS (SELECT doc_id, place, CASE WHEN place % 5 = 0 THEN 'Régions :' ELSE line END AS name, place % 5 = 0 AS rubric, CASE WHEN place % 3 = 0 THEN 0.4 ELSE 0.9 END AS confidence FROM l WHERE length(line) BETWEEN 1 AND 30),
r AS (SELECT doc_id, place, CASE WHEN place % 7 = 0 THEN 'known' END AS authority FROM l WHERE length(line) > 60)"""


def sections(spark, sf_dir):
    """(headings, records) of the documents: short sentences stand for headings, every fifth place for a section of the journal; long ones for records."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.explode(headings.lines_of(F.coalesce("text", F.lit("")), ". ")).alias("l")).select("doc_id", F.col("l.at").alias("place"), "l.line")
    rubric = F.col("place") % 5 == 0
    head = lines.where(F.length("line").between(1, 30)).select("doc_id", "place", F.when(rubric, "Régions :").otherwise(F.col("line")).alias("name"), F.when(F.col("place") % 3 == 0, 0.4).otherwise(0.9).alias("confidence"))
    return head, lines.where(F.length("line") > 60).select("doc_id", "place", F.when(F.col("place") % 7 == 0, "known").alias("authority"))


@query(LINES + " SELECT r.doc_id, r.place, h.name AS heading, h.place AS heading_place FROM r ASOF LEFT JOIN h ON r.doc_id = h.doc_id AND r.place >= h.place")
def headings_before(spark, sf_dir):
    head, rows = sections(spark, sf_dir)
    return headings.governed(rows.drop("authority"), head, by="doc_id", at="place", name="name").withColumnRenamed("heading_at", "heading_place")


@query(LINES + """, a AS (SELECT r.*, h.name, h.confidence FROM r ASOF LEFT JOIN (SELECT * FROM h WHERE NOT rubric) h ON r.doc_id = h.doc_id AND r.place >= h.place),
b AS (SELECT a.*, k.place IS NOT NULL AS section FROM a ASOF LEFT JOIN (SELECT * FROM h WHERE rubric) k ON a.doc_id = k.doc_id AND a.place >= k.place)
SELECT doc_id, place, coalesce(authority, CASE WHEN confidence >= 0.6 THEN name END) AS authority, CASE WHEN authority IS NOT NULL THEN 'kept' WHEN confidence >= 0.6 THEN 'filled' WHEN name IS NOT NULL THEN 'doubt' WHEN section THEN 'rubric' ELSE 'not found' END AS outcome FROM b""")
def authorities_completed(spark, sf_dir):
    head, rows = sections(spark, sf_dir)
    return headings.completed(rows, head, by="doc_id", at="place", name="name", confidence="confidence")[0]


PIECES = """CASE p_partkey % 3 WHEN 0 THEN 'engagement' WHEN 1 THEN 'marche' ELSE 'realisation' END AS kind, p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN p_partkey // 11 END AS project_id,
p_name AS label, CASE WHEN p_size % 4 = 0 THEN p_brand END AS sector, CASE WHEN p_size % 3 = 0 THEN p_type END AS region FROM part WHERE p_partkey % 13 <> 5"""
#: Pairs of neighbours, so that components are runs of part keys.
PROJECTS = f"""WITH piece AS (SELECT {PIECES}), e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_size % 5 < 2),
n AS (SELECT a AS k FROM e UNION SELECT b FROM e), runs AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM n),
linked AS (SELECT n.k, sum(CASE WHEN e.b IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY n.k) AS root FROM n LEFT JOIN e ON e.b = n.k),
c AS (SELECT root, count(*) AS n, min(project_id) AS old, count(DISTINCT project_id) > 1 AS conflict, min(piece.id * 4 + CASE kind WHEN 'engagement' THEN 1 WHEN 'marche' THEN 2 ELSE 3 END) AS first FROM linked JOIN piece ON piece.id = k GROUP BY root HAVING count(*) >= 2),
g AS (SELECT *, coalesce(old, (SELECT max(project_id) FROM piece) + row_number() OVER (PARTITION BY old IS NULL ORDER BY first)) AS project FROM c)"""


def pieces_and_pairs(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = lambda x: F.when(x % 3 == 0, "engagement").when(x % 3 == 1, "marche").otherwise("realisation")
    pieces = part.where(k % 13 != 5).select(kind(k).alias("kind"), k.alias("id"), F.when(k % 11 == 0, F.floor(k / 11).cast("long")).alias("project_id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("sector"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("region"))
    said = F.when(F.col("p_size") % 5 == 0, " Oui ").when(F.col("p_size") % 5 == 1, "x").when(F.col("p_size") % 5 == 2, "non").otherwise("")
    return pieces, part.select(said.alias("apply"), kind(k).alias("kind_a"), k.alias("id_a"), kind(k + 1).alias("kind_b"), (k + 1).alias("id_b"))


KINDS = ["engagement", "marche", "realisation"]


@query(PROJECTS + " SELECT kind, piece.id, coalesce(g.project, piece.project_id)::BIGINT AS project_id FROM piece LEFT JOIN linked ON linked.k = piece.id LEFT JOIN g ON g.root = linked.root")
def projects_assigned(spark, sf_dir):
    ready(spark)
    return projects.assigned(*pieces_and_pairs(spark, sf_dir), KINDS, "engagement")[0].select("kind", "id", "project_id")


@query(PROJECTS + " SELECT kind, piece.id, coalesce(g.project, piece.project_id)::BIGINT AS project_id FROM piece LEFT JOIN linked ON linked.k = piece.id LEFT JOIN g ON g.root = linked.root")
def projects_assigned_again(spark, sf_dir):
    """A second run over what the first has made: nothing changes."""
    ready(spark)
    pieces, pairs = pieces_and_pairs(spark, sf_dir)
    first = projects.assigned(pieces, pairs, KINDS, "engagement")[0].checkpoint()
    return projects.assigned(first, pairs, KINDS, "engagement")[0].select("kind", "id", "project_id")


@query(PROJECTS + """, m AS (SELECT g.project, g.old IS NULL AS new, g.conflict, g.n, piece.*, CASE kind WHEN 'engagement' THEN 1 WHEN 'marche' THEN 2 ELSE 3 END AS r FROM g JOIN linked USING (root) JOIN piece ON piece.id = linked.k)
SELECT project::BIGINT AS project_id, left(coalesce(arg_min(label, r * 1000000000::BIGINT + id) FILTER (kind = 'engagement'), arg_max(label, length(label) * 100000000000::BIGINT - r * 10000000000::BIGINT - id)), 500) AS title,
arg_min(sector, r * 1000000000::BIGINT + id) FILTER (sector IS NOT NULL) AS sector, arg_min(region, r * 1000000000::BIGINT + id) FILTER (region IS NOT NULL) AS region, bool_and(new) AS new, bool_or(conflict) AS conflict, count(*) AS n FROM m GROUP BY project""")
def projects_made(spark, sf_dir):
    ready(spark)
    return projects.assigned(*pieces_and_pairs(spark, sf_dir), KINDS, "engagement")[1]


@query(ctes("facility") + """, f AS (SELECT id, id % 25 AS a, (id * 7 + 3) % 25 AS b, id % 4 AS k FROM facility)
SELECT f.id, a AS from_id, b AS to_id FROM f WHERE k < 3 AND a <> b""")
def linear_works(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    h = F.md5(F.col("n_name").cast("binary"))
    # every third name has a hyphen in it, so that where a title is to be cut takes looking up
    name = F.concat(F.substring(h, 1, 6), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("-"), F.substring(h, 7, 6))).otherwise(""))
    places = nation.select(F.col("n_nationkey").cast("long").alias("place_id"), name.alias("name"), F.lit(1).cast("long").alias("population"))
    work = view(spark, sf_dir, "facility").select("id", (F.col("id") % 25).alias("a"), ((F.col("id") * 7 + 3) % 25).alias("b"), (F.col("id") % 4).alias("k"))
    one = lambda c: places.select(F.col("place_id").alias(c), F.col("name").alias(f"{c}_name"))
    work = work.where("a != b").join(one("a"), "a").join(one("b"), "b")
    a, b = F.initcap("a_name"), F.initcap("b_name")
    title = F.when(F.col("k") == 0, F.concat(F.lit("Bitumage de la route "), a, F.lit("-"), b, F.lit(", lot 2"))).when(F.col("k") == 1, F.concat(F.lit("Pont entre "), a, F.lit(" et "), b)).when(F.col("k") == 2, F.concat(F.lit("Travaux de la piste rurale de "), a, F.lit(" à "), b, F.lit("."))).otherwise(F.concat(F.lit("Marché de "), a))
    return facilities.linear_ends(work.select("id", title.alias("title")), places, "id", "title").select("id", F.col("from_id").alias("from_id"), "to_id")


#: Words as SQL sees them; the stems that queries ask for are those of few words, which the SQL lists.
PLACES = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS word, len(w) AS n FROM d),
a AS (SELECT doc_id, place FROM p WHERE word IN ('license', 'licenses')),
b AS (SELECT p.doc_id, p.place FROM p JOIN p AS q ON q.doc_id = p.doc_id AND q.place = p.place + 1 AND p.word = 'apache' AND q.word IN ('license', 'licenses')),
c AS (SELECT doc_id, place FROM p WHERE word IN ('version', 'versions'))"""
FULLTEXT = 'version "apache license" -idiot'


def _index(spark, sf_dir, name):
    import uuid

    ready(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fulltext.write_index(t(spark, sf_dir, "documents"), path)
    return path


def _found(spark, sf_dir, query):
    path = _index(spark, sf_dir, "fulltext")
    return fulltext.search(fulltext.postings(spark, path, fulltext.asked(query).stems()), query)


@query(PLACES + """, e AS (SELECT doc_id, place, 0 AS g FROM c UNION ALL SELECT doc_id, place, 1 FROM b),
o AS (SELECT *, lead(place) OVER w AS np, lead(g) OVER w AS ng FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY place, g))
SELECT doc_id AS id, round(sum(0.1::DOUBLE / (1 + greatest(np - place - 1, 0))), 6) AS rank FROM o WHERE g <> ng AND doc_id NOT IN (SELECT doc_id FROM p WHERE word IN ('idiot', 'idiots', 'idiote', 'idiotes')) GROUP BY doc_id""")
def fulltext_search(spark, sf_dir):
    return _found(spark, sf_dir, FULLTEXT).select("id", F.round("rank", 6).alias("rank"))


@query(PLACES + """, e AS (SELECT doc_id, place FROM a UNION SELECT doc_id, place FROM c)
SELECT doc_id AS id, round(count(*) * 0.1::DOUBLE, 6) AS rank, min(place)::INT AS "begin" FROM e GROUP BY doc_id ORDER BY rank DESC, id LIMIT 20""")
def fulltext_either(spark, sf_dir):
    return _found(spark, sf_dir, "les licenses OR versions").select("id", F.round("rank", 6).alias("rank"), "begin").orderBy(F.desc("rank"), "id").limit(20)


@query(PLACES + """, r AS (SELECT doc_id, count(*) AS k, min(place) AS place FROM a GROUP BY doc_id ORDER BY k DESC, doc_id LIMIT 8)
SELECT r.doc_id AS id, array_to_string(list_transform(x[greatest(place - 6, 0) + 1 : greatest(place - 6, 0) + 28], lambda w: CASE WHEN lower(w) IN ('license', 'licenses') THEN '<mark>' || w || '</mark>' ELSE w END), ' ') AS headline
FROM r JOIN (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS x FROM documents) USING (doc_id)""".replace("\\\\", "\\"))
def fulltext_headlines(spark, sf_dir):
    found = _found(spark, sf_dir, "licenses").orderBy(F.desc("rank"), "id").limit(8)
    return fulltext.headlines(found, t(spark, sf_dir, "documents")).select("id", "headline")


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%apache%icense%' OR source ILIKE '%apache%icense%'")
def contained_by_index(spark, sf_dir):
    import uuid

    ready(spark)
    d = t(spark, sf_dir, "documents")
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/grams-{uuid.uuid4().hex}"
    search.write_gram_index(d, path, "doc_id", ["text", "source"])
    return search.containing(d, path, "doc_id", ["text", "source"], "apache%icense").select("doc_id", "source")
