"""Read routes: functions over the record tables, with filters, pages and totals, and a query of each on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.offices import FUNCTIONS, OTHER_FUNCTION, function_category, institution_type, portfolio
from .functions.papers import rfc822
from .operators import institutions, records
from .operators.search import matches, ranked
from .views import ctes, display_name, view

SPARK, SQL = {}, {}


def route(*names: str, sql: str | None = None):
    """Register a function of these views as a query, beside SQL that begins with the views."""

    def add(f):
        SPARK[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = ctes(*names) + ("," if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")
        return f

    return add


def money(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def year_is(c: str, year: int | None) -> Column:
    """A year filter; none, or 0, filters nothing. As a range, which reaches the scan."""
    if not year:
        return F.lit(True)
    return (F.col(c) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(c) < F.lit(f"{year + 1}-01-01").cast("date"))


def awards_shown(award: DataFrame, *, q: str | None = None, sector: str | None = None, region: str | None = None, year: int | None = None, nature: str | None = None) -> DataFrame:
    """Awards that passed review; preselections only if all natures are asked for."""
    rows = records.published(award)
    if nature != "all":
        rows = rows.where(F.col("nature") == (nature or "attribution"))
    if q:
        rows = rows.where(records.contains_any(["object", "awardee", "authority"], q))
    for name, value in (("sector", sector), ("region", region)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows.where(year_is("day", year))


#: The orders that a request may name.
AWARD_ORDER = {"amount": ["amount"], "date": ["day"], "name": ["awardee"]}


def awards_page(award: DataFrame, *, sort: str = "date", number: int = 1, size: int = 20, **filters) -> tuple[DataFrame, DataFrame]:
    """A page of awards in the order that is asked for (ascending for names, else descending, nulls last), and how many there are."""
    rows = awards_shown(award, **filters)
    order = [F.col(c).asc_nulls_last() if sort == "name" else F.col(c).desc_nulls_last() for c in AWARD_ORDER.get(sort, AWARD_ORDER["date"])]
    return records.page(rows, [*order, F.col("id").desc()], number, size), rows.agg(F.count(F.lit(1)).alias("total"))


@route("award", sql="""SELECT id, object, awardee, amount, day FROM award WHERE status = 'valid' AND nature = 'attribution' AND (object ILIKE '%a%' OR awardee ILIKE '%a%' OR authority ILIKE '%a%') AND region = 'ASIA' AND year(day) = 1996
ORDER BY amount DESC NULLS LAST, id DESC LIMIT 10 OFFSET 10""")
def route_awards(award):
    return awards_page(award, q="a", region="ASIA", year=1996, sort="amount", number=2, size=10)[0].select("id", "object", "awardee", "amount", "day")


@route("award", sql="""SELECT count(*) AS total FROM award WHERE status = 'valid' AND year(day) = 1995""")
def route_awards_total(award):
    return awards_page(award, nature="all", year=1995)[1]


@route("award", "company", sql="""SELECT coalesce(c.canonical_id, c.id) AS company_id, count(*) AS n, count(DISTINCT authority) AS authorities, coalesce(sum(amount), 0)::BIGINT AS amount, min(day) AS first, max(day) AS last
FROM award JOIN company c ON c.id = supplier_id WHERE status = 'valid' AND nature = 'attribution' GROUP BY 1 ORDER BY amount DESC, company_id LIMIT 50""")
def route_suppliers(award, company):
    """Suppliers by what they won: spellings count for the one that they are the same as."""
    same = company.select(F.col("id").alias("supplier_id"), F.coalesce("canonical_id", "id").alias("company_id"))
    made = awards_shown(award).join(same, "supplier_id").groupBy("company_id")
    made = made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("authority").alias("authorities"), money("amount").alias("amount"), F.min("day").alias("first"), F.max("day").alias("last"))
    return records.page(made, [F.desc("amount"), F.col("company_id")], 1, 50)


@route("award", "company", sql="""SELECT a.id, a.name, coalesce(b.name, a.name) AS shown, (SELECT count(*) FROM award w WHERE w.supplier_id = a.id) AS n FROM company a LEFT JOIN company b ON b.id = coalesce(a.canonical_id, a.id)""")
def route_supplier_names(award, company):
    """Each spelling with the name that it is shown under (one step along the pointer) and its number of awards."""
    b = company.select(F.col("id").alias("cid"), F.col("name").alias("shown"))
    rows = company.withColumn("cid", F.coalesce("canonical_id", "id")).join(b, "cid", "left").select("id", "name", F.coalesce("shown", "name").alias("shown"))
    return records.with_counts(rows, "id", n=(award, "supplier_id"))


@route("award", sql="""SELECT 'sector' AS facet, sector AS value FROM award WHERE status = 'valid' GROUP BY ALL UNION ALL SELECT 'region', region FROM award WHERE status = 'valid' GROUP BY ALL
UNION ALL SELECT 'year', year(day)::VARCHAR FROM award WHERE status = 'valid' GROUP BY ALL""")
def route_award_options(award):
    """What the filters offer, whatever is filtered at the moment."""
    rows = records.published(award)
    parts = [rows.select(F.lit(n).alias("facet"), c.cast("string").alias("value")).distinct() for n, c in (("sector", F.col("sector")), ("region", F.col("region")), ("year", F.year("day")))]
    return parts[0].union(parts[1]).union(parts[2])


@route("award", sql="""SELECT sector, coalesce(sum(amount) FILTER (nature = 'attribution'), 0)::BIGINT AS amount, count(*) FILTER (nature = 'attribution') AS n, count(*) FILTER (nature = 'preselection') AS preselections,
count(*) FILTER (year(day) NOT IN (1993, 1994)) AS other_years, list_sort(list(DISTINCT region)) AS regions FROM award WHERE status = 'valid' AND trim(object) <> '' GROUP BY sector""")
def route_award_sectors(award):
    rows = records.published(award).where(F.trim("object") != "")
    bought = F.col("nature") == "attribution"
    made = rows.groupBy("sector").agg(F.coalesce(F.sum(F.when(bought, F.col("amount"))), F.lit(0)).cast("long").alias("amount"), F.count_if(bought).alias("n"), F.count_if(F.col("nature") == "preselection").alias("preselections"), F.count_if(~F.year("day").isin(1993, 1994)).alias("other_years"), F.array_sort(F.collect_set("region")).alias("regions"))
    return made


@route("paper", sql="""+ r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY published DESC NULLS LAST, id DESC) AS k, count(*) OVER (PARTITION BY source, url) AS versions FROM paper)
SELECT id, kind, published, versions, file IS NOT NULL AS has_file, substr(coalesce(nullif(json_extract_string(meta, '$.description'), ''), text), 1, 280) AS summary FROM r
WHERE k = 1 AND kind IN ('report', 'law') AND length(text) >= 500 AND NOT regexp_matches(text, '(?i)apache license') ORDER BY published DESC NULLS LAST, id DESC LIMIT 40""")
def route_papers(paper):
    """The newest versions of papers of two kinds that have enough text of their own, latest first, with a summary."""
    w = Window.partitionBy("source", "url")
    rows = records.latest(paper.withColumn("versions", F.count(F.lit(1)).over(w)), ["source", "url"], [F.col("published").desc_nulls_last(), F.col("id").desc()])
    rows = rows.where(F.col("kind").isin("report", "law") & (F.length("text") >= 500) & ~F.col("text").rlike("(?i)apache license"))
    summary = F.substring(F.coalesce(F.nullif(F.get_json_object("meta", "$.description"), F.lit("")), F.col("text")), 1, 280)
    rows = records.page(rows, [F.col("published").desc_nulls_last(), F.col("id").desc()], 1, 40)
    return rows.select("id", "kind", "published", "versions", F.col("file").isNotNull().alias("has_file"), summary.alias("summary"))


@route("paper", sql="""SELECT id, published, row_number() OVER (PARTITION BY source, url ORDER BY published NULLS FIRST, id) AS version, lag(id) OVER (PARTITION BY source, url ORDER BY published NULLS FIRST, id) AS before FROM paper""")
def route_history(paper):
    """The versions of each paper, oldest first, undated ones before all."""
    w = Window.partitionBy("source", "url").orderBy(F.col("published").asc_nulls_first(), "id")
    return paper.select("id", "published", F.row_number().over(w).cast("long").alias("version"), F.lag("id").over(w).alias("before"))


@route("paper", sql="""SELECT id FROM paper WHERE json_extract_string(meta, '$.pdf') = 'scan' AND file IS NOT NULL AND kind NOT IN ('news') ORDER BY CASE kind WHEN 'law' THEN 0 WHEN 'report' THEN 1 ELSE 9 END, published DESC NULLS LAST, id LIMIT 40""")
def route_pending_scans(paper):
    """The next batch of scans to be read: laws first, then reports, the newest of each first."""
    rows = paper.where((F.get_json_object("meta", "$.pdf") == "scan") & F.col("file").isNotNull() & ~F.col("kind").isin("news"))
    rank = F.when(F.col("kind") == "law", 0).when(F.col("kind") == "report", 1).otherwise(9)
    return rows.orderBy(rank, F.col("published").desc_nulls_last(), "id").limit(40).select("id")


@route("paper", sql="""SELECT id FROM paper WHERE lower(strip_accents(concat_ws(' ', source, lang, text))) LIKE '%idiot%license%' OR lower(strip_accents(concat_ws(' ', source, lang, text))) LIKE 'src1 de%'""")
def route_folded_like(paper):
    base = F.lower(tx.fold(F.concat_ws(" ", "source", "lang", "text")))
    return paper.where(base.like("%idiot%license%") | base.like("src1 de%")).select("id")


@route("paper", sql="""SELECT id, regexp_replace(substr(text, 1, 600), 'the|license', '*', 'gi') AS text FROM paper""")
def route_masked(paper):
    return paper.select("id", F.regexp_replace(F.substring("text", 1, 600), "(?iu)the|license", "*").alias("text"))


@route("paper", sql="""+ i AS (SELECT * FROM paper WHERE kind = 'news' ORDER BY published DESC NULLS LAST, id DESC LIMIT 30), c AS (SELECT id, published, '<item><title>' || replace(replace(replace(source || ' & ' || lang, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><guid isPermaLink="false">' || id || '</guid><description>'
|| replace(replace(replace(substr(text, 1, 280), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</description>' || coalesce('<pubDate>' || strftime(published, '%a, %d %b %Y') || ' 12:00:00 +0000</pubDate>', '') || '</item>' AS item FROM i)
SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>News</title><language>fr</language>' || string_agg(item, '' ORDER BY published DESC NULLS LAST, id DESC) || '</channel></rss>' AS feed FROM c""")
def route_feed(paper):
    """An RSS 2.0 channel of the latest news."""
    rows = records.page(paper.where("kind = 'news'"), [F.col("published").desc_nulls_last(), F.col("id").desc()], 1, 30)
    return feed(rows, "News", F.concat_ws(" & ", "source", "lang"), F.col("id"), F.substring("text", 1, 280), "published")


def feed(rows: DataFrame, title: str, name: Column, guid: Column, summary: Column, date: str) -> DataFrame:
    """One row with the whole channel; ``rows`` are few (a feed has some dozen items). Undated items have no date."""
    item = F.concat(F.lit("<item><title>"), tx.escape_xml(name), F.lit('</title><guid isPermaLink="false">'), guid.cast("string"), F.lit("</guid><description>"), tx.escape_xml(summary), F.lit("</description>"), F.coalesce(F.concat(F.lit("<pubDate>"), rfc822(date), F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    order = F.struct(F.col(date).isNull().alias("undated"), (-F.unix_date(F.col(date))).alias("day"), (-guid).alias("last"), item.alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["item"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><language>fr</language>'
    return rows.agg(F.concat(F.lit(head), items, F.lit("</channel></rss>")).alias("feed"))


@route("structure", "tenure", sql="""+ c AS (SELECT s.id, s.name, r.id AS root, r.name AS root_name, coalesce(nullif(r.acronym, ''), r.name) AS shown FROM structure s JOIN structure r ON r.id = coalesce(s.canonical_id, s.id))
SELECT root AS id, any_value(shown) AS shown, count(DISTINCT CASE WHEN done IS NULL THEN person_id END) AS current, count(DISTINCT person_id) AS people, max(begin) AS latest,
round(sum(CASE WHEN post = 'Administrateur' THEN 1 ELSE 0 END) / count(*), 6) AS board_share, list_sort(list(DISTINCT c.id)) AS variants FROM tenure t JOIN c ON c.id = t.structure_id GROUP BY root""")
def route_institutions(structure, tenure):
    """Institutions with who serves and served there, names that are the same put together."""
    root = structure.select(F.col("id").alias("root"), display_name().alias("shown"))
    same = structure.select(F.col("id").alias("structure_id"), F.coalesce("canonical_id", "id").alias("root")).join(root, "root")
    rows = tenure.drop("id").join(F.broadcast(same), "structure_id").groupBy("root")
    made = rows.agg(F.first("shown").alias("shown"), F.count_distinct(F.when(F.col("done").isNull(), F.col("person_id"))).alias("current"), F.count_distinct("person_id").alias("people"), F.max("begin").alias("latest"), F.round(F.sum((F.col("post") == "Administrateur").cast("int")) / F.count(F.lit(1)), 6).alias("board_share"), F.array_sort(F.collect_set("structure_id")).alias("variants"))
    return made.withColumnRenamed("root", "id")


#: The order in which kinds of institutions are shown.
KINDS = ["ministere", "institution", "juridiction", "territoriale", "police", "diplomatique", "etablissement"]


@route("structure", "tenure", sql="""+ k AS (SELECT id, name, CASE WHEN name LIKE 'Ministère%' THEN 'ministere' WHEN name LIKE 'Région du %' THEN 'territoriale' ELSE 'etablissement' END AS kind FROM structure)
SELECT kind, CASE kind WHEN 'ministere' THEN 0 WHEN 'territoriale' THEN 3 ELSE 6 END AS place, count(DISTINCT k.id) AS institutions, count(DISTINCT person_id) AS people FROM k LEFT JOIN tenure ON structure_id = k.id GROUP BY ALL ORDER BY place""")
def route_institution_kinds(structure, tenure):
    """Institutions and people by kind, kinds in their fixed order."""
    kinds = structure.select("id", institution_type("name").alias("kind"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    rows = kinds.join(tenure.select("structure_id", "person_id"), F.col("structure_id") == F.col("id"), "left").groupBy("kind").agg(F.count_distinct("id").alias("institutions"), F.count_distinct("person_id").alias("people"))
    return rows.select("kind", place.alias("place"), "institutions", "people").orderBy("place")


@route("structure", "tenure", sql="""+ k AS (SELECT id, regexp_extract(lower(name), '^ministère de ([a-z]+)', 1) AS lead FROM structure WHERE name LIKE 'Ministère%')
SELECT lead AS portfolio, count(DISTINCT person_id) AS people, list_sort(list(DISTINCT k.id)) AS variants FROM k JOIN tenure ON structure_id = k.id GROUP BY lead""")
def route_portfolios(structure, tenure):
    """People of a portfolio over its successive names: everyone counts once, however many of the names had them."""
    held = structure.select(F.col("id").alias("structure_id"), portfolio("name").alias("portfolio")).where("portfolio IS NOT NULL")
    return tenure.join(held, "structure_id").groupBy("portfolio").agg(F.count_distinct("person_id").alias("people"), F.array_sort(F.collect_set("structure_id")).alias("variants"))


@route("structure", "tenure", sql="""+ t AS (SELECT coalesce(s.canonical_id, s.id) AS id, person_id, done, CASE post WHEN 'Administrateur' THEN 'Conseils d''administration' WHEN 'Conseiller' THEN 'Cabinet & conseil' ELSE 'Direction & encadrement' END AS category FROM tenure JOIN structure s ON s.id = structure_id),
p AS (SELECT id, category, person_id, bool_or(done IS NULL) AS now FROM t GROUP BY ALL)
SELECT id, category, CASE category WHEN 'Conseils d''administration' THEN 2 WHEN 'Cabinet & conseil' THEN 3 ELSE 4 END AS place, count(*) FILTER (now) AS current, count(*) FILTER (NOT now) AS former FROM p GROUP BY ALL""")
def route_institution(structure, tenure):
    """For each institution, all its names together: who serves and who served (but doesn't now) by category of function, in the fixed order."""
    root = structure.select(F.col("id").alias("structure_id"), F.coalesce("canonical_id", "id").alias("root"))
    people = tenure.join(F.broadcast(root), "structure_id").withColumn("category", function_category("post")).groupBy("root", "category", "person_id").agg(F.bool_or(F.col("done").isNull()).alias("now"))
    place = F.array_position(F.array(*[F.lit(c) for c, _ in FUNCTIONS], F.lit(OTHER_FUNCTION)), F.col("category")).cast("int") - 1
    return people.groupBy(F.col("root").alias("id"), "category").agg(F.count_if("now").alias("current"), F.count_if(~F.col("now")).alias("former")).select("id", "category", place.alias("place"), "current", "former")


@route("structure", "tenure", sql="""+ c AS (SELECT person_id FROM tenure WHERE structure_id = 3 AND done IS NULL), f AS (SELECT person_id FROM tenure WHERE structure_id = 3 AND done IS NOT NULL)
SELECT DISTINCT person_id, person_id IN (SELECT person_id FROM c) AS now FROM (SELECT * FROM c UNION SELECT * FROM f)""")
def route_agents(structure, tenure):
    """Everyone who serves or served at an institution, and whether they do now."""
    own = tenure.where("structure_id = 3")
    return own.groupBy("person_id").agg(F.bool_or(F.col("done").isNull()).alias("now"))


@route("tenure", sql="""SELECT person_id, id, post, begin, done, CASE WHEN done IS NULL THEN 0 ELSE 1 END AS former FROM tenure WHERE person_id IN (SELECT person_id FROM tenure GROUP BY 1 HAVING count(*) > 5)
ORDER BY former, begin DESC, id LIMIT 100""")
def route_careers(tenure):
    """Tenures of people with more than five: those in office first, the latest first."""
    many = tenure.groupBy("person_id").count().where("count > 5").select("person_id")
    rows = tenure.join(many, "person_id", "left_semi").withColumn("former", F.when(F.col("done").isNull(), 0).otherwise(1))
    return rows.orderBy(F.col("done").isNull().desc(), F.col("begin").desc(), "id").limit(100).select("person_id", "id", "post", "begin", "done", "former")


@route("tenure", sql="""SELECT person_id, arg_min(post, (CASE WHEN done IS NULL THEN 0 ELSE 1 END, -epoch(begin), id)) AS position, count(*) AS n FROM tenure GROUP BY person_id""")
def route_positions(tenure):
    """Each person's position: the latest that has no end, else the latest."""
    order = F.struct(F.when(F.col("done").isNull(), 0).otherwise(1).alias("a"), (-F.unix_date("begin")).alias("b"), F.col("id").alias("c"))
    return tenure.groupBy("person_id").agg(F.min_by("post", order).alias("position"), F.count(F.lit(1)).alias("n"))


@route("tenure", sql="""SELECT CASE post WHEN 'Administrateur' THEN 'Conseils d''administration' WHEN 'Conseiller' THEN 'Cabinet & conseil' ELSE 'Direction & encadrement' END AS category, count(*) AS n, count(DISTINCT person_id) AS people FROM tenure WHERE done IS NULL GROUP BY 1""")
def route_categories(tenure):
    return tenure.where(F.col("done").isNull()).groupBy(function_category("post").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("people"))


@route("appointment", "paper", sql="""SELECT a.id, person_id, coalesce(a.day, p.published) AS day, p.id AS paper FROM appointment a LEFT JOIN paper p ON p.id = a.id WHERE a.status = 'valid' ORDER BY day ASC NULLS FIRST, a.id LIMIT 100""")
def route_appointments(appointment, paper):
    """Appointments by their effective date, the paper's where none is stated, undated ones first."""
    rows = records.published(appointment).join(paper.select(F.col("id").alias("paper"), "published"), F.col("paper") == F.col("id"), "left")
    return rows.select("id", "person_id", F.coalesce("day", "published").alias("day"), "paper").orderBy(F.col("day").asc_nulls_first(), "id").limit(100)


@route("member", sql="""SELECT id, name, party, rank FROM member WHERE status = 'valid' AND active AND rank >= 0 ORDER BY rank, name LIMIT 100""")
def route_roster(member):
    return records.published(member).where("active AND rank >= 0").orderBy("rank", "name").limit(100).select("id", "name", "party", "rank")


@route("member", sql="""SELECT count(*) AS members, count(*) FILTER (gender = 'F') AS women, count(*) FILTER (rank < 0) AS presidents, min(name) FILTER (rank = 0) AS first FROM member WHERE status = 'valid' AND active""")
def route_government(member):
    return records.published(member).where("active").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("gender") == "F").alias("women"), F.count_if(F.col("rank") < 0).alias("presidents"), F.min(F.when(F.col("rank") == 0, F.col("name"))).alias("first"))


@route("member", sql="""SELECT party, count(*) AS n FROM member WHERE contains(lower(name), '1') GROUP BY party ORDER BY n DESC, lower(party)""")
def route_parties(member):
    return member.where(F.contains(F.lower("name"), F.lit("1"))).groupBy("party").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("party"))


def admin_page(df: DataFrame, *, searched: list[str], sortable: list[str], default: list[Column], status: str | None = None, q: str | None = None, sort: str | None = None, down: bool = False, number: int = 1) -> DataFrame:
    """A review list: by status, words in the searchable columns, one of the sortable columns or the default order; 100 rows a page."""
    rows = df.where(F.col("status") == status) if status else df
    rows = rows.where(records.contains_any(searched, q)) if q else rows
    order = [F.col(sort).desc_nulls_last() if down else F.col(sort).asc_nulls_first(), *default] if sort in sortable else default
    return records.page(rows, order, number, 100)


@route("award", sql="""SELECT id, awardee, amount FROM award WHERE status = 'pending' AND (object ILIKE '%e%' OR awardee ILIKE '%e%') ORDER BY amount DESC NULLS LAST, id LIMIT 100 OFFSET 100""")
def route_review(award):
    return admin_page(award, searched=["object", "awardee"], sortable=["amount", "day"], default=[F.col("id")], status="pending", q="e", sort="amount", down=True, number=2).select("id", "awardee", "amount")


@route("facility", sql="""SELECT id, json_object('type', 'Feature', 'geometry', CASE WHEN lat2 IS NULL THEN json_object('type', 'Point', 'coordinates', [lon, lat]) ELSE json_object('type', 'LineString', 'coordinates', [[lon, lat], [lon2, lat2]]) END, 'properties', json_object('id', id, 'title', title))::VARCHAR AS feature
FROM facility WHERE lat IS NOT NULL AND lon IS NOT NULL""")
def route_map(facility):
    """GeoJSON features: points, or lines where there is a second end; those without a place are left out."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("lon", "lat"), F.array("lon2", "lat2")).alias("coordinates")))
    geometry = F.when(F.col("lat2").isNull(), point).otherwise(line)
    about = F.to_json(F.struct("id", "title"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), about, F.lit("}"))
    return facility.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", feature.alias("feature"))


@route("facility", sql="""SELECT state, count(*) AS n, count(*) FILTER (day IS NULL) AS undated FROM facility WHERE year(day) BETWEEN 2019 AND 2022 GROUP BY state UNION ALL SELECT 'all', count(*), count(*) FILTER (day IS NULL) FROM facility""")
def route_years(facility):
    """By state, those of a range of years; undated ones count only where all years are asked for."""
    some = facility.where(F.year("day").between(2019, 2022)).groupBy("state")
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("day").isNull()).alias("undated")]
    return some.agg(*counts).union(facility.agg(*counts).select(F.lit("all").alias("state"), "n", "undated"))


@route("award", "facility", sql="""SELECT DISTINCT y FROM (SELECT year(day)::INT AS y FROM award UNION SELECT year(day)::INT FROM facility) WHERE y IS NOT NULL""")
def route_all_years(award, facility):
    return award.select(F.year("day").alias("y")).union(facility.select(F.year("day"))).where("y IS NOT NULL").distinct()


@route("award", sql="""+ y AS (SELECT year(day)::INT AS y, sum(amount)::BIGINT AS spent, sum(CASE WHEN nature = 'preselection' THEN amount END)::BIGINT AS part FROM award GROUP BY 1)
SELECT a.y, a.spent, round(a.part / nullif(a.spent, 0), 6) AS share, a.spent - a.part AS balance, round((a.spent - b.spent) / nullif(b.spent, 0), 6) AS variation FROM y a LEFT JOIN y b ON b.y = a.y - 1""")
def route_budget(award):
    """By year: what was spent, the share of a part of it, what is left, and the change since the year before; a sum of 0 counts as missing."""
    y = award.groupBy(F.year("day").alias("y")).agg(F.sum("amount").alias("spent"), F.sum(F.when(F.col("nature") == "preselection", F.col("amount"))).alias("part"))
    last = y.select((F.col("y") + 1).alias("y"), F.col("spent").alias("before"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return y.join(last, "y", "left").select("y", "spent", F.round(F.col("part") / zero("spent"), 6).alias("share"), (F.col("spent") - F.col("part")).alias("balance"), F.round((F.col("spent") - F.col("before")) / zero("before"), 6).alias("variation"))


@route("award", sql="""SELECT 'award' AS kind, count(*) FILTER (status = 'valid') AS validated, count(*) FILTER (status = 'pending') AS remaining FROM award""")
def route_validation(award):
    return award.agg(F.count_if(F.col("status") == "valid").alias("validated"), F.count_if(F.col("status") == "pending").alias("remaining")).select(F.lit("award").alias("kind"), "validated", "remaining")


@route("paper", "award", sql="""SELECT p.id FROM paper p WHERE p.id IN (SELECT document_id FROM award WHERE nature = 'preselection')""")
def route_papers_with_awards(paper, award):
    return paper.join(award.where("nature = 'preselection'").select(F.col("document_id").alias("id")), "id", "left_semi").select("id")


@route("award", sql="""SELECT 'a' AS id, id AS number, coalesce(awardee, '') AS awardee, CASE nature WHEN 'attribution' THEN 'Attribution' ELSE 'Présélection' END AS nature, coalesce(amount::VARCHAR, '') AS amount, coalesce(strftime(day, '%Y-%m-%d'), '') AS day FROM award WHERE status = 'valid'""")
def route_award_export(award):
    """What an export of awards has: labels for codes, nulls as empty strings."""
    label = F.when(F.col("nature") == "attribution", "Attribution").otherwise("Présélection")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return records.published(award).select(F.lit("a").alias("id"), F.col("id").alias("number"), text("awardee").alias("awardee"), label.alias("nature"), text("amount").alias("amount"), text("day").alias("day"))


WORDS = "list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')"


@route("paper", sql=f"""+ w AS (SELECT id, {WORDS} AS w FROM paper), h AS (SELECT id, len(list_filter(w, lambda x: x = 'idiot')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b, len(list_filter(w, lambda x: x = 'apache')) AS c, len(w) AS n FROM w)
SELECT id, round((a + b) / (1 + ln(n)), 6) AS rank FROM h WHERE a > 0 AND b > 0 AND c = 0 ORDER BY rank DESC, id LIMIT 20""")
def route_search(paper):
    """Papers that hold all the words of a search and none of those behind a minus, best first."""
    return ranked(matches(paper, "text", "idiot the -apache"), "text", "idiot the -apache").select("id", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


#: All ministries of the view are one portfolio, which a post of the government names.
DIRECTORY = """+ c AS (SELECT s.id AS sid, k.id, k.name, nullif(k.acronym, '') AS acronym FROM structure s JOIN structure k ON k.id = coalesce(s.canonical_id, s.id)),
t AS (SELECT c.*, CASE WHEN name LIKE 'Ministère%' THEN 'nation' ELSE '#' || c.id END AS key, person_id, "begin", done, post FROM tenure JOIN c ON c.sid = structure_id),
g AS (SELECT key, id, name, acronym, count(DISTINCT person_id) FILTER (done IS NULL) AS n, max("begin") AS last FROM t GROUP BY ALL),
v AS (SELECT key, list(id ORDER BY last DESC, n DESC, id) AS ids, list(name ORDER BY last DESC, n DESC, id) AS names, list(acronym ORDER BY last DESC, n DESC, id) AS acronyms FROM g GROUP BY key),
a AS (SELECT key, count(DISTINCT person_id) FILTER (done IS NULL) AS agents FROM t GROUP BY key)"""
TITLE = "Ministère de NATION_9"


@route("structure", "tenure", sql=f"""{DIRECTORY}, d AS (SELECT ids[1] AS id, CASE WHEN key = 'nation' THEN ['{TITLE}'] || list_filter(names, lambda x: x <> '{TITLE}') ELSE names END AS titles, CASE WHEN key <> 'nation' THEN acronyms[1] END AS acronym,
CASE WHEN key = 'nation' THEN 'ministere' WHEN names[1] LIKE 'Région%' THEN 'territoriale' ELSE 'etablissement' END AS kind, agents, key = 'nation' AS official, list_sort(ids) AS variants FROM v JOIN a USING (key))
SELECT id, titles[1] AS name, acronym, kind, agents, array_to_string(titles, '|') AS titles, official, variants FROM d""")
def route_directory(structure, tenure):
    """Institutions with all their names, under the title that the government uses today."""
    made = institutions.index(structure, tenure, _posts(structure))
    return made.withColumn("titles", F.array_join("titles", "|"))


@route("structure", "tenure", sql=f"""{DIRECTORY} SELECT ids[1] AS id, CASE WHEN key = 'nation' THEN '{TITLE}' ELSE names[1] END AS name, agents FROM v JOIN a USING (key)
WHERE len(list_filter(names, lambda x: contains(lower(x), 'nation_1'))) > 0""")
def route_directory_searched(structure, tenure):
    return institutions.index(structure, tenure, _posts(structure), "Nation_1").select("id", "name", "agents")


def _posts(structure):
    said = F.when(F.col("id") == 9, F.concat(F.lit("Ministre de "), F.substring_index("name", " ", -1), F.lit(", porte-parole du gouvernement"))).otherwise("Directeur de cabinet")
    return structure.where("id < 12").select(said.alias("post"))


@route("structure", "tenure", sql=f"""{DIRECTORY}, x AS (SELECT key, CASE post WHEN 'Administrateur' THEN 'Conseils d''administration' WHEN 'Conseiller' THEN 'Cabinet & conseil' ELSE 'Direction & encadrement' END AS category, person_id, bool_or(done IS NULL) AS now FROM t GROUP BY ALL)
SELECT key, category, CASE category WHEN 'Conseils d''administration' THEN 2 WHEN 'Cabinet & conseil' THEN 3 ELSE 4 END AS place, count(*) FILTER (now) AS current, count(*) FILTER (NOT now) AS former FROM x GROUP BY ALL""")
def route_staff(structure, tenure):
    """Who serves and served at an institution under any of its names, by category of function."""
    rows = institutions.staff(structure, tenure)
    return rows.groupBy("key", "category", "place").agg(F.count_if("now").alias("current"), F.count_if(~F.col("now")).alias("former"))
