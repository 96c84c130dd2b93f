"""The record tables that the routes read, seen in the driver's tables: each view as a frame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    # institutions, some of which point to the one that they are the same as
    "structure": """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 3 = 0 THEN concat('Ministère de ', n_name) WHEN n_nationkey % 7 = 1 THEN concat('Région du ', n_name) ELSE concat('Office ', n_name) END AS name,
CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN substr(n_name, 1, 3) END AS acronym, CASE WHEN n_nationkey % 4 = 1 THEN CAST(n_nationkey - 1 AS BIGINT) END AS canonical_id FROM nation""",
    # papers: several versions for a URL, some without a date, some short
    "paper": """SELECT doc_id AS id, source, concat('u', CAST(doc_id % 70 AS VARCHAR)) AS url, CASE WHEN doc_id % 3 = 0 THEN 'report' WHEN doc_id % 3 = 1 THEN 'law' ELSE 'news' END AS kind, lang,
CASE WHEN doc_id % 17 <> 0 THEN CAST(DATE_ADD(DATE '2020-01-01', CAST(doc_id % 2000 AS INT)) AS DATE) END AS published, coalesce(text, '') AS text, CASE WHEN doc_id % 4 = 0 THEN concat('f/', CAST(doc_id AS VARCHAR), '.pdf') END AS file,
CASE WHEN doc_id % 5 = 0 THEN concat('{"description": "About ', source, '", "pdf": "', CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'ok' END, '"}') WHEN doc_id % 5 = 1 THEN '{"description": ""}' END AS meta FROM documents""",
    # awards, with what was bought, by whom and from whom
    "award": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, l_suppkey AS supplier_id, s_name AS awardee, p_name AS object, n_name AS authority, r_name AS region, p_brand AS sector,
CAST(floor(l_extendedprice) AS BIGINT) AS amount, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN 'preselection' ELSE 'attribution' END AS nature, CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'pending' END AS status
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    # suppliers, every fifth a spelling of the one before
    "company": """SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS key, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey - 1 END AS canonical_id, s_nationkey AS place FROM supplier""",
    # appointments to posts and their ends
    "appointment": """SELECT event_id AS id, user_id AS person_id, CAST(floor(value) AS BIGINT) % 25 AS structure_id, CASE user_id % 5 WHEN 0 THEN 'Directeur général' WHEN 1 THEN 'Conseiller' WHEN 2 THEN 'Secrétaire général' WHEN 3 THEN 'Administrateur' ELSE 'Chef de service' END AS post,
CASE WHEN event_type = 'error' THEN 'end' ELSE 'start' END AS type, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'valid' END AS status FROM events""",
    # who holds a post and from when to when
    "tenure": """SELECT event_id AS id, user_id AS person_id, CAST(floor(value) AS BIGINT) % 25 AS structure_id, CASE user_id % 5 WHEN 0 THEN 'Directeur général' WHEN 1 THEN 'Conseiller' WHEN 2 THEN 'Secrétaire général' WHEN 3 THEN 'Administrateur' ELSE 'Chef de service' END AS post,
CAST(ts AS DATE) AS begin, CASE WHEN event_type IN ('error', 'click') THEN CAST(DATE_ADD(CAST(ts AS DATE), CAST(event_id % 90 AS INT)) AS DATE) END AS done FROM events WHERE event_type <> 'view'""",
    # members of an assembly
    "member": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS party, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c_custkey % 50 - 1 AS rank, c_acctbal > 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'valid' END AS status FROM customer""",
    # works with places, some of them unknown
    "facility": """SELECT p_partkey AS id, p_name AS title, p_type AS kind, p_brand AS sector, CASE WHEN p_size % 4 = 0 THEN 'inauguration' WHEN p_size % 4 = 1 THEN 'premiere_pierre' ELSE 'annonce' END AS state,
CASE WHEN p_size % 6 <> 0 THEN CAST(DATE_ADD(DATE '2018-01-01', CAST(p_partkey * 7 % 2500 AS INT)) AS DATE) END AS day, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS lat, CASE WHEN p_size % 5 <> 0 THEN -CAST(p_size AS DOUBLE) / 8 END AS lon,
CASE WHEN p_size % 10 = 1 THEN CAST(p_size AS DOUBLE) / 2 END AS lat2, CASE WHEN p_size % 10 = 1 THEN CAST(p_size AS DOUBLE) END AS lon2 FROM part""",
}
#: What the views are made of.
TABLES = {"structure": ["nation"], "paper": ["documents"], "award": ["lineitem", "supplier", "part", "nation", "region"], "company": ["supplier"], "appointment": ["events"], "tenure": ["events"], "member": ["customer"], "facility": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body = VIEWS[name].replace("VARCHAR", "STRING").replace("{", "{{").replace("}", "}}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t in sorted(frames, key=len, reverse=True):
        for word in ("FROM", "JOIN"):
            body = body.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(body, **frames)


def ctes(*names: str) -> str:
    """The views as the beginning of a DuckDB query."""
    plain = {n: VIEWS[n].replace("DATE_ADD(DATE '2020-01-01', CAST(doc_id % 2000 AS INT))", "DATE '2020-01-01' + CAST(doc_id % 2000 AS INT)").replace("DATE_ADD(DATE '2018-01-01', CAST(p_partkey * 7 % 2500 AS INT))", "DATE '2018-01-01' + CAST(p_partkey * 7 % 2500 AS INT)").replace("DATE_ADD(CAST(ts AS DATE), CAST(event_id % 90 AS INT))", "CAST(ts AS DATE) + CAST(event_id % 90 AS INT)") for n in names}
    return "WITH " + ", ".join(f"{n} AS ({plain[n]})" for n in names)


def display_name() -> Column:
    """The acronym of an institution, else its name."""
    return F.coalesce(F.nullif("acronym", F.lit("")), F.col("name"))
