"""Rules over the tables' own values: each text is laid out around a row's values as it is printed in records, and the SQL says what the rule must read out of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import awards, offices, papers, passages, rules
from .functions import text as tx
from .operators import headings
from .queries import t
from .sources import archive
from .views import ctes, view

SPARK, SQL = {}, {}


def over(name: str, table: str, key: str, make, sql: str) -> None:
    """Register what ``make()`` gives over a table, a row each, beside the SQL of what it must give."""
    SPARK[name] = lambda spark, sf_dir: t(spark, sf_dir, table).select(F.col(key).alias("id"), make().alias("value"))
    SQL[name] = f"SELECT {key} AS id, {sql} AS value FROM {table}"


def s(*parts) -> Column:
    """A text of columns (by name) and signs (behind an equals sign)."""
    return F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts])


def case(key: str, *options: Column) -> Column:
    """One option for each remainder of the key."""
    out = F.lit(None)
    for k, o in enumerate(options):
        out = F.when(F.col(key) % len(options) == k, o).otherwise(out)
    return out


P = "p_partkey"
over("lots_read", "part", P, lambda: awards.lot_number(case(P, s("=Lot n° 0", "p_size", "= : Acquisition de ", "p_name"), s("=LOT", "p_size"), F.col("p_name"))), f"CASE WHEN {P} % 3 = 2 OR p_size > 99 THEN NULL ELSE p_size END")
over("objects_suspected", "part", P, lambda: awards.suspect_object(case(P, s("p_name", "= pour un montant de ", "p_size"), s("=Accord multi-attributaires de ", "p_name"), F.col("p_name"), s("p_name", "= (Non précisé)"))), f"{P} % 4 IN (0, 3)")
over("objects_accepted", "part", P, lambda: awards.acceptable_object(case(P, s("=Acquisition de ", "p_name", "= de ", "p_brand"), s("p_name", "= de la part de ", "p_brand"), s("=Travaux ", "p_name", "= est attributaire ", "p_brand"))), f"{P} % 3 = 0 AND length('Acquisition de ' || p_name || ' de ' || p_brand) >= 20")
over("tails_cut", "part", P, lambda: awards.without_tail(case(P, s("=Travaux de voirie pour ", "p_name", "= à ", "p_brand", "= pour un montant de ", "p_size"), s("=Lot 2 : Acquisition de ", "p_name", "= et de ", "p_brand", "= (non précisé ici)"), F.col("p_name"))), f"CASE {P} % 3 WHEN 0 THEN 'Travaux de voirie pour ' || p_name || ' à ' || p_brand WHEN 1 THEN 'Lot 2 : Acquisition de ' || p_name || ' et de ' || p_brand END")
over("refusals_read", "part", P, lambda: awards.not_an_award(case(P, s("p_name", "= : Non conforme"), s("=Lot ", "p_size", "= INFRUCTUEUX"), F.col("p_name"))), f"{P} % 3 < 2")
over("inventions_read", "part", P, lambda: awards.made_up_object(case(P, s("p_name", "= non indiqué"), F.col("p_name"))), f"{P} % 2 = 0")
over("companies_repeated", "supplier", "s_suppkey", lambda: awards.only_repeats_company(case("s_suppkey", s("=3 ", "s_name", "= sarl"), s("=Achat de riz par ", "s_name"), s("s_name")), s("s_name")), "s_suppkey % 3 <> 1")
over("objects_cleaned", "part", P, lambda: awards.clean_object(case(P, s("=Objet : Acquisition de ", "p_name", "= Financement : budget ", "p_size"), s("=Demande de prix n°2026-", "p_size", "=/X relative à la construction de ", "p_name"), s("=Région du Centre Commune de Saaba Construction de ", "p_name"), s("=Référence ", "p_size"))), f"CASE {P} % 4 WHEN 0 THEN 'Acquisition de ' || p_name WHEN 1 THEN 'la construction de ' || p_name WHEN 2 THEN 'Construction de ' || p_name ELSE 'Objet non précisé (voir le Quotidien)' END")
over("awardees_cleaned", "supplier", "s_suppkey", lambda: awards.clean_awardee(case("s_suppkey", s("=Attributaire provisoire : ", "s_name"), s("s_name", "= pour un montant de 3 000 000"), s("=Acquisition de riz : ", "s_name"), s("=Acquisition de ", "s_name"))), "CASE WHEN s_suppkey % 4 < 3 THEN s_name END")
over("lot_headings_read", "part", P, lambda: awards.lot_heading(case(P, s("=Lot 6 : Construction de ", "p_name", "= et de ", "p_brand", "= Conforme : non\n\nfin"), s("=Lot 7 : Construction de ", "p_name")), F.lit(6)), f"CASE WHEN {P} % 2 = 0 THEN 'Construction de ' || p_name || ' et de ' || p_brand END")
over("rubrics_refused", "part", P, lambda: awards.is_heading(case(P, F.lit("SOCIÉTÉS D’ÉTAT :"), F.lit("Régions"), F.col("p_name"))), f"{P} % 3 < 2")
over("amounts_read", "part", P, lambda: tx.plausible_amount(case(P, F.concat(F.lit("Montant : "), F.replace(F.format_number(F.col(P) * 1000 + 77, 0), F.lit(","), F.lit(" ")), F.lit(" FCFA")), s("=n° ", "p_size"))), f"CASE WHEN {P} % 2 = 0 AND {P} * 1000 + 77 >= 100000 THEN {P} * 1000 + 77 END")
over("html_read", "part", P, lambda: tx.html_text(s("=<style>p {}</style><div><p>", "p_name", "=</p><p>", "p_type", "= &amp; <b>", "p_brand", "=</b></p></div><!-- no -->")), "p_name || chr(10) || chr(10) || p_type || ' & ' || chr(10) || p_brand")
over("seats_folded", "part", P, lambda: offices.seat_text(s("=Président du Conseil d’", "p_name")), "'president du conseil d''' || lower(p_name)")
over("regions_folded", "part", P, lambda: offices.region_key(s("=Hauts-", "p_name", "=  d’Été")), "'hauts ' || lower(p_name) || ' d ete'")
over("regions_labelled", "part", P, lambda: offices.region_label(case(P, s("=Région du Sahel"), F.lit("Centre-Est"), F.col("p_name"))), f"CASE {P} % 3 WHEN 0 THEN 'Région Liptako (ex-Sahel)' WHEN 1 THEN 'Région Nakambé (ex-Centre-Est)' ELSE p_name END")
over("titles_official", "part", P, lambda: offices.official_title(case(P, s("=Ministre d'État, Ministre de ", "p_name"), s("=Ministre de ", "p_name", "=, porte-parole du gouvernement"), s("=Ministre délégué auprès du ministre de ", "p_name"), s("=Directeur de ", "p_name"))), f"CASE WHEN {P} % 4 < 2 THEN 'Ministère de ' || p_name END")
over("titles_compared", "part", P, lambda: offices.title_key(s("=de  l’", "p_name", "=. ")), "'de l''' || lower(p_name)")
over("sectors_told", "part", P, lambda: rules.sector(case(P, s("=Acquisition de médicaments pour ", "p_brand"), s("=Réalisation d'un forage à ", "p_brand"), s("=Lampadaires solaires de ", "p_brand"), s("=Kits scolaires de ", "p_brand"), s("=Semences améliorées de ", "p_brand"), s("=Gardiennage de ", "p_brand"), s("=Divers de ", "p_brand")), F.lit(None).cast("string")), f"['Santé', 'Eau & assainissement', 'Énergie', 'Éducation & formation', 'Agriculture & élevage', 'Services & prestations', 'Autres'][{P} % 7 + 1]")
over("facility_sectors", "part", P, lambda: rules.facility_sector(case(P, F.lit("pont"), F.lit("usine"), F.lit("centre_sante"), F.lit("logement"), F.col("p_type"))), f"CASE {P} % 5 WHEN 0 THEN 'Transport & mobilité' WHEN 1 THEN 'Industrie' WHEN 2 THEN 'Santé' WHEN 3 THEN 'Habitat & urbanisme' END")
over("news_chosen", "part", P, lambda: rules.news_matters(case(P, s("=Inauguration d'un pont à ", "p_brand"), s("=Inauguration de ", "p_brand"), s("=Un pont à ", "p_brand"), F.lit(None).cast("string")), case(P, F.lit(""), F.lit("art"), F.lit("sur le fleuve"), s("=mise en service de la centrale de ", "p_brand"))), f"{P} % 4 IN (0, 3)")
over("confidences_capped", "part", P, lambda: rules.award_confidence(F.when(F.col("p_size") % 2 == 0, "preselection").otherwise("attribution"), F.when(F.col("p_size") % 3 != 0, F.col(P)), F.col("p_size") / 50), "CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN least(p_size / 50.0::DOUBLE, 0.5) ELSE p_size / 50.0::DOUBLE END")
over("segments_read", "part", P, lambda: papers.last_segment(s("=https://h/a/b/", "p_partkey", "=%20c.pdf?x=1")), f"{P} || ' c.pdf'")
over("initials_shown", "supplier", "s_suppkey", lambda: tx.initials(s("=awa ", "s_name", "= x")), "'A' || upper(left(s_name, 1))")

MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


def _said() -> Column:
    """An order's day in French prose."""
    day = F.col("o_orderdate").cast("date")
    return F.concat(F.when(F.dayofmonth(day) == 1, "1er").otherwise(F.dayofmonth(day).cast("string")), F.lit(" "), F.get(F.array(*map(F.lit, MONTHS)), F.month(day) - 1), F.lit(" "), F.year(day).cast("string"))


over("prose_dates_read", "orders", "o_orderkey", lambda: papers.prose_date(F.concat(F.lit("réunie le vendredi "), _said(), F.lit(" à Ouaga, puis le 3 mai 2001"))), "CAST(o_orderdate AS DATE)")
over("issue_dates_read", "orders", "o_orderkey", lambda: papers.issue_date(F.concat(F.lit("Quotidien N° "), F.col("o_orderkey") % 9000 + 1000, F.lit(" - Lundi "), F.when(F.dayofmonth("o_orderdate") > 1, _said()))), "CASE WHEN day(o_orderdate) > 1 THEN CAST(o_orderdate AS DATE) END")
over("issue_numbers_read", "orders", "o_orderkey", lambda: papers.issue_number(F.when(F.col("o_orderkey") % 2 == 0, F.format_string("https://x/Quotidien%%20n%%C2%%B0%s.pdf", F.col("o_orderkey") % 9000 + 1000)).otherwise("https://x/q.pdf"), F.format_string("Quotidien N° %s - Lundi", F.col("o_orderkey") % 9000 + 1000)), "(o_orderkey % 9000 + 1000)::VARCHAR")

D = "doc_id"
over("awards_found_in_texts", "documents", D, lambda: passages.located(F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 800), F.lit(" le DPX \n n°"), F.col(D), F.lit("-A du 3")), s("=« DPX n°", D, "=-A »"), F.lit(None).cast("string"), F.lit(None).cast("string")), "length(left(coalesce(text, ''), 800)) + 4")
over("numbers_found_in_texts", "documents", D, lambda: passages.number_after_name(F.concat(F.lit("Monsieur Éric  SOURCE"), F.col(D), F.lit(", Mle "), F.substring(F.lpad(F.col(D).cast("string"), 6, "0"), 1, 3), F.lit(" "), F.substring(F.lpad(F.col(D).cast("string"), 6, "0"), 4, 3), F.lit(" N, ingénieur"), F.when(F.col(D) % 5 == 0, F.format_string("; Eric Source%s, Mle 999999", D)).otherwise("")), s("=Eric Source", D)), "CASE WHEN doc_id % 5 <> 0 THEN lpad(doc_id::VARCHAR, 6, '0') || 'N' END")
over("passages_found_in_texts", "documents", D, lambda: passages.passage(F.concat(F.lit("Avant. Au titre de "), F.col("source"), F.lit(" & co, Madame N"), F.col(D), F.lit(" est nommée. Après.")), [(s("=n", D, "= est"), False)]), "'Au titre de ' || source || ' &amp; co, Madame <mark>N' || doc_id || ' est</mark> nommée.'")
over("archive_keys_made", "documents", D, lambda: archive.archive_key(F.col("source"), F.col(D) % 30 + 1995, F.coalesce("text", F.lit("")).cast("binary"), F.lit("txt")), "source || '/' || (doc_id % 30 + 1995) || '/' || left(sha256(coalesce(text, '')), 16) || '.txt'")
over("page_links_found", "pages", "page_id", lambda: F.array_join(F.array_sort(archive.links(F.col("html"))), " "), """array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1))), ' ')""")


def query(sql: str):
    def add(f):
        SPARK[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(ctes("tenure") + """ SELECT id, CASE post WHEN 'Directeur général' THEN CASE WHEN id % 2 = 0 THEN 'dg' ELSE 'directeur general' END WHEN 'Secrétaire général' THEN CASE WHEN id % 2 = 0 THEN 'sg' ELSE 'secretaire general' END WHEN 'Chef de service' THEN 'chef de service' END AS seat FROM tenure""")
def seats_read(spark, sf_dir):
    return view(spark, sf_dir, "tenure").select("id", offices.seat_key("post", F.col("id") % 2 == 0).alias("seat"))


@query(ctes("structure") + """ SELECT id, acronym IS NOT NULL AND acronym <> '' AND (name NOT LIKE 'Ministère%' OR id % 3 = 0 AND id % 2 = 0 AND id > 9) AS holds FROM structure""")
def acronyms_held(spark, sf_dir):
    return view(spark, sf_dir, "structure").select("id", offices.acronym_holds("name", "acronym", F.when(F.col("id") > 9, 0.95)).alias("holds"))


@query("SELECT p_partkey AS id, 'Acquisition de ' || p_name || ' et de ' || p_brand AS heading FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 2 = 1")
def lots_in_texts(spark, sf_dir):
    """Each part is a lot of a text of its own; the object says only its number, and every other text has no heading before it."""
    part = t(spark, sf_dir, "part")
    text = F.concat(F.lit("Lot 3 : Acquisition de "), "p_name", F.lit(" et de "), "p_brand", F.lit("\n\nLot 3 : Acquisition d'autre chose encore\n\n"))
    texts = part.select(F.col(P).alias("doc"), text.alias("text"))
    at = F.length(F.concat("p_name", "p_brand")) + 40
    rows = part.select(F.col(P).alias("doc"), F.when(F.col(P) % 2 == 0, at).otherwise(F.lit(3)).cast("int").alias("at"), F.lit("lot n° 03").alias("object"))
    return headings.lots_named(rows, texts, by="doc", at="at", text="text", obj="object").select(F.col("doc").alias("id"), "heading")
