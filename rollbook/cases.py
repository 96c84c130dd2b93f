"""Rules over single values, as queries: each takes a row's case by the row's number, and its SQL states what must come out.

The cases are written by hand, so the SQL knows nothing of the rules.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import awards, offices, papers, passages, rules
from .functions import text as tx
from .sources import archive

SPARK, SQL = {}, {}


def _sql(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, datetime.date):
        return f"DATE '{x}'"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x)


def cases(name: str, make, rows: list[tuple], types: list[str] | None = None, kind: str = "string") -> None:
    """Register a query: ``make`` of the columns that a case's values fill, the last value of a case being what it gives.

    Every row of ``part`` takes the case with its key's number modulo that of the cases. ``types`` are those of the values, ``kind`` that of the result.
    """
    n = len(rows)
    types = types or ["string"] * (len(rows[0]) - 1)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = (F.col("p_partkey") % n).cast("int")
        inputs = [F.get(F.array(*[F.lit(r[k]).cast(t) for r in rows]), at).alias(f"v{k}") for k, t in enumerate(types)]
        picked = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *inputs)
        return picked.select("p_partkey", make(*[F.col(f"v{k}") for k in range(len(types))]).cast(kind).alias("value"))

    SPARK[name] = query
    of = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}[kind]
    SQL[name] = f"SELECT p_partkey, CAST(([{', '.join(_sql(r[-1]) for r in rows)}])[p_partkey % {n} + 1] AS {of}) AS value FROM part"


def day(y: int, m: int, d: int) -> datetime.date:
    return datetime.date(y, m, d)


cases("person_key_rules", tx.person_key, [("  Éric  N’DIAYE-Traoré ", "eric n'diaye traore"), ("OUÉDRAOGO Aïcha", "ouedraogo aicha"), ("Désiré", "desire"), ("‘Ali’", "'ali'"), ("ﬁls", "fils"), ("", ""), (None, None)])
cases("company_key_rules", tx.company_key, [("ETS WEND-KUUNI", "wend kuuni"), ("Ets Wend Kuuni SARL", "wend kuuni"), ("E.W.K. Sarl", "ewk"), ("SARL", "sarl"), ("A & B Cie", "a et b"), ("Société Générale d’Eau", "generale d'eau"), ("Entreprises Zongo/Fils", "zongo fils"), (" ", ""), ("Groupement X_Y", "groupement x y")])
cases("place_key_rules", tx.place_key, [("Commune de Manga", "manga"), ("Région du Centre-Est", "centre est"), ("Ville d'Orodara", "orodara"), ("la  Léraba", "leraba"), ("arrondissement 4", "arrondissement 4"), ("Secteur 6", "6"), (None, ""), ("aux Cascades", "cascades")])
cases("version_key_rules", tx.version_key, [("L’école  d´été", "l'école d'été"), ("ÉTÉ", "été"), ("a  b\n", "a b"), (None, ""), ("Ça va", "ça va")])
cases("fold_rules", lambda c: F.lower(tx.fold(c)), [("Ñandú Œuvre", "nandu œuvre"), ("Ğŭřž", "gurz"), ("ﬀ½", "ff1⁄2"), ("Àb", "ab")])
cases("distinctive_tokens", lambda c: F.array_join(F.array_sort(tx.tokens(c)), " "), [("Construction de 431 salles de classe à Bogodogo", "431 bogodogo classe salles"), ("Travaux de la route R5, km 12", "12 km r5 route"), ("CHU de Tengandogo", "chu tengandogo"), (None, ""), ("R+5 du ministère", "r+5"), ("Énergie énergie", "energie")])
cases("initials", tx.initials, [("Awa Traoré Diallo", "AT"), ("mariam", "M"), ("", ""), ("  jean  paul ", "JP")])
cases("html_text", tx.html_text, [("<p>Un</p><p>deux &amp; trois</p>", "Un\n\ndeux & trois"), ("<script>x</script><b>gras</b> fin", "gras\n fin"), ("a<!-- c -->b", "ab"), ("a \t b", "a b"), ("<div>\n\n\n</div>x", "x"), (None, None)])
cases("escape_html", tx.escape_html, [("<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"), ("", "")])
cases("plausible_amount", tx.plausible_amount, [("Montant : 12 345 678 FCFA", 12345678), ("1.500.000", 1500000), ("99 999", None), ("12345", None), ("600000000000", None), ("500000000000", 500000000000), ("rien", None), ("n° 1234 puis 100000", None), ("n° 1234, puis 100000", 100000), (None, None)], kind="long")

cases("sector_rules", lambda a, b: rules.sector(a, b), [("Acquisition de médicaments", None, "Santé"), ("Réalisation d'un forage", "CSPS de Manga", "Santé"), ("Réalisation d'un forage", None, "Eau & assainissement"), ("Lampadaires solaires", None, "Énergie"), ("Kits scolaires", None, "Éducation & formation"), ("Semences améliorées", None, "Agriculture & élevage"), ("Logiciels de paie", None, "Informatique & numérique"), ("Achat de pneus", None, "Transport & véhicules"), ("Construction d'un mur", None, "Bâtiment & travaux publics"), ("Achat de mobilier", None, "Fournitures & équipements"), ("Gardiennage des locaux", None, "Services & prestations"), ("Divers", None, "Autres"), (None, None, "Autres"), ("Divers", "Université", "Éducation & formation")])
cases("facility_sector", rules.facility_sector, [("pont", "Transport & mobilité"), ("usine", "Industrie"), ("centre_sante", "Santé"), ("logement", "Habitat & urbanisme"), ("inconnu", None), ("autre", "Autres")])
cases("news_matters", rules.news_matters, [("Inauguration d'un pont", "", True), ("Pose de la première pierre du lycée", None, True), ("Inauguration d'une exposition", "art", False), ("Un pont", "sur le fleuve", False), (None, "mise en service de la centrale", True), (None, None, False)], kind="boolean")
cases("award_confidence", rules.award_confidence, [("preselection", 1000, 0.9, 0.5), ("preselection", None, 0.9, 0.9), ("attribution", 1000, 0.9, 0.9), ("preselection", 5, 0.3, 0.3)], ["string", "long", "double"], "double")
cases("project_stage_rules", rules.project_stage, [(True, True, True, "delivered"), (False, True, True, "works"), (False, False, True, "awarded"), (False, False, False, "announced")], ["boolean"] * 3)

cases("institution_type", lambda a, b, c: offices.institution_type(a, b, c), [("Ministère de la Santé", None, None, "ministere"), ("Ministère des Infrastructures", "SOGEMAB", 1.0, "etablissement"), ("Ministère des Infrastructures", "DGI", 0.62, "ministere"), ("Présidence du Faso", None, None, "institution"), ("Cour des comptes", None, None, "juridiction"), ("Conseil constitutionnel", None, None, "juridiction"), ("Direction régionale de la police de l'Est", None, None, "police"), ("Ambassade du Burkina à Dakar", None, None, "diplomatique"), ("Région du Sahel", None, None, "territoriale"), ("Région du sahel", None, None, "etablissement"), ("Centre-Nord", None, None, "territoriale"), ("Office national de l'eau", None, None, "etablissement"), (None, None, None, "etablissement"), ("Commune de l’Oubri", None, None, "etablissement"), ("Commune de Saaba", None, None, "territoriale")], ["string", "string", "double"])
cases("function_category", offices.function_category, [("Ministre de la Santé", "Membres du gouvernement"), ("Ambassadeur à Rome", "Diplomatie & représentation"), ("Administrateur représentant l'État", "Conseils d'administration"), ("Chargé de missions", "Cabinet & conseil"), ("Directeur général", "Direction & encadrement"), ("Haut-commissaire", "Direction & encadrement"), ("Inspecteur des impôts", "Inspection & contrôle"), ("Jardinier", "Autres fonctions"), (None, "Autres fonctions")])
cases("seat_key", lambda p, s: offices.seat_key(p, s), [("Directeur général", True, "dg"), ("Directrice générale adjointe", True, "dga"), ("Directeur général des impôts", False, "directeur general des impots"), ("Administrateur", True, None), ("Conseiller technique", True, None), ("Juge des enfants", True, None), ("Juge au tribunal", True, None), ("Président du conseil d’administration", True, "pca"), ("Chef de service", True, "chef de service"), ("Gouverneur", False, "gouverneur"), ("Haut-commissaire", True, "haut-commissaire"), ("Jardinier", True, None), (None, True, None), ("Secrétaire général", True, "sg"), ("Trésorier", True, "tresorier")], ["string", "boolean"])
cases("portfolio", lambda c: offices.portfolio(c), [("Ministère de la Santé", "sante"), ("Ministère de la Défense nationale", "guerre"), ("Ministère de l'Action humanitaire", "solidarite"), ("Ministère du Développement industriel", "industrie"), ("Ministère des Affaires étrangères", "affaires etrangeres"), ("Ministère chargé de l’Eau", "eau"), ("Ministère", None), ("Office de l'eau", None), ("Ministère de la Famille", "solidarite"), ("Ministère des Affaires", "affaires"), (None, None)])
cases("official_title", offices.official_title, [("Ministre d'État, Ministre de la Guerre et de la Défense patriotique", "Ministère de la Guerre et de la Défense patriotique"), ("Ministre de l'Eau, porte-parole du gouvernement", "Ministère de l'Eau"), ("Ministre délégué auprès du ministre de l'Eau", None), ("Premier ministre", None), ("Directeur de cabinet du ministre de l'Eau", None), ("Secrétaire", None), (None, None)])
cases("title_key", offices.title_key, [("des Langues nationales.", "des langues nationales"), ("de l’Eau  ", "de l'eau"), (None, "")])
cases("region_label", offices.region_label, [("Région du Sahel", "Région Liptako (ex-Sahel)"), ("Centre-Est", "Région Nakambé (ex-Centre-Est)"), ("région de la Boucle du Mouhoun", "Région Bankui (ex-Boucle du Mouhoun)"), ("Kadiogo", "Kadiogo"), (None, "")])
cases("region_key", offices.region_key, [("Hauts-Bassins", "hauts bassins"), ("Plateau  Central", "plateau central"), ("L’Est", "l est")])
cases("seat_text", offices.seat_text, [("Président du Conseil d’administration", "president du conseil d'administration"), ("Haut-Commissaire", "haut commissaire"), (None, "")])
cases("acronym_holds", lambda a, b, c: offices.acronym_holds(a, b, c), [("Ministère de l'Eau", "ONEA", None, False), ("Ministère de l'Eau", "ONEA", 0.95, True), ("Office de l'eau", "ONEA", None, True), ("Office de l'eau", None, None, False), ("Office de l'eau", "", None, False)], ["string", "string", "double"], "boolean")

cases("lot_number", awards.lot_number, [("Lot 3 : tables", 3), ("LOT n° 06", 6), ("lot12", 12), ("Lot 123", None), ("sans", None), (None, None)], kind="int")
cases("suspect_object", awards.suspect_object, [("L'entreprise est attributaire", True), ("Accord multi-attributaires de riz", False), ("Achat de riz", False), ("12 000 FCFA", True), ("", False), (None, False)], kind="boolean")
cases("acceptable_object", awards.acceptable_object, [("Acquisition de mobilier de bureau", True), ("Acquisition", False), ("Mobilier de bureau neuf et solide", False), ("Travaux pour un montant de 3 millions", False), ("Fourniture accord multi-attributaires de riz local", True), (None, False)], kind="boolean")
cases("without_tail", awards.without_tail, [("Acquisition de chaises visiteur (Directeur et Agent) pour un montant TTC de quatre-vingt-deux millions", "Acquisition de chaises visiteur (Directeur et Agent)"), ("Lot 2 : Construction de trois salles de classe (non précisé dans l'extrait)", "Lot 2 : Construction de trois salles de classe"), ("Fourniture de services pour un montant de 5", None), (None, None), ("Travaux de voirie urbaine, montant minimum 5", "Travaux de voirie urbaine")])
cases("not_an_award", awards.not_an_award, [("Offre non retenue", True), ("Lot 2 infructueux", True), ("Achat de riz", False), (None, False)], kind="boolean")
cases("made_up_object", awards.made_up_object, [("Objet non précisé", True), ("non indique", True), ("Achat", False), (None, False)], kind="boolean")
cases("only_repeats_company", awards.only_repeats_company, [("3 ETABLISSEMENT YAKNABA ET FRERES", "YAKNABA ET FRERES", True), ("Achat de riz par YAKNABA ET FRERES", "YAKNABA ET FRERES", False), ("ABC", "ABC", False), (None, "YAKNABA", True), ("x", None, False)], kind="boolean")
cases("clean_object", awards.clean_object, [("Objet : Acquisition de riz Financement : budget 2026", "Acquisition de riz"), ("Demande de prix n°2026-01/X relative à la construction de deux salles", "la construction de deux salles"), ("Travaux de voirie. Date de dépouillement : 3 mai", "Travaux de voirie"), ("Référence 12", "Objet non précisé (voir le Quotidien)"), ("Région du Centre Commune de Saaba Construction de dix boutiques", "Construction de dix boutiques"), ("", ""), (None, None)])
cases("clean_awardee", awards.clean_awardee, [("Attributaire provisoire : ETS KABORE", "ETS KABORE"), ("s provisoires : Lot unique : SOGEDIM", "SOGEDIM"), ("EKS SARL pour un montant de 3 000 000", "EKS SARL"), ("Acquisition de riz : ZONGO ET FILS", "ZONGO ET FILS"), ("Acquisition de riz", None), ("ab", None), ("WATAM SA 01 BP 12 Ouaga", "WATAM SA"), (None, None)])
cases("is_heading", awards.is_heading, [("Collectivités territoriales", True), ("SOCIÉTÉS D’ÉTAT :", True), ("sociétés", False), ("Agence d'appui aux collectivités territoriales", False), (None, False)], kind="boolean")
cases("lot_heading", lambda a, b, c: awards.lot_heading(a, b, c), [("Lot 6 : Construction d'un hall d'attente au CSPS Conforme : non\n\nfin", 6, None, "Construction d'un hall d'attente au CSPS"), ("Lot 1 : Acquisition de tables et de bancs\n\nLot 1 : Acquisition de riz local blanc\n\nligne", 1, 60, "Acquisition de tables et de bancs"), ("Lot 1 : Acquisition de tables et de bancs\n\nLot 1 : Acquisition de riz local blanc\n\nligne", 1, 90, "Acquisition de riz local blanc"), ("Lot 2 : xyz", 2, None, None), (None, 1, None, None)], ["string", "int", "int"])
cases("award_fingerprint", awards.fingerprint_of, [("R 1", "ETS  X", 5, "Achat", "r 1|ets x|5|achat"), (None, "x", None, "y", "|x||y"), ("a", "b", 0, None, "a|b|0|")], ["string", "string", "long", "string"])

cases("prose_date", papers.prose_date, [("réunie le vendredi 31 juillet 2026 à Ouaga", day(2026, 7, 31)), ("le 1er février 2025", day(2025, 2, 1)), ("le 31 février 2025", None), ("le 3 AOÛT 2024, puis 4 mai 2023", day(2024, 8, 3)), ("sans date", None), (None, None)], kind="date")
cases("issue_date", papers.issue_date, [("Quotidien N° 4442 - Lundi 13 juillet 2026", day(2026, 7, 13)), ("N°4442 – 1 mars 2026", day(2026, 3, 1)), ("N° 4442 - Lundi 33 juillet 2026", None), (None, None)], kind="date")
cases("issue_number", papers.issue_number, [("https://x/Quotidien%20n%C2%B04442.pdf", "N° 1111", "4442"), ("https://x/q.pdf", "Quotidien N° 04443 - Lundi", "4443"), ("https://x/q.pdf", "rien", None), (None, None, None)])
cases("court_kind", papers.court_kind, [("Avis sur le projet d'ordonnance", "decision.pdf", "avis_constitutionnel"), ("« Ordonnance n° 1", None, "ordonnance_constitutionnelle"), ("Texte", "DECISON_3.pdf", "decision_constitutionnelle"), ("Texte", "avis_2.pdf", "avis_constitutionnel"), (None, None, "decision_constitutionnelle")])
cases("court_reference", lambda a, b, c: papers.court_reference(a, b, c), [("Décision 2026-018/CC", None, None, "2026-18"), ("Décision", "dec_2025_3.pdf", None, "2025-03"), ("Décision numéro 020/CC", None, 2025, "2025-20"), ("Avis n°7", None, 2024, "2024-07"), ("Avis n°7", None, None, None), ("x", "y", 2024, None), ("Décision 2026-118/CC", None, None, "2026-118")], ["string", "string", "int"])
cases("court_date", lambda a, b, c: papers.court_date(a, b, c), [("t", "d_du_10_juin_2026.pdf", None, day(2026, 6, 10)), ("Décision du 24 Octobre 2025", "x.pdf", None, day(2025, 10, 24)), ("Décision du 3 janv.", "x", 2024, day(2024, 1, 3)), ("Décision du 3 janv.", "x", None, None), ("du 31 avril 2024", None, None, None), (None, None, 2024, None)], ["string", "string", "int"], "date")
cases("iso_day", papers.iso_day, [("2024-03-05T10:00:00", day(2024, 3, 5)), ("2024-13-05", None), ("x", None), (None, None)], kind="date")
cases("rfc822", papers.rfc822, [(day(2026, 7, 30), "Thu, 30 Jul 2026 12:00:00 +0000"), (None, None)], ["date"])
cases("effective_date", papers.effective_date, [(day(2026, 1, 2), day(2026, 1, 5), day(2026, 1, 2)), (None, day(2026, 1, 5), day(2026, 1, 5)), (None, None, None)], ["date", "date"], "date")
cases("last_segment", papers.last_segment, [("https://h/a/b%20c.pdf?x=1", "b c.pdf"), ("https://h/a/", ""), (None, None)])

cases("award_located", passages.located, [("Lot 1\nDPX  n°2026-01 du 3", "DPX n°2026-01", None, None, 6), ("le sieur  L’OASIS sarl gagne", "absent1", "L'OASIS SARL", None, 10), ("vu: Acquisition de mobilier de bureau neuf", None, "x", "Acquisition de mobilier de bureau neuf.", 4), ("rien", "abc", "abcdefg", None, None), (None, "abcdefg", None, None, None)], kind="int")
cases("number_after_name", passages.number_after_name, [("Monsieur Éric TRAORE, Mle 355 091 N, ingénieur", "Eric Traoré", "355091N"), ("Eric  TRAORE, Mle 1234; Eric TRAORE, Mle 5678", "Eric Traore", None), ("Eric TRAORE nommé à Ouagadougou puis Mle 1234", "Eric Traore", None), ("Eric TRAORE Mle. 12.345; Eric TRAORE Mle 12345", "Eric Traore", "12345"), (None, "x", None), ("x", "", None)])
cases("passage_shown", lambda t, a, n: passages.passage(t, [(a, False), (n, True)]), [("Au titre. - Monsieur A & B, Mle 35 50 91, est nommé ; - Madame C", "monsieur a", "355091", "<mark>Monsieur A</mark> &amp; B, Mle <mark>35 50 91</mark>, est nommé"), ("Un. Deux trois. Quatre", "trois", None, "Deux <mark>trois</mark>."), ("abc", "x", "12", None), (None, "x", None, None), ("Début sans fin", "sans", "", "Début <mark>sans</mark> fin")])

cases("links_found", lambda h, b: F.array_join(archive.links(h, b), " "), [('<a href="/x.pdf"><a href="https://h.org/x.pdf"><a href="//o/y">', "https://h.org/p/q", "https://h.org/x.pdf //o/y"), ("<a>", "https://h.org", ""), (None, "https://h.org", "")])
cases("archive_key_made", lambda s, y, c, e: archive.archive_key(s, y, c.cast("binary"), e), [("court", 2024, "abc", "pdf", "court/2024/ba7816bf8f01cfea.pdf"), ("law", 2023, "", "txt", "law/2023/e3b0c44298fc1c14.txt")], ["string", "int", "string", "string"])
