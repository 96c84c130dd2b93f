"""Record linkage: exact trigram joins, rarity-weighted pairs, components, geocoding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .records import fenced


#: Trigrams that names must share to meet, at most, and how many combinations of so many a name may give.
TOGETHER, KEYS = 3, 300
#: Records of one name that a row of :func:`blocks` holds, at most.
BLOCK = 1024


def named(df: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(record, text, id) of the records, where ``id`` tells sets of trigrams apart, and (id, g) of the names: each different text is taken apart once.

    Null ids and texts without trigrams are left out.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("record"), text.alias("text"))
    texts = fenced(rows.select("text").distinct(), g=trigrams("text")).where(F.size("g") > 0)
    texts = texts.withColumn("id", F.unhex(F.md5(F.array_join(F.array_sort("g"), "|"))))
    return rows.join(texts.select("text", "id"), "text"), texts.groupBy("id").agg(F.first("g").alias("g"))


def _keys(names: DataFrame, other: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(id, n, m, own, level, key): combinations of each name's rarest trigrams, ``level`` at a time, of those that other names have (``m``).

    Names that reach the threshold share at least ``need`` trigrams, so the rarest ``level`` of what they share are among the
    ``m - need + level`` rarest of either (prefix filter). A name gives combinations of up to ``own``.
    """
    smallest = other.agg(F.min(F.size("g")).alias("smallest"))
    each = names.select("id", F.size("g").alias("n"), F.explode("g").alias("gram")).join(frequency, "gram")
    held = each.groupBy("id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "gram"))), lambda x: F.xxhash64(x["gram"])).alias("h"))
    partner = F.greatest(F.col("smallest"), F.ceil(F.col("n") * threshold - 1e-9))
    held = held.join(F.broadcast(smallest)).withColumn("need", F.greatest(F.ceil((F.col("n") + partner) * (threshold / (1 + threshold)) - 1e-9), F.lit(1)).cast("int"))
    held = held.withColumn("m", F.size("h")).where("m >= need")
    spare = F.col("m") - F.col("need")
    ways = {1: spare + 1, 2: (spare + 2) * (spare + 1) / 2, 3: (spare + 3) * (spare + 2) * (spare + 1) / 6}
    fits = lambda k: (ways[k] <= KEYS) & (F.col("need") >= k)
    held = held.withColumn("own", F.when(fits(3), 3).when(fits(2), 2).otherwise(1))

    def combined(k: int, h: Column, said: list[Column]) -> Column:
        if k == 1:
            return F.transform(h, lambda x: F.xxhash64(*said, x))
        return F.flatten(F.transform(h, lambda x, i: combined(k - 1, F.slice(h, i + 2, F.size(h)), [*said, x])))

    def level(k: int) -> Column:
        made = combined(k, F.slice("h", 1, spare + k), [F.lit(k)])
        return F.when(F.col("own") >= k, F.transform(made, lambda x: F.struct(F.lit(k).alias("level"), x.alias("key")))).otherwise(F.array().cast("array<struct<level:int,key:bigint>>"))

    each = F.explode(F.concat(*[level(k) for k in range(1, TOGETHER + 1)])).alias("x")
    return held.select("id", "n", "m", "own", each).select("id", "n", "m", "own", "x.level", "x.key")


def alike(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(na, nb, similarity) of all different names (id, g) whose trigram similarity reaches the threshold; of one table each pair once, na < nb.

    Names are compared only if they share a combination of their rarest trigrams and are large enough for each other; both
    are necessary for the threshold, so no pair is lost.
    """
    counted = lambda names: names.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # what no other name has can't be shared
    if right is None:
        frequency = counted(left).where("df > 1")
    else:
        frequency = counted(left).join(counted(right).withColumnRenamed("df", "dg"), "gram").select("gram", (F.col("df") + F.col("dg")).alias("df"))
    other = left if right is None else right
    p = _keys(left, other, frequency, threshold).alias("p")
    q = _keys(other, left, frequency, threshold).alias("q")
    near = (F.col("p.level") == F.col("q.level")) & (F.col("p.key") == F.col("q.key")) & (F.least("p.n", "q.n") >= F.greatest("p.n", "q.n") * threshold)
    near = near & (F.least("p.m", "q.m") >= (F.col("p.n") + F.col("q.n")) * (threshold / (1 + threshold)) - 1e-9)
    if right is None:
        near = near & (F.col("p.id") < F.col("q.id"))
    # of two names the one that gives fewer at a time decides
    met = [p.where("own = level").join(q, near), p.where("own > level").join(q.where("own = level"), near)]
    pairs = met[0].select(F.col("p.id").alias("na"), F.col("q.id").alias("nb")).union(met[1].select(F.col("p.id").alias("na"), F.col("q.id").alias("nb"))).distinct()
    found = pairs.join(left.select(F.col("id").alias("na"), F.col("g").alias("ga")), "na").join(other.select(F.col("id").alias("nb"), F.col("g").alias("gb")), "nb")
    found = found.withColumn("i", F.size(F.array_intersect("ga", "gb"))).withColumn("u", F.size("ga") + F.size("gb") - F.col("i"))
    return found.where(F.col("i") >= F.col("u") * threshold).select("na", "nb", F.round(F.col("i") / F.col("u"), 4).alias("similarity"))


def blocks(rows: DataFrame) -> DataFrame:
    """(id, records): the records of each name (record, id) in order, at most ``BLOCK`` of neighbours in a row, so that no task holds all of a name."""
    placed = rows.select("id", "record").repartitionByRange("id", "record").sortWithinPartitions("id", "record").withColumn("place", F.monotonically_increasing_id())
    made = placed.groupBy("id", F.expr(f"place div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list("record")).alias("records"))
    return made.select("id", "records")


def expanded(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, similarity) of the records (record, id) of linked names (na, nb, similarity), a < b, the most similar first.

    Blocks of records are dealt to the tasks and put in order, pairs are not: each task makes those of its blocks, and
    they are neither shuffled nor sorted. Pairs of two blocks follow each other, so files hold them closely.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = blocks(rows)
    x = held.select(F.col("id").alias("na"), F.col("records").alias("x"), F.col("records")[0].alias("first"))
    y = held.select(F.col("id").alias("nb"), F.col("records").alias("y"), F.element_at("records", -1).alias("last"), F.col("records")[0].alias("begin"))
    met = links.join(x, "na").join(y, "nb").where("first < last")
    # a number of tasks of its own: by the bytes of the blocks, few would seem enough
    order = [F.desc("similarity"), F.col("na"), F.col("nb"), F.col("begin"), F.col("first")]
    met = met.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    one = met.select(F.explode("x").alias("a"), "y", "similarity")
    # one record at a time: explode within explode would hold all pairs of two blocks before it hands them on
    later = F.when(F.col("a") < F.col("y")[0], F.col("y")).otherwise(F.filter("y", lambda b: b > F.col("a")))
    return one.select("a", later.alias("y"), "similarity").select("a", F.explode("y").alias("b"), "similarity")


def trigram_join(left: DataFrame, right: DataFrame | None, id_col: str, text: Column, threshold: float, below: float | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs whose trigram similarity reaches the threshold (and is less than ``below``); of one table each pair once, a < b, the most similar first.

    Names are compared, each different one once (by its set of trigrams, see :func:`alike`); records take their names'
    pairs. Null ids and texts without trigrams are left out.
    """
    a, na = named(left, id_col, text)
    b, nb = (a, None) if right is None else named(right, id_col, text)
    found = alike(na, nb, threshold)
    if right is None:
        found = found.union(found.select("nb", "na", "similarity")).union(na.select("id", "id", F.lit(1.0)))
    if below is not None:
        found = found.where(F.col("similarity") < below)
    if right is None:
        return expanded(found, a)
    both = found.join(a.select(F.col("id").alias("na"), F.col("record").alias("a")), "na").join(b.select(F.col("id").alias("nb"), F.col("record").alias("b")), "nb")
    return both.select("a", "b", "similarity")


def trigram_components(df: DataFrame, id_col: str, text: Column, threshold: float) -> DataFrame:
    """(node, root): what :func:`components` gives of the pairs of :func:`trigram_join`, without making them.

    A name's records are all linked, so its smallest one stands for them, and only different names are linked.
    """
    rows, names = named(df, id_col, text)
    rows = rows.select("record", "id").distinct()
    firsts = rows.groupBy("id").agg(F.min("record").alias("first"))
    one = lambda c: firsts.select(F.col("id").alias(f"n{c}"), F.col("first").alias(c))
    linked = alike(names, None, threshold).join(one("a"), "na").join(one("b"), "nb").select("a", "b")
    # a record under several names ties them together
    held = rows.join(firsts, "id").groupBy("record").agg(F.min("first").alias("first"), F.collect_set("first").alias("all"))
    tied = held.where(F.size("all") > 1).select(F.col("first").alias("a"), F.explode("all").alias("b"))
    roots = components(linked.union(tied))
    made = held.select(F.col("record").alias("node"), "first").join(roots.withColumnRenamed("node", "first"), "first", "left").select("node", F.coalesce("root", "first").alias("root"))
    shared = made.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    return made.join(shared, "root").select("node", "root")


def idf(pieces: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df, idf): ln(N / (1 + df))."""
    n = pieces.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"))
    df = pieces.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n_docs") / (1 + F.col("df"))), 6).alias("idf"))


def pair_scores(pieces: DataFrame, weights: DataFrame, most: int = 60) -> DataFrame:
    """(a, b, score) of pieces of different kinds that share a token of at most ``most`` pieces: weighted Dice of their tokens.

    ``pieces`` has (id, kind, tokens). The limit on a token's frequency is part of the operator: common tokens don't link.
    """
    w = weights.select("token", "df", F.greatest("idf", F.lit(0.0)).alias("w"))
    each = pieces.select("id", "kind", F.explode(F.array_distinct("tokens")).alias("token")).join(w, "token")
    mass = each.groupBy("id").agg(F.sum("w").alias("m"))
    rare = each.where(F.col("df") <= most).alias("x")
    other = each.where(F.col("df") <= most).alias("y")
    pairs = rare.join(other, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.kind") != F.col("y.kind"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    shared = pairs.join(each.select(F.col("id").alias("a"), "token", "w"), "a").join(each.select(F.col("id").alias("b"), "token"), ["b", "token"]).groupBy("a", "b").agg(F.sum("w").alias("s"))
    out = shared.join(mass.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(mass.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    return out.select("a", "b", F.round(F.when(F.col("ma") + F.col("mb") > 0, 2 * F.col("s") / (F.col("ma") + F.col("mb"))).otherwise(0.0), 4).alias("score"))


def amount_proximity(a: Column, b: Column) -> Column:
    """1 for amounts within a tenth, falling to 0 at ten times; null if one is missing or 0."""
    ratio = F.greatest(a, b) / F.least(a, b)
    return F.when((F.coalesce(a, F.lit(0)) == 0) | (F.coalesce(b, F.lit(0)) == 0), None).when(ratio <= 1.1, 1.0).when(ratio >= 10, 0.0).otherwise(1 - (ratio - 1.1) / 8.9)


#: A common word must be at least so rare for a pair to count in full: 15 in a thousand pieces have it.
TELLING = -math.log(0.015)
#: What a pair without such a word, an amount that fits, dates out of order and sectors are worth.
COMMON, AMOUNT, REVERSED, SAME, OTHER = 0.6, 0.15, 0.10, 0.05, 0.10


def project_scores(pieces: DataFrame, weights: DataFrame, least: float = 0.30, most: int = 60) -> DataFrame:
    """(a, b, score, common, telling) of pieces of different kinds that may belong to one project, from ``least`` on.

    ``pieces`` has (id, kind, rank, tokens, amount, sector, day); ``rank`` is a kind's place in the chain. To the weighted
    Dice of the tokens come how well the amounts fit, whether the later piece has the earlier date, and whether the sectors
    agree, as far as they are known; without a rare common token the score counts for less.
    """
    base = pair_scores(pieces, weights, most)
    one = lambda c: pieces.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("rank", "tokens", "amount", "sector", "day")])
    rows = base.join(one("a"), "a").join(one("b"), "b")
    common = rows.select("a", "b", F.explode(F.array_intersect("a_tokens", "b_tokens")).alias("token")).join(weights.select("token", "idf"), "token")
    common = common.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("idf").alias("rarest"), F.max_by("token", F.struct("idf", "token")).alias("telling"))
    rows = rows.join(common, ["a", "b"])
    fits = amount_proximity(F.col("a_amount"), F.col("b_amount"))
    first = F.col("a_rank") <= F.col("b_rank")
    early, late = F.when(first, F.col("a_day")).otherwise(F.col("b_day")), F.when(first, F.col("b_day")).otherwise(F.col("a_day"))
    agree = F.when(F.col("a_sector").isNull() | F.col("b_sector").isNull(), 0.0).when(F.col("a_sector") == F.col("b_sector"), SAME).otherwise(-OTHER)
    total = F.col("score") + F.coalesce(AMOUNT * (fits - 0.5), F.lit(0.0)) - F.when(late < early, REVERSED).otherwise(0.0) + agree
    rare = F.col("rarest") >= TELLING
    total = F.when(rare, total).otherwise(total * COMMON)
    made = rows.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("score"), "common", F.when(rare, F.col("telling")).alias("telling"))
    return made.where(F.col("score") >= least)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is reachable over the pairs (a, b). Labels jump along their own pointers each round, until none moves."""
    edges = pairs.select("a", "b").union(pairs.select("b", "a")).where("a != b").distinct()
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    edges, before = edges.checkpoint(), None
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("root", "m").alias("root"))
        up = moved.select(F.col("node").alias("n"), F.col("root").alias("r"))
        labels = moved.join(up, moved.root == up.n).select("node", F.least("root", "r").alias("root")).checkpoint()
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).collect()[0][0]
        if total == before:
            break
        before = total
    return labels


def canonical(df: DataFrame, id_col: str, pointer: str) -> DataFrame:
    """(id, canonical): one hop, as queries resolve it."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(pointer, id_col).alias("canonical"))


def geocode(places: DataFrame, gazetteer: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(key, place_id, similarity): the exact name with most people, else the most similar one that reaches the threshold.

    ``places`` has (key), ``gazetteer`` (place_id, key, population). Empty keys find nothing. Similarities have four places; of
    equal ones the place with most people counts, then the smallest id.
    """
    wanted = places.select("key").where("key <> ''").distinct()
    order = [F.col("population").desc_nulls_last(), F.col("place_id")]
    exact = wanted.join(gazetteer, "key").withColumn("similarity", F.lit(1.0))
    exact = exact.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("k = 1").select("key", "place_id", "similarity")
    rest = wanted.join(exact, "key", "left_anti")
    # only names that share one of their rarest trigrams meet, each different name once
    names = gazetteer.select("key").where("key <> ''").distinct()
    near = trigram_join(rest.select(F.col("key").alias("id")), names.select(F.col("key").alias("id")), "id", F.col("id"), threshold)
    pairs = near.select(F.col("a").alias("key"), F.col("b").alias("name"), "similarity").join(gazetteer.select("place_id", "population", F.col("key").alias("name")), "name")
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), *order))).where("k = 1")
    return exact.unionByName(best.select("key", "place_id", "similarity"))


def keyword_windows(docs: DataFrame, id_col: str, text: str, word: str, before: int, after: int) -> DataFrame:
    """(id, start, end): stretches around each hit of a word (in any case, taken literally), touching ones merged; counted from 0. Null texts have none."""
    literal = r"\Q" + word.lower().replace(r"\E", r"\E\\E\Q") + r"\E"
    rows = docs.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.length(text).alias("n"), F.split(F.lower(text), literal, -1).alias("parts"))
    parts = rows.where(F.size("parts") > 1).select("row", "id", "n", F.size("parts").alias("k"), F.posexplode("parts").alias("nth", "part"))
    w = Window.partitionBy("row").orderBy("nth")
    hits = parts.select("row", "id", "n", "k", "nth", (F.sum(F.length("part")).over(w) + F.col("nth") * len(word)).alias("p")).where("nth < k - 1")
    spans = hits.select("row", "id", "nth", F.greatest(F.col("p") - before, F.lit(0)).alias("s"), F.least(F.col("p") + after, F.col("n")).alias("e"))
    new = (F.col("s") > F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    islands = spans.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("island", F.sum("new").over(w))
    return islands.groupBy("row", "island").agg(F.first("id").alias("id"), F.min("s").alias("start"), F.max("e").alias("end")).select("id", "start", "end")
