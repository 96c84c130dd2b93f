"""Jobs that put records together: suppliers, pointers, tenures, proposals, admissions. Each may be run again and gives the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.offices import seat_key
from ..functions.rules import facility_sector
from ..functions.text import company_key, person_key, place_key
from . import linkage, records

#: From here on two spellings are the same supplier without a review.
MERGED = 0.90


def suppliers(raw: DataFrame, known: DataFrame) -> DataFrame:
    """(key, name, n, spellings, id, state): one supplier for each key of the spellings in ``raw`` (name).

    The name is the most frequent spelling. ``known`` has (id, key, name, frozen): a supplier that isn't in it is ``new``
    (with a null id), one whose name isn't frozen and is another now is ``renamed`` and has the new name, others stay the ``same``.
    """
    rows = raw.where(F.trim("name") != "").withColumn("key", company_key("name")).where("key <> ''")
    found = records.display_form(rows, "key", "name")
    held = known.select("key", "id", F.col("name").alias("was"), "frozen")
    state = F.when(F.col("id").isNull(), "new").when(~F.col("frozen") & (F.col("was") != F.col("display")), "renamed").otherwise("same")
    made = found.join(held, "key", "left").withColumn("state", state)
    return made.select("key", F.when(F.col("state") == "same", F.col("was")).otherwise(F.col("display")).alias("name"), "n", "spellings", "id", "state")


def resolved(df: DataFrame, id_col: str, pointer: str) -> DataFrame:
    """(id, root): where the pointers lead from each row. In a circle the way ends where it comes by again; a pointer to nowhere ends at what it names.

    Each round doubles the steps that a row has taken, so a chain takes as many rounds as its length has binary digits. The few
    rows that go round in circles are followed step by step.
    """
    links = df.where(F.col(pointer).isNotNull()).select(F.col(id_col).alias("from"), F.col(pointer).alias("to")).checkpoint()
    rows, size = df.select(F.col(id_col).alias("id")), links.count()
    jumps, steps = links, 1
    while True:
        # where a row is after so many steps, or where its way ended before
        onward = jumps.select(F.col("from").alias("via"), F.col("to").alias("then"))
        moved = jumps.join(onward, F.col("to") == F.col("via"), "left").select("from", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("open")).checkpoint()
        jumps, steps = moved.drop("open"), steps * 2
        if steps > size or moved.where("open").limit(1).count() == 0:
            break
    # who still has a way to go after more steps than there are pointers is in a circle, or leads into one
    endless = jumps.join(links.select(F.col("from").alias("next")), F.col("to") == F.col("next"), "left_semi").select("from")
    straight = rows.join(jumps, F.col("id") == F.col("from"), "left").join(endless.withColumnRenamed("from", "endless"), F.col("id") == F.col("endless"), "left_anti").select("id", F.coalesce("to", "id").alias("root"))
    way = rows.join(endless, F.col("id") == F.col("from"), "left_semi").select("id", F.col("id").alias("at"), F.array("id").alias("way"))
    done = straight
    while way.limit(1).count():
        step = way.join(links, F.col("at") == F.col("from"), "left").checkpoint()
        again = F.array_contains("way", F.col("to"))
        done = done.union(step.where(F.col("to").isNull() | again).select("id", F.coalesce("to", "at").alias("root")))
        way = step.where(F.col("to").isNotNull() & ~again).select("id", F.col("to").alias("at"), F.array_append("way", F.col("to")).alias("way"))
    return done


def automatic_merges(names: DataFrame, threshold: float = MERGED) -> DataFrame:
    """(id, canonical) of suppliers (id, name) that are merged without a review: names of at least this similarity.

    The most similar pairs first (of equal ones by their ids), a supplier is merged once, into what the one with the shorter
    name (of equal ones the smaller id) has been merged into by then. So each goes to the first better one that it meets, and
    on from there along what was merged before. Suppliers of one name and length meet the same ones, hence only the first
    of each such group is compared; the others go where their equals are.
    """
    rows, sets = linkage.named(names, "id", F.col("name"))
    rows = rows.select("record", F.col("id").alias("key"), F.length("text").alias("n")).distinct()
    groups = rows.groupBy("key", "n").agg(F.min("record").alias("first")).checkpoint()
    found = linkage.alike(sets, None, threshold)
    found = found.union(found.select("nb", "na", "similarity")).union(sets.select("id", "id", F.lit(1.0)))
    x, y = groups.alias("x"), groups.alias("y")
    near = x.join(found, F.col("x.key") == F.col("na")).join(y, F.col("nb") == F.col("y.key")).where("y.n <= x.n")
    near = near.select(F.col("x.key").alias("key"), F.col("x.n").alias("n"), F.col("x.first").alias("first"), "similarity", F.col("y.first").alias("to"), (F.col("y.n") < F.col("x.n")).alias("shorter")).checkpoint()
    when = [(-F.col("similarity")).alias("s"), F.least("id", "to").alias("lo"), F.greatest("id", "to").alias("hi")]
    firsts = near.where("shorter OR to < first").groupBy(F.col("first").alias("id")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "to")).alias("k"))
    firsts = firsts.select("id", (-F.col("k.s")).alias("similarity"), "k.to").select("id", "to", F.struct(*when).alias("when")).checkpoint()
    equal = near.where("similarity = 1").groupBy("key", "n", "first").agg(F.min("to").alias("to"))
    others = rows.join(equal, ["key", "n"]).where("record <> first").select(F.col("record").alias("id"), F.lit(1.0).alias("similarity"), "to").select("id", "to", F.struct(*when).alias("when"))
    step = firsts.select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("when").alias("then"))
    here, arrived = firsts.union(others), None
    while True:
        # what has come to one that was merged earlier goes on, the rest has arrived
        went = here.join(step, F.col("to") == F.col("at"), "left").withColumn("on", F.coalesce(F.col("then") < F.col("when"), F.lit(False))).checkpoint()
        there = went.where("NOT on").select("id", F.col("to").alias("canonical"))
        arrived = there if arrived is None else arrived.union(there)
        here = went.where("on").select("id", F.col("next").alias("to"), "when")
        if here.isEmpty():
            return arrived


def proposals(names: DataFrame, low: float, high: float = MERGED) -> DataFrame:
    """(a, b, similarity) to be reviewed: names alike, but not so much that they are merged anyway; rounded to two places, the most alike first.

    The join makes them in this order (see :func:`linkage.expanded`), so they aren't sorted again.
    """
    pairs = linkage.trigram_join(names, None, "id", F.col("name"), low, below=high)
    return pairs.select("a", "b", F.round("similarity", 2).alias("similarity"))


def _fold_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Tenures of the people and seats of one component, by the order of the appointments."""
    made: list[list] = []
    seats: dict[tuple, int] = {}
    held: dict[int, list[int]] = {}

    def close(k: int, day, by: int) -> None:
        made[k][5:7] = [day, by]
        if k in held.get(made[k][0], []):
            held[made[k][0]].remove(k)

    for r in rows.sort_values(["nth"]).itertuples():
        place = None if pd.isna(r.place) else int(r.place)
        seat = (place, r.seat) if place is not None and isinstance(r.seat, str) else None
        structure = None if pd.isna(r.structure_id) else int(r.structure_id)
        own = held.setdefault(r.person_id, [])
        if r.type == "start":
            before = seats.get(seat) if seat else None
            if seat and before is not None and made[before][0] == r.person_id:
                continue
            if not seat and any(made[k][2] == r.post and made[k][1] == structure for k in own):
                continue
            if before is not None:
                close(before, r.day, r.id)
            made.append([r.person_id, structure, r.post, r.day, r.id, None, None])
            own.append(len(made) - 1)
            if seat:
                seats[seat] = len(made) - 1
        elif own:
            there = [k for k in own if made[k][1] == structure] if structure is not None else []
            last = (there or own)[-1]
            close(last, r.day, r.id)
            if seat and seats.get(seat) == last:
                del seats[seat]
    out = pd.DataFrame(made, columns=["person_id", "structure_id", "post", "begin", "opened_by", "done", "closed_by"])
    return out.astype({"structure_id": "Int64", "closed_by": "Int64", "person_id": "int64", "opened_by": "int64"})


TENURE = "person_id long, structure_id long, post string, begin date, opened_by long, done date, closed_by long"


def tenures(appointments: DataFrame, structures: DataFrame) -> DataFrame:
    """Who held which post from when to when, from valid appointments (id, person_id, structure_id, post, type, day, published, status).

    Who follows on a seat closes the tenure before; an end closes the last open tenure of the person, in that institution
    if there is one; an appointment to what someone holds already says nothing. ``structures`` has (id, name, canonical_id).
    People and seats that appointments tie together form a component, and each is gone through in order by itself.
    """
    single = ~F.coalesce(F.col("name"), F.lit("")).rlike(r"(?iU)^\s*minist[èe]re\b")
    roots = structures.select(F.col("id").alias("root"), single.alias("single"))
    places = structures.select(F.col("id").alias("structure_id"), F.coalesce("canonical_id", "id").alias("place")).join(roots, F.col("place") == F.col("root"), "left").drop("root")
    rows = records.published(appointments).join(places, "structure_id", "left")
    seat = F.when(F.col("place").isNotNull(), seat_key("post", F.coalesce("single", F.lit(False))))
    rows = rows.withColumn("seat", seat).select("id", "person_id", "structure_id", "place", "seat", "post", "type", "published", F.coalesce("day", "published").alias("day"))
    # a seat's number is negative, so that it can't be a person's
    number = F.when(F.col("seat").isNotNull(), -F.abs(F.xxhash64("place", "seat") % F.lit(1 << 62)) - 1)
    rows = rows.withColumn("seat_number", number).checkpoint()
    ties = rows.where("seat_number IS NOT NULL").select(F.col("person_id").alias("a"), F.col("seat_number").alias("b")).distinct()
    root = linkage.components(ties)
    grouped = rows.join(root, rows.person_id == root.node, "left").withColumn("group", F.coalesce("root", "person_id"))
    order = F.struct(F.col("published").isNotNull().alias("a"), F.col("published").alias("b"), F.col("id").alias("c"))
    numbered = grouped.withColumn("nth", F.format_string("%d|%s|%020d", order["a"].cast("int"), F.coalesce(order["b"].cast("string"), F.lit("")), order["c"]))
    return numbered.select("group", "id", "person_id", "structure_id", "place", "seat", "post", "type", "day", "nth").groupBy("group").applyInPandas(_fold_group, TENURE)


def admitted(incoming: DataFrame, known: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Awards that are taken in: with an awardee and an object, not published before, and of those that come twice the first."""
    rows = incoming.where((F.coalesce("awardee", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "")).withColumn("key", key)
    fresh = rows.join(known.select(key.alias("key")).distinct(), "key", "left_anti")
    return records.latest(fresh, ["key"], order)


def people(mentions: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """(key, id, name): the person of each key that is mentioned: the known one with the smallest id, else a new one (null id) by the least name."""
    held = known.withColumn("key", key).groupBy("key").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("was"))
    asked = mentions.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min("name").alias("said"))
    return asked.join(held, "key", "left").select("key", "id", F.coalesce("was", "said").alias("name"))


def synchronised(state: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """(key, role, active, change): a list as it is now; who isn't on it any more stays, but isn't active."""
    now = snapshot.select(F.col(key), F.col("role").alias("new_role"), F.lit(True).alias("there"))
    made = state.withColumn("known", F.lit(True)).join(now, key, "full_outer")
    change = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull() & F.col("active"), "left").when(F.col("there") & ~F.col("active"), "back").otherwise("none")
    return made.select(key, F.when(F.col("there"), F.col("new_role")).otherwise(F.col("role")).alias("role"), F.coalesce("there", F.lit(False)).alias("active"), change.alias("change"))


def facilities_admitted(found: DataFrame, known: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Facilities (kind, place, day, ...) with the locality that their place names, without those known already and each once.

    Known is a facility of the same kind that wasn't rejected, at the same locality (or, where none is found, of the same
    place's key) and of the same day, if the new one has a day. ``known`` has (kind, locality, place, day, status),
    ``gazetteer`` (place_id, key, population).
    """
    rows = found.withColumn("key", place_key("place"))
    places = linkage.geocode(rows.select("key"), gazetteer).select("key", F.col("place_id").alias("locality"))
    rows = rows.join(places, "key", "left").withColumn("spot", F.coalesce(F.col("locality").cast("string"), F.concat(F.lit("?"), "key")))
    there = known.where(F.col("status") != records.REJECTED).select("kind", "locality", place_key("place").alias("key"), "day")
    there = there.select("kind", F.col("day").alias("known_day"), F.explode(F.array_compact(F.array(F.col("locality").cast("string"), F.concat(F.lit("?"), "key")))).alias("spot"))
    dated = rows.where("day IS NOT NULL").join(there.withColumnRenamed("known_day", "day"), ["kind", "spot", "day"], "left_anti")
    undated = rows.where("day IS NULL").join(there, ["kind", "spot"], "left_anti")
    fresh = dated.unionByName(undated)
    return records.latest(fresh, ["kind", "spot", "day"], [F.col("id")]).drop("key", "spot")


def same_names(structures: DataFrame, pointer: str | None = None) -> DataFrame:
    """(id, canonical, acronym) of institutions (id, name, acronym) whose name's key another one has: the smallest id stands for all, and takes the acronym of the first that has one if it has none.

    With a ``pointer`` only those take part that don't point to another one yet.
    """
    rows = (structures.where(F.col(pointer).isNull()) if pointer else structures).withColumn("key", person_key("name"))
    has = F.nullif("acronym", F.lit(""))
    groups = rows.groupBy("key").agg(F.min("id").alias("canonical"), F.min_by(has, F.struct(has.isNull(), "id")).alias("given"), F.min_by(has, "id").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, "key").where("id <> canonical").select("id", "canonical", F.coalesce("own", "given").alias("acronym"))


def homonyms(mentions: DataFrame) -> DataFrame:
    """(id, person_id, identity) of mentions (id, person_id, structure_id, number): which of the people that share a record is meant.

    A record whose mentions have several numbers is several people; the number with most mentions (of equals the least)
    keeps the record. A mention without a number is of the one whose number alone belongs to its institution, else of that one.
    """
    known = mentions.where("number IS NOT NULL")
    counts = known.groupBy("person_id", "number").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("person_id").agg(F.min_by("number", F.struct(-F.col("n"), "number")).alias("main"))
    places = known.where("structure_id IS NOT NULL").groupBy("person_id", "structure_id").agg(F.count_distinct("number").alias("k"), F.min("number").alias("only")).where("k = 1")
    rows = mentions.join(first, "person_id", "left").join(places.drop("k"), ["person_id", "structure_id"], "left")
    return rows.select("id", "person_id", F.coalesce("number", "only", "main").alias("identity"))


def structures(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """(name, acronym, id, new) of every different mention (name, acronym): the known institution (id, name, acronym) with its acronym, else with its name in any case, else a new one.

    Of several known ones the smallest id is meant. Mentions that nothing is known of are one new institution if they share an
    acronym, or a name in any case with one that has an acronym; ``id`` is null then and ``new`` tells them apart. Mentions of nothing are left out.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    asked = mentions.select(blank("name"), blank("acronym")).distinct().where("name IS NOT NULL OR acronym IS NOT NULL")
    by_acronym = known.select(blank("acronym"), "id").where("acronym IS NOT NULL").groupBy("acronym").agg(F.min("id").alias("of_acronym"))
    by_name = known.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.min("id").alias("of_name"))
    rows = asked.withColumn("low", F.lower("name")).join(by_acronym, "acronym", "left").join(by_name, "low", "left").withColumn("id", F.coalesce("of_acronym", "of_name"))
    given = rows.where("id IS NULL AND acronym IS NOT NULL AND low IS NOT NULL").groupBy("low").agg(F.min("acronym").alias("shared"))
    new = F.when(F.col("id").isNull(), F.coalesce("acronym", "shared", "low"))
    return rows.join(given, "low", "left").select("name", "acronym", "id", new.alias("new"))


def facilities_read(entries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Facilities of structured news (id, document, type, title, place, region, arrival, day, published), with their places: (id, document, kind, title, day, place_id, place, region, latitude, longitude, arrival, latitude_to, longitude_to, precision, sector, status).

    The place is looked up by its name, or the region's where none is given; the arrival's name only stays if it is found. The
    event's day is the paper's where none is stated. ``gazetteer`` has (place_id, name, key, type, region, latitude, longitude,
    population). All wait for review.
    """
    rows = entries.withColumn("__from", place_key(F.coalesce("place", "region"))).withColumn("__to", place_key("arrival"))
    asked = rows.select(F.explode(F.array("__from", "__to")).alias("key")).distinct()
    found = linkage.geocode(asked, gazetteer.select("place_id", "key", "population")).select("key", "place_id")
    known = gazetteer.select("place_id", "type", F.col("region").alias("known_region"), "latitude", "longitude")
    start = found.join(known.withColumnRenamed("type", "__type"), "place_id").withColumnRenamed("key", "__from")
    end = found.join(known, "place_id").select(F.col("key").alias("__to"), F.col("latitude").alias("latitude_to"), F.col("longitude").alias("longitude_to"))
    made = rows.join(start, "__from", "left").join(end, "__to", "left")
    precision = F.when(F.col("__type") == "commune", "commune").when(F.col("place_id").isNotNull(), "region")
    return made.select("id", "document", F.col("type").alias("kind"), F.substring("title", 1, 500).alias("title"), F.coalesce("day", "published").alias("day"), "place_id", F.coalesce("place", "region").alias("place"), F.coalesce("known_region", "region").alias("region"), "latitude", "longitude", F.when(F.col("latitude_to").isNotNull(), F.col("arrival")).alias("arrival"), "latitude_to", "longitude_to", precision.alias("precision"), F.coalesce(facility_sector(F.col("type")), F.lit("Autres")).alias("sector"), F.lit(records.PENDING).alias("status"))
