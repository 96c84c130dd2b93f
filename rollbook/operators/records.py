"""Shapes over a versioned fact store: gates, versions, facets, rankings, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALID, REJECTED, PENDING = "valid", "rejected", "pending"


def published(df: DataFrame, status: str = "status") -> DataFrame:
    """Only rows that passed review."""
    return df.where(F.col(status) == VALID)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The reference version: the first row of each key in the given order (end it with a unique column)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_counts(parent: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Counts of each child table by the parent's key, summed up before they are joined; 0 where there is none."""
    out = parent
    for name, (child, child_key) in children.items():
        counts = child.groupBy(F.col(child_key).alias("__key")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, out[key] == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def facets(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """(facet, value, n): each dimension counted under the filters of the others, in one pass: a row counts for a facet if it meets all filters but that facet's."""
    held = {name: F.lit(True) if value is None else F.coalesce(F.col(name) == value, F.lit(False)) for name, value in filters.items()}
    entries = []
    for name in filters:
        others = F.lit(True)
        for other, meets in held.items():
            others = others if other == name else others & meets
        entries.append(F.when(others, F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
    rows = df.select(*filters).select(F.explode(F.array_compact(F.array(*entries))).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of a listing, counted from 1; at most 100 rows."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-insensitive, in any of the columns; % and _ in the needle are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return out


def consolidate(entities: DataFrame, url: list[str], keys: list[str], status: str, order: Column) -> DataFrame:
    """Across versions of a document the entity with the best status stays (valid, rejected, pending; then ``order``)."""
    rank = F.when(F.col(status) == VALID, 0).when(F.col(status) == REJECTED, 1).otherwise(2)
    return latest(entities, [*url, *keys], [rank, order])


def first_publication(df: DataFrame, key: Column, date: str, id_col: str, status: str) -> DataFrame:
    """Of rows with the same fingerprint the earliest stays (undated ones last); it is valid if any was."""
    w = Window.partitionBy("__key")
    rows = df.withColumn("__key", key)
    rows = rows.withColumn("__any", F.max((F.col(status) == VALID).cast("int")).over(w))
    first = latest(rows, ["__key"], [F.col(date).asc_nulls_last(), F.col(id_col)])
    return first.withColumn(status, F.when(F.col("__any") == 1, VALID).otherwise(F.col(status))).drop("__key", "__any")


def new_versions(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored yet, once each; a null in the key never equals anything, so such rows always count as new."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    fresh = incoming.where(whole).join(known.select(keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return fresh.unionByName(incoming.where(~whole))


def display_form(df: DataFrame, key: str, raw: str) -> DataFrame:
    """Of each key the most frequent spelling; of equals the longest, then the greatest."""
    counts = df.groupBy(key, raw).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by(F.trim(raw), F.struct("n", F.length(raw), raw)).alias("display"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"))


def budget_years(df: DataFrame, year: str, law: Column, revenue: str, spending: str, id_col: str) -> DataFrame:
    """One budget a fiscal year: the highest law, then the fullest, then the last."""
    full = law * 10 + (F.coalesce(F.col(revenue), F.lit(0)) != 0).cast("int") + (F.coalesce(F.col(spending), F.lit(0)) != 0).cast("int")
    return latest(df.withColumn("score", full), [year], [F.col("score").desc(), F.col(id_col).desc()])


def tenures(appointments: DataFrame, seat: str, person: str, date: str, id_col: str) -> DataFrame:
    """Who follows closes the one before: (seat, person, start, end) where the holder changes."""
    w = Window.partitionBy(seat).orderBy(date, id_col)
    changed = appointments.withColumn("__last", F.lag(person).over(w)).where(F.col("__last").isNull() | (F.col("__last") != F.col(person)))
    return changed.select(seat, person, F.col(date).alias("start"), F.lead(date).over(w).alias("end"))


def stale(runs: DataFrame, sources: DataFrame, now: str, hours: dict[str, int]) -> DataFrame:
    """(source, last_ok, stale): no good run within the cadence's hours, or none at all."""
    last = runs.where("status = 'ok'").groupBy("source").agg(F.max("end").alias("last_ok"))
    limit = F.create_map(*[x for k, v in hours.items() for x in (F.lit(k), F.lit(v * 3600))])
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_ok")
    return sources.join(last, "source", "left").withColumn("stale", F.coalesce(age > F.try_element_at(limit, F.col("cadence")), F.lit(True)))


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are made once a row: later filters and expressions that name them often don't have them made again."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """All rows with their place, from 1, in an order of columns that tells every row apart. Dealt by ranges; the driver sees a number a partition."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()
    counts = {r["__part"]: r.n for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [sum(n for p, n in counts.items() if p < k) for k in range(max(counts, default=0) + 1)]
    return rows.withColumn(out, F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__part")) + F.col("__place") + 1).drop("__part", "__place")


def pending_queues(queues: dict[str, DataFrame], status: str = "status") -> DataFrame:
    """(queue, n): how many rows of each wait for review; a queue without any has 0."""
    each = [df.agg(F.count_if(F.col(status) == PENDING).alias("n")).select(F.lit(name).alias("queue"), "n") for name, df in queues.items()]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def bulk_report(kinds: dict[str, DataFrame], least: float, without_score: bool = False, status: str = "status", score: str = "confidence") -> DataFrame:
    """(kind, validated, without_score, remaining) of putting all pending rows of at least this score to valid, by kind.

    ``without_score`` counts the pending rows that have none; they are validated as well if that is asked for.
    """
    waits, none = F.col(status) == PENDING, F.col(score).isNull()
    good = waits & F.coalesce(F.col(score) >= least, F.lit(without_score))
    out = None
    for name, df in kinds.items():
        row = df.agg(F.count_if(good).alias("validated"), F.count_if(waits & none).alias("without_score"), F.count_if(waits & ~good).alias("remaining")).select(F.lit(name).alias("kind"), "validated", "without_score", "remaining")
        out = row if out is None else out.unionByName(row)
    return out


def answers(df: DataFrame, columns: list[str], order: list[str], size: int = 20) -> DataFrame:
    """(page, body): every page of a listing as a JSON answer with its page, the number of pages and rows in all, and its rows in order; ``order`` tells every row apart."""
    size = min(max(size, 1), 100)
    rows = numbered(df, order, "__n")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    item = F.struct("__n", F.struct(*columns).alias("item"))
    pages = rows.groupBy(F.ceil(F.col("__n") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("rows"))  # at most 100 rows a page
    body = F.struct("page", F.ceil(F.col("total") / size).cast("int").alias("pages"), "total", F.transform("rows", lambda x: x["item"]).alias("rows"))
    return pages.join(F.broadcast(total)).select("page", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


#: From here on a reviewer's verdict is applied.
SURE = 0.85


def judged(pairs: DataFrame, verdict: str = "verdict", confidence: str = "confidence", least: float = SURE) -> DataFrame:
    """The pairs with ``accepted``: a verdict that is true and of enough confidence. A null verdict or confidence accepts nothing."""
    return pairs.withColumn("accepted", F.coalesce(F.col(verdict) & (F.col(confidence) >= least), F.lit(False)))


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, value: str, least: float = SURE) -> DataFrame:
    """The rows with ``value`` as the ``reviews`` (key, said, confidence) of enough confidence have it, of several the surest; ``outcome`` is changed, kept or doubt."""
    best = reviews.where(F.col("said").isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct("said", "confidence"), F.struct("confidence", "said")).alias("__r"))
    joined = rows.join(best, F.col(key) == F.col("__key"), "left")
    other = F.col("__r").isNotNull() & ~F.col("__r.said").eqNullSafe(F.col(value))
    sure = F.coalesce(F.col("__r.confidence") >= least, F.lit(False))
    return joined.withColumns({"outcome": F.when(other & sure, "changed").when(other, "doubt").otherwise("kept"), value: F.when(other & sure, F.col("__r.said")).otherwise(F.col(value))}).drop("__key", "__r")


def exploded(papers: DataFrame, id_col: str, text: str, field: str, schema: str, needed: list[str]) -> DataFrame:
    """The entries of one field of structured papers: (id, nth, the entry's columns). Malformed papers have none, nor have entries that lack one of the ``needed`` columns."""
    rows = papers.select(F.col(id_col), F.from_json(text, f"{field} array<struct<{schema}>>").alias("__s")).select(id_col, F.posexplode(f"__s.{field}").alias("nth", "__e")).select(id_col, "nth", "__e.*")
    there = F.lit(True)
    for c in needed:
        there = there & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows.where(there)
