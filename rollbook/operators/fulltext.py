"""French full-text search in a positional inverted index.

:func:`write_index` stores for each stem and text where the stem stands, in folders by a hash of the stem and sorted by stem
within, so that a search reads the postings of the stems that it asks for and nothing else. A stem that most texts have is
many rows, dealt to several files. Stop words have no postings but count as places.

Queries are written as people do: all words must occur, ``"several words"`` must follow each other, ``a OR b`` needs one of
both, ``-word`` must not occur. A text's rank is its cover density: every shortest stretch that holds something of each thing
that is asked for counts the more the fewer other words it has.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import STOP_WORDS, stem
from ..llm.common import small_batches

BUCKETS, SALTS = 64, 8
#: Words of the texts whose postings Python holds at once, or one text.
CHUNK = 50_000
#: What a stretch counts, and words of a passage that is shown.
WEIGHT, PASSAGE, BEFORE = 0.1, 28, 6
_WORD = re.compile(r"[^\W_]+")
_STOP = frozenset(STOP_WORDS)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def _postings(batches):
    """A batch for every CHUNK postings and the text that completes them, so that long texts don't add up."""
    for batch in batches:
        kind = batch.schema.field("id").type
        ids, size, terms, places, held = [], [], [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(terms, pa.string()), pa.array(size, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["id", "term", "n", "places"])  # noqa: B023

        for k, text in zip(batch.column("id"), batch.column("text"), strict=True):
            found = defaultdict(list)
            words = words_of((text.as_py() or "").lower())
            for at, word in enumerate(words):
                if word not in _STOP:
                    found[stem(word)].append(at)
            ids += [k.as_py()] * len(found)
            size += [len(words)] * len(found)
            terms += found.keys()
            places += found.values()
            held += len(words)
            if held >= CHUNK:
                yield made()
                ids, size, terms, places, held = [], [], [], [], 0
        yield made()


def bucket(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """The postings (bucket, term, id, n, places) of all texts, as Parquet. Null texts have none, as have rows with a null id; ids must tell texts apart."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_postings, f"id {docs.schema[id_col].dataType.simpleString()}, term string, n int, places array<int>")
    found = found.withColumn("bucket", bucket("term", buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    found.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


@dataclass
class Phrase:
    """Stems and how far each stands behind the first; other words may stand where stop words did."""

    stems: list[str]
    gaps: list[int]


@dataclass
class Asked:
    """Of each list in ``all_of`` a phrase must occur, of ``none_of`` none."""

    all_of: list[list[Phrase]] = field(default_factory=list)
    none_of: list[Phrase] = field(default_factory=list)

    def stems(self) -> list[str]:
        return sorted({s for p in [*(p for ps in self.all_of for p in ps), *self.none_of] for s in p.stems})


def asked(query: str) -> Asked:
    """What a query asks for; stop words ask for nothing."""
    out, either = Asked(), False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.upper() == "OR" and not minus:
            either = bool(out.all_of)
            continue
        found = [(k, stem(w)) for k, w in enumerate(words_of((quoted or word).lower())) if w not in _STOP]
        if not found:
            continue
        phrase = Phrase([s for _, s in found], [k - found[0][0] for k, _ in found])
        if minus:
            out.none_of.append(phrase)
        elif either:
            out.all_of[-1].append(phrase)
        else:
            out.all_of.append([phrase])
        either = False
    return out


def postings(spark: SparkSession, path: str, stems: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some stems; only their folders are opened, and of those the row groups that may hold them."""
    wanted = spark.createDataFrame([(s,) for s in stems], "term string").select(bucket("term", buckets)).distinct().collect() if stems else []
    return spark.read.parquet(path).where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("term").isin(stems)).drop("bucket")


def _starts(phrase: Phrase) -> Column:
    """Where a phrase begins, in the text's map ``m`` of stems to places; empty where it doesn't occur."""
    at = lambda s: F.coalesce(F.try_element_at("m", F.lit(s)), F.array().cast("array<int>"))
    found = at(phrase.stems[0])
    for s, gap in zip(phrase.stems[1:], phrase.gaps[1:], strict=True):
        # meeting places by their sets keeps this linear in their number
        found = F.array_intersect(found, _moved(at(s), gap))
    return found


def _moved(places: Column, gap: int) -> Column:
    return F.transform(places, lambda p: p - gap)


def _events(places: Column, group: int) -> Column:
    return F.transform(places, lambda p: F.struct(p.alias("p"), F.lit(group).alias("i")))


def _covers(groups: list[Column]) -> Column:
    """(rank, begin, end): the density of shortest stretches that hold an entry of each group, and the densest of them."""
    k = len(groups)
    events = F.array_sort(F.flatten(F.array(*[_events(g, i) for i, g in enumerate(groups)])))
    kind = "struct<rank:double,last:array<int>,begin:int,best:double,from:int,to:int>"
    start = F.struct(F.lit(0.0), F.array_repeat(F.lit(-1), k), F.lit(-1), F.lit(0.0), F.lit(-1), F.lit(-1)).cast(kind)

    def step(done: Column, e: Column) -> Column:
        last = F.transform(done["last"], lambda x, i: F.when(i == e["i"], e["p"]).otherwise(x))
        begin = F.array_min(last)
        new = begin > done["begin"]
        worth = F.when(new, WEIGHT / (1 + F.greatest(e["p"] - begin - (k - 1), F.lit(0)))).otherwise(0.0)
        better = worth > done["best"]
        return F.struct((done["rank"] + worth), last, F.when(new, begin).otherwise(done["begin"]), F.greatest(worth, done["best"]), F.when(better, begin).otherwise(done["from"]), F.when(better, e["p"]).otherwise(done["to"])).cast(kind)

    made = F.aggregate(events, start, step)
    return F.struct(made["rank"].alias("rank"), made["from"].alias("begin"), made["to"].alias("end"))


def search(found: DataFrame, query: str) -> DataFrame:
    """(id, n, rank, begin, end, hits) of the texts that answer a query, from the postings (id, term, n, places) of its stems.

    ``begin`` and ``end`` are the words between which the densest stretch stands, ``hits`` the places of all that was asked
    for. A query that asks for nothing finds nothing. Texts come to a row by their ids, a posting a stem.
    """
    q = asked(query)
    rows = found.groupBy("id").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
    if not q.all_of:
        return rows.where(F.lit(False)).select("id", "n", F.lit(0.0).alias("rank"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.array().cast("array<int>").alias("hits"))
    for k, phrases in enumerate(q.all_of):
        rows = rows.select("*", F.explode(F.array(F.array_sort(F.array_distinct(F.flatten(F.array(*map(_starts, phrases))))))).alias(f"g{k}")).where(F.size(f"g{k}") > 0)
    for p in q.none_of:
        rows = rows.where(F.size(_starts(p)) == 0)
    stems = [s for phrases in q.all_of for p in phrases for s in p.stems]
    hits = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.array().cast("array<int>")) for s in stems]))))
    rows = rows.select("id", "n", F.explode(F.array(_covers([F.col(f"g{k}") for k in range(len(q.all_of))]))).alias("c"), hits.alias("hits"))
    return rows.select("id", "n", "c.rank", "c.begin", "c.end", "hits")


def scan(docs: DataFrame, query: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same without an index: every text is read."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_postings, f"id {docs.schema[id_col].dataType.simpleString()}, term string, n int, places array<int>")
    return search(found.where(F.col("term").isin(asked(query).stems())), query)


def headlines(found: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = PASSAGE, before: int = BEFORE) -> DataFrame:
    """All columns of ``found`` with ``headline``: ``size`` words from a few before the densest stretch, as HTML, with what was asked for in <mark>. Meant for a page of results."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(found), "id")

    def mark(batches):
        for batch in batches:
            out = []
            for t, begin, hits in zip(*(batch.column(c).to_pylist() for c in ("__text", "begin", "hits")), strict=True):
                words, at = words_of(t or ""), max(begin - before, 0)
                asked_for = set(hits)
                out.append(" ".join(f"<mark>{html.escape(w)}</mark>" if k in asked_for else html.escape(w) for k, w in enumerate(words[at : at + size], at)))
            yield batch.drop_columns(["__text"]).append_column("headline", pa.array(out, pa.string()))

    kept = rows.drop("__text")
    return rows.mapInArrow(mark, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", headline string")
