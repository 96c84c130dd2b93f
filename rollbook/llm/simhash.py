"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most three bits have a segment in which they differ in at most one, so
they share a signature that leaves out ("deletes") one bit of that segment: 32
signatures a segment, 64 a fingerprint. Equal signatures are candidates, verified by
counting differing bits.

Only different fingerprints are compared. A signature with two holders is a pair;
those with more go to tasks that compare neighbours in sorted blocks and send back a
spanning forest instead of all pairs. A signature with more than ``MOST`` holders is
cut again: the other segment has a half in which near fingerprints differ in at most
one bit, which leaves at most 2**18 different fingerprints to a signature.

:func:`similar` is for links by the similarity of the shingles themselves. Fingerprints
find texts that are nearly equal; at a Jaccard similarity of 0.8 they differ in ten bits
or so, which no cut into few segments finds. There fingerprints give candidates as well,
and so do ``BANDS`` min-hash keys of ``ROWS`` minima each, by which a pair at the very
threshold is missed with a probability of (1 - 0.8**6)**24, one in 1,400, and others less
often. Whatever is a candidate is compared exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_group, forest, partitions, save, small, small_batches
from .components import components

BITS = 3
SHINGLE = 3
SEED = 42
#: Holders of a signature that are compared in one go.
MOST = 20_000

#: Words of a shingle where texts are compared by similarity, and the least similarity as a fraction.
SIZE = 5
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 6
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_ROW = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def fingerprint_of(text: str, size: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    return int(_majority(h))


def _majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fp") -> DataFrame:
    """All columns but the text, with the fingerprint as a signed long. A null text counts as empty."""
    small_batches(docs.sparkSession)
    rest = docs.drop(out)
    names = [c for c in rest.columns if c != text]

    def run(batches):
        for batch in batches:
            fp = [fingerprint_of(t or "") for t in batch.column(text).cast(pa.string()).to_pylist()]
            kept = batch.select(names)
            yield kept.append_column(out, pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64()))

    fields = [rest.schema[c] for c in names]
    return rest.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))


def _signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): bit j//32 picks the segment, j%32 the bit that is left out."""
    j = F.col("j")
    segment = F.when(j < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    left_out = F.expr("shiftleft(1L, CAST(j % 32 AS INT))")
    return fps.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(F.shiftleft(j.cast("long"), 32).bitwiseOR(segment.bitwiseAND(F.bitwise_not(left_out))).alias("key"), "fp")


def _finer(held: DataFrame) -> DataFrame:
    """Cut the signatures of (key, fp) again, by halves of the other segment."""
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    half = F.when(F.col("i") < 16, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
    left_out = F.expr("shiftleft(1L, CAST(i % 16 AS INT))")
    key = F.shiftleft("key", 21).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 16)).bitwiseOR(half.bitwiseAND(F.bitwise_not(left_out)))
    return held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31)))).select(key.alias("key"), "fp")


def _linked(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each run of equal keys."""
    u, v, held = [], [], 0
    left = np.arange(len(key))
    apart = 0
    while len(left):
        apart += 1
        left = left[left + apart < len(key)]
        left = left[key[left] == key[left + apart]]
        near = left[np.bitwise_count((fp[left] ^ fp[left + apart]).view(np.uint64)) <= bits]
        if len(near):
            u.append(fp[near])
            v.append(fp[near + apart])
            held += len(near)
        if held > 1_000_000:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [a], [b], 0
    if not held and not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(u), np.concatenate(v))


def _within(held: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) among the holders of each signature of (key, fp)."""

    def run(batches):
        for table in by_group(batches, "key"):
            u, v = _linked(table.column("key").to_numpy(), table.column("fp").to_numpy(), bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    n = partitions(held.sparkSession)
    return held.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the different fingerprints ``fp``."""
    if bits > BITS:
        raise ValueError("two segments find at most three differing bits")
    # a fingerprint is a few bytes and gives 64 rows, so the few partitions of its table are dealt out again before
    keyed = _signatures(fps.repartition(partitions(fps.sparkSession)))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    counted = save(counted, "signatures")
    pairs = counted.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v").distinct()
    shared = keyed.join(counted.where("n > 2").select("key", "n"), "key")
    few = shared.where(F.col("n") <= MOST).select("key", "fp")
    many = _finer(shared.where(F.col("n") > MOST).select("key", "fp"))
    return pairs.union(_within(few, bits)).union(_within(many, bits))


def _of_one_id(rows: DataFrame) -> DataFrame:
    """Links (u, v) between the different fingerprints of an id in (id, fp); null ids name nothing in common."""
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).where("u <> most").select("id", "u")
    return rows.join(several, "id").where("fp <> u").select("u", F.col("fp").alias("v"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", bits: int = BITS, by_id: bool = False) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id that is reachable by links.

    Rows with equal fingerprints are linked, so repeated rows and exact copies share a class. With ``by_id`` an id is
    one document, whatever number of rows has it: what any of them is linked with is reachable from all. Otherwise texts
    that share an id are judged each by itself. An id that is null is never the smallest and links nothing; a class of
    null ids only has a null ``component_id``. Any other column is dropped.
    """
    return _classes(docs, id_col, text, bits, by_id).drop("root")


def _classes(docs: DataFrame, id_col: str, text: str, bits: int, by_id: bool = False) -> DataFrame:
    """The same with ``root``, which tells classes apart that have the same smallest id."""
    rows = save(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"))
    fps = save(fps, "distinct")
    linked = links(fps.select("fp"), bits)
    roots = components(linked.union(_of_one_id(rows)) if by_id else linked)
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(found, "fp").select("id", "fp", "root", "component_id")


def hex16(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def _kept(docs: DataFrame, found: DataFrame, id_col: str, named) -> DataFrame:
    """One row of each class of ``found`` (id, name, root): that with the smallest id, and of several such rows that of the smallest name.

    Rows are told apart by id and name, so a text that shares its id with another one is judged by itself; equal in both,
    one stays. Only the few rows whose ids repeat are named again, by ``named``, which adds the column ``__name``; the
    others are picked by id. Rows with a null id stay.
    """
    first = found.where("id IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "name")).alias("k")).select("k.*")
    times = found.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    first = save(first.join(times, "id").select(F.col("id").alias("__id"), F.col("name").alias("__of"), "n"), "kept")
    own = F.col(id_col) == F.col("__id")
    once = docs.join(small(first.where("n = 1").select("__id")), own, "left_semi")
    again = named(docs.join(small(first.where("n > 1").select("__id").distinct()), own, "left_semi"))
    again = again.join(first.where("n > 1"), own & (F.col("__name") == F.col("__of")), "left_semi").dropDuplicates([id_col, "__name"]).drop("__name")
    return once.unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each class: that with the smallest id (of several such rows, that of the smallest fingerprint); rows with a null id and all columns stay."""
    found = _classes(docs, id_col, text, bits).withColumnRenamed("fp", "name")

    def named(rows: DataFrame) -> DataFrame:
        return fingerprints(rows.withColumn("__text", F.col(text)), text="__text", out="__name")

    return _kept(docs, found, id_col, named)


@lru_cache(maxsize=200_000)
def _word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), SEED)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """The hashes of a text's runs of words, sorted, each once; a text of fewer words is one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += _mixed(h[j : j + n]) * _PLACE[j % SIZE]
    return np.unique(_mixed(out))


def keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes, a number for each band."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        # the high bits of a product depend on all bits of its factor
        made = found[at : at + 1024, None] * _TIMES
        made += _PLUS
        made ^= made >> np.uint64(32)
        low = np.minimum(low, made.min(0))
    own = _mixed((_mixed(low).reshape(BANDS, ROWS) * _ROW).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return own.view(np.int64)


def _name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays that share its memory; as Python numbers a component would take several times as much."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())
        out += np.split(values, ends[:-1]) if len(ends) else []
    return out


def _roots(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of the first set that it is linked with, over any number of links."""
    size = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(len(sets)), size)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    whole = flat
    own = np.full(len(sets), -1)
    held = np.zeros(len(values), bool)
    for first in range(len(sets)):
        if own[first] >= 0:
            continue
        own[first] = first
        queue = [first]
        while queue:
            k = queue.pop()
            free = own[which] < 0
            which, flat = which[free], flat[free]
            if not len(flat):
                break
            mine = whole[ends[k] - size[k] : ends[k]]
            held[mine] = True
            common = np.bincount(which[held[flat]], minlength=len(sets))
            held[mine] = False
            near = np.flatnonzero((own < 0) & (common * UNDER >= (size + size[k] - common) * OVER))
            own[near] = first
            queue.extend(near.tolist())
    return own


def similar(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, name, component_id): every row with the name of its set of shingles and the smallest id that is reachable by links.

    A text is the set of its runs of SIZE words (split at white space, lower case). Rows are linked if the Jaccard
    similarity of their sets is OVER / UNDER or more; equal sets are, those without words too. Null texts count as empty;
    null ids are never the smallest, and a class of null ids only has a null ``component_id``. Only different sets are
    compared, and within a component of candidates a set only with those that aren't linked to anything yet; a task
    holds the sets of one component of candidates.
    """
    return _similar(docs, id_col, text).drop("root")


def _similar(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The same with ``root``, which tells classes apart that have the same smallest id."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"]

    def mark(batches):
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            fp = np.array([_majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_name(s) for s in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], names=["id", "name", "fp", "keys"])

    def whole(batches):
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["name", "found"])

    def linked(batches):
        for table in by_group(batches, "root", 2_000):
            root, name = table.column("root").to_numpy(), table.column("name").to_numpy()
            found = _sets(table.column("found"))
            cuts = np.concatenate([[0], np.flatnonzero(root[1:] != root[:-1]) + 1, [len(root)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = _roots(found[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(name[a:b]), pa.array(name[a:b][own])], names=["name", "root"])

    rows = save(docs.mapInArrow(mark, T.StructType([kind, T.StructField("name", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])), "shingled")
    once = save(rows.groupBy("name").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    keyed = once.select("name", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("u"), F.max("name").alias("v")).where("n > 1")
    shared = save(shared, "keys")
    # every holder of a key, or of a fingerprint, is a candidate with the smallest one; so are those of near fingerprints
    more = keyed.join(shared.where("n > 2").select("key", "u"), "key").select("u", F.col("name").alias("v"))
    prints = save(once.groupBy("fp").agg(F.min("name").alias("first")), "prints")
    same = once.join(prints, "fp").where("name != first").select(F.col("first").alias("u"), F.col("name").alias("v"))
    left, right = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in ("u", "v"))
    near = links(prints.select("fp")).join(left, "u").join(right, "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    maybe = components(shared.where("n = 2").select("u", "v").union(more).union(same).union(near))
    maybe = save(maybe.union(maybe.select("root", "root").distinct().toDF("node", "root")).withColumnRenamed("node", "name"), "candidates")
    # the texts of the candidates; ids may be null or repeated, so names are made again and asked for
    wanted = rows.join(maybe, "name", "left_semi").where("id IS NOT NULL").select("id").distinct()
    texts = docs.join(wanted, "id", "left_semi").union(docs.where("id IS NULL"))
    sets = texts.mapInArrow(whole, "name long, found array<long>").join(maybe, "name").dropDuplicates(["name"])
    n = partitions(spark)
    roots = sets.repartition(n, "root").sortWithinPartitions("root").mapInArrow(linked, "name long, root long")
    rooted = save(once.select("name", "least").join(roots, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "name").join(rooted.join(smallest, "root").select("name", "root", "component_id"), "name").select("id", "name", "root", "component_id")


def deduplicate_similar(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of :func:`similar`: that with the smallest id (of several such rows, that of the smallest name); rows with a null id and all columns stay."""
    found = _similar(docs, id_col, text)

    def named(rows: DataFrame) -> DataFrame:
        fields = T.StructType([*rows.schema.fields, T.StructField("__name", T.LongType())])

        def run(batches):
            for batch in batches:
                yield batch.append_column("__name", pa.array([_name(shingles(t or "")) for t in batch.column(text).cast(pa.string()).to_pylist()], pa.int64()))

        return rows.mapInArrow(run, fields)

    return _kept(docs, found, id_col, named)
