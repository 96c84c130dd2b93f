"""Documents drawn so that together they look like a target's texts.

Runs of words are hashed into buckets. A bucket's gain is the logarithm of how much more
frequent it is in the target than in the corpus, and a document weighs what its runs
gain in all; with Gumbel noise from its id added, the highest scores are a sample drawn
without replacement in proportion to the exponential of the weights.

Where the cut lies is found without sorting: tasks report medians of the keys that are
still open, the driver takes their median weighted by how many keys each stands for, and
one pass counts what lies on both sides of it and reports the medians of both. At least
about a quarter of the open keys goes in each pass. Only the rows above the cut are sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, save, small_batches, whole_text

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Runs that a worker remembers the buckets of; keys that a median stands for at most.
MEMORY, CHUNK = 1_000_000, 1_000_000
#: What isn't a letter, a digit or beyond ASCII parts words; only A-Z are lower-cased.
APART = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max


def words(text: bytes) -> list[bytes]:
    return text.translate(APART).split()


def features(text: bytes, size: int) -> tuple[list[bytes], int]:
    """Runs of 1 to ``size`` words, repeats included, and the number of words."""
    found = words(text)
    runs = list(found)
    for k in range(2, size + 1):
        runs += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return runs, len(found)


class _Buckets(dict):
    """run -> bucket, made when first asked."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[run] = made = zlib.crc32(run) % self.buckets
        return made


def _bucketed(text: bytes | None, size: int, known: _Buckets) -> tuple[np.ndarray, int]:
    runs, n = features(text or b"", size)
    return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)), n


def bucket_counts(texts: DataFrame, text: str = "text", *, size: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket. Null texts have none; an empty table gives zeros."""
    small_batches(texts.sparkSession)

    def count(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(_bucketed(t.as_py(), size, known)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    each = texts.select(whole_text(text).cast("binary").alias("t")).mapInArrow(count, "bucket int, n long")
    made = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        made[r.bucket] = r.n
    return made


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much more frequent each bucket is in the target, with one added everywhere."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text: str = "text", size: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score), a row for each row of ``docs``. A null id counts as the empty text in the noise."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(gain)

    def weigh(batches):
        known, gain_of = _Buckets(len(held.value)), held.value
        for batch in batches:
            made = [_bucketed(t.as_py(), size, known) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) for b, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([int(gain_of[b].sum()) for b, _ in made], pa.int64())],
                names=["doc_id", "n_features", "n_words", "weight"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("t"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def _in_order(score: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return np.lexsort((doc_id, -score))


def _medians(score: np.ndarray, doc_id: np.ndarray):
    """(score, id, number of keys) of each chunk's middle key."""
    for at in range(0, len(score), CHUNK):
        s, d = score[at : at + CHUNK], doc_id[at : at + CHUNK]
        mid = _in_order(s, d)[(len(s) - 1) // 2]
        yield int(s[mid]), int(d[mid]), len(s)


def cutoff(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The k-th key (score, doc_id) by falling score and rising doc_id of a frame of non-null keys; None if k is 0 or there are fewer."""
    if k <= 0:
        return None

    def before(s, d, key):
        return (s > key[0]) | ((s == key[0]) & (d < key[1]))

    def passed(pivot, first, last):
        """Each task: how many open keys are before, at and after the pivot, and medians of those before (side 0) and after (side 2)."""

        def run(batches):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                s, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                open_ = np.ones(len(s), bool)
                if first is not None:
                    open_ &= ~before(s, d, first) & ~((s == first[0]) & (d == first[1]))
                if last is not None:
                    open_ &= before(s, d, last)
                if open_.any():
                    held.append((s[open_], d[open_]))
                if sum(len(x) for x, _ in held) >= CHUNK:
                    yield told(held)
                    held = []
            if held:
                yield told(held)

        def told(held):
            s, d = (np.concatenate(x) for x in zip(*held, strict=True))
            side = np.full(len(s), 2)
            if pivot is not None:
                ahead, same = before(s, d, pivot), (s == pivot[0]) & (d == pivot[1])
                side[ahead], side[same] = 0, 1
            out = [(i, *m) for i in (0, 2) for m in _medians(s[side == i], d[side == i])]
            out += [(1, *pivot, int((side == 1).sum()))] if pivot is not None else []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["side", "score", "doc_id", "n"])

        return keys.select("score", "doc_id").mapInArrow(run, "side long, score long, doc_id long, n long").collect()  # a few rows a task

    first = last = pivot = None
    rows = passed(None, None, None)
    while True:
        sides = {i: [(r.score, r.doc_id, r.n) for r in rows if r.side == i and r.n] for i in (0, 1, 2)}
        ahead, same = (sum(n for _, _, n in sides[i]) for i in (0, 1))
        if pivot is not None and ahead < k <= ahead + same:
            return pivot
        if k <= ahead:
            last, left = pivot, sides[0]
        else:
            k, first, left = k - ahead - same, pivot if pivot is not None else first, sides[2]
        if k > sum(n for _, _, n in left):
            return None
        left.sort(key=lambda m: (-m[0], m[1]))
        half, pivot = sum(n for _, _, n in left) / 2, None
        for s, d, n in left:
            half -= n
            if half <= 0:
                pivot = (s, d)
                break
        rows = passed(pivot, first, last)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", target_text: str = "text", size: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``docs``; ``rank`` counts from 1 and is null where a row isn't drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down. Null and empty texts
    have no runs, weigh 0 and aren't drawn. Equal scores go by the smaller id, null ids last; repeated rows count each, and
    which of rows equal in score and id are drawn isn't said (as many as are due). Texts are read whole. An empty table
    stays empty, an empty target counts 0 everywhere; other columns, whatever their names, are left out.
    """
    gain = gains(bucket_counts(docs, text, size=size, buckets=buckets), bucket_counts(target, target_text, size=size, buckets=buckets))
    rows = save(scored(docs, gain, id_col=id_col, text=text, size=size, seed=seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= least_words
    k = rows.where(fit).count() * percent // 100
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    cut = cutoff(rows.where(fit).select("score", key.alias("doc_id")), k)
    out = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    wins = fit & ((F.col("score") > cut[0]) | ((F.col("score") == cut[0]) & (key <= cut[1])))
    # the row's number lets Spark part rows of one key as well
    best = rows.where(wins).repartitionByRange(partitions(docs.sparkSession), F.desc("score"), key, "row").sortWithinPartitions(F.desc("score"), key, "row")
    best = save(best.select(*out, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "drawn")
    counts = {r.part: r.n for r in best.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    start, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        start.append(before)
        before += counts.get(part, 0)
    rank = F.get(F.array(*[F.lit(x).cast("long") for x in start]), F.col("part")) + F.col("place") + 1
    drawn = best.select(*out, F.when(rank <= k, rank).alias("rank"))
    return drawn.unionByName(rows.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))
