"""Best-fit packing of token pieces by exact-complement hashing.

How many sequences are made depends on the lengths alone, and there are at most
``capacity`` different ones: the histogram of the lengths is all that the driver sees,
whatever the corpus. From it a plan is made. From the largest length down, the gap
that a piece leaves is looked up among the single lengths, the sums of two and the
sums of three that are still available; a combination that fills the gap exactly is
used as often as the counts allow. What is left goes by best fit: the largest piece
first, each into the fullest sequence that still has room.

The plan says of each length which ranks go where. Pieces get their rank within
their length from counts for each task, and look their place up in the plan.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, save, small_batches
from .tokens import tokenizer

CAPACITY = 4096


class Plan:
    """Groups of equal sequences: (first sequence, how many, lengths in order)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.groups: list[tuple[int, int, tuple[int, ...]]] = []
        self.sequences = 0
        self.left = {k: n for k, n in counts.items() if n > 0}
        if any(not 0 < k <= capacity for k in self.left):
            raise ValueError(f"lengths from 1 to {capacity} can be packed")
        self._exact()
        self._best_fit()

    def _add(self, lengths: tuple[int, ...], times: int) -> None:
        self.groups.append((self.sequences, times, lengths))
        self.sequences += times

    def _exact(self) -> None:
        have, cap = self.left, self.capacity
        bits = sum(1 << k for k in have)
        mirror = sum(1 << (cap - k) for k in have)

        def use(lengths: tuple[int, ...]) -> bool:
            """Make as many sequences of these lengths as there are pieces for."""
            nonlocal bits, mirror
            times = min(have.get(k, 0) // lengths.count(k) for k in set(lengths))
            if not times:
                return False
            self._add(lengths, times)
            for k in lengths:
                have[k] -= times
            for k in set(lengths):
                if not have[k]:
                    del have[k]
                    bits ^= 1 << k
                    mirror ^= 1 << (cap - k)
            return True

        def two(total: int, first: tuple[int, ...]) -> tuple[int, ...] | None:
            """Two available lengths with this sum, the larger one as large as it can be."""
            if total < 2:
                return None
            found = bits & (mirror >> (cap - total)) if total <= cap else 0
            found &= (1 << total) - 1
            while found:
                b = found.bit_length() - 1
                if b * 2 < total:
                    return None
                new = (*first, b, total - b)
                if all(have.get(k, 0) >= new.count(k) for k in set(new)):
                    return new
                found ^= 1 << b
            return None

        for k in sorted(have, reverse=True):
            gap = cap - k
            if not gap:
                use((k,))
                continue
            while k in have and use((k, gap)):
                pass
            while k in have and (new := two(gap, (k,))) and use(new):
                pass
            parts = bits & ((1 << gap) - 1) if k in have else 0
            while k in have and parts:
                c = parts.bit_length() - 1
                if c * 3 < gap:
                    break
                if c in have and (new := two(gap - c, (k, c))) and use(new):
                    continue
                parts ^= 1 << c

    def _best_fit(self) -> None:
        open_at: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        gaps = 0  # a bit for each gap that some open sequence has

        def put(lengths: tuple[int, ...], times: int) -> None:
            nonlocal gaps
            gap = self.capacity - sum(lengths)
            if gap:
                open_at[gap].append((lengths, times))
                gaps |= 1 << gap
            else:
                self._add(lengths, times)

        for k in sorted(self.left, reverse=True):
            n = self.left[k]
            while n:
                fits = gaps >> k
                if not fits:
                    each = min(self.capacity // k, n)
                    times = n // each
                    put((k,) * each, times)
                    n -= each * times
                    continue
                gap = k + (fits & -fits).bit_length() - 1
                lengths, times = open_at[gap].pop()
                if not open_at[gap]:
                    gaps ^= 1 << gap
                each = min(gap // k, n)
                used = min(times, n // each)
                put((*lengths, *(k,) * each), used)
                n -= each * used
                if times > used:
                    put(lengths, times - used)
        for made in open_at.values():
            for lengths, times in made:
                self._add(lengths, times)

    def places(self) -> dict[int, np.ndarray]:
        """For each length the rows (first rank, first sequence, pieces a sequence, offset): those of rank r from the first rank on lie in sequence first + (r - first rank) // pieces."""
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        for first, times, lengths in self.groups:
            at = 0
            for k in dict.fromkeys(lengths):
                each = lengths.count(k)
                rows[k].append((rank[k], first, each, at))
                rank[k] += times * each
                at += each * k
        return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut_documents(docs: DataFrame, path: str, *, end_id: int, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids as little-endian uint32): each document's ids and the end id, cut only where there are more than ``capacity``.

    A null text is empty, so such a document is the end id alone. Repeated rows give repeated pieces; null ids stay null. A text
    of any length gives as many pieces as it fills; an empty table has none; other columns, whatever their names, are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        made = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = made.encode([t or "" for t in batch.column(1).to_pylist()])
            rows: list[tuple] = []
            for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                x += end
                rows += [(doc, k, k * capacity, len(part) // 4, part) for k, at in enumerate(range(0, len(x), 4 * capacity)) if (part := x[at : at + 4 * capacity])]
            doc, piece, start, length, part = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.column(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(part, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, T.StructType(fields))


def digest(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by their crc32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All rows of ``pieces`` with ``sequence_id`` and ``offset``.

    ``length`` runs from 1 to ``capacity``. Rows of equal length are interchangeable, so repeated rows just take two
    places. Any other columns stay; an empty table stays empty.
    """
    spark = pieces.sparkSession
    # written first: else a task that numbers pieces would hold two Python workers, one of them with the tokenizer
    rest = save(pieces.drop("sequence_id", "offset", "__task", "__nth"), "cut")
    names = rest.columns

    def number(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            k = batch.column(length).to_numpy().astype(np.int64)
            order = np.argsort(k, kind="stable")
            first = np.searchsorted(k[order], k[order])
            nth = np.empty(len(k), np.int64)
            nth[order] = np.arange(len(k)) - first
            nth += seen[k]
            seen += np.bincount(k, minlength=capacity + 1)
            yield batch.append_column("__task", pa.array(np.full(len(k), task), pa.int32())).append_column("__nth", pa.array(nth, pa.int64()))

    numbered = save(rest.mapInArrow(number, T.StructType([*rest.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__nth", T.LongType())])), "pieces")
    drop(rest)
    counts = save(numbered.groupBy("__task", length).agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy(length).agg(F.sum("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(Plan(histogram, capacity).places())
    before = counts.select("__task", length, (F.sum("n").over(Window.partitionBy(length).orderBy("__task")) - F.col("n")).alias("before"))

    def place(batches):
        plan = places.value
        for batch in batches:
            k = batch.column(length).to_numpy().astype(np.int64)
            rank = batch.column("__nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for size in np.unique(k):
                own = np.flatnonzero(k == size)
                rows = plan[int(size)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                within = rank[own] - at[:, 0]
                sequence[own] = at[:, 1] + within // at[:, 2]
                offset[own] = at[:, 3] + within % at[:, 2] * size
            kept = batch.select(names)
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    small_batches(spark)
    return numbered.join(before, ["__task", length]).mapInArrow(place, T.StructType([*rest.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
