"""Near-duplicate embeddings by product quantisation.

Unit vectors are put into inverted lists of a coarse quantiser; what is left of them
is quantised in subspaces, a byte each. Centroids and codebooks are fitted on a bounded
sample, every row is indexed. A row asks all lists in which a link can lie: a vector of
another list is on the far side of the plane between the two centres, so a list is asked
only if that plane is within the radius of a link. Within a list, distances come from lookup tables of the query's residual
against the codebooks; with the quantising error that is stored for each row they bound
the true distance from below, so what is dropped is proven to be too far. The rest is
reranked by the exact cosine in double precision.

Equal vectors are collapsed before, and a list with more than ``BLOCK`` members is dealt
out in blocks, each of which every query of the list visits once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, forest, partitions, save, small_batches
from .components import components

COSINE = 0.98
#: Rows that the quantisers are fitted on at most, lists at most, rows a list aimed at.
SAMPLE, LISTS, ROWS_A_LIST = 20_000, 1024, 1024
SUBSPACES, CODES = 8, 64
BLOCK = 2_000
QUERIES = 512
ROUNDING = 1e-9


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        for j in np.flatnonzero(count):
            centres[j] = x[own == j].mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Index:
    """Coarse centres, and codebooks of the residual's subspaces."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 3):
        self.dim = sample.shape[1] if sample.ndim == 2 and len(sample) else 0
        if not self.dim:
            return
        lists = int(np.clip(rows // ROWS_A_LIST, 1, LISTS))
        self.centres = _kmeans(sample, lists, 8, seed)
        squares = (self.centres**2).sum(1)
        self.apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.centres @ self.centres.T, 0))
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        left = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [_kmeans(left[:, a:b], CODES, 6, seed + k) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantising error of each unit vector."""
        own = _nearest(x, self.centres)
        left = x - self.centres[own]
        codes = np.stack([_nearest(left[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)
        return own, codes, np.linalg.norm(left - self.decode(codes), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of every list that may hold a vector within the radius."""
        d = (x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T
        own = d.argmin(1)
        # half of (d - own d) / apart is the way to the plane between the two centres
        return np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * radius * self.apart[own] + ROUNDING)

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the queries to the quantised members of a list, summed from tables."""
        left = x - self.centres[own]
        total = np.zeros((len(x), len(codes)))
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[k]
            table = (left[:, a:b] ** 2).sum(1)[:, None] + (book**2).sum(1) - 2 * left[:, a:b] @ book.T
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def classes(rows: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of ``rows``.

    Rows are linked if their labels are equal and the cosine of their vectors is at least ``cosine``. Vectors of
    different lengths aren't linked. Vectors that are null, zero, or hold null or non-finite numbers, and rows with a null label or id, link
    with nothing: such a row is its own class. Repeated ids count as separate rows with one name,
    so equal rows link with each other. A cosine that is exactly ``cosine`` links. An empty table stays empty; other columns, whatever their names, are left out.
    """
    spark = rows.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-7
    # floats travel as floats; all sums are in double precision
    of = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    data = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast(of).alias("v"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine = fine & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    data = data.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # a direction is named by the hash of label and vector; equal vectors are one from here on
    good = data.where("fine").withColumn("key", F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), ","))))
    one = save(good.groupBy("key", "label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("node")), "vectors")
    counts = {r.d: r.n for r in one.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, 1.2 * SAMPLE / max(sum(counts.values()), 1))
    sample = one.sample(fraction=share, seed=1) if share < 1 else one
    picked: dict[int, list] = {}
    for r in sample.select("v").limit(SAMPLE).collect():
        picked.setdefault(len(r.v), []).append(r.v)
    index = {}
    for d, n in counts.items():
        # a length that the sample lacks has one list around any centre: the bounds hold, they only exclude less
        x = np.array(picked.get(d, [[1.0] * d]), np.float64)
        x /= np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
        index[d] = Index(x / np.linalg.norm(x, axis=1, keepdims=True), n)
    held = spark.sparkContext.broadcast(index)

    def unit(table) -> np.ndarray:
        x = _matrix(table.column("v"))
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def by_length(batches):
        for batch in batches:
            size = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                yield int(d), batch.filter(pa.array(size == d))

    def put(batches):
        for dim, batch in by_length(batches):
            own, codes, error = held.value[dim].encode(unit(batch))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own.astype(np.int32)), batch.column("node"), batch.column("copies"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["label", "list", "node", "copies", "v", "codes", "error"])

    def ask(batches):
        for dim, batch in by_length(batches):
            q, own = held.value[dim].probes(unit(batch), radius)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([batch.column("label").take(take), pa.array(own.astype(np.int32)), batch.column("node").take(take), batch.column("copies").take(take), batch.column("v").take(take)], names=["label", "list", "node", "copies", "v"])

    kind = one.schema["label"].dataType.simpleString()
    same = one.withColumn("node", F.col("node").cast("long"))
    base = f"label {kind}, list int, node long, copies long, v {of}"
    members = save(same.select("label", "node", "copies", "v").mapInArrow(put, f"{base}, codes binary, error double"), "index")
    members = members.withColumn("dim", F.size("v"))
    sizes = members.groupBy("label", "dim", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    stored = members.join(sizes, ["label", "dim", "list"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    queries = same.select("label", "node", "copies", "v").mapInArrow(ask, base).withColumn("dim", F.size("v")).join(sizes, ["label", "dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("label", "dim", "list", "block").alias("key")
    both = stored.select(group, "label", "list", "block", "node", "copies", "v", "codes", "error").unionByName(queries.select(group, "label", "list", "block", "node", "copies", "v"), allowMissingColumns=True)

    def search(batches):
        for table in by_group(batches, "key", 2_000):
            key = table.column("key").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                stored_rows = np.flatnonzero(part.column("codes").is_valid().to_numpy())
                if not len(stored_rows):
                    continue
                x = unit(part)
                node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                own = part.column("list").to_numpy()[0]
                asking = np.setdiff1d(np.arange(len(x)), stored_rows)
                codes = np.frombuffer(b"".join(part.column("codes").take(pa.array(stored_rows)).to_pylist()), np.uint8).reshape(len(stored_rows), -1)
                error = part.column("error").take(pa.array(stored_rows)).to_numpy()
                u, v, near = [], [], np.zeros(len(asking), np.int64)
                for at in range(0, len(asking), QUERIES):
                    rows = asking[at : at + QUERIES]
                    q, m = np.nonzero(held.value[x.shape[1]].distances(x[rows], own, codes) - error <= radius + ROUNDING)
                    exact = np.einsum("ij,ij->i", x[rows[q]], x[stored_rows[m]])
                    linked = (exact >= cosine) & (node[rows[q]] != node[stored_rows[m]])
                    q, m = rows[q[linked]], stored_rows[m[linked]]
                    near[at : at + QUERIES] = np.bincount(np.searchsorted(rows, q), weights=copies[m], minlength=len(rows)).astype(np.int64)
                    u.append(node[q])
                    v.append(node[m])
                    if sum(map(len, u)) > 1_000_000:
                        a2, b2 = forest(np.concatenate(u), np.concatenate(v))
                        u, v = [a2], [b2]
                if near.any():
                    tree = forest(np.concatenate(u), np.concatenate(v))
                    n1, n2 = np.count_nonzero(near), len(tree[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[asking][near > 0], tree[0]])), pa.array(np.concatenate([near[near > 0], np.zeros(n2, np.int64)])), pa.array(np.concatenate([np.zeros(n1, np.int64), tree[1]]), mask=np.arange(n1 + n2) < n1)], names=["node", "near", "other"])

    small_batches(spark)
    found = save(both.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(search, "node long, near long, other long"), "links")
    near = found.where("other IS NULL").groupBy("node").agg(F.sum("near").alias("near"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("root", "component")
    known = good.select("id", "key").join(one.select("key", F.col("copies"), F.col("node").cast("long").alias("node")), "key")
    linked = known.join(near, "node", "left").join(roots, "node", "left").select("id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    alone = data.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
