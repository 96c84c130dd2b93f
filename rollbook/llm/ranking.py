"""The best documents for each item, by a tree of documents that share their frequent words.

Of every document only the words that some item asks for are kept, with their numbers of
occurrences. A task puts its documents into a prefix tree, in which a document's path is its
words from the most to the least frequent one, so that documents with the same frequent
words lie in one subtree. A node knows, for each word, the largest number of occurrences in
a document under it, and the smallest length factor m. As the score rises with the one and
falls with the other, these bound every score of the subtree, and the search of an item
goes depth first, best bound first, and leaves out what can't reach its ten best so far.

Nothing is dropped that could be among the best: a bound equal to the tenth score is
followed, as ties go by id. Tasks give at most ``top`` rows an item, of which windows keep
the best. Items come in blocks of a bounded number of words, each against all documents.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, small_batches, whole_text

TOP = 10
#: Distinct words of a block of items (a longer item is a block of its own), and items in it.
WORDS_A_BLOCK, ITEMS_A_BLOCK = 8_192, 2_000
#: Word entries that a tree is built over, documents of a leaf at least, numbers in the table of maxima at most.
ENTRIES_A_TREE, LEAF, CELLS = 2_000_000, 16, 12_000_000
#: Groups that an item's candidates are dealt to before the last ranking.
SALTS = 64
#: A letter or digit of ASCII, or any byte beyond it, belongs to a word; only A-Z are lower-cased.
APART = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))
#: Of the score.
SHARE, SCALE = 75, 1_000_000_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(APART).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


class Tree:
    """A prefix tree over documents given as sorted word ranks: ``ptr`` parts ``term`` and ``tf`` by document.

    Chains without a fork are one node, and sibling subtrees of fewer than ``leaf`` documents share a leaf. Nodes stand
    before what is below them. ``most[t, v]`` is the largest tf of word t under node v, ``least[v]`` the smallest m.
    """

    def __init__(self, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int, leaf: int = LEAF):
        n = len(ptr) - 1
        leaf = max(leaf, int(3 * n * n_terms / CELLS) + 1)
        raw, ends = term.astype(">u4").tobytes(), (ptr * 4).tolist()
        path = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.order = np.array(sorted(range(n), key=path.__getitem__), np.int64)
        size = np.diff(ptr)[self.order]
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(ptr[:-1][self.order] - self.ptr[:-1], size) + np.arange(self.ptr[-1])
        self.term, self.m = term[take], m[self.order]
        own_tf = tf[take]
        self.impact = impact(own_tf, np.repeat(self.m, size))
        shared = self._shared([path[k] for k in self.order])
        self.low, self.high, self.parent = [], [], []
        inner = []
        # (first, last, parent, whether it must be a leaf)
        stack = [(0, n, -1, n <= leaf)] if n else []
        while stack:
            a, b, parent, last = stack.pop()
            v = len(self.low)
            self.low.append(a), self.high.append(b), self.parent.append(parent)
            inner.append(not last)
            if not last:
                depth = shared[a + 1 : b].min()
                cuts = [a, *(np.flatnonzero(shared[a + 1 : b] == depth) + a + 1).tolist(), b]
                begin = a
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if y - x > leaf:
                        if begin < x:
                            stack.append((begin, x, v, True))
                        stack.append((x, y, v, False))
                        begin = y
                    elif y - begin > leaf:
                        if begin < x:
                            stack.append((begin, x, v, True))
                        begin = x
                if begin < b:
                    stack.append((begin, b, v, True))
        nodes = len(self.low)
        self.below: list[list[int]] = [[] for _ in range(nodes)]
        for v in range(1, nodes):
            self.below[self.parent[v]].append(v)
        most, self.least = np.zeros((nodes, n_terms), np.int32), np.full(nodes, np.iinfo(np.int64).max)
        for v in range(nodes - 1, -1, -1):
            if not inner[v]:
                a, b = self.ptr[self.low[v]], self.ptr[self.high[v]]
                np.maximum.at(most[v], self.term[a:b], own_tf[a:b])
                self.least[v] = self.m[self.low[v] : self.high[v]].min()
            if v:
                np.maximum(most[self.parent[v]], most[v], out=most[self.parent[v]])
                self.least[self.parent[v]] = min(self.least[self.parent[v]], self.least[v])
        self.most = np.ascontiguousarray(most.T)

    @staticmethod
    def _shared(path: list[bytes]) -> np.ndarray:
        """How many words each path has in common with the one before (at position 0: none)."""
        out = np.zeros(max(len(path), 1), np.int64)
        for k in range(1, len(path)):
            a, b = path[k - 1], path[k]
            if a == b:
                out[k] = len(a) // 4
                continue
            n = min(len(a), len(b))
            x, y = np.frombuffer(a, ">u4", n // 4), np.frombuffer(b, ">u4", n // 4)
            d = np.flatnonzero(x != y)
            out[k] = d[0] if len(d) else n // 4
        return out

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What no document under each node can exceed."""
        return weight @ impact(self.most[term].astype(np.int64), self.least[None, :])

    def search(self, term: np.ndarray, weight: np.ndarray, least: int, wanted):
        """Depth first, best bound first; calls ``wanted(docs, scores)`` with what scores ``least`` or more and takes its new ``least``."""
        if not self.low:
            return
        bound = self.bounds(term, weight).tolist()
        of = np.zeros(len(self.most), np.int64)
        of[term] = weight
        stack = [0]
        while stack:
            v = stack.pop()
            if bound[v] < least:
                continue
            if self.below[v]:
                stack += sorted((x for x in self.below[v] if bound[x] >= least), key=bound.__getitem__)
                continue
            a, b = self.low[v], self.high[v]
            at = self.ptr[a : b + 1]
            sums = np.concatenate([[0], np.cumsum(of[self.term[at[0] : at[-1]]] * self.impact[at[0] : at[-1]])])
            score = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
            good = np.flatnonzero(score >= least)
            if len(good):
                least = wanted(self.order[a + good], score[good])


class Best:
    """The ``top`` best (score, id) of an item: higher scores first, then smaller ids, ids that are null last."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def least(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def put(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, -d if known else None) for s, known, d in self.heap]


def _blocks(items: DataFrame, item_id: str, text: str):
    """Lists of (id, words) with few enough distinct words; the driver holds one at a time."""
    block, seen = [], set()
    for r in items.select(F.col(item_id).alias("item_id"), whole_text(text).cast("binary").alias("t")).distinct().toLocalIterator():
        asked = Counter(words(bytes(r.t)))
        if not asked:
            continue
        if block and (len(block) >= ITEMS_A_BLOCK or len(seen | asked.keys()) > WORDS_A_BLOCK):
            yield block
            block, seen = [], set()
        block.append((r.item_id, asked))
        seen |= asked.keys()
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, fewer if there are fewer.

    Null texts have no words. Every row of ``docs`` is a document, repeated ones too; equal scores go by ascending id, null
    ids last. Of equal rows of ``items`` one counts; different texts under one item id are ranked each by itself. Items
    without words, or whose words no document holds, have no rows; nor has anything if a table is empty. Texts are read
    whole, whatever their length; other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = items.schema[item_id].dataType.simpleString()
    made = None
    for block in _blocks(items, item_id, item_text):
        found = _block_ranked(docs, block, id_col, text, kind, top)
        made = found if made is None else made.unionByName(found)
    return made if made is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _block_ranked(docs: DataFrame, block: list, id_col: str, text: str, kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast({w: k for k, w in enumerate(sorted({w for _, asked in block for w in asked}))})

    def restrict(batches):
        known = vocabulary.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for t in batch.column("t"):
                found = words(t.as_py())
                count = Counter(found)
                own = sorted((known[w], count[w]) for w in count.keys() & known.keys())
                n.append(len(found))
                terms.append([k for k, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("t"))
    vectors = save(rows.mapInArrow(restrict, "doc_id long, n long, term array<int>, tf array<int>").where("n > 0"), "vectors")
    sums = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).collect()[0]
    size = len(vocabulary.value)
    df = np.zeros(size, np.int64)
    for r in vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a word of the block
        df[r.term] = r.n
    weight = np.floor(1000 * np.log((2.0 * sums.docs + 2) / (2.0 * df + 1))).astype(np.int64)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
    asked = []
    for _, terms in block:
        at = np.array([vocabulary.value[w] for w in terms], np.int64)
        some = df[at] > 0
        asked.append((rank[at[some]], (weight[at] * np.array(list(terms.values()), np.int64))[some]))
    held = spark.sparkContext.broadcast((rank, asked, int(sums.docs), int(sums.terms or 0)))

    def search(batches):
        rank, asked, n_docs, n_terms = held.value
        best = [Best(top) for _ in asked]
        for ids, n, ptr, term, tf in _trees(batches):
            m = 100 - SHARE + (SHARE * n * n_docs) // n_terms
            term = rank[term]
            order = np.lexsort((term, np.repeat(np.arange(len(n)), np.diff(ptr))))
            tree = Tree(ptr, term[order], tf[order], m, len(rank))
            for own, (terms, weights) in zip(best, asked, strict=True):
                if not len(terms):
                    continue

                def wanted(docs, scores, own=own, ids=ids):
                    for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                        own.put(s, ids[d])
                    return own.least()

                tree.search(terms, weights, own.least(), wanted)
        out = [(k, d, s) for k, own in enumerate(best) for s, d in own.rows()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["item", "doc_id", "score"])

    found = vectors.mapInArrow(search, "item long, doc_id long, score long").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item long, item_id {kind}")
    return last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _trees(batches):
    """Documents of bounded numbers of entries: (ids, n, ptr, term, tf)."""
    held, entries = [], 0
    for batch in batches:
        held.append(batch)
        entries += len(batch.column("term").flatten()) + batch.num_rows
        if entries >= ENTRIES_A_TREE:
            yield _arrays(held)
            held, entries = [], 0
    if held:
        yield _arrays(held)


def _arrays(held):
    table = pa.Table.from_batches(held).combine_chunks()
    term, tf = (table.column(c).combine_chunks() for c in ("term", "tf"))
    size = term.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return table.column("doc_id").to_pylist(), table.column("n").to_numpy(), np.concatenate([[0], np.cumsum(size)]), flat(term), flat(tf)
