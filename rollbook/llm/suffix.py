"""Exact removal of long repeated substrings by external induced sorting.

A symbol is removed if a string of ``length`` symbols that covers it also starts anywhere
else in the corpus (same text included; matches never cross texts). Symbols are bytes, or
words. All starts are found, not a sample of them:

1. *Sample suffixes.* Every window of ``length`` symbols has an anchor, the place in it
   whose next symbols (``gram`` of them) hash lowest (the rightmost of equals). Equal windows
   have their anchors at the same offset, so only windows at anchors with equal grams are
   ever compared. An anchor stands for a run of windows; its *span* is their union. Grams
   that the corpus has at one place only are done with: they are left out by counts that
   are summed up before any shuffle.
2. *Naming.* Anchors are named by two hashes of different kinds, of the gram and of the
   span, and the names are counted with map-side sums. A name that occurs twice means that
   all windows of the run repeat, and one occurrence stands for the others from here on.
   This settles exact copies and the inside of near copies.
3. *Induced sorting.* What remains are grams with several different spans. Their
   suffixes are sorted from the anchor on by Spark's external sorter (sorted runs on
   disk, merged by a priority queue), a partition being far larger than memory if need
   be. The common prefixes of neighbours are taken once. The order of the windows that
   start one symbol earlier is then induced, symbol by symbol to the left: a stable sort of
   the order before by the new first symbol, the common prefix of new neighbours being one
   more than the minimum between their old places. A window repeats if the prefix that it
   shares with a neighbour reaches ``length``; here symbols themselves are compared.
4. *Recursion.* A gram with more than ``MOST`` different spans isn't sorted in one go: its
   windows are taken in bands of ``BAND`` starts, the band's common core being the gram
   and the band's union the span, and named again as in 2; of bands with too many spans
   each single window is named. So no group is bounded by luck, and none is cut short.

Texts are shuffled once, into a table with each different text once that is bucketed by the
text's id; the later joins bring ids and places to it. What is gathered for one text (its
anchors, runs and spans) is in proportion to that text, which is a row itself. Texts go
through in pieces of ``CHUNK`` symbols that overlap by a window, so a text may be as long as
Spark can hold.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_group, drop, partitions, save, save_bucketed, small_batches, whole_text

LENGTH = 400
#: Symbols of a gram in a window of LENGTH; other windows in proportion.
GRAM = 144
BAND = 16
MOST = 4_096
CHUNK = 1 << 21
SEED = 42
#: Ranges of scripts that put no spaces between words; each of their characters counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
DENSE = re.compile(f"[{UNSPACED}]")
_UNSPACED = [(ord(a), ord(b)) for a, b in re.findall("(.)-(.)", UNSPACED)]
#: Which code points are white space; the last is U+3000, so U+3001 stands for all others.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=200_000)
def _word(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"), SEED)


def words_of(text: str) -> list[str]:
    """Between white space; of scripts without spaces each character."""
    return WORD.findall(text) if not text.isascii() and DENSE.search(text) else text.split()


def symbols(text: str, words: bool) -> np.ndarray:
    """The bytes of a text, or its words as 64-bit numbers."""
    if not words:
        return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    found = words_of(text)
    return np.fromiter(map(_word, found), np.uint64, len(found))


class Hashes:
    """Hashes of any substring of a buffer, in constant time each."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data)).bit_length())
        self.up, self.down = _powers(size)
        each = _TABLE[data] if data.dtype == np.uint8 else data
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(each * self.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _MIX)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings by another function than that of the grams, from the symbols themselves."""
    raw, width = memoryview(np.ascontiguousarray(data)).cast("B"), data.itemsize
    name = xxhash.xxh3_64_intdigest
    return np.fromiter((name(raw[a:b], SEED) for a, b in zip((start * width).tolist(), (end * width).tolist(), strict=True)), np.uint64, len(start)).view(np.int64)


def anchors(data: np.ndarray, stop: np.ndarray, length: int, gram: int):
    """Anchors of the windows in a buffer of texts: (place, first window, last window, gram hash, span hash).

    ``stop``: for each symbol the end of its text. Windows that don't lie within one text are left out.
    """
    empty = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return empty, empty, empty, empty, empty
    h = Hashes(data).grams(gram)
    order = np.arange(len(h), dtype=np.uint64)
    low = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - order)  # of equals the rightmost is lowest
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))).astype(np.int64)[:n]
    starts = np.arange(n)
    inside = stop[:n] - starts >= length
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]]) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    at = place[first]
    return at, first, last, h[at].view(np.int64), _names(data, first, last + length)


def _pieces(texts: list[np.ndarray], length: int):
    """Buffers of at most about CHUNK symbols: (text numbers, their offsets in the text, the parts). Long texts are cut with an overlap that keeps every window in one piece."""
    owner, offset, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            part = t[at : at + CHUNK + length - 1]
            owner.append(k)
            offset.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(owner), np.array(offset), parts
                owner, offset, parts, size = [], [], [], 0
    if parts:
        yield np.array(owner), np.array(offset), parts


ANCHOR = "gram long, span long, copies long, tid binary, place long, first int, last int"


def _anchor_rows(one: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """Anchors of (tid, text, copies), one row each: first and last count the symbols from a window's start to the anchor."""

    def run(batches):
        for batch in batches:
            tids, copies = batch.column(0), batch.column(2)
            texts = [symbols(t, words) for t in batch.column(1).to_pylist()]
            for owner, offset, parts in _pieces(texts, length):
                size = np.array([len(x) for x in parts])
                base = np.cumsum(size) - size
                at, first, last, h, span = anchors(np.concatenate(parts), np.repeat(base + size, size), length, gram)
                part = np.searchsorted(base, at, side="right") - 1
                of = pa.array(owner[part])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(span), copies.take(of), tids.take(of), pa.array(at - base[part] + offset[part]), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32))], names=["gram", "span", "copies", "tid", "place", "first", "last"])

    return one.select("tid", "text", "copies").mapInArrow(run, ANCHOR)


def _named(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Count the names (gram, span) of anchor rows.

    Gives the places whose whole run repeats, and one place for each of the names that a gram with several names
    has, with the number of the gram's names; of those, ``n`` tells how often the name occurs.
    """
    rows = save(rows, f"{name}-all")
    # as a table of its own, or the join couldn't split a gram that many places have
    again = save(rows.groupBy("gram").agg(F.sum("copies").alias("total")).where("total > 1").select("gram"), f"{name}-again")
    shared = save(rows.join(again, "gram", "left_semi"), f"{name}-shared")
    drop(rows, again)
    names = save(shared.groupBy("gram", "span").agg(F.sum("copies").alias("n"), F.min(F.struct("tid", "place", "first", "last")).alias("one")), f"{name}-names")
    grams = names.groupBy("gram").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1")
    repeated = save(shared.join(names.where("n > 1").select("gram", "span"), ["gram", "span"], "left_semi").select("tid", "place", "first", "last"), f"{name}-repeated")
    mixed = save(names.join(grams, "gram").select("gram", "span", "n", "spans", "one.*"), f"{name}-mixed")
    drop(shared, names)
    return repeated, mixed


def _cores(reps: DataFrame, one: DataFrame, band: int, length: int, words: bool) -> DataFrame:
    """Anchor rows of the bands of the windows that ``reps`` stand for; what occurs ``n`` times counts so often again."""
    wanted = reps.groupBy("tid").agg(F.collect_list(F.struct("gram", "n", "place", "first", "last")).alias("w"))

    def run(batches):
        for batch in batches:
            for tid, text, w in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = symbols(text, words)
                g, c, p, a, b = (np.array([x[k] for x in w], np.int64) for k in ("gram", "n", "place", "first", "last"))
                low = (a // band) * band
                each = (b - low) // band + 1
                start = np.repeat(low, each) + band * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
                g, c, p = np.repeat(g, each), np.repeat(c, each), np.repeat(p, each)
                first, last = np.maximum(np.repeat(a, each), start), np.minimum(np.repeat(b, each), start + band - 1)
                core = Hashes(data).of(p - start, p - start - band + 1 + length).view(np.int64)  # what all windows of the whole band share
                core = _mixed((core ^ (g * 31 + start)).view(np.uint64)).view(np.int64)
                span = _names(data, p - last, p - first + length)
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(span), pa.array(c), pa.array([tid] * len(g), pa.binary()), pa.array(p), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["gram", "span", "copies", "tid", "place", "first", "last"])

    return one.select("tid", "text").join(wanted, "tid").select("tid", "text", "w").mapInArrow(run, ANCHOR)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of two tables."""
    same = a == b
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low + 1 .. high] for each pair of places."""
    out = values[high].copy()
    wide = np.flatnonzero(high - low > 1)
    if not len(wide):
        return out
    a, n = low[wide] + 1, high[wide] - low[wide]
    level = np.int64(np.floor(np.log2(n)))
    table = values
    for k in range(int(level.max()) + 1):
        own = level == k
        if own.any():
            out[wide[own]] = np.minimum(table[a[own]], table[a[own] + n[own] - (1 << k)])
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def induced(group: np.ndarray, left: np.ndarray, right: np.ndarray, right_n: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat: a table with a column for each distance from a window's start to its anchor.

    The rows are sorted by (group, right). ``left`` has the symbols before the anchor, nearest first; ``right`` those
    from it on, ``right_n`` of them.
    """
    n, most = len(group), int(last.max())
    found = np.zeros((n, most + 1), bool)
    shared = np.zeros(n + 1, np.int64)  # between a row and the one above it, from the anchor on
    for at in range(1, n, 20_000):
        rows = np.arange(at, min(at + 20_000, n))
        common = np.minimum(_common(right[rows - 1], right[rows]), np.minimum(right_n[rows - 1], right_n[rows]))
        shared[rows] = np.where(group[rows] == group[rows - 1], common, 0)
    order = np.arange(n)
    for d in range(most + 1):
        if d:
            alive = ((shared[:-1] > 0) | (shared[1:] > 0)) & (last[order] >= d)
            old = np.flatnonzero(alive)
            if not len(old):
                break
            rows = order[old]
            new = left[rows, d - 1]
            new = new if new.dtype == np.uint8 else np.unique(new, return_inverse=True)[1]
            # groups lie in order already, so a stable sort by group and symbol keeps each bucket's order
            old = old[np.argsort((np.cumsum(np.concatenate([[0], group[rows][1:] != group[rows][:-1]])) << 32) | new, kind="stable")]
            rows = order[old]
            fits = (group[rows[1:]] == group[rows[:-1]]) & (left[rows[1:], d - 1] == left[rows[:-1], d - 1])
            new = np.zeros(len(rows) + 1, np.int64)
            pair = np.flatnonzero(fits)
            new[pair + 1] = _minimum(shared[:-1], old[pair], old[pair + 1])
            order, shared = rows, new
        reach = np.maximum(shared[:-1], shared[1:]) + d >= length
        rows = order[reach]
        found[rows[(first[rows] <= d) & (last[rows] >= d)], d] = True
    return found


def _sorted_groups(reps: DataFrame, one: DataFrame, length: int, words: bool) -> DataFrame:
    """Windows that repeat among ``reps`` of the same gram: (tid, place, first, last) of runs."""
    wanted = reps.groupBy("tid").agg(F.collect_list(F.struct("gram", "n", "place", "first", "last")).alias("w"))
    kind = np.dtype(np.uint64 if words else np.uint8)

    def cut(batches):
        for batch in batches:
            for tid, text, w in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = symbols(text, words)
                cols = {k: [x[k] for x in w] for k in ("gram", "n", "place", "first", "last")}
                left = [data[p - b : p][::-1].tobytes() for p, b in zip(cols["place"], cols["last"], strict=True)]
                right = [data[p : p - a + length].tobytes() for p, a in zip(cols["place"], cols["first"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols["gram"], pa.int64()), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array([tid] * len(w), pa.binary()), pa.array(cols["place"], pa.int64()), pa.array(cols["first"], pa.int32()), pa.array(cols["last"], pa.int32()), pa.array(cols["n"], pa.int64())], names=["gram", "right", "left", "tid", "place", "first", "last", "n"])

    def table(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        size = np.array([len(x) for x in values])
        width = max(kind.itemsize, int(size.max()))
        return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in values), kind).reshape(len(values), -1), size // kind.itemsize

    def sort(batches):
        for rows in by_group(batches, "gram", 20_000):
            right, right_n = table(rows.column("right"))
            left, _ = table(rows.column("left"))
            first, last, place = (rows.column(k).to_numpy().astype(np.int64) for k in ("first", "last", "place"))
            found = induced(rows.column("gram").to_numpy(), left, right, right_n, first, last, length)
            found[rows.column("n").to_numpy() > 1] = False  # known already
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, a = np.nonzero(edge == 1)
            _, b = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([rows.column("tid").combine_chunks().take(pa.array(row)), pa.array(place[row]), pa.array(a.astype(np.int32)), pa.array((b - 1).astype(np.int32))], names=["tid", "place", "first", "last"])

    parts = one.select("tid", "text").join(wanted, "tid").select("tid", "text", "w").mapInArrow(cut, "gram long, right binary, left binary, tid binary, place long, first int, last int, n long")
    return parts.repartition(partitions(reps.sparkSession), "gram").sortWithinPartitions("gram", "right").mapInArrow(sort, "tid binary, place long, first int, last int")


def _text_id(text):
    return F.unhex(F.md5(text))


def different(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(tid, text, copies): each different text once, bucketed by its id. A null text counts as empty."""
    rows = docs.select(_text_id(whole_text(text)).alias("tid"), whole_text(text).alias("text"))
    once = rows.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return save_bucketed(once, "tid", "texts")


def repeated_runs(one: DataFrame, *, length: int = LENGTH, words: bool = False, gram: int | None = None, most: int = MOST) -> DataFrame:
    """Runs of window starts that repeat, as (tid, place, first, last): the windows that start ``first`` to ``last`` symbols before ``place``.

    ``one`` is what :func:`different` gives; each copy of a text counts.
    """
    gram = gram or max(1, length * GRAM // LENGTH)
    repeated, mixed = _named(_anchor_rows(one.where(F.octet_length("text") >= length), length, gram, words), "grams")
    runs = [repeated, save(_sorted_groups(mixed.where(F.col("spans") <= most), one, length, words), "sorted")]
    big = mixed.where(F.col("spans") > most)
    if big.limit(1).count():
        # all of a name's windows repeat if it occurs twice, so its windows are counted as often in each band
        for band in (BAND, 1):
            repeated, mixed = _named(_cores(big, one, band, length, words), f"band{band}")
            runs += [repeated, save(_sorted_groups(mixed.where(F.col("spans") <= most), one, length, words), "sorted")]
            big = mixed.where(F.col("spans") > most)
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    return out


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes where each word of a text starts and ends, for the words of :func:`words_of`."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(code, len(_BLANK) - 1)]
    alone = np.zeros(len(code), bool)
    if not text.isascii():
        for low, high in _UNSPACED:
            alone |= (code >= low) & (code <= high)
    apart = np.concatenate([[True], blank | alone, [True]])  # what no word goes on from or into
    starts, ends = ~blank & (alone | apart[:-2]), ~blank & (alone | apart[2:])
    # a lone surrogate is written as one question mark
    size = np.where((code >= 0xD800) & (code <= 0xDFFF), 1, 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000))
    at = np.concatenate([[0], np.cumsum(size)])
    return at[np.flatnonzero(starts)], at[np.flatnonzero(ends) + 1]


def _spans(docs: DataFrame, text: str, ways: list[tuple[int, bool]], most: int) -> DataFrame:
    """(tid, text, spans0, spans1, ...) for each different text: the byte ranges to remove by each (length, words) of ``ways``."""
    small_batches(docs.sparkSession)
    one = different(docs, text=text)
    found = one.select("tid", "text")
    for k, (length, words) in enumerate(ways):
        runs = repeated_runs(one, length=length, words=words, most=most)
        found = found.join(runs.groupBy("tid").agg(F.collect_set(F.struct("place", "first", "last")).alias(f"runs{k}")), "tid", "left")

    def ranges(texts: pa.Array, runs: pa.ListArray, length: int, words: bool) -> pa.ListArray:
        ends = np.cumsum(runs.value_lengths().fill_null(0).to_numpy())
        place, first, last = (c.to_numpy().astype(np.int64) for c in runs.flatten().flatten())
        begin, stop = place - last, place - first + length
        low, high, count, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(ends) + 1, np.int32), 0
        for k, end in enumerate(ends.tolist()):
            if end > at:
                a, b = _merge(begin[at:end], stop[at:end])
                if words:
                    starts, ends_at = _places(texts[k].as_py())
                    a, b = starts[a], ends_at[b - 1]
                low.append(a)
                high.append(b)
                count[k + 1] = len(a)
            at = end
        made = pa.StructArray.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), made)

    def run(batches):
        for batch in batches:
            spans = [ranges(batch.column(1), batch.column(2 + k), *way) for k, way in enumerate(ways)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *spans], names=["tid", "text", *(f"spans{k}" for k in range(len(ways)))])

    kinds = "".join(f", spans{k} array<struct<start:bigint,end:bigint>>" for k in range(len(ways)))
    return found.mapInArrow(run, f"tid binary, text string{kinds}")


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH, words: bool = False, most: int = MOST) -> DataFrame:
    """(tid, text, spans) for each different text, ``spans`` being the byte ranges [start, end) to remove, in order.

    ``tid`` is the text's md5. ``length`` counts bytes, or words (between white space; of scripts without spaces each
    character). A null text counts as empty; a text shorter than ``length`` has no spans. Repeated rows are copies of
    each other, so all of such a text is removed if it is long enough.
    """
    return _spans(docs, text, [(length, words)], most).withColumnRenamed("spans0", "spans")


def kept_bytes(text: str, spans: list) -> bytes:
    data, at, out = text.encode("utf-8", "replace"), 0, []
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def digests(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = MOST, passage: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, changed), a row for each row of ``docs``.

    With ``passage`` two columns follow: ``n_passages``, the maximal runs of the text that repeated passages of so many words
    cover, however few bytes they have, and ``passage_bytes``, the bytes of these runs. The columns before know nothing of them.
    """
    ways = [(length, False)] + ([(passage, True)] if passage else [])

    def run(batches):
        for batch in batches:
            rows = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = kept_bytes(t, s)
                n = len(t.encode("utf-8", "replace"))
                rows.append((n, n - len(kept), len(s), hashlib.sha256(kept).hexdigest(), len(kept)))
            n, removed, spans, sha, left = zip(*rows, strict=True) if rows else ((),) * 5
            out = {"tid": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "n_kept": pa.array(left, pa.int64())}
            if passage:
                covered = batch.column(3).to_pylist()
                out |= {"n_passages": pa.array([len(s) for s in covered], pa.int64()), "passage_bytes": pa.array([sum(x["end"] - x["start"] for x in s) for s in covered], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = ", n_passages long, passage_bytes long" if passage else ""
    made = _spans(docs, text, ways, most).mapInArrow(run, f"tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long{more}")
    rows = docs.select(F.col(id_col).alias("id"), _text_id(whole_text(text)).alias("tid")).join(made, "tid")
    first = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept"]
    return rows.select(*first, (F.col("n_removed") > 0).alias("changed"), *(["n_passages", "passage_bytes"] if passage else []))


def deduplicate(docs: DataFrame, *, text: str = "text", length: int = LENGTH, words: bool = False, most: int = MOST) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated bytes or words gone from the text; rows of which nothing but white space is left after a removal go.

    A character of which a byte is removed goes with it; white space around removed words stays.
    """

    def run(batches):
        for batch in batches:
            kept = [kept_bytes(t, s).decode("utf-8", "ignore") for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["__tid", "__kept"])

    found = repeated_spans(docs, text=text, length=length, words=words, most=most).where(F.size("spans") > 0)
    made = found.mapInArrow(run, T.StructType([T.StructField("__tid", T.BinaryType()), T.StructField("__kept", T.StringType())]))
    joined = docs.withColumn("__tid", _text_id(whole_text(text))).join(made, "__tid", "left")
    left = joined.where(F.col("__kept").isNull() | (F.trim(F.regexp_replace("__kept", r"\s+", " ")) != ""))
    return left.withColumn(text, F.coalesce("__kept", F.col(text))).select(docs.columns)
