"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows of
toxic text. A document is cut into overlapping byte windows; every window is compressed
with either dictionary, and the difference of the two lengths says which kind of text
it resembles. The largest differences of a document go through a logistic calibration,
which gives a probability.

Toxic documents are mostly ordinary text as well, and what a dictionary trained on all of
their windows would hold is ordinary text. So of the toxic documents those windows are
learned from that begin where a sequence does which is far more frequent in them than in
ordinary documents. The toxic dictionary has the ordinary one behind it, so that a window
is compressed better by it only if it has something of that kind. The sequences serve
to choose what is learned from; a score comes from the lengths alone.

Fitting uses at most ``max_docs`` labelled documents of each class (chosen by a hash of the
text) of at most ``MAX_CHARS`` characters, and at most ``TRAINED`` windows of ordinary text,
chosen at random with a fixed seed: the driver holds them. Scoring runs over every window
of every text in Arrow batches, so a very long text takes time, not memory.

Nulls: a null text is empty; an empty text has no window and gets the score that
the calibration gives to "no evidence". Labels that are null aren't learned from; with no
labelled rows, or an empty table, or one class only, the score is the share of toxic labels.
Equal texts have equal scores, repeated rows each their own row. Extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import labelled_sample, small_batches

#: Bytes of a window and between the starts of two windows.
WINDOW, STEP = 32, 8
#: Largest differences of a document that are looked at, and what counts as a large one.
TOP, LARGE = 4, 3
FEATURES = TOP + 3
#: Bytes of the dictionaries of ordinary and of toxic text, and windows of ordinary text that are learned from at most.
DICT_BYTES, TOXIC_BYTES, TRAINED = 32_768, 2_048, 60_000
#: Bytes of the toxic windows that are learned from, and of the segments and sequences that the trainer counts in them.
SPAN, SEGMENT, SEQUENCE = 14, 16, 6
#: Labelled documents of each class that are fitted on at most, and the longest of them in characters.
MAX_DOCS, MAX_CHARS = 2_500, 60_000
THRESHOLD = 0.7
#: Bytes that a match has at least.
MATCH = 4
#: What a trained dictionary has just before its content: the first three offsets.
OFFSETS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
#: Only matches of MATCH bytes or more count: shorter ones are in any text of the language.
PARAMETERS = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=1, min_match=MATCH, target_length=0, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
#: A beginning of a word tells of toxic text if its rate among toxic documents is, ERRORS standard errors taken off,
#: so many times that among ordinary ones, and so high at least.
RATIO, LEAST, ERRORS = 4.0, 0.015, 1.5
WORD = re.compile(r"[^\W\d_]+")
OTHER = re.compile(r"[\W\d_]")
#: Bytes, the space before it included, that a beginning has at least, and characters that it has at most.
HEAD, LONGEST = 5, 12
BUCKETS = 1 << 20
#: Every ASCII character that is no letter becomes a space.
PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def _plain(text: str) -> bytes:
    """In lower case, everything but letters as a space."""
    if not text:
        return b""
    low = text.lower()
    low = low.encode().translate(PLAIN) if low.isascii() else OTHER.sub(" ", low).encode("utf-8", "replace")
    return b" " + low + b" "


def _cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the texts: the joined bytes, (offset, length) of each, its text's number, and each text's count of windows."""
    raw = [_plain(t) for t in texts]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    base = np.cumsum(size) - size
    count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STEP), 0) + 1, 0)
    owner = np.repeat(np.arange(len(raw)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    segments = np.stack([base[owner] + start, np.minimum(size[owner] - start, WINDOW)], axis=1).astype(np.uint64)
    return b"".join(raw), segments, owner, count


def _lengths(data: bytes, segments: np.ndarray, dictionary: bytes) -> np.ndarray:
    """Compressed length of each window with the dictionary."""
    if not len(segments):
        return np.zeros(0, np.int64)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=PARAMETERS)
    made = zstandard.ZstdCompressor(compression_params=PARAMETERS, dict_data=held)
    out = []
    for at in range(0, len(segments), 200_000):
        part = np.ascontiguousarray(segments[at : at + 200_000])
        packed = made.multi_compress_to_buffer(zstandard.BufferWithSegments(data, part.tobytes()), threads=1)
        out.append(np.fromiter(map(len, packed), np.int64, len(part)))
    return np.concatenate(out)


def _train(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a trained zstandard dictionary, without its header; where there is too little text to train one, the text itself."""
    try:
        made = zstandard.train_dictionary(size, samples, **how).as_bytes()
        return made.partition(OFFSETS)[2] or made
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:].rjust(16, b" ")


def _unlike(texts: list[str]) -> np.ndarray:
    """Which texts to learn from: of near copies only the first, or the words of a text with many copies would look telling."""
    seen: set[int] = set()
    keep = np.zeros(len(texts), bool)
    for k, t in enumerate(texts):
        words = t.lower().split()
        low = sorted({zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))})[:4]
        keep[k] = seen.isdisjoint(low)
        seen.update(low)
    return keep


@lru_cache(maxsize=20_000)
def _heads_of(word: str) -> tuple[str, ...]:
    whole = f" {word} "
    return tuple(whole[:k] for k in range(3, min(len(whole), LONGEST) + 1) if len(whole[:k].encode()) >= HEAD)


def _beginnings(text: str) -> set[str]:
    """The words of a text, with the space before and after, and what they begin with."""
    return set(chain.from_iterable(map(_heads_of, set(WORD.findall(text.lower())))))


def _telling(texts: list[str], labels: np.ndarray) -> list[bytes]:
    """Beginnings of words that are far more often in toxic than in ordinary documents."""
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    least = max(3, LEAST * n[1])
    # counts by bucket first, as nearly all beginnings are too rare and needn't be held
    buckets = np.zeros(BUCKETS, np.int32)
    for t, c in zip(texts, labels, strict=True):
        if c:
            buckets[np.unique(np.fromiter((hash(w) % BUCKETS for w in _beginnings(t)), np.int64))] += 1
    often = (buckets >= least).tolist()
    toxic = Counter()
    for t, c in zip(texts, labels, strict=True):
        if c:
            toxic.update(w for w in _beginnings(t) if often[hash(w) % BUCKETS])
    toxic = {w: k for w, k in toxic.items() if k >= least}
    ordinary = Counter()
    for t, c in zip(texts, labels, strict=True):
        if not c:
            ordinary.update(toxic.keys() & _beginnings(t))
    low = {w: np.log((k + 0.5) / n[1]) - np.log((ordinary[w] + 0.5) / n[0]) - ERRORS * np.sqrt(1 / (k + 0.5) + 1 / (ordinary[w] + 0.5)) for w, k in toxic.items()}
    return sorted(w.encode() for w in low if low[w] >= np.log(RATIO))


def _windows_from(texts: list[str], begins: list[bytes]) -> list[bytes]:
    """The windows of SPAN bytes of the texts that begin with one of these."""
    if not begins:
        return []
    any_of = re.compile(b"|".join(re.escape(w) for w in sorted(begins, key=len, reverse=True)))
    return [data[m.start() : m.start() + SPAN] for data in map(_plain, texts) for m in any_of.finditer(data)]


def _features(gain: np.ndarray, owner: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per document: its TOP largest differences (0 where it has fewer), how many are large, how many there are, and how many windows it has (logarithms)."""
    n = len(windows)
    out = np.zeros((n, FEATURES))
    order = np.lexsort((-gain, owner))
    owner, gain = owner[order], gain[order]
    first = np.searchsorted(owner, np.arange(n))
    count = np.bincount(owner, minlength=n)
    for k in range(TOP):
        has = count > k
        out[has, k] = np.maximum(gain[first[has] + k], 0)
    out[:, TOP] = np.log1p(np.bincount(owner, weights=gain >= LARGE, minlength=n))
    out[:, TOP + 1] = np.log1p(np.bincount(owner, weights=gain > 0, minlength=n))
    out[:, TOP + 2] = np.log1p(windows)
    return out


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[str]) -> np.ndarray:
        """In groups of texts of a few MB, so that windows don't add up to more than memory holds."""
        out, group, size = [np.zeros((0, FEATURES))], [], 0
        for k, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size > 4_000_000 or k == len(texts) - 1:
                data, segments, owner, windows = _cut(group)
                gain = _lengths(data, segments, self.ordinary) - _lengths(data, segments, self.toxic + self.ordinary)
                out.append(_features(gain, owner, windows))
                group, size = [], 0
        return np.concatenate(out)

    def score(self, texts: list[str]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the differences count for toxicity or not at all."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(model: ToxicityModel, texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Train the model's dictionaries on windows of either class."""
    toxic = [t for t, c in zip(texts, labels, strict=True) if c]
    data, segments, _, _ = _cut([t for t, c in zip(texts, labels, strict=True) if not c])
    rows = rng.permutation(len(segments))[:TRAINED]
    model.ordinary = _train([data[int(o) : int(o + n)] for o, n in segments[rows]], DICT_BYTES, k=64, d=8)
    samples = _windows_from(toxic, _telling(texts, labels))
    model.toxic = _train(samples, TOXIC_BYTES, k=SEGMENT, d=SEQUENCE) if samples else b""


def fit_texts(texts: list[str], labels: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Fit on labelled texts: the calibration on either half with dictionaries of the other, then the dictionaries on all."""
    labels = np.asarray(labels, dtype=np.int64)
    keep = _unlike(texts)
    texts, labels = [t for t, k in zip(texts, keep, strict=True) if k], labels[keep]
    model = ToxicityModel(b" " * 16, b"", np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    if not len(texts) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        model.weights[0] = np.log((rate + 0.01) / (1.01 - rate))
        return model
    rng = np.random.default_rng(seed)
    half = np.zeros(len(texts), bool)
    for c in (0, 1):
        own = np.flatnonzero(labels == c)
        half[rng.permutation(own)[: (len(own) + 1) // 2]] = True
    x = np.zeros((len(texts), FEATURES))
    for h in (half, ~half) if (~half).any() else ():
        part = ToxicityModel(model.ordinary, model.toxic, model.mean, model.scale, model.weights)
        _dictionaries(part, [t for t, own in zip(texts, h, strict=True) if own], labels[h], rng)
        x[~h] = part.features([t for t, own in zip(texts, h, strict=True) if not own])
    _dictionaries(model, texts, labels, rng)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.scale, labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicityModel:
    """Learn from the documents that ``labels`` marks: at most ``max_docs`` of each class, taken by a hash of the text."""
    return fit_texts(*labelled_sample(docs, labels, text, id_col, label, max_docs, MAX_CHARS))


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability that the text is toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).cast(pa.string()).to_pylist()]
            yield batch.append_column(out, pa.array(held.value.score(texts), pa.float64()))

    rest = docs.drop(out)
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))
