"""Quality scores from random-indexing word vectors and a small network.

Every token has a sparse random index vector, drawn from its hash. A token's context
vector sums the index vectors of its neighbours in the fitting sample; tokens that the
sample lacks have a zero context. A document is the mean of its tokens' vectors, index
and context side by side, with a few shares of kinds of tokens; a two-layer network on
that, its logit divided by a fitted temperature, gives the probability.

Tokens are words in lower case, and beside each word its shape (case, digits, what
signs cling to it, whether it repeats the word before), since junk shows in shapes.

Word vectors and network are fitted on at most ``max_docs`` labelled documents of each
class. Scoring reads every token of every text. A null text is empty and has the mean of
no tokens; null labels aren't learned from; extra columns stay; repeated rows are scored
each by itself.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import labelled_sample, small_batches

DIM, NONZERO, WINDOW = 64, 4, 2
HIDDEN, ROUNDS, RATE = 32, 60, 3e-3
MAX_DOCS, MAX_CHARS = 2_500, 60_000
VOCABULARY, LEAST = 30_000, 3
THRESHOLD = 0.7
#: A worker keeps the vectors of at most so many tokens.
MEMORY = 400_000
CORE = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


def _shape(word: str) -> str:
    head, core, tail = CORE.match(word).groups()
    if not core:
        return f"~{head[:3]}"
    case = "9" if core.isdigit() else "X" if core.isupper() and len(core) > 1 else "x" if core.islower() else "Xx" if core[0].isupper() and core[1:].islower() else "m"
    return f"{head[-2:]}~{case}~{tail[:3]}~{min(len(core) // 4, 5)}"


def _crc(tokens) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in tokens], np.uint32)


def _codes(crc: np.ndarray) -> np.ndarray:
    """The entries of the index vectors as numbers: the place, and DIM more for a minus."""
    places, signs = _random(crc)
    return (places + DIM * (signs < 0)).astype(np.int16)


def _random(crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the index vectors' entries, NONZERO a row."""
    h, places, signs = crc.astype(np.uint64), [], []
    for _ in range(NONZERO):
        h = (h * np.uint64(2_654_435_761) + np.uint64(97)) & np.uint64(0xFFFFFFFF)
        places.append(((h >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64))
        signs.append(np.where(h >> np.uint64(31), 1.0, -1.0))
    return np.stack(places, 1), np.stack(signs, 1)


class _Memory:
    """What a worker knows of the words that it has met: a row of the context table, the index vector's entries, the shape."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.columns = [np.zeros(0, np.int64), np.zeros((0, NONZERO), np.int16), np.zeros(0, np.int64)]
        self.shape_table = np.zeros((0, 2 * DIM))

    def look(self, words: set[str], context: dict[str, int]) -> tuple[dict[str, int], list[np.ndarray]]:
        new = [w for w in words if w not in self.row]
        if not new:
            return self.row, self.columns
        low = [w.lower() for w in new]
        shape = [self.shapes.setdefault(_shape(w), len(self.shapes)) for w in new]
        made = [np.array([context.get(w, len(context)) for w in low], np.int64), _codes(_crc(low)), np.array(shape, np.int64)]
        columns = [np.concatenate(c) for c in zip(self.columns, made, strict=True)]
        rows = {w: len(self.row) + k for k, w in enumerate(new)}
        if len(self.row) + len(new) > MEMORY:
            return self.row | rows, columns
        self.row.update(rows)
        self.columns = columns
        return self.row, columns


@dataclass
class QualityModel:
    words: dict[str, int]
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0
    memory: _Memory = field(default_factory=_Memory)

    def __getstate__(self):
        return self.__dict__ | {"memory": _Memory()}

    def _shape_table(self) -> np.ndarray:
        """A row for each shape met so far: twice its index vector, and its context vector."""
        names = list(self.memory.shapes)
        if len(names) == len(self.memory.shape_table):
            return self.memory.shape_table
        places, signs = _random(_crc(names))
        own = np.zeros((len(names), DIM))
        np.add.at(own, (np.arange(len(names))[:, None], places), signs)
        self.memory.shape_table = np.concatenate([2 * own, self.context[[self.words.get(x, len(self.words)) for x in names]]], axis=1)
        return self.memory.shape_table

    def pool(self, texts: list[str]) -> np.ndarray:
        width = 4 * DIM + 1
        out = np.zeros((len(texts), width + 5))
        lists = [t.split() for t in texts]
        row, (context, codes, shape) = self.memory.look(set().union(*lists), self.words)
        shapes = self._shape_table()
        for k, words in enumerate(lists):
            n = len(words)
            if not n:
                continue
            total = np.zeros(width)
            for at in range(0, n, 100_000):
                part = words[at : at + 100_000]
                ids = np.fromiter(map(row.__getitem__, part), np.int64, len(part))
                entries = np.bincount(codes[ids].ravel(), minlength=2 * DIM)
                total[:DIM] += entries[:DIM] - entries[DIM:]
                total[DIM : 2 * DIM] += self.context[context[ids]].sum(0)
                total[2 * DIM : 4 * DIM] += np.bincount(shape[ids], minlength=len(shapes)) @ shapes
                total[-1] += np.count_nonzero(context[ids] < len(self.words))
            lines = texts[k].split("\n")
            again = sum(map(str.__eq__, words, words[1:])) / n
            out[k, :width] = total / n
            out[k, width:] = np.log1p(n), len(texts[k]) / n, again, len(set(words)) / n, len(set(lines)) / len(lines)
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(texts)) / self.temperature, -30, 30)))


def _contexts(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Context vectors, as unit vectors, of the words and shapes that the texts have often enough; a last row of zeros for all others."""
    number: dict[str, int] = {}
    shapes: dict[str, str] = {}
    parts, size = [], []
    for t in texts:
        own = [number.setdefault(x, len(number)) for w in t.split() for x in (w.lower(), shapes.get(w) or shapes.setdefault(w, _shape(w)))]
        parts.append(np.array(own, np.int32))
        size.append(len(own))
    if not sum(size):
        return {}, np.zeros((1, DIM), np.float32)
    ids, names = np.concatenate(parts), list(number)
    of = np.repeat(np.arange(len(size), dtype=np.int32), size)
    places, signs = _random(_crc(names))
    count = np.bincount(ids, minlength=len(names))
    often = np.flatnonzero(count >= LEAST)
    often = often[np.argsort(-count[often], kind="stable")[:VOCABULARY]]
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    total = np.zeros(len(often) * DIM)
    for step in range(1, 2 * WINDOW + 1):
        for at in range(0, max(len(ids) - step, 0), 250_000):
            end = min(at + 250_000, len(ids) - step)
            a, b = ids[at:end], ids[at + step : end + step]
            near = of[at:end] == of[at + step : end + step]
            for x, y in ((a, b), (b, a)):
                use = near & (place[x] >= 0)
                total += np.bincount((place[x[use]][:, None] * DIM + places[y[use]]).ravel(), signs[y[use]].ravel(), len(total))
    table = total.reshape(-1, DIM)
    table /= np.linalg.norm(table, axis=1, keepdims=True) + 1e-9
    return {names[i]: k for k, i in enumerate(often)}, np.concatenate([table, np.zeros((1, DIM))]).astype(np.float32)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -logits, logits) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_texts(texts: list[str], labels: np.ndarray, seed: int = 5) -> QualityModel:
    """Fit on labelled texts: a fifth of them is kept back for the temperature."""
    labels = np.asarray(labels, np.float64)
    width = 4 * DIM + 6
    if not len(texts) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.5
        return QualityModel({}, np.zeros((1, DIM), np.float32), np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.log((rate + 0.01) / (1.01 - rate))])
    rng = np.random.default_rng(seed)
    rows = rng.permutation(len(texts))
    back, rows = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    model = QualityModel(*_contexts([texts[i] for i in rows]), np.zeros(width), np.ones(width), [])
    x = model.pool([texts[i] for i in rows])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    x, y = (x - model.mean) / model.scale, labels[rows]
    layers = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moment, square, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(ROUNDS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            b = order[at : at + 64]
            w1, b1, w2, b2 = layers
            h = np.tanh(x[b] @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[b]) * weight[b] / len(b)
            gh = g[:, None] * w2 * (1 - h * h)
            grads = [x[b].T @ gh + 1e-3 * w1, gh.sum(0), h.T @ g + 1e-3 * w2, np.array([g.sum()])]
            step += 1
            for k, d in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                layers[k] = layers[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if len(back):
        model.temperature = _temperature(model.logits(model.pool([texts[i] for i in back])), labels[back])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_docs: int = MAX_DOCS) -> QualityModel:
    """Learn from the documents that ``labels`` marks: at most ``max_docs`` of each class, taken by a hash of the text."""
    return fit_texts(*labelled_sample(docs, labels, text, id_col, label, max_docs, MAX_CHARS))


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability that the text is of good quality."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).cast(pa.string()).to_pylist()]
            yield batch.append_column(out, pa.array(held.value.score(texts), pa.float64()))

    rest = docs.drop(out)
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))
