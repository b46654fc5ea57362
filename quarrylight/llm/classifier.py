"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

*Word vectors.*  Every term has a sparse random index vector (:data:`NONZERO` entries
of plus or minus one among :data:`DIMS`, drawn from its bucket's number).  The vector
of a term is the sum of the index vectors of its neighbours, two to either side, over
all texts of the corpus.  Terms share :data:`BUCKETS` hashed rows, so the table that
partitions sum up, and that is broadcast afterwards, has a fixed size however large
the corpus grows.  Sums are of integers: they don't depend on the order of tasks.

*Network.*  A document is the mean of its terms' vectors, scaled to unit length.  A
two-layer numpy network learns from at most :data:`LABELLED` labelled documents,
chosen by the hash of their id; a temperature fitted on rows set aside calibrates its
probabilities.

Defined results: a null, empty or blank text is the zero vector and gets the score
that the network gives it; without labels of both kinds every score is the share of
ones (or a half); repeated rows get equal results, and rows that share a labelled id count
as one when the network learns; other columns are dropped, so clashing names cannot occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.bpe import Memory
from quarrylight.llm.common import ship_package

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 64, 2, 2
#: Labelled rows that the network learns from, at most.
LABELLED = 20_000
HIDDEN, EPOCHS, RATE = 32, 60, 3e-3
TERM = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")


def _terms(chunk: str) -> bytes:
    """Buckets of a chunk's terms: words in lower case (and a mark for capitals),
    numbers by length, runs of signs by sign and length."""
    out = []
    for term in TERM.findall(chunk):
        if term[0].isalpha():
            out.append(term.lower())
            if len(term) > 1 and term.isupper():
                out.append("\x00CAPITALS")
        elif term[0].isdigit():
            out.append(f"\x00{min(len(term), 20)}")
        else:
            out.append(term[:3])
    return np.array([crc32(t.encode("utf-8", "replace")) % BUCKETS for t in out], "<u2").tobytes()


_memory = Memory(_terms, 1 << 17)


_AGAIN = np.array([crc32(b"\x00AGAIN") % BUCKETS], "<u2").tobytes()


def buckets_of(text: str | None) -> np.ndarray:
    """Buckets of a text's terms in order, then a term for every word that only
    repeats the word before it."""
    words = (text or "").split()
    again = sum(map(eq, words, words[1:]))
    return np.frombuffer(b"".join(map(_memory.__getitem__, words)) + again * _AGAIN, "<u2")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    draw = np.random.default_rng(BUCKETS)
    return draw.integers(0, DIMS, (BUCKETS, NONZERO)), draw.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


class Neighbours:
    """Sums of neighbours' index vectors."""

    def __init__(self) -> None:
        self.places, self.signs = index_vectors()
        self.sums = np.zeros(BUCKETS * DIMS, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, buckets: np.ndarray) -> None:
        self.waiting.append(buckets)
        self.held += len(buckets)
        if self.held >= 1 << 19:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        terms = np.concatenate(self.waiting).astype(np.int64)
        doc = np.repeat(np.arange(len(self.waiting)), [len(w) for w in self.waiting])
        self.waiting, self.held = [], 0
        for gap in range(1, REACH + 1):
            same = doc[gap:] == doc[:-gap]
            left, right = terms[:-gap][same], terms[gap:][same]
            for own, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    at, sign = own * DIMS + self.places[other, k], self.signs[other, k]
                    self.sums += np.bincount(at[sign > 0], minlength=len(self.sums)) - np.bincount(at[sign < 0], minlength=len(self.sums))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of :data:`BUCKETS` unit vectors, gathered from all documents."""
    ship_package(docs.sparkSession)
    names = [f"v{i}" for i in range(DIMS)]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Neighbours()
        for batch in batches:
            for text in batch.column(0):
                own.add(buckets_of(text.as_py()))
        own.flush()
        sums = own.sums.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(sums[used, i]) for i in range(DIMS))], names=schema.names)

    sums = docs.select(text_col).mapInArrow(gather, schema).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    table = np.zeros((BUCKETS, DIMS), np.float32)
    for row in sums.toLocalIterator():  # at most BUCKETS rows
        table[row[0]] = row[1:]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(length, 1)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Unit mean of the terms' vectors."""
    buckets = buckets_of(text)
    if not len(buckets):
        return np.zeros(DIMS, np.float32)
    found, times = np.unique(buckets, return_counts=True)
    mean = times.astype(np.float32) @ vectors[found] / len(buckets)
    return mean / max(float(np.linalg.norm(mean)), 1e-9)


@dataclass
class Network:
    """Two layers; ``constant`` where there was nothing to learn from."""

    layers: tuple = ()
    temperature: float = 1.0
    constant: float = 0.5

    def margins(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margins(x).astype(np.float64) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 42) -> Network:
    """Adam on the logistic loss with weight decay; every fifth row sets the temperature."""
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    aside, rows = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    z, t = ((x - mean) / scale).astype(np.float64), y.astype(np.float64)
    w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in w]
    step = 0
    for _ in range(EPOCHS):
        draw.shuffle(rows)
        for at in range(0, len(rows), 128):
            part = rows[at : at + 128]
            hidden = np.tanh(z[part] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - t[part]) / len(part)
            back = np.outer(error, w[2]) * (1 - hidden**2)
            step += 1
            for p, m, g in zip(w, moments, (z[part].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum(keepdims=True)), strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= RATE * m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net = Network((mean, scale, *w))
    margins, truth = net.margins(x[aside]), t[aside]
    loss = lambda heat: np.logaddexp(0, np.where(truth == 1, -1, 1) * margins / heat).mean()
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> Network:
    """The network, learned from at most ``most`` of the labelled documents."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # the bound of the broadcast and of what comes to the driver
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "label", F.xxhash64("text").alias("hash"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = "_id string, label int, hash long, pooled binary"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pooled(t.as_py(), shared.value).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("label"), batch.column("hash"), pa.array(found, pa.binary())], names=["_id", "label", "hash", "pooled"])

    # a row an id, however many rows share it: at most ``most`` come to the driver
    each = rows.mapInArrow(pool, schema).groupBy("_id", "label").agg(F.min_by("pooled", "hash").alias("pooled"))
    got = sorted(map(tuple, each.collect()))  # one order, whatever the tasks' order
    x = np.array([np.frombuffer(r[2], "<f4") for r in got]).reshape(len(got), DIMS)
    return fit(x, np.array([r[1] for r in got]))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, ``score``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for batch in batches:
            x = np.array([pooled(t.as_py(), table) for t in batch.column("text")]).reshape(batch.num_rows, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(x), pa.float64())], names=["doc_id", "score"])

    return source.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """-> id, ``score``: probability that the label is 1."""
    vectors = word_vectors(docs, text_col)
    network = train(docs, labels, vectors, id_col=id_col, text_col=text_col, label_col=label_col)
    return score(docs, vectors, network, id_col=id_col, text_col=text_col)
