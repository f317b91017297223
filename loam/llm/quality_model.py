"""Quality classifier: random-indexing vectors pooled per document, then a calibrated two-layer network.

Every word, and every word's shape (letter case, digits and symbols, runs collapsed), has a fixed sparse
random index vector. Its word vector is the sum, over all its places in the whole corpus, of the index
vectors around it and its own. Words are told apart by hash bucket, so the vectors are a table of fixed
size. A document is the mean of its words' vectors, the mean of its shapes' vectors, and how alike neighbouring words'
vectors are. The network learns from a
bounded, documented number of labelled documents; a temperature fitted on a part of them that training
does not see calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SEPARATOR, Hasher, buffer, mix, spans
from .common import drawn, materialize, partitions, remainder, slices

WORD_BUCKETS, SHAPE_BUCKETS, SIZE, NONZERO, REACH = 1 << 13, 1 << 11, 32, 4, 2
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
INPUTS = 2 * SIZE + 1
#: Labelled rows that the network is fitted on, about at most, drawn by hash (``drawn``).
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 24, 60, 7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def index_vectors() -> np.ndarray:
    """For each bucket a vector with ``NONZERO`` entries of +1 or -1, others 0."""
    draw = np.random.default_rng(SEED)
    table = np.zeros((BUCKETS, SIZE), np.int8)
    for _ in range(NONZERO):
        table[np.arange(BUCKETS), draw.integers(0, SIZE, BUCKETS)] = draw.choice([-1, 1], BUCKETS)
    return table


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets, and how many words each text has."""
    flat, offsets = buffer(column)
    starts, ends, counts = spans(flat, offsets)
    words = (Hasher(flat)(starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    kind = _SHAPE[flat]
    change = np.ones(len(flat), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = True
    change &= ~SEPARATOR[flat]
    place = np.r_[0, np.cumsum(change)]
    shapes = (Hasher(kind[change])(place[starts], place[ends]) % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + WORD_BUCKETS
    return words, shapes, counts


def word_vectors(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all buckets, of unit length, and the buckets' counts over all of ``texts`` (text)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.ascontiguousarray(index_vectors().T)
        total, count = np.zeros((SIZE, BUCKETS)), np.zeros(BUCKETS)
        for batch in slices(batches, "text", 1 << 20):
            words, shapes, counts = units(batch.column(0))
            row = np.empty(2 * len(words), np.int64)
            row[0::2], row[1::2] = words, shapes
            if not len(row):
                continue
            size = 2 * counts
            last, place = np.repeat(np.cumsum(size), size), np.arange(len(row))
            high, low = np.minimum(place + 2 * REACH + 1, last), np.maximum(place - 2 * REACH, last - np.repeat(size, size))
            run = np.zeros(len(row) + 1, np.int32)
            for k in range(SIZE):  # one dimension at a time keeps the arrays flat and in cache
                np.cumsum(index[k][row], out=run[1:])
                total[k] += np.bincount(row, run[high] - run[low], BUCKETS)
            count += np.bincount(row, minlength=BUCKETS)
        used = np.flatnonzero(count)
        sums = pa.array([x.tobytes() for x in np.ascontiguousarray(total.T[used].astype("<f8"))], pa.binary())
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used].astype(np.int64)), sums], names=["bucket", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = {}, {}
        for batch in batches:
            for b, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(x, "<f8")
                count[b] = count.get(b, 0) + n
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["bucket", "n", "sums"])

    schema = "bucket int, n long, sums binary"
    parts = min(partitions(texts.sparkSession), 64)
    vectors, counts = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    for r in texts.mapInArrow(gather, schema).repartition(parts, "bucket").mapInArrow(add, schema).collect():  # BUCKETS rows at most
        vectors[r.bucket], counts[r.bucket] = np.frombuffer(r.sums, "<f8"), r.n
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32), counts


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, text_key (hash of the text) and the pooled vector of every row, as the bytes of INPUTS float32; zeros without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * SIZE floats

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        for batch in slices(batches, "text", 1 << 20):
            words, shapes, counts = units(batch.column("text"))
            out = np.zeros((len(counts), INPUTS), np.float32)
            full = np.flatnonzero(counts)
            if len(full):
                at = (np.cumsum(counts) - counts)[full]
                alike = np.zeros(len(words), np.float32)
                for k, dimension in enumerate(table):
                    own = dimension[words]
                    alike[1:] += own[1:] * own[:-1]
                    out[full, k] = np.add.reduceat(own, at) / counts[full]
                    out[full, SIZE + k] = np.add.reduceat(dimension[shapes], at) / counts[full]
                alike[at] = 0
                out[full, 2 * SIZE] = np.add.reduceat(alike, at) / counts[full]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "text_key", "pooled"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(pool, "doc_id long, text_key long, pooled binary")


class Network:
    """input -> tanh layer -> logit, on standardised inputs; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        draw = np.random.default_rng(SEED)
        held = draw.random(len(y)) < 0.2
        if not (0 < y[~held].sum() < (~held).sum()):  # a single class, or nothing: its share is all there is to learn
            share = (y.sum() + 1) / (len(y) + 2)
            self.mean, self.scale = np.zeros(INPUTS), np.ones(INPUTS)
            self.a, self.b = np.zeros((INPUTS, HIDDEN)), np.zeros(HIDDEN)
            self.c, self.d, self.temperature = np.zeros(HIDDEN), np.log(share / (1 - share)), 1.0
            return
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-6
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        parts = [draw.normal(0, 1 / np.sqrt(INPUTS), (INPUTS, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(t))
            for i in range(0, len(t), 128):
                rows = order[i : i + 128]
                hidden = np.tanh(z[rows] @ parts[0] + parts[1])
                error = (1 / (1 + np.exp(-(hidden @ parts[2] + parts[3]))) - t[rows]) / len(rows)
                back = np.outer(error, parts[2]) * (1 - hidden**2)
                grads = [z[rows].T @ back + 1e-4 * parts[0], back.sum(0), hidden.T @ error + 1e-4 * parts[2], error.sum(keepdims=True)]
                step += 1
                for p, g, m, v in zip(parts, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.a, self.b, self.c, self.d = parts[0], parts[1], parts[2], float(parts[3][0])
        self.temperature = 1.0
        logit, truth = self.logit(x[held]), y[held]
        if len(truth):
            options = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
            loss = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / k).mean() for k in options]
            self.temperature = float(options[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.a + self.b) @ self.c + self.d

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def train(pooled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """The network from pooled vectors and labels.quality, without the held-out rows (crc32 mod 4 is 2)."""
    marked = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    rows = drawn(materialize(pooled.join(marked, "doc_id").select("doc_id", "quality", "pooled"), "labelled"), sample, "doc_id", "quality", "pooled").collect()
    rows.sort(key=lambda r: (zlib.crc32(b"%d" % r.doc_id), r.doc_id, r.quality, r.pooled))
    x = np.array([np.frombuffer(r.pooled, "<f4") for r in rows], float).reshape(-1, INPUTS)
    return Network(x, np.array([r.quality for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Labels of held-out rows, null labels and labels other than 0 and 1 teach nothing; without labels the
    score is 0.5. Null and wordless texts are scored by the zero vector. Repeated rows are each scored; a
    null doc_id is never held out (false). An empty table gives an empty result; other columns are ignored.
    """
    return _scored(docs, labels, threshold, sample).drop("text_key")


def _scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``score`` with the text_key of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors, _ = word_vectors(rows.select("text"))
    pooled = materialize(document_vectors(rows, vectors), "pooled")
    network = train(pooled, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("pooled").to_pylist()), "<f4").reshape(-1, INPUTS).astype(float)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(network(x))], names=["doc_id", "text_key", "score"])

    scored = pooled.mapInArrow(run, "doc_id long, text_key long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", "text_key", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; rows with a null doc_id are kept.

    A row is dropped for its own text only, also where its doc_id is repeated. An empty table gives an empty result.
    """
    low = _scored(docs, labels, threshold, **how).where("predicted = 0").select(F.col("doc_id").alias("_loam_drop"), F.col("text_key").alias("_loam_key")).distinct()
    return docs.join(low, (docs["doc_id"] == low["_loam_drop"]) & (F.xxhash64(docs["text"].cast("string")) == low["_loam_key"]), "left_anti")
