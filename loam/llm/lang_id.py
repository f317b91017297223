"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of signs. For every bit a logistic classifier over hashed byte n-grams
predicts the sign. The language is the one whose codeword lies nearest to the predictions under the
logistic loss, each bit weighted by how well its classifier does on that language; a small margin to the second
nearest flags the prediction as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SEPARATOR, buffer
from .common import drawn, remainder, slices

GRAMS, BUCKET_BITS = 3, 11
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows that the classifiers are fitted on, about at most, drawn by hash (``drawn``); rows that repeat one teach once.
SAMPLE = 8_000
EPOCHS, SEED = 30, 11
_BYTE = LOWER.copy()
_BYTE[SEPARATOR] = 0x20


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed byte n-grams, zeros for none."""
    flat, offsets = buffer(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(n, dtype=np.int64), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(flat))
    byte = _BYTE[flat].astype(np.uint32)
    code, counts = np.zeros(len(flat), np.uint32), np.zeros(n * BUCKETS)
    for k in range(GRAMS):
        code = code * np.uint32(257)
        code[: len(flat) - k] += byte[k:] + np.uint32(1)
        whole = left > k
        bucket = (code[whole] * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(32 - BUCKET_BITS)
        counts += np.bincount(text[whole] * BUCKETS + bucket, minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """(classes, bits) of +1 and -1: all distinct splits for up to six classes, else the best random code."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = np.arange(2 ** (classes - 1) - 1)
        rows = [np.ones(len(splits))] + [np.where(splits >> (classes - 2 - c) & 1, 1, -1) for c in range(classes - 1)]
        return np.array(rows, float)
    draw, best, far = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (classes, int(np.ceil(10 * np.log2(classes)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(classes) * code.shape[1]
        if apart.min() > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, apart.min()
    return best


class Codes:
    """The bit classifiers, fitted on features ``x`` and class numbers ``y``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, languages: list[str]):
        self.languages, self.code = languages, codewords(len(languages))
        draw = np.random.default_rng(SEED)
        held = draw.random(len(y)) < 0.2
        bits = self.code.shape[1]
        self.w, self.b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
        z, sign = x[~held], self.code[y[~held]].astype(np.float32)
        first, second, step = np.zeros_like(self.w), np.full_like(self.w, 1e-8), 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(z))
            for i in range(0, len(z), 256):
                rows = order[i : i + 256]
                pull = -sign[rows] / (1 + np.exp(np.clip(sign[rows] * (z[rows] @ self.w + self.b), -30, 30))) / len(rows)
                grad = z[rows].T @ pull + 1e-6 * self.w
                step += 1
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                self.w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
                self.b -= pull.sum(0)
        right = np.full(self.code.shape, 0.5)
        out = x[held] @ self.w + self.b
        for c in range(len(languages)):
            own = y[held] == c
            right[c] = ((np.sign(out[own]) == self.code[c]).sum(0) + 1) / (own.sum() + 2)
        self.weight = right / right.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class number, score (0 to 1) and margin to the second class of every row."""
        out = x @ self.w + self.b
        loss = np.stack([np.logaddexp(0, -out * self.code[c]) @ self.weight[c] for c in range(len(self.languages))], 1)
        like = np.exp(loss.min(1, keepdims=True) - loss)
        like /= like.sum(1, keepdims=True)
        ranked = np.sort(like, 1)
        margin = ranked[:, -1] - (ranked[:, -2] if like.shape[1] > 1 else 0)
        return like.argmax(1), like.max(1), margin


def fit(rows: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Classifiers from ``rows`` (doc_id, text, lang, letters), without the held-out ones (crc32 mod 4 is 2)."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("letters") & (remainder(F.col("doc_id"), 4) != 2))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.record_batch([pa.array([x.tobytes() for x in features(batch.column("text"))], pa.binary()), batch.column("lang")], names=["x", "lang"])

    usable = usable.withColumn("text_key", F.xxhash64("text"))
    chosen = drawn(usable, sample, "doc_id", "lang", "text_key")
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang", "text_key"], "left_semi").dropDuplicates(["doc_id", "lang", "text_key"])
    found = texts.select("text", "lang").mapInArrow(run, "x binary, lang string").toArrow()
    if not found.num_rows:
        return None
    order = np.lexsort((found["x"].to_numpy(zero_copy_only=False), found["lang"].to_numpy(zero_copy_only=False)))
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)[order]
    names = found["lang"].to_numpy(zero_copy_only=False)[order]
    languages = sorted(set(names))
    return Codes(x, np.searchsorted(np.array(languages), names.astype(str)), languages)


def identify(docs: DataFrame, least_margin: float = 0.1, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text, lang).

    Null texts, texts without a letter, and all texts if no row has a language to learn from, are ``und``
    with score 0. Ties go to the first language by name, and are ambiguous. Repeated rows each get a result, a null doc_id
    is not held out, an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    codes = fit(rows, sample)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    if codes is None:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            parts = [shared.value(features(batch.column("text").slice(i, 1024))) for i in range(0, batch.num_rows, 1024)]
            number, score, margin = (np.concatenate(p) for p in zip(*parts, strict=True))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names = np.where(letters, np.array(shared.value.languages, object)[number], "und")
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0).astype(float)), pa.array(~letters | (margin < least_margin))],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    found = rows.select("doc_id", "text", "letters").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held, "lang_pred", "score", "ambiguous")
