"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation, over word tokens.

The model predicts a token w after the tokens c1 (last) and c2 (before) from h = r[c1] C1 + r[c2] C2. The vocabulary's
words, sorted by frequency, are cut into classes of about equal mass, and P(w) = P(class of w) P(w in its class), both
softmax over dot products with h. So every token's log-probability is normalised exactly by two batched matrix products of some
hundred columns, however many words there are. A token outside the vocabulary takes the probability of the
``other`` word times its smoothed share among such tokens.

What is learnt comes from all training documents. Texts are dealt into blocks by hash; the counts of all tokens are summed over the
corpus and joined back to the blocks by token. In each round every block is trained from the same parameters, with
each of its tokens drawn once and noise sampled for it; the blocks' mean, weighted by tokens, is the next round's start.
Blocks depend on the rows alone, so the scores don't depend on how files or partitions are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, distinct, spans
from .blocks import blocks, pack, positions_of, unpack
from .common import materialize, remainder

#: The vocabulary is the tokens that occur LEAST_COUNT times, at most VOCABULARY of them, since the model is broadcast.
VOCABULARY, LEAST_COUNT = 32_768, 2
CLASSES, SIZE, ROUNDS, RATE, SEED = 256, 16, 1, 0.1, 5
#: Tokens of a training step, noise classes drawn for a step, and noise words of its class drawn for a token.
BATCH, NOISE_CLASSES, NOISE_WORDS = 8192, 32, 1
BLOCK_BYTES = 6 << 20
#: Parameters in a row of those that are summed over the blocks.
CHUNK = 1 << 14
#: Stands for the end of a text; no word has a space.
END = b" "


def tokens(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Numbers of the tokens, A-Z lowered, each text's last one the end; the tokens by number; the texts' numbers of tokens."""
    flat = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    starts, ends, counts = spans(flat, offsets)
    numbers, words = distinct(flat, starts, ends)
    out = np.full(len(starts) + len(texts), len(words), np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), counts)] = numbers
    return out, [*words.to_pylist(), END], counts + 1


def held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.array([bool(k) and zlib.crc32(b"%d" % i) % 7 == 2 for i, k in zip(ids.tolist(), known.tolist(), strict=True)], bool)


class Vocabulary:
    """Shares of the words by number, frequent ones first, and the first word of every class, with the end."""

    def __init__(self, counts: np.ndarray, other: int, other_total: int, other_distinct: int, classes: int = CLASSES):
        self.other, self.other_total, self.other_distinct = other, other_total, other_distinct
        share = counts + 1.0
        self.share = share / share.sum()
        middle = np.cumsum(self.share) - self.share / 2
        place = np.minimum((middle * classes).astype(np.int64), classes - 1)
        self.edges = np.r_[np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), len(share)]
        self.of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        self.class_share = np.add.reduceat(self.share, self.edges[:-1])
        self.inside = self.share / self.class_share[self.of]


def learn_words(totals: DataFrame, size: int) -> tuple[Vocabulary, DataFrame, int, int]:
    """The vocabulary from ``totals`` (word, n), a table (word, v) of its words, the tokens' total and the number of different ones.

    Words above a count are taken: the least count, a step of a sixteenth of a power of two, that leaves at most ``size``.
    """
    spark = totals.sparkSession
    total, distinct_words = totals.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = totals.where((F.col("n") >= LEAST_COUNT) & (F.col("word") != F.lit(END)))
    steps = words.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # a row a step
    least, room = None, size - 2
    for r in steps:
        if r.words > room:
            break
        least, room = r.n, room - r.words
    chosen = [] if least is None else words.where(F.col("n") >= least).collect()  # ``size`` rows at most
    ends = totals.where(F.col("word") == F.lit(END)).first()
    end = ends.n if ends else 0
    rest = int(total - end - sum(r.n for r in chosen))
    rest_distinct = int(distinct_words - len(chosen) - (end > 0))
    listed = sorted([(bytes(r.word), r.n) for r in chosen] + [(END, end), (b"", rest)], key=lambda x: (-x[1], x[0]))
    numbers = {word: v for v, (word, _) in enumerate(listed)}
    vocabulary = Vocabulary(np.array([n for _, n in listed], float), numbers.pop(b""), rest, rest_distinct)
    return vocabulary, spark.createDataFrame(list(numbers.items()), "word binary, v int"), total, distinct_words


def contexts(words: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For every token the word before it and the one before that; the end stands before a text's first."""
    start = np.cumsum(sizes) - sizes
    one, two = np.full(len(words), end, words.dtype), np.full(len(words), end, words.dtype)
    one[1:], two[2:] = words[:-1], words[:-2]
    second = start[sizes > 1] + 1
    one[start], two[start], two[second] = end, end, end
    return one, two


class Parameters:
    """r, q (words, d), u (classes, d), c1, c2 (d, d), b (words) and a (classes), over one flat float32 array."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        n, k = len(vocabulary.share), len(vocabulary.class_share)
        shapes = [(n, SIZE), (n, SIZE), (k, SIZE), (SIZE, SIZE), (SIZE, SIZE), (n,), (k,)]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        if fresh := flat is None:
            flat = np.random.default_rng(SEED).normal(0, 0.1, cuts[-1]).astype(np.float32)
        self.flat, self.vocabulary = flat, vocabulary
        self.r, self.q, self.u, self.c1, self.c2, self.b, self.a = (x.reshape(s) for x, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True))
        if fresh:
            self.q[:] = self.u[:] = 0
            self.c1 += np.eye(SIZE, dtype=np.float32)
            self.c2 += np.eye(SIZE, dtype=np.float32) / 2
            self.a[:], self.b[:] = np.log(vocabulary.class_share), np.log(vocabulary.inside)

    def _add(self, table: np.ndarray, power: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """Adagrad on the given rows; the gradients of a row that comes again are summed."""
        order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")  # short numbers are sorted by radix
        sorted_rows = rows[order]
        first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
        at, total = sorted_rows[first], np.add.reduceat(gradient[order], first, axis=0)
        power[at] += total**2
        table[at] += rate * total / np.sqrt(power[at])

    def fit(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, rate: float, seed: int) -> None:
        """Noise-contrastive estimation by Adagrad; every token is drawn once.

        The noise of a class is drawn from the classes' shares, for all tokens of a step; that of a word from its class.
        """
        v, draw = self.vocabulary, np.random.default_rng(seed)
        power = Parameters(v, np.full(len(self.flat), 1e-2, np.float32))
        log_class = np.log(NOISE_CLASSES * v.class_share).astype(np.float32)
        log_inside = np.log(NOISE_WORDS * v.inside).astype(np.float32)
        edge = np.r_[0, np.cumsum(v.share)]
        edge /= edge[-1]
        order = draw.permutation(len(word))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            o, t, w = one[rows], two[rows], word[rows]
            k = v.of[w]
            left, right = self.r[o], self.r[t]
            h = left @ self.c1 + right @ self.c2
            noise = draw.choice(len(v.class_share), NOISE_CLASSES, p=v.class_share)
            up = 1 / (1 + np.exp((h * self.u[k]).sum(1) + self.a[k] - log_class[k]))
            down = -1 / (1 + np.exp(-(h @ self.u[noise].T + self.a[noise] - log_class[noise])))
            back = up[:, None] * self.u[k] + down @ self.u[noise]
            # Words in a class of their own have nothing to learn there.
            many = np.flatnonzero((v.edges[k + 1] - v.edges[k]) > 1)
            hm, wm, km = h[many], w[many], k[many]
            low, high = edge[v.edges[km]], edge[v.edges[km + 1]]
            other = np.searchsorted(edge, low[:, None] + (high - low)[:, None] * draw.random((len(many), NOISE_WORDS)), "right") - 1
            other = np.clip(other, v.edges[km][:, None], v.edges[km + 1][:, None] - 1)
            up_word = 1 / (1 + np.exp((hm * self.q[wm]).sum(1) + self.b[wm] - log_inside[wm]))
            qo = self.q[other]
            down_word = -1 / (1 + np.exp(-(np.einsum("nd,nmd->nm", hm, qo) + self.b[other] - log_inside[other])))
            back[many] += up_word[:, None] * self.q[wm] + np.einsum("nm,nmd->nd", down_word, qo)
            if len(many):
                rows = np.r_[wm, other.ravel()]
                self._add(self.q, power.q, rows, np.concatenate([up_word[:, None] * hm, (down_word[:, :, None] * hm[:, None, :]).reshape(-1, SIZE)]), rate)
                self._add(self.b, power.b, rows, np.r_[up_word, down_word.ravel()], rate)
            self._add(self.u, power.u, np.r_[k, noise], np.concatenate([up[:, None] * h, down.T @ h]), rate)
            self._add(self.a, power.a, np.r_[k, noise], np.r_[up, down.sum(0)], rate)
            self._add(self.r, power.r, np.r_[o, t], np.concatenate([back @ self.c1.T, back @ self.c2.T]), rate)
            for table, own, gradient in ((self.c1, power.c1, left.T @ back), (self.c2, power.c2, right.T @ back)):
                own += gradient**2
                table += rate / 10 * gradient / np.sqrt(own)

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, room: int = 1 << 20) -> np.ndarray:
        """log P(word) after the words ``one`` (last) and ``two``, in batches of matrix products with about ``room`` entries.

        The classes' normaliser depends on the two words before only, so it is computed once for each pair of them.
        """

        def normaliser(h: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
            out, size = np.empty(len(h), np.float32), max(room // max(len(bias), 1), 1)
            for i in range(0, len(h), size):
                odds = h[i : i + size] @ table.T
                odds += bias
                top = odds.max(1)
                odds -= top[:, None]
                out[i : i + size] = top + np.log(np.exp(odds, out=odds).sum(1))
            return out

        def own(h: np.ndarray, table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.einsum("nd,nd->n", h, table[rows]) + bias[rows]

        v, log = self.vocabulary, np.empty(len(word))
        kind = v.of[word]
        left, right = self.r @ self.c1, self.r @ self.c2
        for i in range(0, len(word), 1 << 20):
            some = slice(i, i + (1 << 20))
            pairs, which = np.unique(one[some].astype(np.int64) * len(v.share) + two[some], return_inverse=True)
            h = left[pairs // len(v.share)] + right[pairs % len(v.share)]
            total = normaliser(h, self.u, self.a)
            for j in range(0, len(which), 1 << 16):
                at, part = slice(i + j, min(i + j + (1 << 16), i + len(which))), which[j : j + (1 << 16)]
                log[at] = own(h[part], self.u, self.a, kind[at]) - total[part]
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(len(v.class_share) + 1))
        for c in np.flatnonzero(np.diff(v.edges) > 1):
            rows, low, high = order[cuts[c] : cuts[c + 1]], v.edges[c], v.edges[c + 1]
            if len(rows):
                h, table, bias = left[one[rows]] + right[two[rows]], self.q[low:high], self.b[low:high]
                log[rows] += own(h, table, bias, word[rows] - low) - normaliser(h, table, bias)
        return log


def train(spark: SparkSession, coded: DataFrame, vocabulary: Vocabulary, end: int, rounds: int = ROUNDS) -> Parameters:
    """Parameters after ``rounds`` of training on the training texts of ``coded`` (block, packed)."""
    parameters = Parameters(vocabulary)
    for step in range(rounds):
        shared = spark.sparkContext.broadcast(parameters)
        rate = RATE / (1 + step)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, step=step) -> Iterator[pa.RecordBatch]:
            start, total, weight = shared.value, None, 0
            for batch in batches:
                for block, value in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                    ids, known, sizes, words, *_ = unpack(value)[1]
                    words = words.astype(np.int32)
                    one, two = contexts(words, sizes, end)
                    mine = np.flatnonzero(np.repeat(~held_out(ids, known), sizes))
                    if len(mine):
                        own = Parameters(start.vocabulary, start.flat.copy())
                        own.fit(one[mine], two[mine], words[mine], rate, block % (1 << 40) + step)
                        total = np.zeros(len(own.flat)) if total is None else total
                        total += own.flat * float(len(mine))
                        weight += len(mine)
            if total is not None:  # one sum for all blocks of the task
                for i in range(0, len(total), CHUNK):
                    yield pa.record_batch([pa.array([i // CHUNK], pa.int32()), pa.array([weight], pa.int64()), pa.array([total[i : i + CHUNK].tobytes()], pa.binary())], names=["chunk", "weight", "sums"])

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), "<f8") for x in rows["sums"]) / sum(rows["weight"].to_pylist())
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "mean": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        means = coded.mapInArrow(run, "chunk int, weight long, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, mean binary").collect()
        if not means:
            return parameters
        flat = np.frombuffer(b"".join(bytes(r["mean"]) for r in sorted(means, key=lambda r: r.chunk)), "<f4").copy()
        parameters = Parameters(vocabulary, flat)
    return parameters


def score(docs: DataFrame, vocabulary_size: int = VOCABULARY, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, other_tokens of every row of ``docs`` (doc_id, text).

    Learns from the rows that are not held out (crc32 of doc_id mod 7 is not 2; a null doc_id is not). Null texts
    are empty: their one token is the end. base_score sums the add-one unigram log10 probabilities, score the
    model's; other_tokens counts those outside its vocabulary. Repeated rows each count and get a result, an empty table gives an empty result, without
    training rows every token is unknown; other columns are ignored. Ties in frequency go to the lesser word.
    """
    spark = docs.sparkSession

    def trained(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        return ~held_out(ids, known)

    dealt = materialize(blocks(docs, tokens, block_bytes, counted=trained, by_hash=True), "blocks")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column("owner").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                words, (numbers, n) = unpack(value)
                yield pa.record_batch([pa.array([block] * len(words), pa.int64()), pa.array(numbers.astype(np.int32)), pa.array(words, pa.binary()), pa.array(n)], names=["block", "number", "word", "n"])

    own = dealt.where("owner IS NOT NULL").mapInArrow(listed, "block long, number int, word binary, n long")
    totals = materialize(own.groupBy("word").agg(F.sum("n").alias("n")), "totals")
    vocabulary, numbers, total, kinds = learn_words(totals, vocabulary_size)
    end = next(r.v for r in numbers.where(F.col("word") == F.lit(END)).collect())
    # The vocabulary's rows are bounded by its size.
    joined = own.select("block", "number", "word").join(totals.join(F.broadcast(numbers), "word", "left"), "word").select("block", "number", "n", "v")
    shared = spark.sparkContext.broadcast(vocabulary)

    def code(positions: pa.Table, words: pa.Table) -> pa.Table:
        known_words = shared.value
        ids, known, sizes, numbers = positions_of(positions["packed"][0].as_py())
        place = np.argsort(words["number"].to_numpy())  # every number of a block comes once
        c = words["n"].to_numpy()[place]
        v = words["v"].fill_null(known_words.other).to_numpy()[place].astype(np.int64)
        log = np.log10((c + 1) / (total + kinds + 1))
        outside = np.where(v == known_words.other, np.log10((c + 1) / (known_words.other_total + known_words.other_distinct + 1)), 0)
        at = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x[numbers], at) for x in (log, outside, (c > 0).astype(np.int64), (v == known_words.other).astype(np.int64))]
        packed = pack([x.astype("<f8").tobytes() for x in sums[:2]], ids, known, sizes, v[numbers], *sums[2:])
        return pa.table({"block": positions["block"].slice(0, 1), "packed": pa.array([packed], pa.binary())})

    positions = dealt.where("owner IS NULL").select("block", "packed")
    coded = materialize(positions.groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(code, "block long, packed binary"), "coded")

    model = spark.sparkContext.broadcast(train(spark, coded, vocabulary, end, rounds))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("packed").to_pylist():
                (base, outside), (ids, known, sizes, words, seen, other) = unpack(value)
                words = words.astype(np.int32)
                one, two = contexts(words, sizes, end)
                log = model.value.log_probabilities(one, two, words) / np.log(10)
                own = np.add.reduceat(log, np.cumsum(sizes) - sizes) + np.frombuffer(outside, "<f8")
                columns = {
                    "doc_id": pa.array(ids, pa.int64(), mask=known == 0), "n_tokens": pa.array(sizes), "n_known": pa.array(seen),
                    "base_score": pa.array(np.frombuffer(base, "<f8")), "score": pa.array(own), "other_tokens": pa.array(other),
                }
                yield pa.record_batch(list(columns.values()), names=list(columns))

    scored = coded.mapInArrow(judge, "doc_id long, n_tokens long, n_known long, base_score double, score double, other_tokens long")
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "other_tokens")
