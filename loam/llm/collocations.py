"""Collocations by contiguous pattern growth: frequent phrases from projected occurrences, then the phrases that stick together.

Words are counted first, then pairs of the words that have the support, then longer phrases of pairs that have it. Every occurrence of
a frequent prefix is projected onto what stands to its right in its piece, as far as each two neighbours are frequent. Equal projections of a block of texts
are one row of its bundle, with their number. Bundles are dealt by prefix, the first two words, so that one task holds all occurrences of each
of its prefixes. It sorts them once; the occurrences of any prefix are then a run, and a prefix with enough of them grows to the right, depth
first, over the parts of its run. A bucket of prefixes with too many projections for a task is dealt anew: first to more buckets, and where a
single prefix is that large by one word more, which leaves that prefix's own count, now spread over tasks, as a bundle of its own. So all counts are
whole before they are held against the support, and no task depends on how often one prefix occurs.

The phrases that remain are scored, thinned and ranked with joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import LOWER, distinct, mix, spans
from .blocks import pack, unpack
from .common import LOWER as LOWER_LETTERS
from .common import UPPER, discard, materialize, partitions, slices, utf8

LONGEST = 4
#: Bytes of text a block has, and for which there is a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Binary logarithm of the bits, at most, in which the words or pairs with the support are marked for all tasks. Where that is too few,
#: others are marked as well, which costs room and changes no count.
MARK_BITS = 28
#: Buckets of the first deal at most, and parts into which a bucket is dealt anew.
BUCKETS, PARTS = 1024, 64
#: Projections that a task takes at a time; a bucket with more is dealt anew.
LIMIT = 3_000_000

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True

BUNDLES = "least int, longest int, bucket long, n long, packed binary"


def _bytes(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words end to end, and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return data.to_pybytes()[offsets[0] : offsets[-1]] if data else b"", np.diff(offsets)


class Runs:
    """Distinct projections in order: numbers of words (0: the piece ended) by column, how often each occurs, and the words, each with its language.

    A word is kept as its bytes, a line feed (which no word has) and its language.
    """

    def __init__(self, words: pa.Array, rows: np.ndarray, counts: np.ndarray):
        """``rows`` has a row for each projection; equal ones are summed. ``words`` are distinct, number 1 on."""
        self.words, self.own = words, None
        keys = []
        for k in range(0, rows.shape[1], 2):
            keys.append(rows[:, k].astype(np.uint64) << np.uint64(32))
            if k + 1 < rows.shape[1]:
                keys[-1] |= rows[:, k + 1].astype(np.uint64)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = False
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(new)
        self.rows = rows[order[at]]
        self.counts = np.add.reduceat(counts[order], at) if len(at) else counts[:0]

    def bundles(self, least: int, keys: np.ndarray) -> Iterator[tuple]:
        """The projections in bundles by ``keys``, each with the words it needs."""
        if not len(keys):
            return
        order = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
        keys, rows, counts = keys[order], self.rows[order], self.counts[order]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        place = np.zeros(len(self.words) + 1, np.int32)
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            own = rows[a:b]
            place[own] = 1
            place[0] = 0
            used = np.flatnonzero(place)
            place[used] = np.arange(1, len(used) + 1)
            # A number's bytes of one rank stand together: neighbours share the high ones.
            planes = np.ascontiguousarray(place[own].T).view(np.uint8).reshape(own.shape[1], b - a, 4).transpose(0, 2, 1).tobytes()
            place[used] = 0
            data, lengths = _bytes(self.words.take(pa.array(used - 1)))
            yield (least, own.shape[1], int(keys[a]), b - a, pack([planes, data], counts[a:b], lengths))

    def hashes(self, words: int) -> np.ndarray:
        """A hash of the first words of each projection."""
        if self.own is None:
            self.own = np.r_[np.zeros(1, np.uint64), _hashes(self.words.to_pylist())]
        return _together([self.own[self.rows[:, k]] for k in range(words)])


def _union(bundles: list[bytes], longest: int) -> Runs:
    """The projections of several bundles together."""
    words, parts, counts, base = [], [], [], 0
    for bundle in bundles:
        (planes, data), (n, lengths) = unpack(bundle)
        rows = np.frombuffer(planes, np.uint8).reshape(longest, 4, -1).transpose(0, 2, 1).copy().view("<i4").reshape(longest, -1).T
        parts.append(np.where(rows > 0, rows + np.int32(base), np.int32(0)))
        counts.append(n)
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        words.append(pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        base += len(lengths)
    coded = pa.concat_arrays(words).dictionary_encode()
    number = np.r_[0, coded.indices.to_numpy(zero_copy_only=False) + 1].astype(np.int32)
    rows = np.concatenate(parts)
    del parts, words
    return Runs(coded.dictionary, number[rows], np.concatenate(counts))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["least", "longest", "bucket", "n", "packed"])


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """langs and texts of the rows, about ``block_bytes`` of text at a time."""
    langs, texts, held = [], [], 0
    for batch in slices(batches, "text", block_bytes):
        own = utf8(batch.column("text"))
        size = sum(map(len, own))
        if held and held + size > block_bytes:
            yield langs, texts
            langs, texts, held = [], [], 0
        langs, texts, held = langs + utf8(batch.column("lang")), texts + own, held + size
    if texts:
        yield langs, texts


def _split(langs: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of every word, the words by number (see ``Runs``), and the number of the piece that each word is in."""
    own = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
    flat = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
    starts, ends, counts = spans(flat, offsets, APART)
    numbers, words = distinct(flat, starts, ends)
    code = numbers.astype(np.int64) * len(own) + np.repeat([own[x] for x in langs], counts)
    used, numbers = np.unique(code, return_inverse=True)
    named, every = list(own), words.to_pylist()
    tokens = [every[c // len(own)] + b"\n" + named[c % len(own)] for c in used.tolist()]
    piece = np.cumsum(BREAK[flat], dtype=np.int32)[starts].astype(np.int64) + np.repeat(np.arange(len(texts)) * (len(flat) + 1), counts)
    return numbers, tokens, piece


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def word_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, word, f of every word of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches, block_bytes):
            numbers, tokens, _ = _split(langs, texts)
            counts = np.bincount(numbers, minlength=len(tokens))
            for a in range(0, len(tokens), 50_000):
                parts = [t.split(b"\n", 1) for t in tokens[a : a + 50_000]]
                columns = [pa.array([x[k] for x in parts], pa.binary()).cast(pa.string()) for k in (1, 0)]
                yield pa.record_batch([*columns, pa.array(counts[a : a + 50_000], pa.int64())], names=["lang", "word", "f"])

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _together(hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase from the hashes of its words, word by word."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for own in hashes:
        out = mix(out * np.uint64(3) + own)
    return out


class Marks:
    """A bit for each hash of some number of bits, the first ones of the hash; set for some phrases."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def marked(phrases: DataFrame) -> Marks:
    """The bits of ``phrases`` (lang, words, of one length), put together by tasks; at most 2**MARK_BITS, however many these are."""
    bits = min(MARK_BITS, max(12, (16 * phrases.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = [[w.encode() + b"\n" + lang for w in words] for lang, words in zip(utf8(batch.column("lang")), batch.column("words").to_pylist(), strict=True)]
                place = _together([_hashes(list(column)) for column in zip(*lists, strict=True)]) >> np.uint64(64 - bits)
                slot, mask = (place >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
                yield pa.record_batch([pa.array(slot), pa.array(mask)], names=["slot", "mask"])

    found = phrases.select("lang", "words").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Marks(bits, out)


def project(docs: DataFrame, longest: int, buckets: int, words: Marks, pairs: Marks | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The bundles of ``docs`` (lang, text) by their first two words: pairs of marked words, or with ``pairs`` longer phrases of marked pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))
    least = 3 if pairs else 2

    def bundle(langs: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        words, pairs = shared.value
        numbers, tokens, piece = _split(langs, texts)
        hashes = _hashes(tokens)
        kept = np.flatnonzero(words(_together([hashes])))
        number = np.zeros(len(tokens), np.int32)
        number[kept] = np.arange(1, len(kept) + 1)
        # Whether a word and the next are a pair that may be part of a phrase.
        joined = np.zeros(len(numbers), bool)
        joined[:-1] = (piece[1:] == piece[:-1]) & (number[numbers[:-1]] > 0) & (number[numbers[1:]] > 0)
        if pairs:
            at = np.flatnonzero(joined)
            joined[at] = pairs(_together([hashes[numbers[at]], hashes[numbers[at + 1]]]))
        # Where a phrase of the least length begins; its words further on as far as they are joined.
        begin = joined.copy()
        for k in range(1, least - 1):
            begin[:-k] &= joined[k:]
            begin[-k:] = False
        at = np.flatnonzero(begin)
        rows = np.zeros((len(at), longest), np.int32)
        on = np.ones(len(at), bool)
        for k in range(longest):
            rows[on, k] = number[numbers[at[on] + k]]
            on[on] = joined[at[on] + k]
        found = Runs(pa.array([tokens[k] for k in kept.tolist()], pa.large_binary()), rows, np.ones(len(rows), np.int64))
        found.own = np.r_[np.zeros(1, np.uint64), hashes[kept]]
        return _batch(list(found.bundles(least, (found.hashes(2) % np.uint64(buckets)).astype(np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches, block_bytes):
            yield bundle(langs, texts)

    return docs.mapInArrow(run, BUNDLES)


def _deal_anew(bundles: DataFrame, length: int, divisor: int) -> DataFrame:
    """Large buckets dealt into parts by a hash of ``length`` words; projections with another bound are cut into a count of that and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 4 << 20):
            kinds: dict[tuple, list[bytes]] = {}
            for row in batch.to_pylist():
                kinds.setdefault((row["least"], row["longest"], row["bucket"]), []).append(row["packed"])
            out = []
            for (least, longest, bucket), packed in kinds.items():
                found, wide = _union(packed, longest), min(length, longest)
                parts = ((found.hashes(wide) // np.uint64(divisor)) % np.uint64(PARTS)).astype(np.int64) + bucket * PARTS
                for k in range(least, wide):  # counts of prefixes that are dealt out now
                    short = Runs(found.words, found.rows[:, :k], found.counts)
                    out += short.bundles(k, ((short.hashes(k) // np.uint64(divisor)) % np.uint64(PARTS)).astype(np.int64) + bucket * PARTS)
                longer = found.rows[:, wide - 1] > 0
                found.rows, found.counts = found.rows[longer], found.counts[longer]
                out += found.bundles(max(least, wide), parts[longer])
            yield _batch(out)

    return bundles.mapInArrow(run, BUNDLES)


def _grown(found: Runs, least: int, support: int) -> Iterator[tuple[int, int, int]]:
    """First projection, length and count of every phrase of ``least`` words or more with the support, depth first."""
    rows, sums = found.rows, np.r_[0, np.cumsum(found.counts)]

    def grow(a: int, b: int, depth: int) -> Iterator[tuple[int, int, int]]:
        """``a`` to ``b`` are the occurrences of a prefix of ``depth`` words; those of a longer prefix are a run of them."""
        if depth == rows.shape[1]:
            return
        own = rows[a:b, depth]
        cuts = a + np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, b - a]
        total = sums[cuts[1:]] - sums[cuts[:-1]]
        for k in np.flatnonzero((total >= support) & (rows[cuts[:-1], depth] > 0)).tolist():
            if depth + 1 >= least:
                yield int(cuts[k]), depth + 1, int(total[k])
            yield from grow(int(cuts[k]), int(cuts[k + 1]), depth + 1)

    if len(rows):
        yield from grow(0, len(rows), 0)


FOUND = "lang string, words array<string>, f long"


def _counted(pending: DataFrame, support: int, buckets: int, limit: int) -> DataFrame:
    """lang, words, f of the phrases with the support in the bundles ``pending``, in the shared folder."""

    def grow(table: pa.Table) -> pa.Table:
        least, longest = table["least"][0].as_py(), table["longest"][0].as_py()
        found = _union(table["packed"].to_pylist(), longest)
        words = found.words
        out = [([words[w - 1].as_py() for w in found.rows[at, :size].tolist()], n) for at, size, n in _grown(found, least, support)]
        columns = [pa.array([x[0].split(b"\n", 1)[1].decode() for x, _ in out], pa.string()), pa.array([[w.split(b"\n", 1)[0].decode() for w in x] for x, _ in out], pa.list_(pa.string()))]
        return pa.table([*columns, pa.array([n for _, n in out], pa.int64())], names=["lang", "words", "f"])

    pending, done, key = materialize(pending, "phrases-projected"), [], ["least", "longest", "bucket"]
    # By two words once more, with other bits of their hash, and then by one word more each time.
    for length, divisor in [(2, buckets), *((k, 1) for k in range(3, LONGEST + 1)), (0, 1)]:
        sizes = materialize(pending.groupBy(*key).agg(F.sum("n").alias("all")), "phrases-sizes")
        large = sizes.where(F.col("all") > limit).drop("all")
        more = length > 0 and not large.isEmpty()
        small = pending.join(sizes.where(F.col("all") <= limit).drop("all"), key, "left_semi") if more else pending
        done.append(materialize(small.groupBy(*key).applyInArrow(grow, FOUND), "phrases-counted"))
        dealt = materialize(_deal_anew(pending.join(large, key, "left_semi"), length, divisor), "phrases-dealt-anew") if more else None
        discard(pending)
        if not more:
            break
        pending = dealt
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def frequent(docs: DataFrame, support: int, longest: int = LONGEST, limit: int = LIMIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, words, f of every phrase of up to ``longest`` (2 to 4) words that occurs ``support`` times in a lang; and for each lang a row without words, f all its words.

    ``docs`` has lang and text; null texts are empty, a null lang is ``und``. Repeated rows count each; an empty table has no phrases.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(BUCKETS, -(-total // bucket_bytes)))
    counts = materialize(word_counts(rows), "phrases-words")
    single = counts.where(F.col("f") >= support).select("lang", F.array("word").alias("words"), "f")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.array().cast("array<string>").alias("words"), "f")
    words = marked(single)
    pairs = _counted(project(rows, 2, buckets, words), support, buckets, limit)
    out = single.unionByName(totals).unionByName(pairs)
    if longest > 2:
        out = out.unionByName(_counted(project(rows, longest, buckets, words, marked(pairs)), support, buckets, limit))
    return out


def _joined(words: Column | str) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, support: int = 30, longest: int = LONGEST, covered: int = 80, top: int = 2000, limit: int = LIMIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k: the ``top`` phrases of each lang of ``docs`` (lang, text).

    Texts are lower-cased (A-Z) and split into pieces at marks and line ends, pieces into words at spaces and tabs; a phrase
    lies within a piece. ``a`` is how often it occurs, ``l`` and ``r`` how often the parts of its weakest cut do (the first of equals, after ``k`` words),
    ``n`` the words of the lang, score 2,000,000 * a // (l + r). A phrase inside a longer one that has ``covered`` percent of its
    occurrences is left out. Ties of score go by ``a``, then by the phrase. Null texts are empty, a null lang is ``und``,
    repeated rows count each, an empty table has no phrases; other columns are ignored.
    """
    found = materialize(frequent(docs, support, longest, limit, bucket_bytes), "phrases")
    totals = found.where(F.size("words") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    counts = found.where(F.size("words") > 0).select("lang", _joined("words").alias("phrase"), "words", "f")
    candidates = counts.where(F.size("words") > 1).withColumnRenamed("f", "a")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("words", 1, F.col("k"))).alias("head"), _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")

    longer = candidates.where(F.size("words") > 2)
    inner = longer.select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    around = inner.groupBy("lang", _joined(F.slice("words", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("a").alias("most"))
    inside = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(most AS DECIMAL(20, 0)) >= CAST({covered} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(20, 0))")
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | ~inside).drop("most")

    # A lang's phrases are ranked in parts first, so no task sorts all of them.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER_LETTERS}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
phrases AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING size = 1 OR count(*) >= 30
),
totals AS (SELECT lang, sum(f) AS n FROM phrases WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(c.w[i : i + s - 1], ' ') AS phrase, max(c.a) AS most
  FROM candidates c, (SELECT unnest([2, 3]) AS s) z, (SELECT unnest([1, 2, 3]) AS i) WHERE s < c.size AND i + s - 1 <= c.size GROUP BY ALL
),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < 80 * b.a
)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, k FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
