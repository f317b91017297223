"""Substring dedup by short units of words: of each run of units that repeats, the earliest occurrence stays.

A unit is a run of words that ends with a word on ``.``, ``!`` or ``?``, or with a word whose own hash says so (one in
sixteen), or with the text. So units are sentences, and parts of them where they are long or where there are no stops, and whether a unit ends is told by its
last word alone: a passage has the same units wherever it stands and however its lines are broken. Normalised (A-Z
lowered, words joined by one space) and hashed with BLAKE2b to 128 bits, the digests of all documents are grouped; every
occurrence but the first, by (document, text, place), is a repeat. Runs of adjacent repeats go if they have ``RUN_WORDS`` words
together, so stock phrases and lone sentences stay. Offsets are those of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, buffer, distinct, spans
from .common import discard, materialize, slices

#: Units of fewer words are passed over: they neither begin, count for, nor end a run, but those inside a run go with it.
LEAST_WORDS = 3
#: Words that the units of a run have together, at least.
RUN_WORDS = 25
#: Binary logarithm of the bits, at most, in which repeated digests are marked for all tasks.
MARK_BITS = 28


def ends_unit(word: bytes) -> bool:
    """Whether a word, lower-cased, is the last of its unit: by a stop, or one of sixteen by its MD5."""
    return word[-1:] in (b".", b"!", b"?") or hashlib.md5(word, usedforsecurity=False).digest()[0] < 16


def units(column: pa.Array, least_words: int) -> tuple[np.ndarray, ...]:
    """Of every unit with enough words in the texts: the text, its number there, start, stop (code points), words, and the digest's halves.

    White space before a unit belongs to it, so that it goes with the unit.
    """
    flat, offsets = buffer(column)
    low = LOWER[flat]
    starts, ends, counts = spans(low, offsets)
    numbers, found = distinct(low, starts, ends)
    words = found.to_pylist()
    text = np.repeat(np.arange(len(counts)), counts)
    last = np.fromiter(map(ends_unit, words), bool, len(words))[numbers]
    if len(text):
        last |= np.r_[text[1:] != text[:-1], True]
    stop = np.flatnonzero(last)
    head = np.r_[0, stop[:-1] + 1][: len(stop)]
    char = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
    origin = char[offsets[:-1]]
    own = text[head]
    end = char[ends[stop]] - origin[own]
    begin = np.r_[0, end[:-1]][: len(own)]
    begin[np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])] = 0
    kept = np.flatnonzero(stop - head + 1 >= least_words)
    number = np.arange(len(kept)) - np.searchsorted(own[kept], own[kept])
    every = numbers.tolist()
    digests = b"".join(hashlib.blake2b(b" ".join([words[w] for w in every[a : b + 1]]), digest_size=16).digest() for a, b in zip(head[kept].tolist(), stop[kept].tolist(), strict=True))
    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return own[kept], number, begin[kept], end[kept], (stop - head + 1)[kept], halves[:, 0], halves[:, 1]


def _slim(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def _marked(found: DataFrame) -> DataFrame:
    """The units whose digest is marked, which those of all repeated digests are, and few others while there are bits enough.

    Digests alone are counted; those that repeat set a bit by their first bits, at most 2**MARK_BITS for all, however many they are. So units that stand
    once, most as a rule, stay where they lie.
    """
    often = materialize(found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high"), "repeated-digests")
    bits = min(MARK_BITS, max(12, (16 * often.count()).bit_length()))
    place = F.shiftrightunsigned("high", 64 - bits)
    slots = often.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(high, {64 - bits}) & 63 AS INT))")).alias("mask")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[slots["slot"].to_numpy()] = slots["mask"].to_numpy().astype(np.int64).view(np.uint64)
    discard(often)
    shared = found.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("high").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            held = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            yield batch.filter(pa.array(held))

    return found.mapInArrow(run, found.schema)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """text_key, doc_id, start, stop: the runs to remove, one row each.

    The earliest occurrence of a unit, by doc_id (nulls last), then text, then place, stays. Null texts have no
    units. Rows that repeat a doc_id and text are one document: their runs are removed from all or none.
    """
    names = ["doc_id", "text_key", "unit", "start", "stop", "words", "high", "low"]
    kinds = [*[pa.int32()] * 4, pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            text, *columns = units(batch.column("text"), least_words)
            own = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "text_key")]
            yield pa.record_batch([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    found = _slim(docs).mapInArrow(run, "doc_id long, text_key long, unit int, start int, stop int, words int, high long, low long")
    found = materialize(found, "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "unit")
    again = _marked(found)
    groups = again.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first")
    later = again.withColumn("own", rank).join(groups, ["high", "low"]).where(F.col("own") > F.col("first"))
    place = Window.partitionBy("text_key", "doc_id").orderBy("unit")
    later = later.select("text_key", "doc_id", "unit", "start", "stop", "words").withColumns({
        "run": F.col("unit") - F.dense_rank().over(place),
        # Rows that repeat a document repeat its units, whose words count once.
        "words": F.when(F.lag("unit").over(place) == F.col("unit"), 0).otherwise(F.col("words")),
    })
    runs = later.groupBy("text_key", "doc_id", "run").agg(F.sum("words").alias("words"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.where(F.col("words") >= run_words).select("text_key", "doc_id", "start", "stop")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from text, and ``removed``: their original (start, stop).

    All rows and columns stay; n_chars, if there, becomes the new length. Texts without repeats, and null
    texts, are unchanged with an empty array. A column named removed is replaced. An empty table gives an empty result.
    """
    docs = docs.drop("removed")
    spans = repeats(docs, least_words, run_words).groupBy("text_key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    spans = spans.toDF("_loam_key", "_loam_id", "removed")
    key = F.xxhash64(docs["text"].cast("string")) == spans["_loam_key"]
    out = docs.join(spans, key & docs["doc_id"].cast("long").eqNullSafe(spans["_loam_id"]), "left").drop("_loam_key", "_loam_id")
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    out = out.withColumn("text", F.col("text").cast("string")).withColumn("removed", F.coalesce("removed", empty))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, gone in enumerate(batch.column("removed").to_pylist()):
                if gone:
                    edges = [0, *(x for span in gone for x in (span["start"], span["stop"])), len(texts[i])]
                    texts[i] = "".join(texts[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names]
            yield pa.record_batch(columns, names=batch.schema.names)

    out = out.mapInArrow(cut, out.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def report(docs: DataFrame, least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_removed, chars_removed, spans (start:end in code points, joined by commas), text_sha256 of the rest."""
    out = remove_repeats(docs.select("doc_id", "text"), least_words, run_words)
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"]))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("chars_removed"), F.array_join(spans, ",").alias("spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM l),
w AS (
  SELECT doc_id, k, length(part) AS n, translate(regexp_extract(part, '[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM p),
e AS (SELECT *, (regexp_matches(word, '[.!?]$') OR md5(word)[1] = '0')::INT AS last FROM w),
g AS (SELECT *, coalesce(sum(last) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM e),
n AS (SELECT doc_id, unit, count(*) AS words, sum(n)::BIGINT AS size, string_agg(word, ' ' ORDER BY k) AS joined FROM g GROUP BY doc_id, unit),
s AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY unit)::BIGINT AS stop FROM n),
u AS (
  SELECT doc_id, stop - size AS start, stop, words, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS unit,
    row_number() OVER (PARTITION BY joined ORDER BY doc_id, unit) AS rank
  FROM s WHERE words >= 3),
later AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM u WHERE rank > 1),
gone AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM later GROUP BY doc_id, run HAVING sum(words) >= 25),
edges AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS past FROM gone),
kept AS (
  SELECT doc_id, string_agg(substr(text, past + 1, start - past), '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS text,
    count(*) AS n_removed, sum(stop - start)::BIGINT AS chars_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans
  FROM edges JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(chars_removed, 0)::BIGINT AS chars_removed, coalesce(spans, '') AS spans,
  sha256(coalesce(kept.text, documents.text, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
