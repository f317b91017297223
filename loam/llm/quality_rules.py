"""Quality rules: counts within a document, and the line frequency across a host's documents.

Lines are normalised (A-Z lowered, digits as 0, words joined by one space) and hashed to 128 bits. A line that stands
in more of a host's distinct documents than the limits is boilerplate and removed; a document left with too
few of its words is depleted and rejected. Within a document words, windows and lines are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SEPARATOR, buffer, distinct, spans
from .common import materialize, slices

#: Parts into which the occurrences of every line are dealt where the frequent lines join them.
SALTS = 32
WINDOW, QUERY_SYMBOLS = 5, b"#*$%&|<>"
LINE_BREAK = np.zeros(256, bool)
LINE_BREAK[10] = True
_NORMAL = LOWER.copy()
_NORMAL[ord("0") : ord("9") + 1] = ord("0")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(QUERY_SYMBOLS)] = True

SCHEMA = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<binary>, line_words array<int>"


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[edges[1:]] - total[edges[:-1]]


def _windows(numbers: np.ndarray, length: int) -> np.ndarray:
    """A number for every ``length`` successive entries of ``numbers``, equal for equal entries alone."""
    half = numbers
    size, found = 1, {1: numbers}
    while 2 * size <= length:
        n = len(half) - size
        half = np.unique(half[:n] * (int(half.max()) + 1) + half[size : size + n], return_inverse=True)[1]
        size *= 2
        found[size] = half
    whole, covered = half, size
    while covered < length:
        size = max(k for k in found if covered + k <= length)
        n = len(numbers) - covered - size + 1
        more = found[size][covered : covered + n]
        whole = np.unique(whole[:n] * (int(more.max()) + 1) + more, return_inverse=True)[1]
        covered += size
    return whole


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The counts of each text of ``batch`` (doc_id, host, text), and its normalised lines."""
    flat, offsets = buffer(batch.column("text"))
    starts, ends, counts = spans(flat, offsets)
    word_edges = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(len(starts), bool)
    if len(starts) >= WINDOW:
        whole = np.flatnonzero(text[WINDOW - 1 :] == text[: len(text) - WINDOW + 1])
        window = _windows(distinct(flat, starts, ends)[0].astype(np.int64), WINDOW)[whole]
        twice, _ = _repeated(window * len(counts) + text[whole])
        marks = np.zeros(len(starts) + 1, np.int64)
        np.add.at(marks, whole[twice], 1)
        np.add.at(marks, whole[twice] + WINDOW, -1)
        covered = np.cumsum(marks)[:-1] > 0

    first, last, lines = spans(flat, offsets, LINE_BREAK)
    low, high = np.searchsorted(starts, first), np.searchsorted(starts, last)
    worded = high > low
    line_text = np.repeat(np.arange(len(counts)), lines)[worded]
    first, last, low, high = first[worded], last[worded], low[worded], high[worded]
    _, again = _repeated(distinct(flat, first, last)[0].astype(np.int64) * len(counts) + line_text)
    line_edges = np.searchsorted(line_text, np.arange(len(counts) + 1))

    line = np.repeat(np.arange(len(low)), high - low)
    normal, held = _NORMAL[flat], ~SEPARATOR[flat]
    between = starts[1:][line[1:] == line[:-1]] - 1  # one of the separators before each further word of a line
    normal[between], held[between] = 0x20, True
    place = np.r_[0, np.cumsum(held)]
    numbers, normalised = distinct(normal[held], place[starts[low]], place[ends[high - 1]])
    digest = pa.array([xxhash.xxh3_128_digest(x) for x in normalised.to_pylist()], pa.binary()).take(pa.array(numbers))

    lists = pa.array(line_edges, pa.int32())
    return pa.record_batch(
        [
            batch.column("doc_id"),
            batch.column("host"),
            pa.array(counts, pa.int64()),
            pa.array(_per_text(((flat & 0xC0) != 0x80) & ~SEPARATOR[flat], offsets), pa.int64()),
            pa.array(_per_text(_SYMBOL[flat], offsets), pa.int64()),
            pa.array(np.bincount(line_text[again], minlength=len(counts)), pa.int64()),
            pa.array(_per_text(covered, word_edges), pa.int64()),
            pa.ListArray.from_arrays(lists, digest),
            pa.ListArray.from_arrays(lists, pa.array((high - low).astype(np.int32))),
        ],
        names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
    )


def apply_rules(docs: DataFrame, host: str = "source", limit_docs: int = 20, limit_share: float = 0.1, most_docs: int = 1000, least_words: int = 10, least_share: float = 0.3) -> DataFrame:
    """doc_id, the counts, n_lines_removed, n_words_left, base_failed and kept of every row of ``docs``.

    A line is removed if it stands in more than ``limit_docs`` of a host's distinct documents, and in more than
    ``limit_share`` of them or more than ``most_docs``, which keeps the limit from rising with a large host. A
    document is rejected if ``base_failed``, or if removal leaves it under ``least_words`` or under
    ``least_share`` of its words. Null texts have no words; a null host is the empty one; rows
    that repeat a doc_id count as one document and get a result each; rows with a null doc_id get
    results but don't count. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield measure(batch)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    measured = materialize(rows.mapInArrow(run, SCHEMA).withColumn("row", F.monotonically_increasing_id()), "rules")
    known = measured.where("doc_id IS NOT NULL")
    hosts = known.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = known.select("host", "doc_id", F.explode(F.array_distinct("lines")).alias("line")).distinct()
    often = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit_docs).join(hosts, "host")
    often = often.where((F.col("n") > F.col("host_docs") * limit_share) | (F.col("n") > most_docs))
    often = often.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = measured.select("row", "host", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    own = own.select("row", "host", "salt", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    gone = own.join(often, ["host", "line", "salt"], "left_semi").groupBy("row").agg(F.sum("words").alias("gone_words"), F.count("*").alias("gone_lines"))
    joined = measured.drop("lines", "line_words").join(gone, "row", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    depleted = (left < least_words) | (left < F.col("n_words") * least_share)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_lines_removed"),
        left.alias("n_words_left"),
        (~failed & ~depleted).alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 0) AS lines FROM t),
win AS (
  SELECT doc_id, i, w[i:i + 4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS line,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, host, unnest(lines) AS l FROM w)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM t GROUP BY host),
often AS (
  SELECT host, line FROM line JOIN hosts USING (host) GROUP BY host, line
  HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) > max(host_docs) * 0.1 OR count(DISTINCT doc_id) > 1000)),
lefts AS (
  SELECT doc_id, sum(n) FILTER (WHERE often.line IS NULL) AS words, count(*) FILTER (WHERE often.line IS NOT NULL) AS gone
  FROM line LEFT JOIN often USING (host, line) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone, 0)::INTEGER::BIGINT AS n_lines_removed, coalesce(words, 0)::BIGINT AS n_words_left
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lefts USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 10 AND n_words_left >= n_words * 0.3 AS kept
FROM base
"""
