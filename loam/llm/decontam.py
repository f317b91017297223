"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item of n distinct shingles is contained in a document at 0.8 or more if at most floor(0.2 n) of
them are missing there. Items are partitioned by size into classes (2^(k-1), 2^k]. All items of a
class get a bottom-s MinHash sketch, the s = floor(0.2 * 2^k) + 1 least shingle hashes. One sketch entry
more than can be missing makes the search complete: a document that contains the item holds one of its
sketch entries at least, however long the document is. Documents are probed with all their shingles, so
short items inside long texts are found, and each candidate is verified by its shingles' own words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 80
#: Rows of item tables that a broadcast may hold; beyond it the joins shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(w: Column, length: int, make) -> Column:
    """``make`` of every ``length`` successive words of the array ``w``."""
    positions = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: make(*[F.get(w, i + k) for k in range(length)]))


def _hash(*w: Column) -> Column:
    return F.xxhash64(F.lit(len(w)), *w)


def _text(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def _all(w: Column, lengths: list[int], make) -> Column:
    return reduce(F.concat, [shingles(w, n, make) for n in lengths])


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, len, shingle, hash: the distinct shingles of each item; short items are one shingle."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(SHINGLE_WORDS)))
    by_length = [w.where(F.col("len") == n).select("item_id", "len", F.explode(F.arrays_zip(shingles(F.col("w"), n, _text).alias("shingle"), shingles(F.col("w"), n, _hash).alias("hash"))).alias("s")) for n in range(1, SHINGLE_WORDS + 1)]
    return reduce(DataFrame.union, by_length).select("item_id", "len", "s.shingle", "s.hash").distinct()


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key, item_id, n_shingles, n_shared, containment of every item a document contains.

    n_shingles counts the item's distinct shingles, n_shared those that the document has. Null and
    wordless texts contain nothing, wordless items are in nothing; items under five words are sought as a
    whole. Rows that repeat a doc_id and text give one result, a null doc_id stays null; text_key is the
    hash of the text. Empty tables on either side give an empty result; other columns are ignored.
    """
    items = materialize(items_of(benchmark), "items")
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    small = items.count() <= broadcast_rows
    fit = F.broadcast if small else (lambda df: df)
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # five values at most
    allowed = 100 - threshold_percent
    bound = F.pow(F.lit(2), F.ceil(F.log2("n_shingles")))
    keep = F.floor(bound * allowed / 100).cast("int") + 1
    ranked = items.groupBy("item_id").agg(F.array_sort(F.collect_list("hash")).alias("all"), F.count("*").alias("n_shingles"))
    sketch = ranked.select("item_id", F.explode(F.slice("all", F.lit(1), keep)).alias("hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    if not lengths:
        lengths = [SHINGLE_WORDS]
    split = rows.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    probes = split.select("doc_id", "text_key", F.explode(_all(F.col("w"), lengths, _hash)).alias("hash"))
    found = probes.join(fit(sketch), "hash").select("doc_id", "text_key", "item_id").distinct()
    found = materialize(found, "candidates")
    again = rows.join(found.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["doc_id", "text_key"])
    own = again.select("doc_id", "text_key", words(F.col("text")).alias("w"))
    own = own.select("doc_id", "text_key", F.explode(F.array_distinct(_all(F.col("w"), lengths, _text))).alias("shingle"))
    shared = own.join(fit(items.select("item_id", "shingle")), "shingle").groupBy("doc_id", "text_key", "item_id").agg(F.count("*").alias("n_shared"))
    key = [F.col("a.text_key") == F.col("b.text_key"), F.col("a.item_id") == F.col("b.item_id"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))]
    shared = shared.alias("a").join(found.alias("b"), key, "left_semi")
    counted = shared.join(fit(sizes), "item_id").where(F.col("n_shared") * 100 >= F.col("n_shingles") * threshold_percent)
    return counted.select("doc_id", "text_key", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; columns stay as they are, null texts are kept."""
    found = contained_items(docs, benchmark, **how).select(F.col("text_key").alias("_loam_key")).distinct()
    return docs.join(found, F.xxhash64(docs["text"].cast("string")) == found["_loam_key"], "left_anti")


ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
items AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS shingle
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
dw AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM items),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN items USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""
