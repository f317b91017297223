"""SimHash near-duplicates: fingerprints of word shingles, linked through sharded BK-trees.

Two fingerprints that differ in at most three of 64 bits agree in at least one of four 16-bit
quarters, so each fingerprint goes to four shards, one for each quarter's value, and every link is
found in a shard of its own. A task builds the BK-trees of the shards that it holds and searches them;
trees are never broadcast, since they grow with the data. Only links to the least member of what a shard
connects leave the task: at most one for each fingerprint and shard.

A contract of similarity needs another search. Texts with a Jaccard similarity of 0.8 lie about 10 of 64 bits
apart, with a spread of 3, so a radius that covers them leaves shards of three bits, which is all pairs. ``similar``
takes fingerprints of five-word shingles within the radius, adds what bands of MinHash values find farther apart, and checks
candidates by the shingles themselves. A link to the least member of what a shard connects is a candidate like any other and may
fail the check, so what the first links leave apart is searched again, for every candidate pair between two of its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, buffer, mix, span_hashes, spans
from .bktree import Forest, merge
from .common import discard, materialize, partitions, slices, utf8

QUARTERS, BITS = 4, 16
#: Entries of one shard's tree; a larger shard is split into several trees that each of its queries visits.
TREE_LIMIT = 50_000
#: What a row is in its tree: one to search for, one that is found, or both.
QUERY, ENTRY = 1, 2
#: Rows whose trees a task builds at a time.
HELD = 400_000
#: Bands of MinHash values, and how many of them a band's key has.
BANDS, KEY = 16, 4
#: Members of a band's group that are compared with each other at once; in a larger one each is compared with one member first,
#: and then with those that are still in another component.
PAIRED = 32
#: Members of a part of a large group; every two parts meet in a task.
BLOCK = 2048
#: 64-bit words of a set's parity bits.
PARITY = 16
_STEP = 0xD6E8FEB86659FD93


def simhash(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number; zero without a word."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (hash of the text), fingerprint (bigint holding the 64 bits) of every row of ``docs``.

    Null and wordless texts have fingerprint 0. Rows are kept as they are: a repeated doc_id gives
    repeated rows; a null doc_id stays null. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([simhash(t, words) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(prints)], names=["doc_id", "text_key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def shard_links(distinct: DataFrame, radius: int = 3, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """a, b: links between distinct fingerprints that connect just what lies within ``radius``.

    ``distinct`` has one column, fingerprint. Shards over ``tree_limit`` entries are split. Where it also has label and mixed, the links
    are all pairs within ``radius`` but those of one label, which mixed entries have none of; a pair may be repeated.
    """
    more = [c for c in ("label", "mixed") if c in distinct.columns]
    if not 0 <= radius < QUARTERS:
        raise ValueError(f"radius must be below {QUARTERS}, or links would share no quarter")
    quarter = F.explode(
        F.array(*[F.shiftrightunsigned("fingerprint", BITS * q).bitwiseAND(2**BITS - 1) + q * 2**BITS for q in range(QUARTERS)])
    )
    entries = distinct.select("fingerprint", *more, quarter.alias("shard"))
    hot = entries.groupBy("shard").count().where(F.col("count") > tree_limit)
    hot = hot.select("shard", F.ceil(F.col("count") / tree_limit).cast("int").alias("trees"))
    trees = F.coalesce("trees", F.lit(1))
    # A hot shard has several trees and as many parts of queries, every tree and part a unit of its own: an entry
    # goes to its tree's units, a query to its part's.
    own, part = (F.pmod(F.xxhash64(F.lit(k), "fingerprint"), trees).cast("int") for k in (0, 1))
    every = F.sequence(F.lit(0), trees - 1)

    def unit(tree: Column, queries: Column, role: int) -> Column:
        return F.struct(tree.alias("tree"), queries.alias("part"), F.lit(role).alias("role"))

    units = F.concat(F.transform(every, lambda t: unit(t, part, QUERY)), F.transform(every, lambda q: unit(own, q, ENTRY)))
    units = F.when(trees == 1, F.array(unit(own, part, QUERY + ENTRY))).otherwise(units)
    visits = entries.join(hot, "shard", "left").select("fingerprint", *more, "shard", F.explode(units).alias("u"))
    # 18 bits of shard, 22 each of tree and part: 2**22 trees of 50,000 are more fingerprints than a shard can have.
    unit_number = F.shiftleft(F.col("shard").cast("long"), 44) + F.shiftleft(F.col("u.tree").cast("long"), 22) + F.col("u.part")
    visits = visits.select("fingerprint", *more, unit_number.alias("unit"), F.col("u.role").alias("role"))

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints = rows["fingerprint"].to_numpy().view(np.uint64)
        unit, role = rows["unit"].to_numpy(), rows["role"].to_numpy()
        values, number = np.unique(prints, return_inverse=True)
        place, asked = np.flatnonzero(role & ENTRY), np.flatnonzero(role & QUERY)
        forest = Forest(prints[place], unit[place])
        if more:
            own, mixed = rows["label"].to_numpy(), rows["mixed"].to_numpy()
            for query, found in forest.within(prints[asked], unit[asked], radius):
                a, b = asked[query], place[found]
                apart = (prints[a] < prints[b]) & (mixed[a] | mixed[b] | (own[a] != own[b]))
                yield pa.record_batch([pa.array(prints[x[apart]].view(np.int64)) for x in (a, b)], names=["a", "b"])
            return
        label = np.arange(len(values))
        for query, found in forest.within(prints[asked], unit[asked], radius):
            merge(label, number[asked[query]], number[place[found]])
        linked = np.flatnonzero(label != np.arange(len(values)))
        signed = values.view(np.int64)
        yield pa.record_batch([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole units at a time, about HELD rows of them."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                table = pa.Table.from_batches(held)
                last = int(np.searchsorted(table["unit"].to_numpy(), table["unit"][-1].as_py()))
                if last:
                    yield from search(table.slice(0, last))
                held = table.slice(last).to_batches()
                rows -= last
        if rows:
            yield from search(pa.Table.from_batches(held))

    parts = partitions(distinct.sparkSession)
    return visits.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label of every node in ``links`` (a, b): the least node that it is connected to.

    Every round takes the least label among the neighbours, then the label of that label, so that
    long chains shorten quickly. Rounds end when no label changes; each round's labels are a table in
    the shared folder, so a lost executor costs one round at most.
    """
    both = materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    labels = materialize(both.select("node").distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        near = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").withColumn("least", F.least("label", "near"))
        jump = labels.toDF("least", "jump")
        step = step.join(jump, "least").select("node", F.least("least", "jump").alias("new"), F.col("label").alias("old"))
        step = materialize(step, "labels")
        changed = step.where("new != old").limit(1).count()
        discard(labels)
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_copies for every row of ``docs``.

    component_id is the least doc_id reachable over links of at most ``radius`` differing bits, the
    row's own included. Null doc_ids don't name a component; a component of such rows alone has null.
    An empty table gives an empty result. Ties do not occur: the least id is unique.
    n_copies counts the rows with the same fingerprint.
    """
    return _near_duplicates(docs, words, radius, tree_limit).drop("text_key")


def _near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """``near_duplicates`` with the text_key of every row."""
    prints = materialize(fingerprints(docs, words), "prints")
    groups = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "groups")
    labels = components(shard_links(groups.select("fingerprint"), radius, tree_limit))
    named = groups.join(labels.toDF("fingerprint", "label"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("fingerprint", "component_id", "n_copies")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select("doc_id", "text_key", hexed.alias("fingerprint"), "component_id", "n_copies")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates: of each component the row of its least doc_id.

    Columns stay as they are. Rows with a null doc_id are kept. A row is dropped for its own text only, also where its
    doc_id is repeated; rows that repeat both are one document and stay or go together. An empty table gives an empty result.
    """
    return _kept(docs, _near_duplicates(docs, **how))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    drop = found.where("doc_id != component_id").select(F.col("doc_id").alias("_loam_drop"), F.col("text_key").alias("_loam_key")).distinct()
    return docs.join(drop, (docs["doc_id"] == drop["_loam_drop"]) & (F.xxhash64(docs["text"].cast("string")) == drop["_loam_key"]), "left_anti")


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``words``-word shingles of each text, end to end, and where each text's begin, with the end.

    A text of fewer words is one shingle; a wordless one has none.
    """
    flat, offsets = buffer(column)
    flat = LOWER[flat]
    starts, ends, counts = spans(flat, offsets)
    hashes = span_hashes(flat, starts, ends)
    first = np.r_[0, np.cumsum(counts)]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(starts)) - first[text]
    head = np.flatnonzero((at + words <= counts[text]) | (at == 0))
    total = np.zeros(len(head), np.uint64)
    for k in range(words):
        there = np.flatnonzero(at[head] + k < counts[text[head]])
        total[there] += hashes[head[there] + k] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    keys, owner = mix(total + np.minimum(counts[text[head]], words).astype(np.uint64)), text[head]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (hash of the text), set_key (hash of the shingle set), size, the bands' keys and the set's parity bits.

    A shingle flips one of the bits, so two sets differ in as many shingles as bits at least.
    """
    odd = (np.random.default_rng(42).integers(0, 1 << 63, BANDS * KEY).astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel().view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            keys, edges = shingles(batch.column("text"), words)
            size = np.diff(edges)
            full = np.flatnonzero(size)
            whole = np.zeros(len(size), np.uint64)
            bands, bits = np.zeros((len(size), BANDS), np.uint64), np.zeros((len(size), PARITY), np.uint64)
            if len(full):
                whole[full] = np.add.reduceat(mix(keys ^ np.uint64(_STEP)), edges[full])
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(KEY):
                        key = mix(key + np.minimum.reduceat(keys * odd[b * KEY + k], edges[full]))
                    bands[full, b] = key
                place = keys % np.uint64(64 * PARITY)
                np.bitwise_xor.at(bits, (np.repeat(np.arange(len(size)), size), (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(mix(whole + size.astype(np.uint64)).view(np.int64)), pa.array(size.astype(np.int32)), lists(bands), lists(bits)]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "set_key", "size", "bands", "bits"])

    return docs.mapInArrow(run, "doc_id long, text_key long, set_key long, size int, bands array<long>, bits array<long>")


def in_bands(sets: DataFrame) -> DataFrame:
    """band, set_key, size, n, head of ``sets`` (set_key, size, bands): the groups of two or more that share a band's key, their number and one of them."""
    rows = materialize(sets.select("set_key", "size", F.explode("bands").alias("band")), "bands")
    head = F.min(F.struct(F.xxhash64("set_key", "band").alias("rank"), "set_key", "size")).alias("head")
    groups = rows.groupBy("band").agg(F.count("*").alias("n"), head).where("n > 1")
    return materialize(rows.join(groups.hint("merge"), "band"), "band-groups")


def candidates(banded: DataFrame) -> DataFrame:
    """a, b, size, b_size, of ``banded`` (see ``in_bands``): all pairs of groups of PAIRED, of larger ones each set with the head."""
    own = banded.where(F.col("n") <= PAIRED).select("band", "set_key", "size")
    pairs = own.join(own.toDF("band", "b", "b_size"), "band").where("set_key < b").select(F.col("set_key").alias("a"), "b", "size", "b_size")
    star = banded.where(F.col("n") > PAIRED).select(F.col("set_key").alias("a"), F.col("head.set_key").alias("b"), "size", F.col("head.size").alias("b_size"))
    return pairs.union(star).where("a != b")


def apart_in_bands(banded: DataFrame, bits: DataFrame, labels: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """a, b: pairs of groups over PAIRED (see ``in_bands``) that have two labels and may be similar by their parity bits.

    ``bits`` and ``labels`` have set_key and bits, set_key and label. Parts of a group meet in tasks of their own. ``nearest`` leaves one pair of each set and task.
    """

    def run(rows: pa.Table) -> pa.Table:
        key, size, label, own = (rows[c].to_numpy() for c in ("set_key", "size", "label", "own"))
        parity = rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY)
        left, right = np.flatnonzero(own == rows["low"].to_numpy()), np.flatnonzero(own == rows["high"].to_numpy())
        out = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 32):
            some = left[at : at + 32]
            differ = np.bitwise_count(parity[some][:, None] ^ parity[right]).sum(axis=2, dtype=np.int64)
            x, y = size[some][:, None].astype(np.int64), size[right].astype(np.int64)
            # Of two similar sets at most this share of all shingles is in one of them only.
            may = ((100 + percent) * differ <= (100 - percent) * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (label[some][:, None] != label[right])
            if nearest and len(right):
                share = np.where(may, differ / (x + y), 2.0)
                may &= np.arange(len(right)) == share.argmin(axis=1)[:, None]
            a, b = np.nonzero(may)
            out.append(np.stack([key[some[a]], key[right[b]]]))
        found = np.concatenate(out, axis=1)
        found = np.unique(np.sort(found, axis=0), axis=1)
        return pa.table([found[0], found[1]], names=["a", "b"])

    large = banded.where(F.col("n") > PAIRED).select("band", "set_key", "size", "n").join(labels, "set_key")
    mixed = large.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("band")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    large = large.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64("set_key"), parts).cast("int")).join(bits, "set_key")
    met = large.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set_key", "size", "label", "bits")
    return met.groupBy("band", "low", "high").applyInArrow(run, "a long, b long")


def fingerprint_candidates(own: DataFrame, heads: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, size, b_size of ``own`` (set_key, size, fingerprint): sets of one fingerprint with its head, and the heads of linked fingerprints."""
    equal = own.join(heads, "fingerprint").select(F.col("set_key").alias("a"), F.col("head.set_key").alias("b"), "size", F.col("head.size").alias("b_size"))
    near = links.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return equal.union(near.select(F.col("x.set_key"), F.col("y.set_key"), F.col("x.size"), F.col("y.size"))).where("a != b")


def apart_by_fingerprint(own: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b of ``own`` (set_key, size, fingerprint): all pairs of two labels whose fingerprints lie within the radius, and which may be similar in size.

    ``links`` (a, b) connects what lies within the radius: only fingerprints that it names are searched.
    """
    own = materialize(own.join(labels, "set_key"), "labelled-prints")
    prints = own.groupBy("fingerprint").agg(F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("mixed"))
    linked = links.select(F.explode(F.array("a", "b")).alias("fingerprint")).distinct()
    near = shard_links(prints.join(linked, "fingerprint", "left_semi")).distinct()
    near = materialize(near.union(prints.where("mixed").select("fingerprint", "fingerprint")), "apart-prints")
    x, y = own.toDF("a_key", "a_size", "a", "a_label"), own.toDF("b_key", "b_size", "b", "b_label")
    pairs = near.join(x, "a").join(y, "b").where("a_label != b_label").where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
    return pairs.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (hash of the text), component_id of every row of ``docs``: the least doc_id reachable over texts that are similar.

    Similar are texts whose sets of ``words``-word shingles, A-Z lowered, have a Jaccard similarity of ``percent``
    or more. Candidates are pairs whose fingerprints lie within the radius or that share a band; a pair at just 0.8 shares a band with
    a probability over 0.999. Every link is checked by the hashes of all shingles, and only candidates that
    other links connect already are not checked: in large groups each text is compared with one other first, then with the
    nearest that is still apart, then with all that are. Wordless texts are similar to each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    drawn = materialize(sketches(rows, words), "sketches")
    sets = drawn.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("text_key").alias("text_key"))
    sets = materialize(sets, "sets")
    worded = sets.where("size > 0")
    banded = in_bands(worded.select("set_key", "size", "bands"))
    prints = fingerprints(rows.select("doc_id", "text"), words).select("text_key", "fingerprint").distinct()
    own = materialize(worded.join(prints, "text_key").select("set_key", "size", "fingerprint"), "set-prints")
    heads = materialize(own.groupBy("fingerprint").agg(F.min(F.struct("set_key", "size")).alias("head")), "print-heads")
    near_prints = materialize(shard_links(heads.select("fingerprint")).distinct(), "print-links")
    found = fingerprint_candidates(own, heads, near_prints).union(candidates(banded))
    near = 100 * F.least("size", "b_size") >= percent * F.greatest("size", "b_size")
    tried = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), near.alias("near")).distinct(), "pairs")
    # Sets that no pair names, of whatever size, have no candidate at all.
    used = tried.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    wanted = sets.join(used, "set_key", "left_semi").select("set_key", "text_key")
    texts = rows.join(wanted, "text_key").dropDuplicates(["set_key"]).select("set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            keys, edges = shingles(batch.column("text"), words)
            yield pa.record_batch([batch.column("set_key"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.view(np.int64)))], names=["set_key", "grams"])

    grams = materialize(texts.mapInArrow(run, "set_key long, grams array<long>"), "grams")

    def checked(pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) that are similar."""
        # One text may be in many pairs: these joins are left to the skew handling of sort-merge joins.
        half = materialize(pairs.join(grams.toDF("a", "a_grams").hint("merge"), "a"), "half-pairs")
        both = half.join(grams.toDF("b", "b_grams").hint("merge"), "b").withColumn("shared", F.size(F.array_intersect("a_grams", "b_grams")))
        found = materialize(both.where(100 * F.col("shared") >= percent * (F.size("a_grams") + F.size("b_grams") - F.col("shared"))).select("a", "b"), "similar")
        discard(half)
        return found

    def named(links: DataFrame) -> DataFrame:
        labels = components(links)
        labels = sets.select("set_key").join(labels.toDF("set_key", "label"), "set_key", "left")
        return materialize(labels.select("set_key", F.coalesce("label", "set_key").alias("label")), "set-labels")

    links = checked(tried.where("near").select("a", "b"))
    labels = named(links)
    tried = tried.where("near").select("a", "b")
    bits = drawn.select("set_key", "bits").join(used, "set_key", "left_semi").dropDuplicates(["set_key"])
    for nearest in (True, False):
        pairs = apart_in_bands(banded, bits, labels, percent, nearest)
        if not nearest:
            pairs = pairs.union(apart_by_fingerprint(own, near_prints, labels, percent))
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "apart")
        if pairs.limit(1).count():
            tried, links = tried.union(pairs), links.union(checked(pairs))
            labels = named(links)
    least = sets.select("set_key", "least").join(labels, "set_key")
    least = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("set_key", "component_id")
    return drawn.select("doc_id", "text_key", "set_key").join(least, "set_key").select("doc_id", "text_key", "component_id")


def keep_one_similar(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those that ``similar`` puts behind another; see ``keep_one``."""
    return _kept(docs, similar(docs, **how))
