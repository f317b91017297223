"""Texts in blocks of bounded size, each split into numbered tokens, and the compressed bundles in which they move.

A block is what a task holds at a time. It lists its distinct tokens, which are told apart by their bytes
and go by token to one bucket for the whole corpus, and the number of the token at every position, from which
the texts can be put together again. The texts themselves stay where they are. A block is named by what it holds,
so that a task that is repeated over rows in another order can't mix up its blocks with those of the first run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices, utf8

BLOCK_BYTES = 12 << 20


def pack(parts: list[bytes], *numbers: np.ndarray) -> bytes:
    """Parts and integer arrays as one compressed value."""
    arrays = [np.array([len(x) for x in parts], "<i8"), *(np.asarray(x, "<i8") for x in numbers)]
    head = np.array([len(arrays), *map(len, arrays)], "<i8")
    return zstandard.compress(b"".join([head.tobytes(), *(x.tobytes() for x in arrays), *parts]), 3)


def unpack(packed: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.decompress(packed)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", count, 8)
    cuts = 8 * (1 + count + np.r_[0, np.cumsum(sizes)])
    arrays = [np.frombuffer(raw, "<i8", n, at) for n, at in zip(sizes, cuts[:-1], strict=True)]
    stops = (cuts[-1] + np.r_[0, np.cumsum(arrays[0])]).tolist()
    return [raw[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], arrays[1:]


def few(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in runs of about ``limit`` bytes, for work whose arrays take many times a text's size."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield texts[start:]


#: Numbers of the tokens of some texts end to end, the tokens by number, and how many tokens each text has.
Split = Callable[[list[bytes]], tuple[np.ndarray, list[bytes], np.ndarray]]


#: Which texts' tokens are counted, of the texts' ids and whether these are known.
Counted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def positions_of(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: doc_ids, whether these are not null, the texts' numbers of tokens, and the tokens' numbers."""
    (planes,), (ids, known, counts) = unpack(packed)
    return ids, known, counts, np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


SCHEMA = "block long, owner long, packed binary"


def blocks(docs: DataFrame, split: Split, block_bytes: int = BLOCK_BYTES, counted: Counted | None = None, by_hash: bool = False) -> DataFrame:
    """block, owner, packed: the tokens of every row of ``docs`` (doc_id, text).

    Where owner is null, ``positions_of(packed)`` is what block (a negative number) holds. The other rows have the distinct tokens of the block
    ``owner`` that belong to a bucket, whose number is in block: ``pack(tokens, numbers)``. With ``counted`` there is one bucket,
    and also how often each token occurs in such texts. Null texts are empty. Blocks are cut from each partition as it comes, or, ``by_hash``,
    dealt by the hash of doc_id and text and sorted, so that they depend on the rows alone.
    """
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def bundle(place: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        numbers, counts, name = [], [], xxhash.xxh3_64(b"%d %d" % (place, len(texts)))
        for some in few(texts):
            own, tokens, sizes = split(some)
            whole = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, len(tokens))
            numbers.append(whole[own])
            counts.append(sizes)
        for i, text in zip(ids, texts, strict=True):
            name.update(b"%d %d " % (i or 0, len(text)))
            name.update(text)
        block = -(name.intdigest() >> 1) - 1
        known, named = np.array([i is not None for i in ids], np.int64), np.array([i or 0 for i in ids], np.int64)
        sizes, every = np.concatenate(counts), np.concatenate(numbers)
        # Frequent tokens have low numbers, and bytes of one rank stand together: that packs best.
        rank = np.empty(len(seen), np.int64)
        rank[np.argsort(-np.bincount(every, minlength=len(seen)), kind="stable")] = np.arange(len(seen))
        every = rank[every]
        planes = every.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        used = np.bincount(every[np.repeat(counted(named, known), sizes)], minlength=len(seen)) if counted else None
        dealt: dict[int, list[tuple[bytes, int]]] = {}
        if counted:  # counts are summed by token, in rows
            dealt[0] = list(zip(seen, rank.tolist(), strict=True))
        else:
            for token, number in sorted(zip(seen, rank.tolist(), strict=True)):
                dealt.setdefault(zlib.crc32(token) % parts, []).append((token, number))
        bundles = [pack([planes], named, known, sizes)]
        for own in dealt.values():
            at = np.array([n for _, n in own], np.int64)
            bundles.append(pack([t for t, _ in own], at, *([] if used is None else [used[at]])))
        owners = pa.array([None] + [block] * len(dealt), pa.int64())
        yield pa.record_batch([pa.array([block, *dealt], pa.int64()), owners, pa.array(bundles, pa.binary())], names=["block", "owner", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches, "text", block_bytes):
            own = utf8(batch.column("text"))
            size = sum(map(len, own))
            if held and held + size > block_bytes:
                yield from bundle(place, ids, texts)
                place, ids, texts, held = place + 1, [], [], 0
            ids, texts, held = ids + batch.column("doc_id").to_pylist(), texts + own, held + size
        if texts:
            yield from bundle(place, ids, texts)

    if not by_hash:
        return rows.mapInArrow(run, SCHEMA)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-total // block_bytes) or 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts move compressed, those of a slice that go to one block together."""
        for batch in slices(batches, "text", 8 << 20):
            place, ids, texts = batch.column("place").to_numpy(), batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])
            found = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            own = [pack([texts[i] for i in at], [ids[i] or 0 for i in at], [ids[i] is not None for i in at]) for at in found]
            yield pa.record_batch([pa.array([int(place[at[0]]) for at in found], pa.int64()), pa.array(own, pa.binary())], names=["place", "packed"])

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        both = []
        for value in group["packed"]:
            texts, (ids, known) = unpack(value.as_py())
            both += zip([i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], texts, strict=True)
        both.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return pa.Table.from_batches(list(bundle(key[0].as_py(), [i for i, _ in both], [t for _, t in both])))

    return rows.mapInArrow(deal, "place long, packed binary").groupBy("place").applyInArrow(whole, SCHEMA)


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the lists, and the lists end to end."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def take_runs(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[first[i] : first[i] + size[i]]`` of all i, end to end."""
    done = np.cumsum(size)
    return flat[np.repeat(first - (done - size), size) + np.arange(int(size.sum()))]
