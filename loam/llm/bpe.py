"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, decoding looks tokens up.

Texts are split into pre-tokens with their positions, block by block (``blocks``). A block's distinct pre-tokens go by
word to the task that encodes the word, once for the whole corpus, and their ids return to the block, which joins
them to the positions and so puts each text's ids in order. Texts are neither moved nor split again: what moves is
the positions and, twice, the distinct words of each block. Words are told apart by their bytes everywhere. No vocabulary
of the corpus is held in one place; only the rank file, which is fixed, is broadcast. Decoding joins ids with the
token-byte table of that file on the map side.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import distinct
from .blocks import BLOCK_BYTES, blocks, flat_lists, pack, positions_of, take_runs, unpack
from .common import partitions
from .pretokens import pretokens

#: Words whose ids a task keeps at hand; beyond it a word that comes again is encoded again.
KEPT_WORDS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the pair of least rank, the leftmost of equal ones, until no pair has a rank.

    A heap of candidate pairs and links between the neighbours keep long words at n log n.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    found, i = [], 0
    while i < n:
        found.append(ranks[word[i : end[i]]])
        i = end[i]
    return found


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> of every row of ``docs`` (doc_id, text); with ``decoded``, also what the ids decode to.

    Null and empty texts have no ids. Repeated rows and doc_ids give repeated rows, a null doc_id stays
    null, an empty table gives an empty result; other columns are ignored. Every match of ``pattern`` is
    encoded separately; there are no special tokens, their strings are ordinary text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    back = spark.sparkContext.broadcast(TokenBytes(shared.value)) if decoded else None
    parts = partitions(spark)

    def split(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        flat, starts, ends, counts = pretokens(texts, pattern)
        numbers, words = distinct(flat, starts, ends)
        return numbers, words.to_pylist(), counts

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, {}
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("owner")))
            out = []
            for bundle in batch.column("packed").to_pylist():
                words, (numbers,) = unpack(bundle)
                if len(seen) > KEPT_WORDS:
                    seen.clear()
                for word in words:
                    if word not in seen:
                        seen[word] = encode_word(word, ranks)
                out.append(pack([], numbers, *flat_lists([seen[word] for word in words])))
            yield pa.record_batch([batch.column("owner"), pa.array(out, pa.binary())], names=["block", "packed"])

    def place(positions: pa.Table, words: pa.Table) -> pa.Table:
        own = positions.filter(pc.is_null(positions["owner"]))["packed"]
        if not len(own):  # a bucket's words, which are on their way
            return nothing
        ids, known, counts, numbers = positions_of(own[0].as_py())
        pieces = [unpack(p.as_py())[1] for p in words["packed"]]
        size = np.zeros(sum(len(n) for n, *_ in pieces), np.int64)
        first, flat, start = np.zeros_like(size), np.zeros(sum(len(x) for *_, x in pieces), np.int32), 0
        for own, sizes, tokens in pieces:
            size[own], first[own] = sizes, start + np.cumsum(sizes) - sizes
            flat[start : start + len(tokens)] = tokens
            start += len(tokens)
        if len(numbers) and numbers.max() >= len(size):
            raise RuntimeError("a block's words are not those of its positions: its rows differed between two runs of a task")
        every = take_runs(flat, first[numbers], size[numbers])
        stops = np.r_[0, np.cumsum(size[numbers])][np.r_[0, np.cumsum(counts)]]
        columns = {"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "ids": pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(every, pa.int32()))}
        if back:
            columns["decoded"] = pa.array(back.value(every, np.diff(stops)), pa.binary())
        return pa.table(columns)

    kinds = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
    nothing = pa.schema(kinds[: 2 + decoded]).empty_table()
    # Positions stay in this exchange; its other rows, the words, are read from it once more to be encoded.
    dealt = blocks(docs, split, block_bytes).repartition(parts, "block")
    words = dealt.mapInArrow(once, "block long, packed binary").repartition(parts, "block")
    return dealt.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(place, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


class TokenBytes:
    """The token-byte table: the bytes of all tokens end to end, and their lengths by id."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted((rank, token) for token, rank in ranks.items())
        self.size = np.zeros(tokens[-1][0] + 1, np.int64)
        self.size[[rank for rank, _ in tokens]] = [len(token) for _, token in tokens]
        self.joined = b"".join(token for _, token in tokens)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text; ``ids`` of all of them, ``counts`` of each."""
        if len(ids) and not (ids.max() < len(self.size) and ids.min() >= 0 and (self.size[ids] > 0).all()):
            raise ValueError("an id is not in the token table")
        edges, out = np.r_[0, np.cumsum(counts)], []
        first, flat = np.cumsum(self.size) - self.size, np.frombuffer(self.joined, np.uint8)
        for a in range(0, len(counts), 64):  # some texts at a time: the index takes eight times their size
            b = min(a + 64, len(counts))
            own = ids[edges[a] : edges[b]]
            ends = np.cumsum(self.size[own])
            text = take_runs(flat, first[own], self.size[own]).tobytes()
            stops = np.r_[0, ends][edges[a : b + 1] - edges[a]].tolist()
            out += [text[x:y] for x, y in zip(stops[:-1], stops[1:], strict=True)]
        return out


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` binary: the bytes of its ``ids`` by the token-byte table.

    The table has a row for each token of the rank file, so it's broadcast; null ids decode to nothing,
    an unknown id is an error. Rows and the other columns stay as they are.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(TokenBytes(read_ranks(ranks_path)))
    schema = encoded.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([*batch.columns, pa.array(shared.value(ids, counts), pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, through ``encode`` and its way back."""
    return encode(docs, ranks_path, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
