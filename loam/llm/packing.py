"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by sums of squares.

Documents are tokenised where they lie; those that are too long are cut. Only the pieces' lengths and numbers move. Pieces
of full length are sequences of their own. The others are dealt at random into shards of a bounded number of pieces, and
each shard places its pieces, longest first: of the open sequences with room, into one from which the sum, over all residual gaps, of the
squared number of open sequences with that gap becomes smallest; a sequence is opened where none has room. What a shard leaves
loosely filled is taken apart and packed again with that of other shards, in ever fewer shards, until one shard holds all of it or it no longer shrinks.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrays import distinct
from .blocks import take_runs
from .common import materialize, slices, utf8
from .pretokens import COMMON, LETTER, NUMBER, OTHER, SPACE, _kinds, pretokens

CAPACITY = 1024
#: Pieces that one task packs at a time, about.
SHARD = 1 << 14
#: A sequence with a larger share of its capacity left is packed again with those of other shards.
LOOSE = 1 / 64
#: Words whose ids a Python worker keeps at hand.
KEPT_WORDS = 400_000


@lru_cache(1)
def _unsettled() -> np.ndarray:
    """Code points whose class (letter, number, space) is younger than Unicode 3.2, or has changed: libraries differ there."""
    old = unicodedata.ucd_3_2_0.category
    kinds, first = _kinds(), {"L": LETTER, "N": NUMBER, "Z": SPACE}
    named = np.flatnonzero(kinds != OTHER)
    same = [first.get(old(chr(c))[0], SPACE if c < 256 else OTHER) == kinds[c] for c in named.tolist()]
    found = np.zeros(len(kinds), bool)
    found[named] = ~np.array(same)
    return found


class Encoder:
    """The ids of many texts at once, as ``encode(text, add_special_tokens=False)`` of the tokenizer in ``source`` (JSON) gives them.

    Where the tokenizer is a plain byte-level BPE, each distinct pre-token is given to its model once, in place of every text. Texts with
    one of its added tokens, or with a character that libraries may class differently, go through the tokenizer whole.
    """

    def __init__(self, source: str):
        said = json.loads(source)
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        plain_split = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain_model = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.plain = plain_split and plain_model and not said.get("normalizer") and not said.get("truncation") and not said.get("padding")
        self.added = [t["content"].encode() for t in said.get("added_tokens", [])]
        # Byte-level BPE writes every byte as a printable character: those that are printable as they are, the others from 256 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.words: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        if (found := self.words.get(word)) is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            found = self.words[word] = np.array([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))], "<u4").tobytes()
        return found

    def _odd(self, texts: list[bytes]) -> np.ndarray:
        odd = np.array([any(a in t for a in self.added) for t in texts], bool)
        joined = b"".join(texts)
        if not joined.isascii():
            marks = _unsettled()
            if marks[np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")].any():
                odd |= [not t.isascii() and bool(marks[np.frombuffer(t.decode().encode("utf-32-le"), "<u4")].any()) for t in texts]
        return odd

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text, as little-endian unsigned 32-bit integers."""
        odd = self._odd(texts) if self.plain else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4")
        usual = np.flatnonzero(~odd).tolist()
        flat, starts, ends, counts = pretokens([texts[i] for i in usual], COMMON)
        if len(starts):
            numbers, words = distinct(flat, starts, ends)
            known = [self._word(w) for w in words.to_pylist()]
            size = np.fromiter(map(len, known), np.int64, len(known)) // 4
            every = take_runs(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(size) - size)[numbers], size[numbers])
            stops = np.r_[0, np.cumsum(size[numbers])][np.r_[0, np.cumsum(counts)]].tolist()
            for i, a, b in zip(usual, stops[:-1], stops[1:], strict=True):
                out[i] = every[a:b]
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(source: str) -> Encoder:
    """The encoder of a Python worker, which stays with its words from task to task."""
    key = zlib.crc32(source.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(source)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer_path: str, end: int, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ``ids`` the ids) of every piece of ``docs`` (doc_id, text).

    A document is its ids, then ``end``. One that is longer than ``capacity`` is cut so that all pieces but the first are full. Null and
    empty texts are ``end`` alone. Repeated rows give repeated pieces, a null doc_id stays null, an empty table gives no pieces; other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())  # the tokenizer's file, of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(source.value), np.array([end], "<u4")
        for batch in slices(batches, "text", 2 << 20):
            own, columns = batch.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for doc_id, found in zip(own, encoder(utf8(batch.column("text"))), strict=True):
                found = np.r_[found, last].astype("<u4")
                first = len(found) % capacity or capacity
                cuts = [0, *range(first, len(found) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = found[a:b]
                    for column, v in zip(columns, (doc_id, k, a, b - a, zlib.crc32(part.tobytes()), part), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            if ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            yield pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def placed(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, and the final gap of each sequence; the lengths are in the order in which they are placed.

    A length goes to an open sequence with room whose choice leaves the least sum of squared counts of open sequences by gap (the
    least gap of equals, the sequence that had it last); a full sequence is not open.
    """
    count = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    own, offset, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, size in enumerate(lengths):
        left = np.flatnonzero(count[size:])  # the gaps that open sequences with room would be left with
        if len(left):
            rise = 2 * count[left] + 1
            rise[left == 0] = 0
            rest = int(left[np.argmin(rise - 2 * count[left + size] + 1)])
            at = waiting[rest + size].pop()
            count[rest + size] -= 1
        else:
            at, rest = len(gaps), capacity - size
            gaps.append(rest)
        own[i], offset[i], gaps[at] = at, capacity - rest - size, rest
        if rest:
            waiting[rest].append(at)
            count[rest] += 1
    return own, offset, np.array(gaps, np.int64)


def _filler(base: int, capacity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs one shard; its sequences have odd numbers that begin with the shard's, counted from ``base``."""

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns(["shard"]).sort_by([("length", "descending"), ("at", "ascending")])
        own, offset, gaps = placed(table["length"].to_pylist(), capacity)
        for name, values in (("sequence_id", (((base + key[0].as_py()) << 32) + own) * 2 + 1), ("offset", offset), ("gap", gaps[own])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return fill


def packed(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``rows`` (with length, from 1 to ``capacity``) with sequence_id and offset: every row once, no sequence over capacity, no gaps before its rows.

    Rows that are equal are packed one by one; an empty table gives an empty result. The columns move along, so they should be few
    and small (``sequences`` adds the ids afterwards).
    """
    kept = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "packing-pieces")
    full = kept.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("at") * 2, "offset": F.lit(0).cast("long")})
    rest, base, done = kept.where(F.col("length") < capacity), 0, [full.drop("at")]
    shards = -(-rest.count() // shard)
    schema = kept.withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "gap")}).schema
    while shards:
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)))
        out = materialize(dealt.groupBy("shard").applyInArrow(_filler(base, capacity), schema), "packing-shards")
        loose = out.where(F.col("gap") > int(capacity * LOOSE)).drop("sequence_id", "offset", "gap")
        fewer = -(-loose.count() // shard) if shards > 1 else 0
        again = 0 < fewer <= shards // 2
        done.append((out.where(F.col("gap") <= int(capacity * LOOSE)) if again else out).drop("at", "gap"))
        rest, base, shards = loose, base + shards, fewer if again else 0
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def sequences(docs: DataFrame, tokenizer_path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """The sequences as training reads them: sequence_id, ids, and parts in order (doc_id, piece, start, offset, length).

    Everything as in ``pieces`` and ``packed``; a sequence has ``capacity`` ids at most, so no group is large.
    """
    whole = materialize(pieces(docs, tokenizer_path, end, capacity, ids=True).withColumn("number", F.monotonically_increasing_id()), "packing-ids")
    found = packed(whole.drop("ids", "ids_crc32"), capacity).join(whole.select("number", "ids"), "number")
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    grouped = found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
