import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import packing, queries

PATH, END = public_tokenizers.path("byte_bpe_50k.json"), 2


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected_pieces(rows, tokenizer, capacity=1024):
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            yield (r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))


def check(rows, docs, tokenizer):
    """Every piece once with its ids, and every sequence filled from 0 without gaps, up to the capacity."""
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, expected_pieces(docs.collect(), tokenizer)))
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(found)


def best_fit_decreasing(lengths, capacity=1024):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_query(spark, sf, docs, tokenizer):
    rows = queries.op13_best_fit_packing(spark, sf).collect()
    n = check(rows, docs, tokenizer)
    assert n <= max(best_fit_decreasing([r.length for r in rows]), -(-sum(r.length for r in rows) // 1024)) + 1


def test_shards(spark, docs):
    """Many small shards lose little: what they leave loose is packed again."""
    rows = packing.packed(packing.pieces(docs.limit(200), PATH, END), shard=40).collect()
    used, least = len({r.sequence_id for r in rows}), -(-sum(r.length for r in rows) // 1024)
    assert used <= 1.05 * least + 1


def test_sums_of_squares():
    """Each choice is the one that plain counting of all choices finds."""
    draw = random.Random(5)
    lengths = [draw.randrange(1, 40) for _ in range(400)]
    own, offset, gaps = packing.placed(lengths, 40)
    fill: list[int] = []
    for size, at, start in zip(lengths, own, offset, strict=True):
        def squares(i):
            left = [40 - f - (size if j == i else 0) for j, f in enumerate(fill)]
            return sum(left.count(g) ** 2 for g in set(left) if g)

        room = [i for i, f in enumerate(fill) if f + size <= 40]
        assert (at == len(fill)) == (not room)
        if room:
            assert squares(at) == min(map(squares, room)) and start == fill[at]
        else:
            fill.append(0)
        fill[at] += size
    assert [40 - f for f in fill] == list(gaps)


def test_odd_rows(spark, odd, tokenizer):
    """Nulls, blanks, repeats, clashing names, special tokens as texts, very long texts, and no rows at all."""
    taken = odd.withColumns({c: F.lit(1) for c in ("at", "length", "piece", "start", "gap", "shard", "offset", "sequence_id")})
    more = [(50, "a<|endoftext|>b <|endoftext|>"), (51, "x" * 3_000_000), (52, "é " * 400_000), (53, "word " * 1023 + "x"), (54, " one" * 1023), (55, " one" * 1024), (55, " one" * 2047)]
    docs = taken.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    check(packing.packed(packing.pieces(docs, PATH, END)).collect(), docs, tokenizer)
    check(packing.packed(packing.pieces(taken, PATH, END)).collect(), taken, tokenizer)
    assert packing.packed(packing.pieces(odd.limit(0), PATH, END)).collect() == []


def test_ids_of_every_character(tokenizer):
    """Texts with any assigned character, in words, numbers and white space, have the tokenizer's own ids."""
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    chars = [chr(c) for c in [*range(0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x20100)] if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [f"ab{c}1{c} {c}\n{c}'s{c}{c}  x" for c in chars]
    assert encoder.plain
    got = encoder([t.encode() for t in texts])
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a.tolist() != b.ids] == []


def test_sequences(spark, docs, tokenizer):
    """The sequences hold the documents' ids in the places that their parts name."""
    whole = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END] for r in docs.limit(60).collect()}
    rows = packing.sequences(docs.limit(60), PATH, END).collect()
    found = 0
    for r in rows:
        assert len(r["ids"]) <= 1024 and sum(p["length"] for p in r.parts) == len(r["ids"])
        for p in r.parts:
            assert r["ids"][p["offset"] : p["offset"] + p["length"]] == whole[p.doc_id][p.start : p.start + p["length"]]
            found += p["length"]
    assert found == sum(map(len, whole.values()))
