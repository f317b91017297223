import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import bpe
from loam.llm.pretokens import pretokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def wanted(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_are_the_library_s(docs, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, PATTERN).collect()}
    assert got == {i: wanted(library, t) for i, t in texts.items()}


def test_odd_rows(odd, library):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH, PATTERN).collect())
    assert got == sorted((r.doc_id is None, r.doc_id, *wanted(library, r.text)) for r in odd.collect())
    assert bpe.digests(odd.limit(0), PATH, PATTERN).count() == 0


def test_structured_words(spark, library):
    """Words that a polynomial hash confuses keep their own ids, and so does every block size."""
    rows = []
    for n in (512, 1024, 2048):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        rows.append((n, f"{one}\n{one.translate(str.maketrans('ab', 'ba'))}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (100, 1 << 20):
        got = {r.doc_id: r for r in bpe.encode(docs, PATH, PATTERN, block_bytes=size, decoded=True).collect()}
        for n, text in rows:
            assert list(got[n].ids) == library.encode_ordinary(text) and got[n].decoded.decode() == text


def test_one_long_word(spark, library):
    text = "ab" * 50_000
    row = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, PATTERN).first()
    assert row.n_tokens == wanted(library, text)[0] and row.ids_sha256 == wanted(library, text)[1]


def test_decode(odd):
    encoded = bpe.encode(odd, PATH, PATTERN)
    got = sorted(bytes(r.decoded) for r in bpe.decode(encoded, PATH).collect())
    assert got == sorted((r.text or "").encode() for r in odd.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stremlvd 1 \n\t.你\U0001f600́ "), max_size=30), max_size=4))
def test_splitting(texts):
    import regex

    flat, starts, ends, counts = pretokens([t.encode() for t in texts], PATTERN)
    raw = flat.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [m for t in texts for m in regex.findall(PATTERN, t)]
    assert counts.tolist() == [len(regex.findall(PATTERN, t)) for t in texts]
