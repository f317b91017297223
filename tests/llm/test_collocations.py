import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.llm import collocations


def counted(rows):
    """Every phrase of up to four words with its number, by lang."""
    found, words = Counter(), Counter()
    for r in rows:
        lang, text = "und" if r.lang is None else r.lang, (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                found.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    return found, words


def expected(rows, support=30, top=2000):
    f, n = counted(rows)
    big = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = []
    for lang in n:
        own = {w: a for (g, w), a in big.items() if g == lang}
        best = []
        for w, a in own.items():
            inside = any(100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in own.items() if len(v) > len(w))
            if not inside:
                score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], k))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s, k) for i, (s, a, p, left, right, k) in enumerate(sorted(best)[:top])]
    return out


def check(docs, support=30, **settings):
    got = collocations.collocations(docs, support=support, **settings).collect()
    want = expected(docs.collect(), support, settings.get("top", 2000))
    assert sorted(map(tuple, got)) == sorted(want)
    return got


@pytest.fixture(scope="module")
def drawn(spark):
    """Texts over few words, one pair of them in a third of all places, in three langs, with every mark."""
    draw, rows = random.Random(11), []
    words = ["a", "B", "é", "日本", "x'y", " ", "c-d", "\U0001f600", "e\x00f", "ß"]
    for i in range(300):
        text = ""
        for _ in range(draw.randrange(60)):
            text += "hot pair" if draw.random() < 0.35 else draw.choice(words)
            text += draw.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!?", "\x0b", ";"])
        rows.append((i, text, ["l1", "l2", None, "und"][i % 4]))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_against_counting(drawn):
    assert len(check(drawn, support=5)) > 50


@pytest.mark.parametrize("limit", [1, 40, 400])
def test_large_prefixes_are_dealt_anew(drawn, limit):
    """The rows are the same wherever a bucket, a prefix, or a longer prefix goes over what a task may hold."""
    check(drawn, support=4, limit=limit, bucket_bytes=2000)


def test_top_and_ties(drawn):
    got = check(drawn, support=3, top=7)
    assert max(r.rank for r in got) == 7


def test_odd_rows(spark, odd):
    taken = odd.withColumns({c: F.lit(1) for c in ("a", "l", "words", "phrase", "bucket", "packed", "n")})
    check(taken, support=1)
    check(odd.unionByName(odd), support=2)
    assert collocations.collocations(odd.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "so it goes on " * 300_000 + "z" * 1_000_000, "en")], "doc_id long, text string, lang string")
    check(long)


def test_large_numbers(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    n = 9_000_000_000_000_000
    given = [("en", ["a"], 3 * n), ("en", ["b"], n + 1), ("en", ["c"], n), ("en", ["a", "b"], n), ("en", ["b", "c"], n - 1), ("en", ["a", "b", "c"], n // 10 * 8), ("en", [], 9 * n // 2)]
    monkeypatch.setattr(collocations, "frequent", lambda *_: spark.createDataFrame(given, collocations.FOUND))
    got = {r.phrase: r for r in collocations.collocations(spark.range(1)).collect()}
    assert set(got) == {"a b c", "b c"} or set(got) == {"a b c"}
    for p, r in got.items():
        assert r.score == 2_000_000 * r.a // (r.l + r.r), p
