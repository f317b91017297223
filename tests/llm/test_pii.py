import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.llm import pii
from loam.llm.common import table

# The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()}


def wanted(text):
    found = brute(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
    return *(len(found[k]) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()


def of(r):
    return r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256


def test_base_spans_are_the_contract_s(docs, texts):
    rows = pii.report(docs).collect()
    assert {r.doc_id: of(r) for r in rows} == {i: wanted(t) for i, t in texts.items()}
    assert any(r.n_email for r in rows)


PIECES = ["a@b.c", "x@y", "@", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.004", ".", "-", " ", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 1234567",
          "+1", "+", "123456789012345678901", "é", "\U0001f600", "\n", "a.b+c%d@e-f.g.h-.i", "..@a.b", "5500-0000-0000-0004"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=40, max_size=40))
def test_base_spans_of_any_text(spark, drawn):
    rows = pii.report(spark.createDataFrame(list(enumerate(drawn)), "doc_id long, text string")).collect()
    assert {r.doc_id: of(r) for r in rows} == {i: wanted(t) for i, t in enumerate(drawn)}


@pytest.fixture(scope="module")
def planted(spark):
    """A surname that stands with one address only, and words that stand everywhere."""
    draw, rows = random.Random(4), []
    for i in range(120):
        w = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(25)]
        who = "write to Quillfeather at quill@example.org today" if i % 20 == 0 else f"write to u{i}@example.org today"
        rows.append((i, " ".join(w[:12]) + f" {who} " + " ".join(w[12:])))
    rows.append((500, "Quillfeather was seen by the river, without an address."))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_revealing_terms_go(planted):
    found = pii.find(planted).collect()
    terms = {r.doc_id: {m.value.lower() for m in r.term} for r in found}
    assert "quillfeather" in terms[0] and "quillfeather" in terms[500]
    assert not any("write" in t or "today" in t for t in terms.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(planted).collect()}
    assert "uillfeather" not in clean[500] and "quill@" not in clean[0] and "[EMAIL]" in clean[0]


def disclosures(rows, support):
    """Disclosure of every term by plain counting. ``rows``: text and the key of its near-copy group, one row a group."""
    where, terms, total = defaultdict(set), defaultdict(set), max(len(rows), 2)
    for number, text in enumerate(rows):
        spans = brute(text)
        keep, found = list(text), set()
        for kind, own in spans.items():
            for a, b in own:
                value = text[a:b].lower()
                digits = re.sub("[^0-9]", "", value)
                group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
                found |= {"any", kind, f"{kind}:{value}", f"{kind} of {group}"}
                keep[a:b] = " " * (b - a)
        for e in found:
            where[e].add(number)
        for w in set(re.findall(r"[^\W_]+", "".join(keep).lower())):
            if len(w) >= 3 and re.search(r"[^\W\d_]", w):
                terms[f"#{len(w)}" if re.search(r"\d", w) else w].add(number)
    best = {}
    for term, docs in terms.items():
        for e, own in where.items():
            both, n = len(docs & own), len(docs)
            if both >= support and len(own) >= support:
                p, z = both / n, pii.Z
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                best[term] = max(best.get(term, -99), 1 - math.log(low) / min(math.log(len(own) / total), -1e-9))
    return best


def plain_words(text):
    """The words of a text outside its base spans."""
    keep = list(text)
    for own in brute(text).values():
        for a, b in own:
            keep[a:b] = " " * (b - a)
    return {w for w in re.findall(r"[^\W_]+", "".join(keep).lower()) if len(w) >= 3 and re.search(r"[^\W\d_]", w)}


def alike(a, b):
    return 100 * len(a & b) >= pii.SHARED * len(a | b)


def test_disclosure_against_brute_force(spark, planted):
    """Near copies are told by plain sets: what is put behind a text shares its words, and what stays has no close text of lesser key."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").limit(700).union(planted).where("length(text) < 20000")
    docs = docs.union(docs.where("doc_id % 7 = 0"))
    found = pii.analysed(docs)
    texts = {hashlib.md5(r.text.encode()).hexdigest(): r.text for r in docs.where("text IS NOT NULL").collect()}
    words = {k: plain_words(t) for k, t in texts.items()}
    gone = {(r.doc_key, r.head) for r in pii.near_copies(found).collect()}
    assert all(head < key and alike(words[key], words[head]) for key, head in gone)
    kept = sorted(set(texts) - {key for key, _ in gone})
    close = [(a, b) for i, a in enumerate(kept) for b in kept[:i] if words[a] and 100 * len(words[a] & words[b]) >= 95 * len(words[a] | words[b])]
    assert len(close) <= 1 and len(gone) > 10
    want = {t: d for t, d in disclosures([texts[k] for k in kept], 3).items() if d >= 0.6}
    got = {r.term: r.disclosure for r in pii.revealing_terms(found, 3, 0.6, 0.9).collect()}
    assert got == pytest.approx(want) and "quillfeather" in got


def test_unrelated_texts_all_count(spark):
    """Thousands of texts over few words, alike in nothing but that, and a group of near copies, which counts once."""
    draw = random.Random(12)
    own = ["".join(draw.choices("abcdefghij", k=4)) for _ in range(3000)]
    rows = [(i, " ".join(draw.sample(own, 60))) for i in range(1500)]
    copied = draw.sample(own, 200)
    rows += [(5000 + i, " ".join([*copied[: i % 7], f"x{own[i]}", *copied[i % 7 + 1 :]])) for i in range(200)]
    found = pii.analysed(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.number for r in pii.counted_once(found).collect()}
    keys = {r.doc_key for r in found.where(F.col("number").isin(kept)).collect()}
    by_key = {hashlib.md5(t.encode()).hexdigest(): i for i, t in rows}
    left = [by_key[k] for k in keys]
    assert sum(i < 5000 for i in left) == 1500 and sum(i >= 5000 for i in left) <= 4


def test_terms_on_the_tables(spark):
    """The method finds terms on the tables: the secrets beside the personal data, each of which occurs once."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = pii.find(docs).select("doc_id", "text", "term").collect()
    secret = {r.doc_id: {m.group(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")} for r in rows}
    held = [r for r in rows if secret[r.doc_id]]
    caught = sum(secret[r.doc_id] <= {m.value for m in r.term} for r in held)
    assert len(held) > 10 and caught >= 0.9 * len(held)
    clean = [r for r in rows if not secret[r.doc_id] and not any(brute(r.text).values())]
    assert sum(bool(r.term) for r in clean) <= 0.02 * len(clean)


def test_shuffled_joins_give_the_same(planted):
    a, b = (sorted(map(str, pii.report(planted, broadcast_bytes=n).collect())) for n in (0, 1 << 30))
    assert a == b


def test_very_long_text(spark):
    """200,000 numbers, and 20,000 addresses, in one text."""
    numbers = " ".join(str(10**7 + i) for i in range(200_000))
    mails = " ".join(f"a{i}@b.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")
    got = {r.doc_id: of(r) for r in pii.report(docs).collect()}
    assert got == {1: wanted(numbers), 2: wanted(mails)}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {1: numbers, 2: " ".join(["[EMAIL]"] * 20_000)}


def test_many_terms_in_a_text(spark):
    """16,000 secrets and 2,000 addresses in one text, beside texts with one of each."""
    draw = random.Random(8)

    def secret():
        return "".join(draw.choices("abcdef", k=39)) + "7"

    rows = [(i, f"write to u{i}@example.org with {secret()} for it, said number {own}") for i, own in enumerate(["one", "two", "three"] * 100)]
    rows += [(900 + i, " ".join("".join(draw.choices("klmnopqrst", k=5)) for _ in range(8))) for i in range(400)]
    secrets = [secret() for _ in range(16_000)]
    rows.append((5000, " ".join(f"{s} a{k}@b.org" if k % 8 == 0 else s for k, s in enumerate(secrets))))
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 3 OR doc_id = 5000").collect()}
    assert [m.value for m in found[5000].term] == secrets and len(found[5000].email) == 2000
    assert all(any(len(m.value) == 40 for m in found[i].term) for i in range(3))


def test_odd_rows(odd):
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    assert pii.report(odd.limit(0)).count() == 0


def test_main_path_is_native(docs):
    plan = pii.report(docs)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
