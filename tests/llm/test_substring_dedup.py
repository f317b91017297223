import hashlib
import random
import re

from loam.llm import substring_dedup


def brute(rows, least, run):
    """Start and stop of the runs to remove, found word by word, without the operator's arrays."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        units, at, own = [], 0, []
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        for k, m in enumerate(found):
            word = m.group().encode().lower()
            own.append(word)
            if word.endswith((b".", b"!", b"?")) or hashlib.md5(word).hexdigest().startswith("0") or k + 1 == len(found):
                if len(own) >= least:
                    units.append((at, m.end(), len(own), b" ".join(own)))
                at, own = m.end(), []
        group, removed = [], []
        for unit in [*units, None]:
            if unit and unit[3] in seen:
                group.append(unit)
                continue
            if sum(u[2] for u in group) >= run:
                removed.append((group[0][0], group[-1][1]))
            group = []
            if unit:
                seen.add(unit[3])
        out[doc_id] = removed
    return out


def test_against_brute_force(docs, texts):
    got = {r.doc_id: r.spans for r in substring_dedup.report(docs).collect()}
    want = brute(texts.items(), substring_dedup.LEAST_WORDS, substring_dedup.RUN_WORDS)
    assert got == {i: ",".join(f"{a}:{b}" for a, b in s) for i, s in want.items()}
    assert any(got.values())


def test_earliest_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(15)) + "." for x in "vw")
    once = "Not often seen words are here today"
    rows = [(5, f"head.\n{a.upper()}  Yes! {b}  \n{once}. tail"), (2, f"{a}\tyes!\n{b}\n{once}.\nend"), (9, None), (10, "")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.text, [(s.start, s.stop) for s in r.removed]) for r in out.collect()}
    gone = f"\n{a}  Yes! {b}"
    assert got[2] == (rows[1][1], []) and got[9] == (None, []) and got[10] == ("", [])
    start, stop = got[5][1][0]
    assert (start, rows[0][1][:start] + rows[0][1][stop:]) == (5, got[5][0]) and stop >= 5 + len(gone)
    assert got[5][0].endswith(" tail") and "V1" not in got[5][0]


def wrapped(words, n):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_passages_in_any_layout(spark):
    """A passage goes wherever it stands, however its lines are broken, with stops or without, but for what its first and last unit share with others."""
    draw, fail, whole = random.Random(3), 0, 0

    def some(n):
        return [f"w{draw.randrange(10**6)}" for _ in range(n)]

    for stops in (True, False):
        passage = some(120)
        if stops:
            passage = [w + "." if k % 9 == 8 else w for k, w in enumerate(passage)]
        rows = [(1, " ".join(passage)), (2, wrapped(passage, 8)), (3, wrapped(passage, 11)), (4, " ".join(some(40) + passage + some(30))),
                (5, wrapped(some(7) + passage + some(3), 9)), (6, "\n\n".join(["Title", wrapped(passage, 20), " ".join(some(60))])), (7, " ".join(some(90)))]
        got = {r.doc_id: r.text.split() for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1] == passage and got[7] == rows[6][1].split() and not got[2] and not got[3]
        for i in range(4, 7):
            left = len(set(passage) & set(got[i]))
            fail, whole = fail + left, whole + 120
            assert set(rows[i - 1][1].split()) - set(passage) <= set(got[i])  # nothing else goes
    assert fail <= 0.25 * whole


def test_odd_rows(odd):
    out = substring_dedup.remove_repeats(odd.withColumnRenamed("block", "removed"), least_words=5, run_words=5)
    assert out.count() == odd.count()
    assert {r.doc_id: r.text for r in out.collect()}[7] == ""  # the repeat of document 6
    assert substring_dedup.report(odd.limit(0)).count() == 0


def test_long_text(spark):
    """Many units and removed runs in one text take time in proportion."""
    long = " ".join(f"a{i} b{i} c{i}." for i in range(100_000))
    twice = spark.createDataFrame([(1, long), (2, "x. " + long.replace(" a50000 ", " new "))], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(twice).collect()}
    assert len(got[2].removed) == 2 and len(got[2].text) < 40 and not got[1].removed
