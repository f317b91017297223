import re
from collections import Counter, defaultdict

from loam.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(five)
    covered = {j for i, g in enumerate(five) if often[g] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_columns(docs, texts):
    got = {r.doc_id: columns(r) for r in quality_rules.apply_rules(docs).collect()}
    assert got == {i: base(t) for i, t in texts.items()}


def test_boilerplate_by_host(spark):
    foot = "All rights reserved by the owners of this site 2024"
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{k}" for k in range(30))
        body = foot.replace("2024", str(2000 + i)) + ("\n" + own if i % 3 else "\nonly few words")
        rows.append((i, body, "a" if i < 40 else "b"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), limit_docs=20).collect()}
    for i, r in got.items():
        # host b has 20 documents with the line, which is not above the limit
        assert r.n_lines_removed == (1 if i < 40 else 0)
        assert r.kept == (not r.base_failed and (i >= 40 or i % 3 != 0))


def lines_of_host(rows, limit_docs, limit_share):
    seen, size = defaultdict(set), defaultdict(set)
    for doc_id, host, text in rows:
        if doc_id is None:
            continue
        size[host].add(doc_id)
        for line in (text or "").split("\n"):
            words = WORD.findall(line.translate({c: c + 32 for c in range(65, 91)} | {c: 48 for c in range(48, 58)}))
            if words:
                seen[host, " ".join(words)].add(doc_id)
    return {k for k, d in seen.items() if len(d) > limit_docs and len(d) > limit_share * len(size[k[0]])}


def test_line_frequency_against_brute_force(spark, docs, texts):
    hosts = {r.doc_id: r.source or "" for r in docs.select("doc_id", "source").collect()}
    often = lines_of_host([(i, hosts[i], t) for i, t in texts.items()], 2, 0.01)
    got = {r.doc_id: r.n_lines_removed for r in quality_rules.apply_rules(docs, limit_docs=2, limit_share=0.01).collect()}
    for i, text in texts.items():
        gone = 0
        for line in (text or "").split("\n"):
            words = WORD.findall(line.translate({c: c + 32 for c in range(65, 91)} | {c: 48 for c in range(48, 58)}))
            gone += bool(words) and (hosts[i], " ".join(words)) in often
        assert got[i] == gone


def test_odd_rows(odd):
    rows = quality_rules.apply_rules(odd).collect()
    assert sorted((str(r.doc_id), *map(str, columns(r))) for r in rows) == sorted((str(r.doc_id), *map(str, base(r.text))) for r in odd.collect())
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0


def _thue_morse(n):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_structured_texts(spark):
    """Lines and windows that a polynomial hash confuses are told apart."""
    rows = []
    for i, n in enumerate((512, 1024, 2048)):
        one, other = _thue_morse(n)
        rows += [(3 * i, f"{one}\n{other}"), (3 * i + 1, f"{' '.join(one)}\n{' '.join(other)}"), (3 * i + 2, f"{one} a b c d\n{other} a b c d")]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    assert {r.doc_id: columns(r) for r in quality_rules.apply_rules(docs).collect()} == {i: base(t) for i, t in rows}
    # The line of one letters is in all documents, its complement in one.
    one, other = _thue_morse(1024)
    docs = spark.createDataFrame([(i, " ".join(one) if i else " ".join(other), "h") for i in range(30)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_lines_removed for r in quality_rules.apply_rules(docs).collect()}
    assert got == {i: int(i > 0) for i in range(30)}


def test_limit_of_large_hosts(spark):
    """A line in more than ``most_docs`` documents goes though it is under the share of its host."""
    foot = "one line that stands below many documents of one host"
    rows = []
    for i in range(200):
        name = "".join("abcdefghij"[int(c)] for c in str(i))  # digits would all be the same
        rows.append((i, " ".join(name + "xyz"[k % 3] * k for k in range(30)) + (f"\n{foot}" if i % 10 < 3 else ""), "h"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, gone in ((50, 60), (60, 0)):
        assert sum(r.n_lines_removed for r in quality_rules.apply_rules(docs, limit_share=0.5, most_docs=most).collect()) == gone
