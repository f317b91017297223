"""Language id, language-model scoring, quality classifier and URL filter: exact parts by brute force, models by held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import lang_id, lm_score, quality_model, queries, url_filter
from loam.llm.common import drawn, table

SMALL = "/root/testdata/sf0.01"


def held(doc_id, n):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 2


@pytest.fixture(scope="module")
def more(spark):
    return table(spark, SMALL, "documents")


def test_languages_of_held_out_rows(more):
    rows = lang_id.identify(more).join(more.select("doc_id", "text", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    right = sum(r.lang == r.lang_pred for r in judged) / len(judged)
    assert right > 0.95, right
    assert all((r.lang_pred == "und") == (re.search(r"[^\W\d_]", r.text or "") is None) for r in rows)


def test_codewords_lie_apart():
    for n in (2, 3, 4, 6, 9):
        code = lang_id.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= (1 if n == 2 else 2)


def test_language_odd_rows(odd, spark):
    rows = lang_id.identify(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.identify(nothing).collect()} == {"und"}
    assert lang_id.identify(odd.limit(0)).count() == 0


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def unigram(texts):
    counts = Counter(w for i, t in texts for w in lm_tokens(t) if not held(i, 7))
    total, kinds = sum(counts.values()), len(counts)
    for i, t in texts:
        own = lm_tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        yield i, len(own), sum(counts[w] > 0 for w in own), total, base


def test_lm_base_and_gain(more):
    texts = [(r.doc_id, r.text) for r in more.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm_score.score(more).collect()}
    for i, n, known, total, base in unigram(texts):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(i, 7))
        assert r.base_score == pytest.approx(base, abs=1e-6 * max(1, -base))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_probabilities():
    """Sum to one over the vocabulary, and are those of the plain softmax of both steps."""
    draw = np.random.default_rng(2)
    vocabulary = lm_score.Vocabulary(np.sort(draw.zipf(1.3, 60).clip(1, 5000))[::-1].astype(float), 1, 0, 0, classes=7)
    assert 3 < len(vocabulary.class_share) <= 7 and np.diff(vocabulary.edges).max() > 3
    p = lm_score.Parameters(vocabulary)
    p.flat += draw.normal(0, 0.5, len(p.flat)).astype(np.float32)
    for one, two in ((0, 0), (3, 59), (17, 1)):
        log = p.log_probabilities(np.full(60, one), np.full(60, two), np.arange(60), room=64)
        h = p.r[one].astype(float) @ p.c1 + p.r[two].astype(float) @ p.c2
        classes = np.exp(p.u @ h + p.a)
        words = np.exp(p.q @ h + p.b)
        plain = [np.log(classes[k] / classes.sum() * words[w] / words[vocabulary.of == k].sum()) for w, k in enumerate(vocabulary.of)]
        assert np.exp(log).sum() == pytest.approx(1, abs=1e-4) and log == pytest.approx(plain, abs=1e-4)


def test_lm_learns_word_order(spark):
    """Texts that walk round a ring of words: the model tells the next word, the base can't."""
    rows = [(i, " ".join(f"w{(i + k) % 40}" for k in range(60))) for i in range(4000)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=4).where("held_out").collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_lm_does_not_depend_on_partitions(spark, docs):
    a, b = ({r.doc_id: r.score for r in lm_score.score(docs.repartition(n)).collect()} for n in (2, 7))
    assert a == pytest.approx(b, rel=1e-6)


def test_lm_structured_words(spark):
    """Words that a polynomial hash confuses are counted apart."""
    rows = []
    for i, n in enumerate((512, 1024, 2048)):
        one = "".join("ab"[bin(x).count("1") % 2] for x in range(n))
        rows += [(2 * i, one + " x"), (2 * i + 1, one.translate(str.maketrans("ab", "ba")) + f" {one} y")]
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, n, known, total, round(base, 6)) for i, n, known, total, base in unigram(rows))


def test_lm_odd_rows(odd):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(odd).collect())
    assert got == sorted((str(i), n, known, total, round(base, 6)) for i, n, known, total, base in unigram(texts))
    assert lm_score.score(odd.limit(0)).count() == 0


def test_quality_of_held_out_rows(spark, more):
    labels = table(spark, SMALL, "labels")
    rows = quality_model.score(more, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    above = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert above > 0.9, above
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id, 4) for r in rows)


def test_quality_reads_only_texts(spark, more):
    labels = table(spark, SMALL, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (dict(quality_model.score(more, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == pytest.approx(b)


def test_quality_odd_rows(odd, spark):
    labels = spark.createDataFrame([(0, 1), (None, 0), (4, None), (5, 7), (6, 0), (6, 0)], "doc_id long, quality int")
    rows = quality_model.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_model.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score(odd.limit(0), labels).count() == 0
    kept = quality_model.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_quality_of_repeated_ids(spark, more):
    """A row is dropped for its own text only."""
    labels = table(spark, SMALL, "labels")
    scored = quality_model.score(more, labels).join(more.select("doc_id", "text"), "doc_id").collect()
    good, bad = (next(r.text for r in scored if r.predicted == x) for x in (1, 0))
    rows = more.select("doc_id", "text").union(spark.createDataFrame([(-1, good), (-1, bad), (-2, bad), (None, bad)], "doc_id long, text string"))
    kept = quality_model.keep_good(rows, labels).where("doc_id < 0 OR doc_id IS NULL").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(-1, good), (None, bad)], key=str)
    assert quality_model.keep_good(rows.limit(0), labels).count() == 0


def test_drawn_samples(spark):
    """The number drawn keeps to the bound, repeats count once, and what is drawn doesn't depend on partitions."""
    rows = spark.range(20_000).selectExpr("id % 10000 AS a", "'x' AS b")
    got = {r.a for r in drawn(rows, 1000, "a", "b").collect()}
    assert 850 < len(got) < 1150 and got == {r.a for r in drawn(rows.repartition(7), 1000, "a", "b").collect()}
    assert drawn(rows, 10_000, "a", "b").count() == 10_000 and drawn(rows.limit(0), 5, "a", "b").count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path):
    best = None
    for verdict, rule in queries.URL_RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def test_url_rules(spark, sf):
    rows = queries.op8_url_filter(spark, SMALL).collect()
    urls = {r.page_id: r.url for r in table(spark, SMALL, "pages").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == url_parts(urls[r.page_id])
        best = url_rule(r.host, r.path)
        assert r.rule == (best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_url_models_tell_kinds_apart(spark):
    good = [f"http://blue{i}.com/garden/flower/{i}" for i in range(400)]
    bad = [f"http://x{i}.biz/win-cash-now?id={i}" for i in range(400)]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    models = url_filter.fit(labelled)
    import pyarrow as pa

    p = models.accepted(pa.array(["http://blue999.com/garden/flower/77", "http://x999.biz/win-cash-now?id=5"]))
    assert p[0] > 0.9 and p[1] < 0.1


def test_url_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://EXAMPLE.COM/en/7?q#f", "http://a.net/de/", "http://xcom/en/", "://", "a://b?c/d", "ü://Ü.com/ä", "http://com/en/x", "http://com/en/x"]
    rows = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = url_filter.judge(rows, queries.URL_RULES).collect()
    assert {r.page_id: (r.host, r.path) for r in got} == {i: url_parts(u) for i, u in enumerate(urls)}
    assert {r.page_id: r.rule for r in got}[3] == "example.com/en/7"
    assert url_filter.judge(rows.limit(0), queries.URL_RULES).count() == 0


def test_class_normaliser_is_computed_once_a_pair(monkeypatch):
    """Words after the same two words share the sum over the classes."""
    counts = np.array([40.0, 30, 20, 10, 5, 1])
    v = lm_score.Vocabulary(counts, 5, 1, 1, classes=6)
    words = np.tile(np.array([0, 1, 2], np.int32), 500)
    one, two = lm_score.contexts(words, np.array([len(words)]), 0)
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **how: taken.append(np.size(x)) or exp(x, **how))
    lm_score.Parameters(v).log_probabilities(one, two, words)
    inside = sum(int((v.of[words] == c).sum()) * n for c, n in enumerate(np.diff(v.edges)) if n > 1)
    assert sum(taken) <= 6 * len(v.class_share) + inside
