import regex

from loam.llm import decontam
from loam.llm.common import table


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(w, n):
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    found = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        n = min(5, len(w))
        own = shingles(w, n)
        for doc, body in docs:
            shared = len(own & shingles(words(body), n))
            if 100 * shared >= 80 * len(own):
                found[doc, item] = (len(own), shared)
    return found


def test_against_brute_force(spark, sf, docs, texts):
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contained_items(docs, table(spark, sf, "benchmark")).collect()}
    assert got == brute(texts.items(), items) and got


def test_shuffled_joins_give_the_same(spark, sf, docs):
    bench = table(spark, sf, "benchmark")
    a, b = (decontam.contained_items(docs, bench, broadcast_rows=n).select("doc_id", "item_id") for n in (0, 10**6))
    assert sorted(a.collect()) == sorted(b.collect())


def test_short_items_and_odd_rows(spark, odd):
    items = spark.createDataFrame([(0, "same text of six words here"), (1, "no id"), (2, None), (3, " "), (4, "same TEXT of SIX, words!"), (4, "x")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contained_items(odd, items.where("item_id < 4")).collect()), key=str)
    assert got == [(6, 0), (7, 0), (None, 1)]
    kept = decontam.decontaminate(odd, items.where("item_id < 4"))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.decontaminate(odd, items.limit(0)).count() == odd.count()
    assert decontam.contained_items(odd.limit(0), items).count() == 0


def test_main_path_is_native(docs, spark, sf):
    plan = decontam.contained_items(docs, table(spark, sf, "benchmark"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan
