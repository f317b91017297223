import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from loam.llm import decontam, pii, quality_model
from loam.llm.common import table


def similar_copies(texts):
    """Documents behind another one of lesser id in a chain of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
    least = {i: i for i in sorted(sets)}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in least:
        for b in least:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i for i in least if root(i) != i}


def test_stages(spark, sf):
    """Each stage keeps the columns, and what each operator says of its rows takes effect."""
    docs = table(spark, sf, "documents").cache()
    low = {r.doc_id for r in quality_model.score(docs, table(spark, sf, "labels")).where("predicted = 0").collect()}
    good = corpus_pipeline.good_quality(spark, docs, sf)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - low
    # The stage has its own rule, a similarity of 0.8 of five-word shingles, which all pairs give here.
    copies = similar_copies({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    single = corpus_pipeline.without_near_duplicates(spark, docs, sf)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in docs.collect()} - copies
    leaked = {r.doc_id for r in decontam.contained_items(docs, table(spark, sf, "benchmark")).collect()}
    clean = corpus_pipeline.without_benchmark(spark, docs, sf)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - leaked
    private = corpus_pipeline.without_personal_data(spark, docs, sf)
    assert private.columns == docs.columns and private.count() == docs.count()
    assert {r.doc_id: r.text for r in private.collect()} == {r.doc_id: r.text for r in pii.sanitise(docs).collect()}


def test_run_is_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < table(spark, sf, "documents").count()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]


def test_stages_take_odd_rows(spark, sf, odd):
    """Nulls, blanks, repeats and clashing names go through every stage; an empty table stays empty."""
    import public_tokenizers  # noqa: F401

    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == odd.columns and out.count() <= docs.count()
            docs = out if rows is odd else rows
        done = corpus_pipeline.tokenised(spark, odd if rows is odd else rows, sf)
        assert done.count() == rows.count() and {"doc_id", "n_tokens", "ids", "text"} == set(done.columns)
