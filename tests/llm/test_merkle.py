import hashlib
import random
import zlib

from pyspark.sql import functions as F

from loam.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """What remains of a list of digests, and for each leaf the digests left and right of it in every level."""
    ways, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, way in enumerate(ways):
            run = leaves[at[i] // 8 * 8 :][:8]
            way.append((run[: at[i] % 8], run[at[i] % 8 + 1 :]))
            at[i] //= 8
        leaves = [h(*leaves[k : k + 8]) for k in range(0, len(leaves), 8)]
    return leaves[0], ways


def expected(rows):
    def leaf(r, lower=False):
        text = r.text.translate({c: c + 32 for c in range(65, 91)}) if lower and r.text is not None else r.text
        return h(*map(value, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def key(r):
        return (r.doc_id is not None, r.doc_id or 0)

    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: [(r, leaf(r), leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0)) for r in rows if r.lang == g] for g in langs}
    for found in own.values():
        found.sort(key=lambda x: (*key(x[0]), x[2], x[1]))
    trees = {g: tree([a for _, a, _ in own[g]]) for g in langs}
    root, above = tree([trees[g][0] for g in langs])
    for g, upper in zip(langs, above, strict=True):
        for (r, digest, seen), way in zip(own[g], trees[g][1], strict=True):
            folded, siblings = seen, []
            for left, right in way + upper:
                folded, siblings = h(*left, folded, *right), siblings + left + right
            yield (r.doc_id, digest, trees[g][0], root, h(*siblings), folded, folded == root)


def check(docs):
    got, want = merkle.tampering_report(docs).collect(), list(expected(docs.collect()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


def test_table(docs):
    got = check(docs)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_odd_rows(spark, odd):
    """Null ids, texts and groups, repeated rows and ids, clashing names, and a table without rows."""
    taken = odd.withColumns({c: F.lit(1) for c in ("grp", "row", "digest", "idx", "total", "path", "left", "children")})
    check(taken)
    check(odd.unionByName(odd))
    assert merkle.tampering_report(odd.limit(0)).collect() == []
    assert merkle.tampering_report(odd.limit(0)).columns == merkle.tampering_report(odd).columns


def test_shapes(spark):
    """Groups of every small size, among them one leaf alone and runs with one child, and one group alone; a very long text."""
    draw = random.Random(3)
    sizes = [1, 2, 7, 8, 9, 16, 63, 64, 65, 130]
    rows = [(1000 * k + i, "X y" * draw.randrange(4), f"l{k}" if k else None, "s", 3) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(docs)
    check(docs.where("lang = 'l4'"))
    lone = check(docs.where("lang is null"))[0]
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == hashlib.sha256(b"").hexdigest()
    check(docs.where("lang = 'l1'").withColumn("text", F.expr("repeat('Aé ', 1000000)")))


def test_fanout(spark):
    """Another fanout, and paths that fold up for the row they belong to alone."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("g").alias("lang"))
    rows = merkle.manifest(docs, F.col("lang"), [F.col("doc_id")], merkle.digest_of(F.col("doc_id")), fanout=3)
    wrong = rows.select(merkle.folded("leaf").alias("a"), merkle.folded(F.sha2(F.lit("x").cast("binary"), 256)).alias("b"), "root", F.size("path").alias("n")).collect()
    assert all(r.a == r.root != r.b and r.n == 4 for r in wrong)
