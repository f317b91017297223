import random
import re

import numpy as np
import xxhash

from loam.llm import near_dup
from loam.llm.bktree import Forest


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Least id reachable, by all pairs."""
    names = {i: i for i in prints}

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                names[y] = x
    return {i: root(i) for i in ids}


def test_against_all_pairs(docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    joined = classes(prints)
    assert got == {i: (f"{p:016x}", joined[i]) for i, p in prints.items()}


def test_chains_and_split_shards(spark):
    """Random fingerprints in clusters and a long chain, with shards over the tree limit."""
    draw = random.Random(3)
    prints = {0}
    for _ in range(40):
        base = draw.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(6)}
    prints |= {sum(1 << b for b in range(3 * k)) for k in range(21)}  # each link of the chain is three bits on
    signed = [int(np.uint64(p).astype(np.int64)) for p in sorted(prints)]
    links = near_dup.shard_links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), tree_limit=7)
    labels = {r.node: r.label for r in near_dup.components(links).collect()}
    want = classes({s: s & (2**64 - 1) for s in signed})
    assert {s: labels.get(s, s) for s in signed} == want


def test_tree_search_is_exact():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 12, 400).astype(np.uint64)
    shard = draw.integers(0, 3, 400)
    got = {(int(q), int(e)) for a, b in Forest(prints, shard).within(prints, shard, 2) for q, e in zip(a, b, strict=True)}
    want = {(i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert got == want


def test_odd_rows(odd):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    named = {r.doc_id: r for r in got}
    assert named[0].fingerprint == named[1].fingerprint == named[2].fingerprint == "0" * 16
    assert {named[i].component_id for i in (0, 1, 2)} == {0} and named[7].component_id == 6
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 0, 3, 4, 5, 6} and 7 not in {r.doc_id for r in kept.collect()}
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_planted_near_copies(spark):
    """Copies with changed words at 0.8 or more are found, most of them over three bits apart; texts under 0.8 stay."""
    import corpus_pipeline

    draw, rows, near, far = random.Random(5), [], set(), set()
    for i in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 400))]
        copy = list(words)
        for place in draw.sample(range(len(words)), max(len(words) // (60 if i % 2 else 20), 1)):
            copy[place] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy).upper())]
        (near if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else far).add(2 * i + 1)
    assert len(near) >= 20 and len(far) >= 20
    assert sum((fingerprint(rows[i - 1][1]) ^ fingerprint(rows[i][1])).bit_count() > 3 for i in near) > len(near) / 2
    many = [f"m{k}" for k in range(200)]
    rows += [(1000 + k, " ".join([*many[:k], f"x{k}", *many[k + 1 :]])) for k in range(200)]  # more than one group compares with each other
    kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, _ in rows if i < 1001} - near


def test_similar_odd_rows(odd):
    got = {r.doc_id: r.component_id for r in near_dup.similar(odd).collect()}
    assert near_dup.similar(odd).count() == odd.count() and near_dup.similar(odd.limit(0)).count() == 0
    assert got[0] == got[1] == got[2] == 0 and got[7] == 6 and got[3] == 3
    assert near_dup.keep_one_similar(odd).columns == odd.columns


def test_repeated_ids(spark):
    """Another text under a repeated doc_id stays; rows that repeat a document go or stay together."""
    a, other = "one text of some words that is there twice", "quite another text that nobody else has written"
    rows = spark.createDataFrame([(1, a), (2, a), (2, other), (3, a), (3, a), (4, None), (4, "")], "doc_id long, text string")
    for kept in (near_dup.keep_one(rows), near_dup.keep_one_similar(rows)):
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (2, other), (4, None), (4, "")], key=str)
    for kept in (near_dup.keep_one(rows.limit(0)), near_dup.keep_one_similar(rows.limit(0))):
        assert kept.columns == rows.columns and kept.count() == 0


def test_large_chained_group(spark):
    """600 copies of one text, each with a word or two of an earlier copy changed: far over the members that a band compares in pairs."""
    draw = random.Random(12)
    texts = [[f"w{draw.randrange(5000)}" for _ in range(120)]]
    while len(texts) < 600:
        own = list(draw.choice(texts))
        for _ in range(draw.randint(1, 2)):
            own[draw.randrange(len(own))] = f"w{draw.randrange(5000)}"
        texts.append(own)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    least = list(range(len(sets)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 10 * shared >= 8 * (len(a) + len(sets[j]) - shared):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    behind = [i for i in range(len(sets)) if root(i) != i]
    got = {r.doc_id: r.component_id for r in near_dup.similar(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(behind) > 400 and all(root(got[i]) == root(i) for i in got)
    assert sum(got[i] != i for i in behind) >= 0.99 * len(behind)


def test_similar_texts_are_linked_by_fingerprint(spark, monkeypatch):
    """What lies within three bits is found without the bands; what is not similar is not linked."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(5000)}" for _ in range(600)]
    base, copies = " ".join(words), []
    own = near_dup.simhash(base.encode(), 5)
    for k in range(600):
        copy = " ".join([*words[:k], "changed", *words[k + 1 :]])
        if (near_dup.simhash(copy.encode(), 5) ^ own).bit_count() <= 3:
            copies.append(copy)
    assert copies
    other = " ".join(f"v{draw.randrange(5000)}" for _ in range(600))
    monkeypatch.setattr(near_dup, "candidates", lambda sets: sets.select(sets.set_key.alias("a"), sets.set_key.alias("b"), "size", sets["size"].alias("b_size")).limit(0))
    rows = spark.createDataFrame([(1, base), (2, copies[0]), (3, other)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.similar(rows, 5, 80).collect()} == {1: 1, 2: 1, 3: 3}


def similar_classes(texts, percent=80, words=5):
    """The least index reachable over texts of a Jaccard similarity of ``percent`` or more, by all pairs."""
    sets = [{tuple(t[k : k + words]) for k in range(len(t) - words + 1)} for t in texts]
    least = list(range(len(sets)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return {i: root(i) for i in range(len(sets))}


def found_classes(spark, texts):
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near_dup.similar(rows, 5, 80).collect()}


def test_similar_chain_within_the_radius(spark, monkeypatch):
    """Texts that drift apart while their fingerprints stay in one shard: no link of the chain is lost, without the bands."""
    monkeypatch.setattr(near_dup, "candidates", lambda sets: sets.select(sets.set_key.alias("a"), sets.set_key.alias("b"), "size", sets["size"].alias("b_size")).limit(0))
    draw = random.Random(6)
    texts = [[f"w{draw.randrange(9000)}" for _ in range(500)]]
    prints = [near_dup.simhash(" ".join(texts[0]).encode(), 5)]
    for place in draw.sample(range(0, 500, 5), 40):
        tries = [[*texts[-1][:place], f"x{place}-{k}", *texts[-1][place + 1 :]] for k in range(40)]
        texts.append(min(tries, key=lambda c: ((near_dup.simhash(" ".join(c).encode(), 5) ^ prints[0]).bit_count(), c[place])))
        prints.append(near_dup.simhash(" ".join(texts[-1]).encode(), 5))
    whole = [" ".join(t) for t in texts]
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 3 and jaccard(whole[i], whole[j]) >= 0.8 for j in range(i)) for i in range(1, 41)) and jaccard(whole[0], whole[-1]) < 0.5
    want = similar_classes(texts)
    assert set(want.values()) == {0} and found_classes(spark, texts) == want


def test_similar_in_large_groups(spark, monkeypatch):
    """Copies of copies in groups far over what is compared in pairs at once, in many parts: classes are those of all pairs."""
    monkeypatch.setattr(near_dup, "PAIRED", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 64, raising=False)
    draw = random.Random(1)
    texts = [[f"w{draw.randrange(5000)}" for _ in range(60)]]
    while len(texts) < 500:
        copy = list(draw.choice(texts))
        for _ in range(draw.randint(1, 2)):
            copy[draw.randrange(60)] = f"w{draw.randrange(5000)}"
        texts.append(copy)
    draw.shuffle(texts)
    want = similar_classes(texts)
    assert 100 < len(set(want.values())) < 400
    assert found_classes(spark, texts) == want


def test_apart_in_bands(spark, monkeypatch):
    """Every similar pair of two labels of a large group is a candidate, in any part; pairs of one label and of small groups are not."""
    monkeypatch.setattr(near_dup, "PAIRED", 5)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    draw, sets = np.random.default_rng(2), []
    base = draw.integers(0, 1 << 62, 60)
    for k in range(40):
        changed = draw.choice(60, draw.integers(0, 10), replace=False)
        own = base.copy()
        own[changed] = draw.integers(0, 1 << 62, len(changed))
        sets.append(set(own.tolist()))
    parity = []
    for own in sets:
        bits = [0] * near_dup.PARITY
        for key in own:
            bits[key % (64 * near_dup.PARITY) >> 6] ^= 1 << (key & 63)
        parity.append(np.array(bits, np.uint64).view(np.int64).tolist())
    banded = spark.createDataFrame([(1, k, len(s), 40) for k, s in enumerate(sets)] + [(2, k, len(sets[k]), 5) for k in range(5)], "band long, set_key long, size int, n long")
    bits = spark.createDataFrame(list(enumerate(parity)), "set_key long, bits array<long>")
    labels = spark.createDataFrame([(k, k // 3) for k in range(40)], "set_key long, label long")
    must = {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 3 != b // 3 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in near_dup.apart_in_bands(banded, bits, labels, 80, False).collect()}
    near = {(r.a, r.b) for r in near_dup.apart_in_bands(banded, bits, labels, 80, True).collect()}
    assert must and must <= got and near <= got and len(near) < len(got) and all(a // 3 != b // 3 for a, b in got) and len(got) < 40 * 39 / 2
    assert near_dup.apart_in_bands(banded, bits, labels.selectExpr("set_key", "1L AS label"), 80, False).count() == 0
