import numpy as np
import pytest

from loam import catalogue
from loam.operators import events, vectors

SCHEMA = "vec_id long, embedding array<float>"


def expected(points, asked, k, floor):
    held = {i: np.array(v, np.float32).astype(float) for i, v in points if v and None not in v and np.any(v)}
    ids = np.array(sorted(held))
    unit = np.array([held[i] / np.linalg.norm(held[i]) for i in ids])
    out = []
    for q in asked:
        if q in held:
            near = np.round(unit @ (held[q] / np.linalg.norm(held[q])) + 1e-9, 6)
            best = sorted((-s, i) for s, i in zip(near, ids, strict=True) if i != q and s >= floor)[:k]
            out += [(q, r + 1, int(i), float(-s)) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("part", [100_000, 40])
def test_against_all_pairs(spark, part):
    """Clustered and stray vectors, equal ones, zero and null ones, and a cluster with most vectors in many parts."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    points = [(i, (centres[0 if i % 3 else i % 12] + 0.3 * draw.normal(size=16)).tolist()) for i in range(700)]
    points += [(1000 + i, draw.normal(size=16).tolist()) for i in range(60)]
    points += [(2000 + i, points[0][1]) for i in range(9)] + [(3000, [0.0] * 16), (3001, None), (3002, [None] * 16)]
    frame = spark.createDataFrame(points, SCHEMA)
    asked = frame.where("vec_id % 20 = 0 OR vec_id > 2000")
    for floor, sample in ((0.6, 20_000), (0.1, 200)):
        got = vectors.nearest(frame, asked, 5, floor, part=part, sample=sample).collect()
        want = expected(points, [i for i, _ in points if i % 20 == 0 or i > 2000], 5, floor)
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 6)) for r in got) == sorted((q, r, i, round(s, 6)) for q, r, i, s in want)


def test_nothing_there(spark):
    some, none = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert vectors.nearest(none, some).collect() == [] and vectors.nearest(some, none).collect() == [] and vectors.nearest(some, some).collect() == []


def test_ranks_go_by_rounded_similarity(spark, tmp_path):
    """Similarities that differ behind the sixth decimal only are ties, which go by vec_id."""
    rows = [(20, [1.0, 0.0], 1), (31, [1.0, 0.3000001], 1), (30, [1.0, 0.3000002], 1), (32, [1.0, 0.2], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["rank"], r.vec_id) for r in catalogue.QUERIES["vector_topk"](spark, str(tmp_path)).collect())
    assert got == [(1, 32), (2, 30), (3, 31)]


def test_top_similar_in_parts(spark):
    """Labels of several parts and blocks, equal vectors across them, zero, null and NaN ones, null labels and other lengths; pairs are no rows."""
    draw = np.random.default_rng(4)
    points = [(i, [float(np.float32(x)) for x in draw.normal(size=8)], 0 if i % 3 else i % 7) for i in range(600)]
    points += [(1000 + 10 * i, points[20][1], points[20][2]) for i in range(30)]
    points += [(2000, [0.0] * 8, 0), (2020, None, 0), (2040, [None] * 8, 0), (2060, points[0][1], None), (2080, [float("nan")] * 8, 3), (2100, points[0][1][:5], 0), (2101, points[1][1][:5], 0)]
    frame = spark.createDataFrame(points, "vec_id long, embedding array<float>, label int")
    asked = frame.where("vec_id % 20 = 0")
    want = []
    for q, a, label in points:
        if q % 20 == 0 and a and None not in a and label is not None and any(a):
            near = []
            for v, b, other in points:
                if v != q and other == label and b and None not in b and any(b) and len(a) == len(b):
                    x, y = np.array(a), np.array(b)
                    near.append((float(np.round(x @ y / np.sqrt((x @ x) * (y @ y)) + 1e-9, 6)), v))
            near = sorted(((s, v) for s, v in near if not s < 0.1), key=lambda t: (-(np.inf if np.isnan(t[0]) else t[0]), t[1]))[:5]
            want += [(q, r + 1, v, str(s)) for r, (s, v) in enumerate(near)]
    for limits in ({}, {"vector_bytes": 2000, "query_bytes": 700}):
        got = events.top_similar(frame, asked, 5, 0.1, digits=6, nudge=1e-9, **limits)
        assert sorted((r.query_id, r["rank"], r.vec_id, str(r.similarity)) for r in got.collect()) == sorted(want)
        assert "zip_with" not in got._jdf.queryExecution().toString()
    assert events.top_similar(frame.limit(0), asked).collect() == [] and events.top_similar(frame, asked.limit(0)).collect() == []
