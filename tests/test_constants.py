import random

from loam.operators import constants


def nearest(rows):
    """Level and key of the nearest other value of the category, by all pairs."""
    out = {}
    for k, v, c in rows:
        best = None
        if v is not None and c is not None:
            for k2, v2, c2 in rows:
                if k2 != k and c2 == c and v2 is not None:
                    diff = 0 if v == v2 else abs(v - v2) / max(abs(v), abs(v2))
                    best = min(best or (9, ""), (diff, k2))
        if best is None or best[0] > constants.WARN:
            out[k] = "safe", None
        else:
            out[k] = "danger" if best[0] <= constants.DANGER else "warn", best[1]
    return out


def test_confusion_against_all_pairs(spark):
    """Values of both signs and many sizes, ties, repeats, zeros, nulls, and categories of one."""
    draw = random.Random(6)
    rows = [(i, draw.choice([-1, 1]) * draw.choice([0.0, 1e-9, 1.0, 7.0, 300.0, 1e12]) * round(draw.uniform(0.5, 2), 3), draw.choice("abc")) for i in range(300)]
    rows += [(1000, None, "a"), (1001, 3.0, None), (1002, 5.0, "alone"), (1003, 0.0, "zero"), (1004, -0.0, "zero"), (1005, 1e300, "far"), (1006, 1.1e300, "far")]
    got = constants.tag_confusion(spark.createDataFrame(rows, "id long, numeric_value double, category string")).collect()
    assert {r.id: (r.confusion_level, r.confusion_with) for r in got} == nearest(rows)


def test_resolved_constants(spark):
    known = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", None)], "id long, name string, numeric_value double")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "wanted string")
    assert {r.wanted: r.value for r in constants.resolve(rows, "wanted", known).collect()} == {"a": 2.0, "b": None, "c": None, None: None}
