from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loam.plans import formula as fm

GOLDEN = (Path(fm.__file__).parent / "golden_formulas.txt").read_text().splitlines()


def cases(spark, rows):
    return spark.createDataFrame([(i, f, m) for i, (f, m) in enumerate(rows)], "n int, formula_id string, inputs map<string,double>")


def test_catalogue_is_whole():
    assert len(fm.catalogue()) == 68


def test_golden_values(spark):
    rows, wanted = [], []
    for line in GOLDEN:
        name, inputs, value, tolerance = (x.strip() for x in line.split(" | "))
        rows.append((name, {k.strip(): float(v) for k, v in (x.split(":") for x in inputs.split(","))}))
        wanted.append((float(value), float(tolerance)))
    assert len(rows) == 119
    got = {r.n: r.result for r in fm.evaluate_cases(cases(spark, rows)).collect()}
    wrong = [(rows[i], got[i].value, v) for i, (v, t) in enumerate(wanted) if not got[i].ok or abs(got[i].value - v) > t]
    assert not wrong


def test_error_codes(spark):
    rows = [("F-99", {}), ("F-01", {"damaged_fruits": 1.0}), ("F-03", {"total_sample": 10.5, "variety_target": 1.0, "total_target": 2.0}),
            ("F-06", {"defoliation_rate": 1.5, "elapsed_days": 1.0}), ("F-02", {"defoliated": 0.0, "attached": 0.0}),
            ("F-01", {"damaged_fruits": -1.0, "normal_fruits": 0.5}), ("F-07", {"defoliation_rate": 0.5, "more": 1.0})]
    got = {r.n: r.result for r in fm.evaluate_cases(cases(spark, rows)).collect()}
    assert [got[i].code for i in range(7)] == ["FORMULA_NOT_FOUND", "VARIABLE_MISSING", "VARIABLE_TYPE_MISMATCH", "CONSTRAINT_VIOLATION", "DIVISION_BY_ZERO", "CONSTRAINT_VIOLATION", None]
    assert len(got[5].details) == 2 and got[1].details is None
    assert got[6].warnings == ["unrecognised variable more"]


@pytest.mark.parametrize("text", ["a > 0 ? a : 0", "[1,2]", "1:10", "x = 1", "eval(1)", "import", "'a'", "Abc", "f(1)", "a.b", "__x", "x" * 1025, "a if b else c", "max()"])
def test_unsafe_expressions_do_not_parse(text):
    with pytest.raises(fm.ParseFailed):
        fm.parse(text)


def test_variables_in_order_of_use():
    assert fm.variables_of("max(b - a, 0) * b ^ c") == ["b", "a", "c"]
    assert fm.variables_of("b +") is None


def test_ieee_cases(spark):
    from loam.functions import ieee

    one, zero, nan = F.lit(1.0), F.lit(0.0), F.lit(float("nan"))
    row = spark.range(1).select(
        ieee.div(one, zero).alias("inf"), F.isnan(ieee.div(zero, zero)).alias("nan"), F.isnan(ieee.largest(ieee.div(zero, zero), zero)).alias("max"),
        F.isnan(ieee.smallest(nan, one)).alias("min"), ieee.round_to(F.lit(-2.5), 0).alias("half"), ieee.round_away(F.lit(-2.5)).alias("away"),
        ieee.coerce(F.lit("")).alias("blank"), ieee.coerce(F.lit("0x10")).alias("hex"), F.isnan(ieee.coerce(F.lit("1d"))).alias("bad"), ieee.coerce(F.lit(" 1e3 ")).alias("num"),
    ).first()
    assert list(row) == [float("inf"), True, True, True, -2.0, -3.0, 0.0, 16.0, True, 1000.0]
