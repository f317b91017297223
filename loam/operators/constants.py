"""Numeric constants: number and unit from text, and how easily one is confused with another of its category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text
from loam.functions.ieee import relative_difference

# The greatest relative differences to the nearest value that are a danger, and a warning.
DANGER, WARN = 0.1, 0.3
#: Steps of the grid that values are dealt out by, to each factor of e.
SLICES = 1000


def tag_confusion(rows: DataFrame, key: str = "id", value: str = "numeric_value", category: str = "category") -> DataFrame:
    """``rows`` with confusion_level, confusion_with (the key of the nearest value) and confusion_diff.

    The nearest other value of the category counts, by relative difference; of equally near ones the least
    key. Values of the same sign within 0.3 of each other are neighbours in sorted order, so each distinct value needs its
    two neighbours alone, not all pairs: rows are summed to distinct values first, which also spreads hot values.
    """
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(category).isNotNull())
    twice = F.slice(F.array_sort(F.array_agg("k")), 1, 2)
    # Two least keys of each part of a value, then of the value: no group is ever gathered whole.
    parts = usable.select(F.col(category).alias("c"), F.col(value).cast("double").alias("v"), F.col(key).alias("k"), F.pmod(F.xxhash64(key), F.lit(64)).alias("p"))
    least = parts.groupBy("c", "v", "p").agg(F.min("k").alias("k1"), F.count("*").alias("n"))
    second = parts.join(least, ["c", "v", "p"]).where("k > k1").groupBy("c", "v", "p").agg(F.min("k").alias("k2"))
    heads = least.join(second, ["c", "v", "p"], "left").select("c", "v", F.explode(F.array("k1", "k2")).alias("k")).where("k IS NOT NULL")
    values = heads.groupBy("c", "v").agg(twice.alias("keys"))  # 128 keys of a value at most
    # Neighbours are found within slices of a category, a grid of SLICES steps to each factor of e, and between a
    # slice's edges: a category's values are never sorted in one task, its slices, whose number is bounded, are.
    step = F.floor(F.least(F.log(F.abs("v")), F.lit(999.0)) * SLICES) + 1000 * SLICES
    values = values.withColumns({"slice": F.when(F.col("v") == 0, 0).otherwise(F.signum("v") * step).cast("long"), "head": F.get("keys", 0)})
    order, across = Window.partitionBy("c", "slice").orderBy("v"), Window.partitionBy("c").orderBy("slice")
    edge = lambda pick: pick(F.struct("v", "head"), "v")
    edges = values.groupBy("c", "slice").agg(edge(F.min_by).alias("low"), edge(F.max_by).alias("high"))
    edges = edges.select("c", "slice", F.lag("high").over(across).alias("before"), F.lead("low").over(across).alias("after"))
    near = values.withColumns({"left": F.lag(F.struct("v", "head")).over(order), "right": F.lead(F.struct("v", "head")).over(order)}).join(edges, ["c", "slice"])
    left, right = F.coalesce("left", "before"), F.coalesce("right", "after")
    near = near.withColumns({"lv": left["v"], "lk": left["head"], "rv": right["v"], "rk": right["head"]})

    def option(other: str, k: str):
        return F.when(F.col(other).isNotNull(), F.struct(relative_difference(F.col("v"), F.col(other)).alias("diff"), F.col(k).alias("with")))

    near = near.withColumn("best", F.array_min(F.filter(F.array(option("lv", "lk"), option("rv", "rk")), lambda x: x.isNotNull())))
    joined = rows.join(near.select("c", "v", "keys", "best"), (rows[category] == near["c"]) & (rows[value].cast("double") == near["v"]), "left")
    own = F.when(F.size("keys") > 1, F.struct(F.lit(0.0).alias("diff"), F.when(F.get("keys", 0) == F.col(key), F.get("keys", 1)).otherwise(F.get("keys", 0)).alias("with")))
    best = F.coalesce(own, F.col("best"))
    level = F.when(best["diff"] <= DANGER, "danger").when(best["diff"] <= WARN, "warn").otherwise("safe")
    close = best["diff"] <= WARN
    return joined.select(*[rows[c] for c in rows.columns], level.alias("confusion_level"), F.when(close, best["with"]).alias("confusion_with"), F.when(close, best["diff"]).alias("confusion_diff"))


def enrich(rows: DataFrame) -> DataFrame:
    """Constants (id, name, value, category) with numeric_value, unit and the confusion columns."""
    parsed = rows.withColumns({"numeric_value": text.parse_numeric(F.col("value"), F.col("category")), "unit": text.extract_unit(F.col("value"))})
    return tag_confusion(parsed)


def stats(enriched: DataFrame) -> DataFrame:
    level = [F.count_if(F.col("confusion_level") == x).alias(x) for x in ("danger", "warn", "safe")]
    return enriched.agg(F.count("*").alias("total"), F.count("numeric_value").alias("numeric_parsed"), F.count("unit").alias("with_unit"), *level)


def resolve(rows: DataFrame, name: str, constants: DataFrame) -> DataFrame:
    """``rows`` with value: the number of the constant that the column ``name`` names, null where there is none.

    ``constants`` has id, name and numeric_value; of several with one name the last by id counts. Names are joined, not collected.
    """
    known = constants.groupBy(F.col("name").alias(name)).agg(F.max_by("numeric_value", "id").alias("value"))
    return rows.drop("value").join(known, name, "left")


def risk_text(tagged: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """``tagged`` with confusion_risk: the name of the nearest constant and the difference in percent; null where it is safe."""
    other = names.select(F.col(key).alias("confusion_with"), F.col("name").alias("_other"))
    text_of = F.concat(F.col("_other"), F.lit(" (차이 "), text.one_decimal_percent(F.col("confusion_diff")), F.lit(")"))
    return tagged.join(other, "confusion_with", "left").withColumn("confusion_risk", text_of).drop("_other")
