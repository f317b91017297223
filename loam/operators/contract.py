"""Knowledge contracts in JSON: extraction from a reply, and every violation of the ontology as a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ontology.
NODE_IDS = {"LAW": r"^LAW-\d{3}$", "FORMULA": r"^F-\d{2}$", "INVESTIGATION": r"^INV-\d{3}$", "INSURANCE": r"^INS-\d{2}$", "CROP": r"^CROP-\d{3}$", "CONCEPT": r"^CONCEPT-\d{3}$", "TERM": r"^TERM-\d{3}$"}
EDGE_TYPES = "APPLIES_TO REQUIRES_INVESTIGATION PREREQUISITE USES_FORMULA DEPENDS_ON GOVERNED_BY DEFINED_AS EXCEPTION TIME_CONSTRAINT SUPERSEDES SHARED_WITH DIFFERS_FROM CROSS_REF".split()
CATEGORIES = "threshold coefficient date ratio sample deductible insurance_rate".split()
FORMULA_ID, CONSTANT_ID = r"^F-\d{2}$", r"^CONST-\d{3}$"
TRUTH_WEIGHT = {"LAW": 10, "FORMULA": 8, "INVESTIGATION": 7, "INSURANCE": 6, "CROP": 6, "CONCEPT": 5, "TERM": 3}

SCHEMA = """nodes array<struct<id:string,type:string,title:string,content:string,lv1_insurance:string,lv2_crop:string,lv3_investigation:string,truth_weight:double,source_page:int>>,
edges array<struct<source_id:string,target_id:string,edge_type:string,condition:string>>,
formulas array<struct<id:string,name:string,equation_template:string,variables_schema:string>>,
constants array<struct<id:string,name:string,value:string,category:string>>"""
PARTS = ("nodes", "edges", "formulas", "constants")


def assert_ontology(node_ids: dict[str, str] = NODE_IDS, edge_types: list[str] = EDGE_TYPES, categories: list[str] = CATEGORIES) -> None:
    """Raises unless the ontology has types, unique names and anchored patterns."""
    if not (node_ids and edge_types and categories):
        raise ValueError("the ontology has an empty part")
    if len(set(edge_types)) != len(edge_types) or len(set(categories)) != len(categories):
        raise ValueError("the ontology repeats a name")
    if any(not (p.startswith("^") and p.endswith("$")) for p in node_ids.values()):
        raise ValueError("a pattern of the ontology is not anchored")


def type_of(node_id: Column) -> Column:
    """The node type whose pattern the id fits; null for none."""
    return F.coalesce(*[F.when(node_id.rlike(p), F.lit(t)) for t, p in NODE_IDS.items()])


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the column, which is computed once however often it stands there."""
    return F.get(F.transform(F.array(c), then), 0)


def parse_reply(reply: Column) -> Column:
    """The JSON of a reply, from its fenced block if there is one, as a struct; arrays that are missing are empty.

    Null if the JSON is malformed or all four arrays are empty.
    """
    # Each step is bound once: as plain columns every part of the struct would parse the reply anew.
    text = _once(reply, lambda r: _once(F.regexp_extract(r, r"(?s)```(?:json)?\s*(.*?)```", 1), lambda fenced: F.when(fenced != "", fenced).otherwise(r)))

    def full(parsed: Column) -> Column:
        some = reduce(Column.__or__, [F.size(parsed[p]) > 0 for p in PARTS])
        return F.when(some, F.struct(*[F.coalesce(parsed[p], F.array().cast(dict(_types())[p])).alias(p) for p in PARTS]))

    return _once(F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}), full)


def _types() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SCHEMA).fields]


def _error(when: Column, code: str, where: str | Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(where) if isinstance(where, str) else where).alias("field")))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _rows(contracts: DataFrame, part: str, key: str) -> DataFrame:
    return contracts.select(key, F.posexplode(f"contract.{part}").alias("idx", "x")).select(key, "idx", "x.*")


def _checked(rows: Column, part: str, checks: Callable[[Column, Column], list[Column]]) -> Column:
    """part, idx, code, field of every one of the checks that a row of the part fails."""
    named = lambda i: lambda e: F.struct(F.lit(part).alias("part"), i.alias("idx"), e["code"].alias("code"), e["field"].alias("field"))
    return F.flatten(F.transform(rows, lambda x, i: F.transform(F.filter(F.array(*checks(x, i)), lambda e: e.isNotNull()), named(i))))


def _named(node: Column) -> Column:
    return ~_blank(node["id"]) & ~_blank(node["type"])


def violations(contract: Column) -> Column:
    """Array of part, idx, code, field: every violation of one contract, as ``validate`` has them; empty for null.

    A contract is one row, so its references are looked up in its own ids and no rows are moved.
    """

    def found(ids: Column) -> Column:
        def node(x: Column, i: Column) -> list[Column]:
            named, kind, weight = _named(x), x["type"], x["truth_weight"]
            known = kind.isin(*NODE_IDS)
            fits = reduce(lambda c, t: c.when(kind == t, x["id"].rlike(NODE_IDS[t])), list(NODE_IDS)[1:], F.when(kind == "LAW", x["id"].rlike(NODE_IDS["LAW"])))
            bad_weight = (weight != F.floor(weight)) | (weight < 1) | (weight > 10)
            return [
                _error(_blank(x["id"]), "MISSING_REQUIRED_FIELD", "id"),
                _error(~_blank(x["id"]) & _blank(kind), "MISSING_REQUIRED_FIELD", "type"),
                _error(named & (F.array_position(ids, x["id"]) <= i), "DUPLICATE_NODE_ID", "id"),
                _error(named & ~known, "INVALID_NODE_TYPE", "type"),
                _error(named & known & ~fits, "INVALID_NODE_ID", "id"),
                _error(named & _blank(x["title"]), "MISSING_REQUIRED_FIELD", "title"),
                _error(named & _blank(x["content"]), "MISSING_REQUIRED_FIELD", "content"),
                _error(named & (weight.isNull() | F.isnan(weight)), "MISSING_REQUIRED_FIELD", "truth_weight"),
                _error(named & weight.isNotNull() & ~F.isnan(weight) & bad_weight, "INVALID_TRUTH_WEIGHT", "truth_weight"),
            ]

        def edge(x: Column, i: Column) -> list[Column]:
            ends = []
            for side in ("source_id", "target_id"):
                given = ~_blank(x[side])
                ends.append(_error(~given, "MISSING_REQUIRED_FIELD", side))
                ends.append(_error(given & type_of(x[side]).isNull(), "INVALID_NODE_REFERENCE", side))
                ends.append(_error(given & (F.array_position(ids, x[side]) == 0), "DANGLING_REFERENCE", side))
            return [*ends, _error(x["edge_type"].isNull() | ~x["edge_type"].isin(*EDGE_TYPES), "INVALID_EDGE_TYPE", "edge_type")]

        wrong = lambda c, p: c.isNull() | ~c.rlike(p)
        outside = lambda c: c.isNull() | ~c.isin(*CATEGORIES)
        return F.concat(
            _checked(contract["nodes"], "nodes", node),
            _checked(contract["edges"], "edges", edge),
            _checked(contract["formulas"], "formulas", lambda x, i: [_error(wrong(x["id"], FORMULA_ID), "INVALID_FORMULA_ID", "id")]),
            _checked(contract["constants"], "constants", lambda x, i: [_error(wrong(x["id"], CONSTANT_ID), "INVALID_CONSTANT_ID", "id"), _error(outside(x["category"]), "INVALID_CONSTANT_CATEGORY", "category")]),
        )

    none = F.array().cast("array<struct<part:string,idx:int,code:string,field:string>>")
    # The id at the place of each declared node, null at the others.
    return F.coalesce(_once(F.transform(contract["nodes"], lambda x: F.when(_named(x), x["id"])), found), none)


def validate(contracts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, part, idx, code, field: every violation of ``contracts`` (key, contract), as ``parse_reply`` gives it.

    A node without id or type is not looked at further and is not declared; edges must end at declared nodes of the
    same contract. All violations are found, none hides another.
    """
    return contracts.select(key, F.explode(violations(F.col("contract"))).alias("e")).select(key, "e.*")


def report(contracts: DataFrame, key: str = "doc_id", samples: int = 3) -> DataFrame:
    """One row for each contract: sizes of its arrays, number of violations, valid, and the first few as text."""
    sizes = [F.size(f"contract.{p}").alias(f"n_{p}") for p in PARTS]
    found = contracts.select(key, *sizes, F.col("contract").isNotNull().alias("parsed"), violations(F.col("contract")).alias("errors"))
    n = F.size("errors").cast("long")
    path = F.transform("errors", lambda e: F.format_string("%s[%d].%s: %s", e["part"], e["idx"], e["field"], e["code"]))
    return found.select(key, *[f"n_{p}" for p in PARTS], n.alias("n_errors"), (F.col("parsed") & (n == 0)).alias("valid"), F.slice(F.sort_array(path), 1, samples).alias("samples"))


def to_tables(contracts: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Rows for loading: contract names as the tables' columns, with the type's truth weight where none is given."""
    default = reduce(lambda c, t: c.when(F.col("type") == t, TRUTH_WEIGHT[t]), list(TRUTH_WEIGHT)[1:], F.when(F.col("type") == "LAW", TRUTH_WEIGHT["LAW"]))
    nodes = _rows(contracts, "nodes", key).select(key, "id", "type", F.col("title").alias("name"), F.col("content").alias("description"), "lv1_insurance", "lv2_crop", "lv3_investigation", F.col("source_page").cast("string").alias("page_ref"), F.coalesce(F.col("truth_weight").cast("int"), default).alias("truth_weight"))
    edges = _rows(contracts, "edges", key).select(key, F.concat_ws(":", "source_id", "edge_type", "target_id").alias("id"), F.col("source_id").alias("from_node"), F.col("target_id").alias("to_node"), "edge_type", "condition")
    return {"knowledge_nodes": nodes, "knowledge_edges": edges, "formulas": _rows(contracts, "formulas", key), "constants": _rows(contracts, "constants", key)}


def batch_results(contracts: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each reply: status (success, failed) and error, which names the number of violations and the first three."""
    rows = report(contracts, key)
    found = F.concat(F.lit("Ontology validation failed: "), F.col("n_errors").cast("string"), F.lit(" error(s). Sample: "), F.array_join("samples", "; "))
    n = sum((F.col(f"n_{p}") for p in PARTS[1:]), F.col(f"n_{PARTS[0]}"))
    error = F.when(n.isNull() | (n < 0), "the reply holds no contract").when(F.col("n_errors") > 0, found)
    return rows.select(key, F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"))


# The stages of a batch in order, and the five batches.
STAGES = "pdf_extract section_split batch_structurize constants_extract db_load integrity_check human_review formula_verify qg2_gate".split()
BATCHES = [
    ("BATCH-1", "p.403~434", "적과전 종합위험", 60, 200, 13), ("BATCH-2", "p.435~500", "종합위험 수확감소 16종", 80, 300, 17), ("BATCH-3", "p.501~521", "논작물(벼, 맥류)", 40, 120, 8),
    ("BATCH-4", "p.522~576", "밭작물", 60, 200, 15), ("BATCH-5", "p.577~647", "시설작물 + 수입감소", 60, 200, 15),
]


def batches(spark) -> DataFrame:
    return spark.createDataFrame(BATCHES, "batch_id string, page_range string, description string, expected_nodes int, expected_edges int, expected_formulas int")


def stage_results(outcomes: DataFrame, key: str = "batch_id") -> DataFrame:
    """key, pos, stage, status of every stage of every batch in ``outcomes`` (key, stage, ok): success, failed, or skipped.

    A stage runs only after all before it succeeded; one without an outcome is skipped, and so is what comes behind it. A batch is one
    row of its stages' outcomes before it becomes rows, so nothing is joined.
    """
    own = [F.when(F.col(key).isNotNull() & (F.col("stage") == stage), F.col("ok")) for stage in STAGES]
    rows = outcomes.groupBy(key).agg(*[F.bool_and(ok).alias(f"_ok{n}") for n, ok in enumerate(own)])
    found, through = [], F.lit(True)
    for n, stage in enumerate(STAGES):
        ok = F.col(f"_ok{n}")
        status = F.when(~through | ok.isNull(), "skipped").when(ok, "success").otherwise("failed")
        found.append(F.struct(F.lit(stage).alias("stage"), status.alias("status")))
        through = through & F.coalesce(ok, F.lit(False))
    return rows.select(key, F.posexplode(F.array(*found)).alias("pos", "_x")).select(key, "pos", "_x.stage", "_x.status")
