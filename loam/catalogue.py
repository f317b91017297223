"""The queries outside ``loam.llm``, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import crypto, text
from loam.functions.storage import materialize
from loam.operators import constants, contract, etl, events, graph, rules
from loam.plans import formula as fm
from loam.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- formulas -------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(floor(l_extendedprice * greatest(l_discount - l_tax, 0) + 0.5)) AS DOUBLE) AS total
FROM lineitem GROUP BY l_returnflag""")
def formula_f14_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount", "l_tax")
    done = fm.with_result(rows, "F-14", {"insured_amount": "l_extendedprice", "damage_rate": "l_discount", "deductible_rate": "l_tax"})
    return done.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("result.value").alias("total"))


@query("""SELECT p_partkey, floor((greatest((p_retailprice - p_size - 10.0) / p_retailprice, 0) + 2.220446049250313e-16) * 10000 + 0.5) / 10000 AS value FROM part""")
def formula_f15_part(spark, sf):
    done = fm.with_result(table(spark, sf, "part"), "F-15", {"standard_yield": "p_retailprice", "actual_yield": F.col("p_size").cast("double"), "uncompensated_loss": F.lit(10.0)})
    return done.select("p_partkey", F.col("result.value").alias("value"))


@query("""SELECT l_linestatus, CAST(sum(floor(least(greatest(l_extendedprice * 0.10, 100.0), 3000.0) + 0.5)) AS DOUBLE) AS total FROM lineitem GROUP BY l_linestatus""")
def formula_f55_lineitem(spark, sf):
    done = fm.with_result(table(spark, sf, "lineitem"), "F-55", {"damage_amount": "l_extendedprice", "min_deductible": F.lit(100.0), "max_deductible": F.lit(3000.0)})
    return done.groupBy("l_linestatus").agg(F.sum("result.value").alias("total"))


@query("""WITH n AS (SELECT o_orderkey, count(l_orderkey) AS lines, count(*) FILTER (WHERE l_linestatus = 'O') AS open FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT CASE WHEN lines = 0 THEN 'DIVISION_BY_ZERO' ELSE 'OK' END AS code, count(*) AS n,
  coalesce(round(sum(CASE WHEN lines > 0 THEN floor((open / lines + 2.220446049250313e-16) * 10000 + 0.5) / 10000 END), 4), 0.0) AS total FROM n GROUP BY 1""")
def formula_div0_orders(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0, ["lines", "open"])
    done = fm.with_result(rows, "F-01", {"damaged_fruits": "open", "normal_fruits": F.col("lines") - F.col("open")})
    return done.groupBy(F.coalesce("result.code", F.lit("OK")).alias("code")).agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("result.value"), 4), F.lit(0.0)).alias("total"))


def _sql_of(template: str) -> str:
    """A catalogue template in SQL, for inputs without a zero denominator; numbers as doubles."""
    out = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", r"CAST(\1 AS DOUBLE)", template)
    return re.sub(r"\bmax\(", "greatest(", re.sub(r"\bmin\(", "least(", out))


def _drawn(v: fm.Variable, i: int) -> str:
    """A deterministic input of a variable from p_partkey, in both engines' SQL."""
    if v.kind == "r":
        return f"CAST((p_partkey * {7 * i + 3}) % 101 AS DOUBLE) / 100"
    return f"CAST((p_partkey * {7 * i + 5}) % 29 + 1 AS DOUBLE)"


def _all_formulas_sql() -> str:
    parts = []
    for f in fm.catalogue().values():
        inputs = ", ".join(f"{_drawn(v, i)} AS {v.name}" for i, v in enumerate(f.variables))
        raw, p = _sql_of(f.template), f.precision
        value = f"floor(({raw}) + 0.5)" if p == 0 else f"floor((({raw}) + 2.220446049250313e-16) * {10**p}.0 + 0.5) / {10**p}.0"
        parts.append(f"SELECT '{f.id}' AS formula_id, count(*) AS n, round(CAST(sum({value}) AS DOUBLE), 3) AS total FROM (SELECT {inputs} FROM part)")
    return "\nUNION ALL ".join(parts)


#: Formulas whose results one scan carries; a plan for all of them would be too large to compile.
FORMULAS_A_SCAN = 6


@query(_all_formulas_sql())
def formula_all(spark, sf):
    """All formulas, some of them over each scan: their results are columns of a row, which are summed together and stacked."""
    part, known, out = table(spark, sf, "part").select("p_partkey"), list(fm.catalogue().values()), None
    for start in range(0, len(known), FORMULAS_A_SCAN):
        some, rows = known[start : start + FORMULAS_A_SCAN], part
        for f in some:
            rows = fm.with_result(rows, f, {v.name: F.expr(_drawn(v, i)) for i, v in enumerate(f.variables)}, name=f.id)
            rows = rows.withColumn(f.id, F.col(f"`{f.id}`.value"))
        one = rows.agg(F.count("*").alias("n"), *[F.round(F.sum(F.col(f"`{f.id}`")), 3).alias(f.id) for f in some])
        listed = F.array(*[F.struct(F.lit(f.id).alias("formula_id"), F.col(f"`{f.id}`").alias("total")) for f in some])
        rows = one.select("n", F.explode(listed).alias("f")).select("f.formula_id", "n", "f.total")
        out = rows if out is None else out.union(rows)
    return out


@query("""SELECT * FROM (VALUES ('F-01', 'VARIABLE_MISSING'), ('F-02', 'DIVISION_BY_ZERO'), ('F-03', 'VARIABLE_TYPE_MISMATCH'), ('F-06', 'CONSTRAINT_VIOLATION'), ('F-99', 'FORMULA_NOT_FOUND')) AS t(formula_id, code)""")
def formula_errors(spark, sf):
    rows = [("F-99", {}), ("F-01", {"damaged_fruits": 1.0}), ("F-03", {"total_sample": 10.5, "variety_target": 1.0, "total_target": 2.0}), ("F-06", {"defoliation_rate": 1.5, "elapsed_days": 1.0}), ("F-02", {"defoliated": 0.0, "attached": 0.0})]
    cases = spark.createDataFrame(rows, "formula_id string, inputs map<string,double>")
    known = {k: fm.catalogue()[k] for k in ("F-01", "F-02", "F-03", "F-06")}
    return fm.evaluate_cases(cases, known).select("formula_id", F.col("result.code").alias("code"))


# --- graph ----------------------------------------------------------------------------------------


def _graph(spark, sf):
    """Orders and their customers' parts as a graph: order nodes, line edges to parts; open lines are active."""
    lines = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").cast("string").alias("from_node"), F.concat(F.lit("P"), F.col("l_partkey")).alias("to_node"), F.lit("DEPENDS_ON").alias("edge_type"), (F.col("l_linestatus") == "O").alias("is_active"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("CONCEPT").alias("type"), F.when(F.col("o_orderstatus") == "F", False).alias("is_active"))
    parts = table(spark, sf, "part").where("p_size < 40").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.lit("TERM").alias("type"), F.lit(True).alias("is_active"))
    return orders.union(parts), lines


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""")
def graph_orphans(spark, sf):
    return graph.orphan_nodes(*_graph(spark, sf)).select("id")


@query("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_id, 'to' AS side, 'P' || l_partkey AS missing_node FROM lineitem
WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)
UNION ALL SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'from', CAST(l_orderkey AS VARCHAR) FROM lineitem
WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""")
def graph_broken_edges(spark, sf):
    return graph.broken_edges(*_graph(spark, sf))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(o AS INTEGER) AS occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS o FROM lineitem) WHERE o > 1""")
def graph_duplicates(spark, sf):
    rows = graph.repeated_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * p_partkey + 3) % 1009 AS b FROM part),
image(k, id) AS (SELECT 0, a FROM e UNION SELECT k + 1, b FROM image JOIN e ON id = a WHERE k < 1009) SELECT DISTINCT id FROM image WHERE k = 1009""")
def graph_cycles(spark, sf):
    k = F.col("p_partkey")
    edges = table(spark, sf, "part").select(k.alias("from_node"), ((k * k + 3) % 1009).alias("to_node"), F.lit("SUPERSEDES").alias("edge_type"), F.lit(None).cast("boolean").alias("is_active"))
    return graph.nodes_on_cycles(edges).select("id")


_STATS = """WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus <> 'F' AS act, FALSE AS term FROM orders UNION ALL SELECT 'P' || p_partkey, TRUE, TRUE FROM part WHERE p_size < 40),
e AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(l_orderkey AS VARCHAR) AS a, 'P' || l_partkey AS b, l_linestatus = 'O' AS act FROM lineitem),
s AS (SELECT (SELECT count(*) FROM n) AS total_nodes, (SELECT count(*) FROM n WHERE act) AS active_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM e WHERE act) AS active_edges,
  CAST(0 AS BIGINT) AS n_invalid_id, (SELECT count(*) - count(DISTINCT id) FROM e) AS n_duplicate_id,
  (SELECT count(*) FROM n WHERE act AND NOT term AND NOT EXISTS (SELECT 1 FROM e WHERE e.act AND (e.a = n.id))) AS n_orphan_node,
  (SELECT count(*) FROM e WHERE act AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.b)) + (SELECT count(*) FROM e WHERE act AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.a)) AS n_broken_edge,
  CAST(0 AS BIGINT) AS n_supersede_cycle)"""


def _stats(spark, sf):
    nodes, edges = _graph(spark, sf)
    # Every kind of violation reads the graph: it is put together once.
    nodes, edges = (materialize(df.withColumn("_pos", F.col("id")), name) for df, name in ((nodes, "nodes"), (edges, "edges")))
    return graph.integrity_stats(nodes, edges, graph.integrity(nodes, edges))


@query(_STATS + " SELECT *, n_invalid_id + n_duplicate_id + n_orphan_node + n_broken_edge + n_supersede_cycle = 0 AS valid FROM s")
def graph_report(spark, sf):
    return _stats(spark, sf)


@query(_STATS + """ SELECT 'active_nodes' AS "check", active_nodes AS actual, CAST(40 AS BIGINT) AS required, active_nodes >= 40 AS passed FROM s
UNION ALL SELECT 'active_edges', active_edges, 80, active_edges >= 80 FROM s UNION ALL SELECT 'formula_registry', 68, 7, TRUE FROM s
UNION ALL SELECT 'formula_accuracy', 1, 2, FALSE FROM s UNION ALL SELECT 'no_orphan_node', n_orphan_node, 0, n_orphan_node = 0 FROM s
UNION ALL SELECT 'no_broken_edge', n_broken_edge, 0, n_broken_edge = 0 FROM s UNION ALL SELECT 'no_supersede_cycle', n_supersede_cycle, 0, n_supersede_cycle = 0 FROM s""")
def gate_report(spark, sf):
    cases = spark.createDataFrame([("F-01", {"damaged_fruits": 30.0, "normal_fruits": 70.0}, 0.3), ("F-02", {"defoliated": 45.0, "attached": 55.0}, 0.5)], "formula_id string, inputs map<string,double>, expected double")
    done = fm.evaluate_cases(cases, {k: fm.catalogue()[k] for k in ("F-01", "F-02")})
    accuracy = done.select(F.coalesce(F.col("result.ok") & (F.abs(F.col("result.value") - F.col("expected")) <= 1e-4), F.lit(False)).alias("passed"))
    return graph.gate(_stats(spark, sf), len(fm.catalogue()), accuracy)


def _subgraph(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_size").alias("truth_weight"), F.col("p_partkey").alias("_pos"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("from_node"), ((F.col("l_partkey") * 7) % 2000).alias("to_node"), (F.col("l_linestatus") == "O").alias("is_active"))
    return graph.subgraph(nodes, lines)


@query("SELECT p_partkey AS id, p_size AS truth_weight FROM part ORDER BY p_size DESC, p_partkey LIMIT 100")
def subgraph_top100(spark, sf):
    return _subgraph(spark, sf)[0].select("id", "truth_weight")


@query("""WITH k AS (SELECT p_partkey AS id FROM part ORDER BY p_size DESC, p_partkey LIMIT 100)
SELECT l_partkey AS from_node, (l_partkey * 7) % 2000 AS to_node, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_partkey IN (SELECT id FROM k) AND (l_partkey * 7) % 2000 IN (SELECT id FROM k) GROUP BY 1, 2""")
def subgraph_edges(spark, sf):
    return _subgraph(spark, sf)[1].groupBy("from_node", "to_node").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def temporal_current(spark, sf):
    return graph.current_versions(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01') WHERE r = 1""")
def temporal_asof(spark, sf):
    return graph.current_versions(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.lit("1995-06-01").cast("timestamp")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT a.s_suppkey, n_name, r_name FROM supplier a JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def graph_endpoints(spark, sf):
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name")).union(table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")), F.col("r_name")))
    edges = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("N"), F.col("n_nationkey")).alias("from_node"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("to_node"))
    return graph.endpoints(nodes, edges, ["name"]).select("s_suppkey", F.col("from_name").alias("n_name"), F.col("to_name").alias("r_name"))


# --- constants and contracts ----------------------------------------------------------------------


@query("""WITH x AS (SELECT a.s_suppkey AS id, CASE WHEN a.s_acctbal = b.s_acctbal THEN 0 ELSE abs(a.s_acctbal - b.s_acctbal) / greatest(abs(a.s_acctbal), abs(b.s_acctbal)) END AS d, b.s_suppkey AS other
  FROM supplier a LEFT JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey),
m AS (SELECT id, min(d) AS d FROM x GROUP BY id), t AS (SELECT x.id, m.d, min(other) AS other FROM x JOIN m ON x.id = m.id AND x.d = m.d GROUP BY 1, 2)
SELECT s_suppkey AS id, CASE WHEN d <= 0.1 THEN 'danger' WHEN d <= 0.3 THEN 'warn' ELSE 'safe' END AS confusion_level, CASE WHEN d <= 0.3 THEN other END AS confusion_with FROM supplier LEFT JOIN t ON id = s_suppkey""")
def confusion_tagging(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("numeric_value"), (F.col("s_nationkey") % 5).cast("string").alias("category"))
    return constants.tag_confusion(rows).select("id", "confusion_level", "confusion_with")


_VALUES = [("65%", "threshold", 65.0, "%"), ("1.0115배수", "coefficient", 1.0115, "배수"), ("1.5배", "coefficient", 1.5, "배"), ("30일", "threshold", 30.0, "일"), ("1,000원", "threshold", 1.0, "원"), ("3만원", "threshold", 3.0, "만원"), ("1/3", "ratio", 1 / 3, None), ("5/0", "ratio", None, None), ("-1/2", "ratio", -1.0, None), (".5", "ratio", 0.5, None), ("N/A", "ratio", None, None), ("2024년 5월", "date", None, None), ("2025년 6월", "threshold", None, None), ("65~70%", "threshold", 65.0, "%"), ("6개월", "threshold", 6.0, "개월"), ("12kg", "sample", 12.0, "kg")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', {'CAST(NULL AS DOUBLE)' if n is None else f'CAST({n!r} AS DOUBLE)'}, {'NULL' if u is None else repr(u)})" for v, _, n, u in _VALUES) + ") AS t(value, numeric_value, unit)")
def parse_values(spark, sf):
    rows = spark.createDataFrame([(v, c) for v, c, *_ in _VALUES], "value string, category string")
    return rows.select("value", text.parse_numeric(F.col("value"), F.col("category")).alias("numeric_value"), text.extract_unit(F.col("value")).alias("unit"))


_REPLY = """Here it is:\n```json\n{"nodes":[{"id":"LAW-001","type":"LAW","title":"a","content":"b","truth_weight":10},{"id":"LAW-001","type":"LAW","title":"","content":"b","truth_weight":11},{"type":"LAW"},{"id":"X-1","type":"NONE","title":"a","content":"b","truth_weight":2.5}],"edges":[{"source_id":"LAW-001","target_id":"CROP-001","edge_type":"LINKS"}],"formulas":[{"id":"F-1"}],"constants":[{"id":"CONST-001","category":"weight"}]}\n```"""


@query("""SELECT CAST(1 AS BIGINT) AS doc_id, * FROM (VALUES ('nodes', 1, 'DUPLICATE_NODE_ID', 'id'), ('nodes', 1, 'MISSING_REQUIRED_FIELD', 'title'), ('nodes', 1, 'INVALID_TRUTH_WEIGHT', 'truth_weight'),
('nodes', 2, 'MISSING_REQUIRED_FIELD', 'id'), ('nodes', 3, 'INVALID_NODE_TYPE', 'type'), ('nodes', 3, 'INVALID_TRUTH_WEIGHT', 'truth_weight'), ('edges', 0, 'DANGLING_REFERENCE', 'target_id'),
('edges', 0, 'INVALID_EDGE_TYPE', 'edge_type'), ('formulas', 0, 'INVALID_FORMULA_ID', 'id'), ('constants', 0, 'INVALID_CONSTANT_CATEGORY', 'category')) AS t(part, idx, code, field)""")
def contract_validation(spark, sf):
    replies = spark.createDataFrame([(1, _REPLY)], "doc_id long, reply string")
    return contract.validate(replies.select("doc_id", contract.parse_reply(F.col("reply")).alias("contract")))


# --- documents ------------------------------------------------------------------------------------

_PAGES = [(1, 1, "머리말\n제1장 총칙\n본문 하나\n농작물재해보험 및 가축재해보험 손해평가의 이론과 실무\n제1절 목적\n내용", [[["a\nb", "c"], ["1", None], ["2"]]]), (1, 2, "1. 정의\n뜻\n가. 항목\n\n제2장 다음", [])]


def _pages(spark):
    return spark.createDataFrame(_PAGES, "doc_id long, page int, text string, tables array<array<array<string>>>")


@query("""SELECT CAST(1 AS BIGINT) AS doc_id, * FROM (VALUES (CAST(1 AS BIGINT), 'chapter', '1', '본문 하나', 1, 1, CAST(NULL AS BIGINT)), (2, 'section', '1', '내용', 1, 2, 1), (3, 'subsection', '1', '뜻', 2, 2, 2), (4, 'item', '가', '', 2, 2, 3), (5, 'chapter', '2', '', 2, 2, NULL))
AS t(section_id, level, number, body, start_page, end_page, parent_id)""")
def sections_tree(spark, sf):
    return etl.section_tree(etl.sections(_pages(spark))).drop("heading")


@query("SELECT CAST(1 AS BIGINT) AS doc_id, 1 AS page, 0 AS table_index, 'a b|c' AS headers, '1| / 2' AS body, 3 AS n_rows, 2 AS n_cols, 1 AS ragged")
def table_extract(spark, sf):
    found = etl.tables(_pages(spark))
    return found.select("doc_id", "page", "table_index", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), " / ").alias("body"), "n_rows", "n_cols", "ragged")


_EXAM = "상법(보험편)\n1. 첫째 물음\n이어짐\n① 하나 ② 둘\n③ 셋\n연장\n④ 넷\n3. 건너뜀\n① 가 ② 나 ③ 다 ④ 라\n덧붙임\n9. 물음 아님\n2024년 제10회 손해평가사"


@query("""SELECT CAST(1 AS BIGINT) AS doc_id, * FROM (VALUES (1, '첫째 물음 이어짐', '1:하나|2:둘|3:셋 연장|4:넷', FALSE), (3, '건너뜀', '1:가|2:나|3:다|4:라|4:덧붙임 9. 물음 아님', TRUE)) AS t(question, stem, choices, skipped)""")
def exam_questions(spark, sf):
    pages = spark.createDataFrame([(1, 1, _EXAM, [])], "doc_id long, page int, text string, tables array<array<array<string>>>")
    shown = F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["number"], c["text"])), "|")
    return etl.exam_questions(pages).select("doc_id", "question", "stem", shown.alias("choices"), "skipped")


@query("""SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS answered, count(*) FILTER (WHERE l.doc_id IS NULL) AS unanswered, count(*) FILTER (WHERE d.doc_id IS NULL) AS surplus
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def apply_answers(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"))
    filled, rest = etl.apply_answers(own, table(spark, sf, "labels"), ("doc_id",), "quality")
    counted = filled.select(F.lit("ANSWERED").alias("kind"), "doc_id").union(rest.select("kind", "doc_id")).groupBy().agg(
        F.count_if(F.col("kind") == "ANSWERED").alias("total"), F.count_if(F.col("kind") == "UNANSWERED").alias("unanswered"), F.count_if(F.col("kind") == "SURPLUS").alias("surplus"))
    return counted.select((F.col("total") - F.col("unanswered")).alias("answered"), "unanswered", "surplus")


@query(r"""SELECT doc_id, count(*) AS n, CAST(sum(length(trim(l, E' \t\n\r\f\v'))) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, E' \t\n\r\f\v') <> '' AND NOT regexp_matches(trim(l), '^(The|Les) ') GROUP BY doc_id""".replace(r"E' \t\n\r\f\v'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"))
def lines_noise_filter(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return etl.page_lines(pages, "^(The|Les) ").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def document_text(spark, sf):
    return etl.document_text(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query("SELECT conv_id, turn FROM conversations WHERE turn BETWEEN 1 AND 2")
def page_range(spark, sf):
    return etl.page_range(table(spark, sf, "conversations").withColumn("page", F.col("turn")), "1-2").select("conv_id", "turn")


# --- rules, sessions, events ----------------------------------------------------------------------


@query("""SELECT 'price' AS rule, count(*) AS n FROM orders WHERE o_totalprice < 1000 HAVING count(*) > 0 UNION ALL SELECT 'status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0
UNION ALL SELECT 'priority', count(*) FROM orders WHERE o_orderpriority NOT LIKE '%-%' HAVING count(*) > 0""")
def constraint_violations(spark, sf):
    checks = {"price": rules.at_least("o_totalprice", 1000), "status": rules.one_of("o_orderstatus", ["F", "O"]), "priority": F.col("o_orderpriority").like("%-%"), "key": rules.not_null("o_orderkey"), "blank": rules.not_blank("o_orderpriority")}
    return rules.violations(table(spark, sf, "orders"), checks, "o_orderkey").groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10)""")
def fk_integrity(spark, sf):
    return rules.foreign_keys(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").where("p_size < 10"), "p_partkey").select("l_orderkey", "l_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'DELETED' ELSE 'UPDATED' END AS change FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def append_only_guard(spark, sf):
    old = table(spark, sf, "orders")
    new = old.where("o_orderkey % 7 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderstatus")))
    return rules.rewritten(old, new, "o_orderkey")


_STATUS_SQL = "CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'processed' ELSE 'failed' END"


def _statuses(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return df.withColumn("status", F.when(kind == "view", "received").when(kind == "click", "processing").when(kind == "purchase", "processed").otherwise("failed"))


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATUS_SQL} AS status, lag({_STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events)
SELECT old_status, status, count(*) AS n FROM s WHERE old_status IS NOT NULL AND old_status <> status AND NOT (old_status = 'received' AND status IN ('processing', 'processed', 'failed')) AND NOT (old_status = 'processing' AND status IN ('processed', 'failed')) GROUP BY 1, 2""")
def status_transitions(spark, sf):
    bad = rules.bad_transitions(_statuses(table(spark, sf, "events")), "user_id", ["ts", "event_id"], "status")
    return bad.groupBy("old_status", "status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'review' WHEN 'P' THEN 'approved' ELSE NULL END AS next FROM orders""")
def workflow_next(spark, sf):
    step = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "P", "review").otherwise("published")
    return table(spark, sf, "orders").select("o_orderkey", rules.next_status(step).alias("next"))


@query("""SELECT user_id, event_type, date_trunc('hour', ts) AS hour, event_id, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) > 1 AS replayed FROM events""")
def webhook_dedup(spark, sf):
    rows = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return events.ingest(rows, ["user_id", "event_type", "hour"], ["ts", "event_id"]).select("user_id", "event_type", "hour", "event_id", "replayed")


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 10 = 0""")
def insert_new(spark, sf):
    held = table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey")
    more = table(spark, sf, "customer").select("c_custkey").union(table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey") + 1000000))
    return rules.insert_new(held, more.union(more), ["c_custkey"], ["c_custkey"])[0]


_SESSION_SQL = """s AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' - to_seconds(event_id % 200) END AS revoked_at,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts + INTERVAL 15 DAY END AS expires_at FROM events WHERE event_id % 6 <> 0),
c AS (SELECT e.event_id, s.user_id, CASE WHEN s.event_id IS NULL THEN 'not_found' WHEN revoked_at IS NOT NULL AND epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_ms(revoked_at) <= 60000 THEN 'rotated_recently'
  WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at IS NULL OR expires_at <= TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' ELSE 'ok' END AS state FROM events e LEFT JOIN s USING (event_id))"""


def _sessions(spark, sf):
    rows = table(spark, sf, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    e = F.col("event_id")
    sessions = rows.where("event_id % 6 != 0").select(e.alias("refresh_token_hash"), "user_id", F.when(e % 4 == 0, now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (e % 200).cast("double"))).alias("revoked_at"), F.when(e % 9 != 0, F.col("ts") + F.expr("INTERVAL 15 DAYS")).alias("expires_at"))
    return rows.select(e.alias("refresh_token_hash")), sessions, now


@query(f"WITH {_SESSION_SQL} SELECT event_id, state FROM c")
def refresh_lookup(spark, sf):
    tokens, sessions, now = _sessions(spark, sf)
    return events.classify_tokens(tokens, sessions, now).select(F.col("refresh_token_hash").alias("event_id"), "state")


@query(f"""WITH {_SESSION_SQL}, bad AS (SELECT DISTINCT user_id FROM c WHERE state = 'revoked')
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE revoked_at IS NOT NULL OR user_id IN (SELECT user_id FROM bad)) AS revoked FROM s GROUP BY user_id""")
def revoke_all(spark, sf):
    tokens, sessions, now = _sessions(spark, sf)
    classified = events.classify_tokens(tokens, sessions, now)
    done = events.revoke_reused(sessions, classified, now)
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.count("revoked_at").alias("revoked"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3""")
def rate_limit_windows(spark, sf):
    return events.over_limit(table(spark, sf, "events"), "ts", ["event_type"], 3600, 3)


@query("""SELECT user_id, CAST(sum(event_id % 13) AS BIGINT) AS total_reviews, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS correct_count, count(*) FILTER (WHERE event_id % 40 >= 21) AS mature, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15') AS due FROM events GROUP BY user_id""")
def progress_stats(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("user_id", (e % 13).alias("total_reviews"), F.when(F.col("event_type") == "purchase", 1).alias("correct_count"), (e % 40).alias("fsrs_interval"), F.col("ts").alias("fsrs_next_review"))
    return events.progress(rows, F.lit("2024-01-15").cast("timestamp"))


@query("""SELECT CAST(pos AS INTEGER) AS pos, status, count(o_orderkey) AS n FROM (VALUES (0, 'O'), (1, 'P'), (2, 'X')) AS t(pos, status) LEFT JOIN orders ON o_orderstatus = status GROUP BY pos, status""")
def status_buckets(spark, sf):
    return events.by_status(table(spark, sf, "orders"), "o_orderstatus", ["O", "P", "X"])


@query(r"""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[MASKED]', 'g') AS text FROM documents WHERE contains(text, '@')""")
def mask_addresses(spark, sf):
    rows = table(spark, sf, "documents").where(F.instr("text", "@") > 0)
    return rows.select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[MASKED]").alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[MASKED]' WHEN c_custkey % 3 = 1 THEN left(c_name, 2) || '***@x.example.com' ELSE c_name END AS value FROM customer""")
def log_masking(spark, sf):
    k = F.col("c_custkey") % 3
    key = F.when(k == 0, "Password").when(k == 1, "email").otherwise("note")
    value = F.when(k == 1, F.concat("c_name", F.lit("@x.example.com"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.mask(key, value).alias("value"))


@query("""SELECT page_id, CASE WHEN path LIKE '/en/%' THEN 'private, no-store' ELSE 'no-store' END AS policy, CASE WHEN path LIKE '/en/%' THEN 'network-only' ELSE 'cache-first' END AS strategy
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def cache_policy(spark, sf):
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "^/en/", "/api/user/")
    return table(spark, sf, "pages").select("page_id", events.cache_policy(path).alias("policy"), events.fetch_strategy(F.lit("GET"), F.lit(True), path).alias("strategy"))


@query("""SELECT * FROM (VALUES ('UNIQUE constraint failed: timeout', 'no'), ('network lost', 'yes'), ('D1_ERROR: 503', 'yes'), ('D1_ERROR: 404', 'no'), ('Timeout', 'yes')) AS t(message, retry)""")
def retry_classify(spark, sf):
    rows = spark.createDataFrame([(m,) for m in ("UNIQUE constraint failed: timeout", "network lost", "D1_ERROR: 503", "D1_ERROR: 404", "Timeout")], "message string")
    return rows.select("message", events.retry_class(F.col("message")).alias("retry"))


@query("SELECT c_custkey, sha256(c_name) AS sha256, sha1(c_name) AS sha1 FROM customer")
def token_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", crypto.sha256_hex(F.col("c_name")).alias("sha256"), crypto.sha1_hex(F.col("c_name")).alias("sha1"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1e-9, 6) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5 AND similarity >= 0.1""")
def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # Sums in another order fall on either side of a half; the nudge puts them on one. Ranks go by what is left after rounding.
    return events.top_similar(vectors, vectors.where("vec_id % 20 = 0"), floor=0.1, digits=6, nudge=1e-9)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_writes(spark, sf):
    return events.last_writes(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT w AS window_start, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) >= 2 AND count(*) FILTER (WHERE event_type = 'error') > count(*) * 0.5 AS open
FROM (SELECT event_type, time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * k) AS w, ts FROM events, range(6) AS t(k)) WHERE ts < w + INTERVAL 60 SECOND GROUP BY w""")
def circuit_breaker(spark, sf):
    rows = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return events.breaker(rows, "ts", "failed", least=2)


# --- streams --------------------------------------------------------------------------------------


@query("""SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) FROM events)""")
def stream_dedup(spark, sf):
    rows = streams.follow(spark, f"{sf}/events.parquet").withColumn("hour", F.date_trunc("hour", "ts"))
    return streams.drain(streams.deduplicated(rows, ["user_id", "event_type", "hour"], "ts", "2 hours")).agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf):
    return streams.drain(streams.counted(streams.follow(spark, f"{sf}/events.parquet"), "ts", ["event_type"], 3600), "complete")


@query(f"""WITH s AS (SELECT user_id, {_STATUS_SQL} AS new_status, lag({_STATUS_SQL}) OVER (PARTITION BY user_id ORDER BY ts) AS old_status FROM events)
SELECT user_id AS key, old_status, new_status, count(*) AS n FROM s WHERE old_status IS NOT NULL AND old_status <> new_status AND NOT (old_status = 'received' AND new_status IN ('processing', 'processed', 'failed')) AND NOT (old_status = 'processing' AND new_status IN ('processed', 'failed')) GROUP BY ALL""")
def stream_transitions(spark, sf):
    rows = _statuses(streams.follow(spark, f"{sf}/events.parquet"))
    bad = streams.drain(streams.transition_violations(rows, "user_id", "ts", "status"))
    return bad.groupBy("key", "old_status", "new_status").agg(F.count("*").alias("n"))
