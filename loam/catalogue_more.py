"""Further queries outside ``loam.llm``: constants, contracts, documents, rules, sessions and logs over whole tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from loam.catalogue import query, table
from loam.functions import crypto, ieee, text
from loam.functions.storage import materialize
from loam.operators import constants, contract, etl, events, graph, rules
from loam.plans import formula as fm

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


# --- constants and formulas -----------------------------------------------------------------------


@query("""WITH k AS (SELECT p_name AS name, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY p_name)
SELECT l_orderkey, l_linenumber, l_partkey, value FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN k ON k.name = CASE WHEN l_linenumber = 1 THEN 'none' ELSE p_name END""")
def constants_resolved(spark, sf):
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("numeric_value"))
    lines = table(spark, sf, "lineitem").join(named.select(F.col("id").alias("l_partkey"), "name"), "l_partkey")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, "none").otherwise(F.col("name")).alias("wanted"))
    return constants.resolve(lines, "wanted", named).drop("wanted")


_RISK = """x AS (SELECT a.s_suppkey AS id, CASE WHEN a.s_acctbal = b.s_acctbal THEN 0 ELSE abs(a.s_acctbal - b.s_acctbal) / greatest(abs(a.s_acctbal), abs(b.s_acctbal)) END AS d, b.s_suppkey AS other
  FROM supplier a LEFT JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey),
m AS (SELECT id, min(d) AS d FROM x GROUP BY id), t AS (SELECT x.id, m.d, min(other) AS other FROM x JOIN m ON x.id = m.id AND x.d = m.d GROUP BY 1, 2)"""


def _tagged(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("numeric_value"), (F.col("s_nationkey") % 5).cast("string").alias("category"), F.col("s_name").alias("name"))
    return rows, constants.tag_confusion(rows)


@query(f"WITH {_RISK} SELECT s.s_suppkey AS id, o.s_name || ' (차이 ' || printf('%.1f', d * 100) || '%)' AS confusion_risk FROM supplier s LEFT JOIN t ON t.id = s.s_suppkey AND d <= 0.3 LEFT JOIN supplier o ON o.s_suppkey = t.other")
def confusion_risk(spark, sf):
    rows, tagged = _tagged(spark, sf)
    return constants.risk_text(tagged, rows).select("id", "confusion_risk")


@query("""WITH v AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '%' WHEN 1 THEN 'kg' WHEN 2 THEN '' ELSE '년 3월' END AS value FROM part)
SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 4 <> 3 OR NOT regexp_matches(value, '^[0-9]{4}년')) AS numeric_parsed, count(*) FILTER (WHERE p_partkey % 4 < 2) AS with_unit FROM v""")
def constants_enriched(spark, sf):
    k = F.col("p_partkey") % 4
    ending = F.when(k == 0, "%").when(k == 1, "kg").when(k == 2, "").otherwise("년 3월")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), ending).alias("value"), F.lit("threshold").alias("category"))
    return constants.stats(constants.enrich(rows)).select("total", "numeric_parsed", "with_unit")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS number, CASE WHEN o_orderkey % 3 = 0 THEN FALSE ELSE TRUE END AS finite FROM orders""")
def number_coercion(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 ")))
    rows = table(spark, sf, "orders").select("o_orderkey", ieee.coerce(raw).alias("n"))
    finite = ieee.is_finite(F.col("n"))
    return rows.select("o_orderkey", F.when(finite, F.col("n")).alias("number"), F.coalesce(finite, F.lit(False)).alias("finite"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_extendedprice < l_quantity * 1500) AS negative FROM lineitem GROUP BY l_returnflag""")
def formula_warnings(spark, sf):
    """A formula whose result may be negative: the warning is counted, the row is kept."""
    lost = fm.Formula("X-1", "price - quantity * 1500", (fm.Variable("price", "n"), fm.Variable("quantity", "n")), (), 4)
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    done = fm.with_result(rows, lost, {"price": "l_extendedprice", "quantity": "l_quantity"})
    return done.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.array_contains("result.warnings", "the result is negative")).alias("negative"))


def _golden() -> list[tuple[int, str, dict[str, float], float, float]]:
    """Number, formula, inputs, value and tolerance of the golden cases, which lie beside the formulas."""
    out = []
    for n, line in enumerate((Path(fm.__file__).parent / "golden_formulas.txt").read_text().splitlines()):
        name, inputs, value, tolerance = (x.strip() for x in line.split(" | "))
        out.append((n, name, {k.strip(): float(v) for k, v in (x.split(":") for x in inputs.split(","))}, float(value), float(tolerance)))
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{name}', TRUE)" for n, name, *_ in _golden()) + ") AS t(n, formula_id, passed)")
def golden_formulas(spark, sf):
    """All golden cases of the formula catalogue."""
    cases = spark.createDataFrame(_golden(), "n int, formula_id string, inputs map<string,double>, expected double, tolerance double").coalesce(1)
    right = F.col("result.ok") & (F.abs(F.col("result.value") - F.col("expected")) <= F.col("tolerance"))
    return fm.evaluate_cases(cases).select("n", "formula_id", F.coalesce(right, F.lit(False)).alias("passed"))


# --- graph and contracts --------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey AS id FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_size DESC, p_partkey LIMIT 100)
SELECT id FROM k""")
def subgraph_filtered(spark, sf):
    parts = table(spark, sf, "part")
    least = parts.agg(F.min("p_type").alias("t"), F.min("p_brand").alias("b")).first()
    nodes = parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_brand").alias("lv1"), F.col("p_size").alias("truth_weight"), F.col("p_partkey").alias("_pos"))
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("from_node"), F.col("l_suppkey").alias("to_node"), F.lit(True).alias("is_active"))
    return graph.subgraph(nodes, edges, [least.t], {"lv1": least.b, "lv2": None})[0].select("id")


@query("""SELECT bool_and(n >= 10) AS passed, count(*) FILTER (WHERE n < 10) AS failed, count(*) AS checks FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def gate_rollup(spark, sf):
    checks = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select((F.col("n") >= 10).alias("passed"))
    return graph.gate_summary(checks)




def _replies(spark, sf):
    """A reply in JSON for every order: a node for each line, an edge between each two that follow one another."""
    line = F.col("l_linenumber")
    number = lambda n: F.concat(F.lit("CONCEPT-"), F.lpad(n.cast("string"), 3, "0"))
    node = F.struct(number(line).alias("id"), F.lit("CONCEPT").alias("type"), F.lit("t").alias("title"), F.when(F.col("l_quantity") > 45, "").otherwise("c").alias("content"), F.when(F.col("l_tax") > 0.07, 11).otherwise(5).alias("truth_weight"))
    edge = F.struct(number(line).alias("source_id"), number(line + 1).alias("target_id"), F.lit("CROSS_REF").alias("edge_type"))
    both = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", node.alias("node"), edge.alias("edge"))
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "node", "edge"))).alias("lines")
    grouped = both.groupBy(F.col("l_orderkey").alias("doc_id")).agg(lines).select("doc_id", F.col("lines.node").alias("nodes"), F.col("lines.edge").alias("edges"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("nodes", "edges")), F.lit("\n```"))
    return grouped.select("doc_id", contract.parse_reply(reply).alias("contract"))


_ERRORS = """n AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity) AS r FROM lineitem),
e AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END + CASE WHEN r > 1 THEN 1 ELSE 0 END
  + CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber + 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, count(*) AS lines FROM n GROUP BY l_orderkey)"""


@query(f"WITH {_ERRORS} SELECT l_orderkey AS doc_id, CAST(lines AS INTEGER) AS n_nodes, CAST(lines AS INTEGER) AS n_edges, n_errors, n_errors = 0 AS valid FROM e")
def contract_report(spark, sf):
    return contract.report(_replies(spark, sf)).select("doc_id", "n_nodes", "n_edges", "n_errors", "valid")


@query(f"WITH {_ERRORS} SELECT CASE WHEN n_errors = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN n_errors > 0 THEN 'Ontology validation failed: ' || n_errors || ' error(s)' END AS error, count(*) AS n FROM e GROUP BY 1, 2")
def contract_results(spark, sf):
    rows = contract.batch_results(_replies(spark, sf))
    return rows.groupBy("status", F.regexp_replace("error", r"\. Sample: .*", "").alias("error")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS doc_id, 'CONCEPT-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || ':CROSS_REF:CONCEPT-' || lpad(CAST(l_linenumber + 1 AS VARCHAR), 3, '0') AS id, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def contract_edges(spark, sf):
    return contract.to_tables(materialize(_replies(spark, sf), "contracts"))["knowledge_edges"].groupBy("doc_id", "id").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS doc_id, 'CONCEPT-' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS id, 't' AS name, CASE WHEN l_quantity > 45 THEN '' ELSE 'c' END AS description, count(*) AS n FROM lineitem GROUP BY ALL""")
def contract_nodes(spark, sf):
    return contract.to_tables(materialize(_replies(spark, sf), "contracts"))["knowledge_nodes"].groupBy("doc_id", "id", "name", "description").agg(F.count("*").alias("n"))


@query("""SELECT batch_id, stage, CASE WHEN pos > k THEN 'skipped' WHEN pos = k THEN 'failed' ELSE 'success' END AS status
FROM (SELECT 'B' || c_custkey AS batch_id, c_custkey % 10 AS k FROM customer), (SELECT stage, row_number() OVER () - 1 AS pos FROM (SELECT unnest(['pdf_extract', 'section_split', 'batch_structurize', 'constants_extract', 'db_load', 'integrity_check', 'human_review', 'formula_verify', 'qg2_gate']) AS stage))""")
def batch_stages(spark, sf):
    rows = table(spark, sf, "customer").select(F.concat(F.lit("B"), F.col("c_custkey")).alias("batch_id"), (F.col("c_custkey") % 10).alias("k"), F.posexplode(F.array(*map(F.lit, contract.STAGES))).alias("pos", "stage"))
    return contract.stage_results(rows.select("batch_id", "stage", (F.col("pos") != F.col("k")).alias("ok"))).select("batch_id", "stage", "status")


@query("SELECT CAST(5 AS BIGINT) AS batches, CAST(300 AS BIGINT) AS nodes, CAST(1020 AS BIGINT) AS edges, CAST(68 AS BIGINT) AS formulas")
def batch_table(spark, sf):
    return contract.batches(spark).agg(F.count("*").alias("batches"), F.sum("expected_nodes").alias("nodes"), F.sum("expected_edges").alias("edges"), F.sum("expected_formulas").alias("formulas"))


# --- documents ------------------------------------------------------------------------------------


@query("""SELECT conv_id AS doc_id, string_agg('[' || role || '] ' || 'turn' || turn || ' (p.' || turn || '-' || turn || ')' || chr(10) || CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS prompt
FROM conversations GROUP BY conv_id""")
def section_prompt(spark, sf):
    turn = F.col("turn")
    flat = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("section_id"), F.col("role").alias("level"), F.concat(F.lit("turn"), turn).alias("heading"), turn.alias("start_page"), turn.alias("end_page"), F.col("text").alias("body"))
    return etl.prompt(flat, 100)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2000 + p_partkey % 25 END AS year, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 + p_partkey % 12 END AS round, CASE WHEN p_partkey % 2 = 0 THEN '2nd' ELSE '1st' END AS exam_type, p_partkey % 3 <> 0 AS recognised FROM part""")
def exam_files(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "sheet").otherwise(F.concat((k % 25 + 2000).cast("string"), F.lit("년 제"), (k % 12 + 1).cast("string"), F.lit("회 손해평가사"))), F.when(k % 2 == 0, " 2차").otherwise(""), F.lit(".pdf"))
    return table(spark, sf, "part").select("p_partkey", etl.exam_metadata(name).alias("m")).select("p_partkey", "m.*")


@query("""WITH q AS (SELECT l_orderkey AS doc_id, l_linestatus AS subject, l_linenumber AS question, CAST(l_quantity AS INTEGER) % 6 AS choices, l_tax > 0.06 AS skipped FROM lineitem)
SELECT doc_id, 'FEW_CHOICES' AS kind, count(*) AS n FROM q WHERE choices < 4 GROUP BY doc_id UNION ALL SELECT doc_id, 'SKIPPED_NUMBER', count(*) FROM q WHERE skipped GROUP BY doc_id
UNION ALL SELECT doc_id, 'SUBJECT_COUNT', count(*) FROM (SELECT doc_id, subject FROM q GROUP BY 1, 2 HAVING count(*) <> 25) GROUP BY doc_id""")
def question_warnings(spark, sf):
    choice = F.struct(F.lit(1).alias("number"), F.lit("x").alias("text"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("subject"), F.col("l_linenumber").alias("question"),
        F.array_repeat(choice, F.col("l_quantity").cast("int") % 6).alias("choices"), (F.col("l_tax") > 0.06).alias("skipped"))
    return etl.question_warnings(rows).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(l, E' \t\n\r\f\v') AS l FROM (SELECT doc_id, unnest(string_split(text || chr(10) || '- 2권' || chr(10) || '1권. x' || chr(10) || '- 2권 x', chr(10))) AS l FROM documents WHERE text IS NOT NULL))
WHERE l <> '' AND NOT regexp_matches(l, '^[12]권\.|^-\s*\d권\s*$') GROUP BY doc_id""")
def part_titles(spark, sf):
    """Volume marks and part titles are no lines of a section."""
    pages = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.lit(1).alias("page"), F.concat("text", F.lit("\n- 2권\n1권. x\n- 2권 x")).alias("text"))
    return etl.page_lines(pages).groupBy("doc_id").agg(F.count("*").alias("n"))


# --- rules and changes ----------------------------------------------------------------------------


@query("""SELECT 'email' AS rule, count(*) AS n FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'length', count(*) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'not blank', count(*) FROM customer WHERE c_custkey % 7 = 0""")
def shape_rules(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 4 == 0, "nobody").otherwise("a@b.c").alias("email"), F.when(k % 5 == 0, "ab").otherwise("abc").alias("hash"), F.when(k % 7 == 0, "  ").otherwise("x").alias("name"))
    checks = {"email": rules.like_email("email"), "length": rules.length_is("hash", 3), "not blank": rules.not_blank("name")}
    return rules.violations(rows, checks, "c_custkey").groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE o_orderkey % 4 = 0) AS changed FROM orders""")
def update_count(spark, sf):
    return rules.guarded_update(table(spark, sf, "orders"), F.col("o_orderkey") % 4 == 0, {"o_orderstatus": F.lit("X")})[1]


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1""")
def update_rows(spark, sf):
    done = rules.guarded_update(table(spark, sf, "orders"), F.col("o_orderkey") % 4 == 0, {"o_orderstatus": F.lit("X")})[0]
    return done.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'processed' ELSE 'received' END AS status, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN {NOW} WHEN id % 3 = 0 THEN ts END AS updated_at, CASE WHEN id % 3 = 0 THEN {NOW} END AS processed_at
FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ts END AS ts FROM events) UNION ALL SELECT id, 'failed', NULL, {NOW} FROM (SELECT event_id + 100000000 AS id FROM events WHERE event_id % 10 = 0)""")
def merged_changes(spark, sf):
    """Changed rows get a time of change, unless they bring one, and of processing; new rows are added."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    k, none = F.col("id"), F.lit(None).cast("timestamp")
    held = e.select("id", F.lit("received").alias("status"), none.alias("updated_at"), none.alias("processed_at"))
    changed = e.where(k % 3 == 0).select("id", F.lit("processed").alias("status"), F.when(k % 2 != 0, F.col("ts")).alias("updated_at"), none.alias("processed_at"))
    new = e.where(k % 10 == 0).select((k + 100_000_000).alias("id"), F.lit("failed").alias("status"), none.alias("updated_at"), none.alias("processed_at"))
    return rules.merge(held, changed.union(new), "id", _now())


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def cascade_delete(spark, sf):
    left = table(spark, sf, "orders").where("o_orderstatus != 'F'")
    return rules.cascade(table(spark, sf, "lineitem"), "l_orderkey", left, "o_orderkey").select("l_orderkey", "l_linenumber")


def _session_table(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("id"), "user_id", F.sha2(e.cast("string").cast("binary"), 256).alias("refresh_token_hash"), F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(10))).cast("timestamp").alias("expires_at"), F.when(e % 4 == 0, F.col("ts").cast("timestamp")).alias("revoked_at"))


@query("""SELECT event_id AS id, 'user_id is immutable' AS rule FROM events WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 'revoked_at is final' FROM events WHERE event_id % 4 = 0 AND event_id % 3 = 0""")
def session_changes(spark, sf):
    old, k = _session_table(spark, sf), F.col("id")
    new = old.withColumn("user_id", F.when(k % 6 == 0, F.lit(-1)).otherwise(F.col("user_id"))).withColumn("revoked_at", F.when(k % 3 == 0, F.lit(None)).when((k % 5 == 0) & F.col("revoked_at").isNull(), _now()).otherwise(F.col("revoked_at")))
    return rules.session_changes(old, new)


@query(f"""SELECT event_id AS id FROM events WHERE event_id % 4 = 0 OR ts + INTERVAL 10 DAY > {NOW}""")
def session_expiry(spark, sf):
    return events.unexpired(_session_table(spark, sf), _now()).select("id")


@query(f"""SELECT c_custkey AS id, {NOW} AS created_at, {NOW} + INTERVAL 30 DAY AS expires_at, TRUE AS live FROM customer""")
def session_insert(spark, sf):
    k = F.col("c_custkey")
    logins = table(spark, sf, "customer").select(k.alias("id"), k.alias("user_id"), crypto.random_token().alias("refresh_token_hash"), F.lit("x").alias("user_agent"), crypto.peppered(F.lit("10.0.0.1"), "").alias("ip_hash"))
    rows = events.new_sessions(logins, _now())
    return rows.select("id", "created_at", "expires_at", (F.col("revoked_at").isNull() & (F.length("refresh_token_hash") == 64)).alias("live"))


@query(f"""SELECT event_id, {NOW} <= ts + INTERVAL 7 DAY AS refundable, {NOW} > ts - INTERVAL 1000 DAY + INTERVAL 1095 DAY AS personal_due, {NOW} > ts - INTERVAL 2000 DAY + INTERVAL 60 MONTH AS contract_due FROM events""")
def retention_due(spark, sf):
    at = F.col("ts").cast("timestamp")
    back = lambda days: at - F.make_dt_interval(F.lit(days))
    rows = table(spark, sf, "events").select("event_id", *[events.retention(back(d), _now()).alias(f"d{d}") for d in (0, 1000, 2000)])
    return rows.select("event_id", "d0.refundable", "d1000.personal_due", "d2000.contract_due")


@query("""SELECT event_id, event_id % 1000 <= 300 AS fresh FROM events""")
def replay_window(spark, sf):
    at = F.col("ts").cast("timestamp")
    sent = at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 1000).cast("double"))
    return table(spark, sf, "events").select("event_id", events.in_replay_window(sent, at).alias("fresh"))


# --- payloads, tokens, logs -----------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'malformed' WHEN 1 THEN 'bad_user' WHEN 2 THEN 'bad_transaction' WHEN 3 THEN 'bad_amount' WHEN 4 THEN 'bad_amount' ELSE 'ok' END AS state FROM orders""")
def payment_payloads(spark, sf):
    k = F.col("o_orderkey")
    user = F.when(k % 6 == 1, "").otherwise("u")
    transaction = F.when(k % 6 == 2, F.repeat(F.lit("t"), F.lit(129))).otherwise("t")
    amount = F.when(k % 6 == 3, "1.5").when(k % 6 == 4, '"5"').otherwise("5")
    body = F.concat(F.lit('{"userId":"'), user, F.lit('","transactionId":"'), transaction, F.lit('","amountKRW":'), amount, F.when(k % 6 == 0, "").otherwise("}"))
    return table(spark, sf, "orders").select("o_orderkey", events.payment_state(body).alias("state"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'bad_id' WHEN 2 THEN 'bad_type' ELSE 'ok' END AS state, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 'e' || o_orderkey END AS event_id FROM orders""")
def webhook_payloads(spark, sf):
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, "{").when(k % 4 == 1, '{"type":"x"}').when(k % 4 == 2, F.concat(F.lit('{"id":"e'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"event_id":"e'), k, F.lit('","event_type":"paid"}')))
    return table(spark, sf, "orders").select("o_orderkey", events.payload_state(body).alias("p")).select("o_orderkey", "p.state", "p.event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'too_large' WHEN c_custkey % 3 = 0 THEN 'forged' ELSE 'ok' END AS state FROM customer""")
def webhook_signatures(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 5 == 0, F.repeat(F.lit("x"), F.lit(40_000))).otherwise(F.col("c_name")).alias("payload"))
    good = crypto.hmac_sha256_hex(F.col("payload"), "secret")
    rows = rows.withColumn("signature", F.when(k % 3 == 0, F.reverse(good)).when(k % 2 == 0, F.upper(good)).otherwise(good))
    return events.verified(rows, "secret").select("c_custkey", "state")


@query("""SELECT c_custkey, sha256(CAST(repeat(chr(92), 0) AS VARCHAR) || c_name) AS inner_digest, CASE c_custkey % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'invalid' WHEN 2 THEN 'expired' WHEN 3 THEN 'invalid' ELSE 'ok' END AS state FROM customer""")
def token_states(spark, sf):
    """Signed tokens: cut ones, forged ones, old ones, ones of the future, good ones."""
    k, now = F.col("c_custkey"), 1_700_000_000
    exp, iat = F.when(k % 5 == 2, now - 1000).otherwise(now + 1000), F.when(k % 5 == 3, now + 500).otherwise(now - 10)
    token = crypto.signed_token(F.to_json(F.struct(F.col("c_name").alias("sub"), iat.cast("long").alias("iat"), exp.cast("long").alias("exp"))), "key")
    token = F.when(k % 5 == 0, F.substring_index(token, ".", 2)).when(k % 5 == 1, F.concat(token, F.lit("A"))).otherwise(token)
    return table(spark, sf, "customer").select("c_custkey", crypto.sha256_hex(F.col("c_name")).alias("inner_digest"), crypto.token_check(token, "key", F.lit(now)).alias("state"))


@query("""SELECT c_custkey, rtrim(replace(replace(to_base64(encode(c_name || '?>~')), '+', '-'), '/', '_'), '=') AS url, c_name || '?>~' AS back FROM customer""")
def base64_url(spark, sf):
    own = F.concat("c_name", F.lit("?>~"))
    return table(spark, sf, "customer").select("c_custkey", crypto.base64url(own).alias("url"), crypto.from_base64url(crypto.base64url(own)).cast("string").alias("back"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 50 END AS breaches FROM customer""")
def breach_counts(spark, sf):
    k = F.col("c_custkey")
    body = F.concat(F.lit("00AA:7\r\n"), F.when(k % 3 == 0, "FF00").otherwise("ABCD"), F.lit(":"), (k % 50).cast("string"), F.lit("\r\nEE:3"))
    return table(spark, sf, "customer").select("c_custkey", text.breach_count(body, F.lit("abcd")).alias("breaches"))


@query("""SELECT c_custkey, 'at [REDACTED_HOME]/x' || c_custkey AS redacted, 'Hello ' || c_name || ' {{more}}' AS filled, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'a.b' END AS found, lower(c_name) AS email FROM customer""")
def text_templates(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    tree = F.parse_json(F.when(k % 2 == 0, F.to_json(F.struct(F.struct(name.alias("b")).alias("a")))).otherwise("{}"))
    return table(spark, sf, "customer").select("c_custkey", text.redact_homes(F.concat(F.lit("at /home/me/x"), k)).alias("redacted"),
        text.interpolate(F.lit("Hello {{name}} {{more}}"), {"name": name}).alias("filled"), text.lookup_path(tree, "a.b").alias("found"), text.normal_email(F.concat(F.lit("　 "), name, F.lit("\n"))).alias("email"))


@query("""SELECT o_orderkey, printf('%.1f', (o_orderkey % 997) / 997.0 * 100) || '%' AS percent, format('{:,}', CAST(o_orderkey AS BIGINT)) AS grouped,
CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' WHEN d = -1 THEN 'yesterday' WHEN d > 0 THEN 'in ' || d || ' days' ELSE -d || ' days ago' END AS days FROM (SELECT o_orderkey, o_orderkey % 7 - 3 AS d FROM orders)""")
def formats(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", text.one_decimal_percent((k % 997) / F.lit(997.0)).alias("percent"), text.grouped(k).alias("grouped"), text.relative_days((k % 7) - 3).alias("days"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '저장 중 문제가 발생했습니다. 잠시 후 자동 재시도합니다.' WHEN 1 THEN '이 주제는 교재 ' || c_custkey || ' 페이지가 더 정확합니다. AI 해설 대신 교재 원문을 권장합니다.' ELSE '이 주제는 교재 해당 단원가 더 정확합니다. AI 해설 대신 교재 원문을 권장합니다.' END AS message FROM customer""")
def degradation_texts(spark, sf):
    k = F.col("c_custkey")
    reason = F.when(k % 3 == 0, "write_path_503").otherwise("low_similarity")
    return table(spark, sf, "customer").select("c_custkey", text.degradation(reason, F.when(k % 3 == 1, k)).alias("message"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'error' ELSE 'log' END AS stream, '{"level":"' || CASE WHEN c_custkey % 2 = 0 THEN 'error' ELSE 'info' END || '","message":"m","service":"s","environment":"development","timestamp":"2024-01-20T00:00:00.000Z","user":{"email":"' || left(c_name, 2) || '***@x.org","password":"[MASKED]","tags":["a"]},"id":' || c_custkey
|| CASE WHEN c_custkey % 2 = 0 THEN ',"error":[{"name":"E","message":"m","stack":"at [REDACTED_HOME]/f"}]' ELSE '' END || '}' AS line FROM customer WHERE c_custkey % 3 <> 0""")
def log_sink(spark, sf):
    k = F.col("c_custkey")
    user = F.struct(F.concat("c_name", F.lit("@x.org")).alias("email"), F.lit("hidden").alias("password"), F.array(F.lit("a")).alias("tags"))
    error = F.array(F.struct(F.lit("E").alias("name"), F.lit("m").alias("message"), F.lit("at /home/me/f").alias("stack")))
    level = F.when(k % 3 == 0, "debug").when(k % 2 == 0, "error").otherwise("info")
    rows = table(spark, sf, "customer").select(level.alias("level"), F.lit("m").alias("message"), _now().alias("timestamp"), F.struct(user.alias("user"), k.alias("id")).alias("context"), F.when(k % 2 == 0, error).alias("error"))
    lines = events.log_lines(rows, "s", "info")
    return lines.select(F.get_json_object("line", "$.id").cast("long").alias("c_custkey"), "stream", "line")


@query("""SELECT p_partkey, len(x) AS n, x[1] AS first FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_name, p_brand] END AS x FROM part)""")
def json_lists(spark, sf):
    own = F.when(F.col("p_partkey") % 3 == 0, "not json").otherwise(F.to_json(F.array("p_name", "p_brand")))
    rows = table(spark, sf, "part").select("p_partkey", text.text_list(own).alias("x"))
    return rows.select("p_partkey", F.size("x").cast("long").alias("n"), F.get("x", 0).alias("first"))


@query("""SELECT c_custkey, CAST(least(1000 * 2 ** (c_custkey % 7), 16000) AS INTEGER) AS wait, CASE WHEN c_custkey % 2 = 0 THEN 'deny' ELSE 'allow' END AS limiter FROM customer""")
def retry_waits(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", events.backoff_ms(k % 7).alias("wait"), events.without_limiter(F.when(k % 2 == 0, "production").otherwise("test")).alias("limiter"))


# --- ranking --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey AS vec_id, l_discount AS similarity FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(r AS INTEGER) AS rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY similarity * p_size DESC, l_linenumber, l_partkey) AS r FROM s JOIN lineitem USING (l_orderkey, l_linenumber) JOIN part ON p_partkey = vec_id WHERE l_partkey = vec_id) WHERE r = 1""")
def truth_ranking(spark, sf):
    similar = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("vec_id"), F.col("l_discount").alias("similarity"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_size").alias("truth_weight"))
    best = events.by_truth(similar, nodes).groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct((-F.col("score")).alias("s"), "l_linenumber", "vec_id")).alias("l_linenumber"))
    return best.select("l_orderkey", "l_linenumber", F.lit(1).alias("rank"))


@query("""SELECT p_partkey AS id, p_size AS exam_priority FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 50""")
def priority_order(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("exam_priority"), F.col("p_retailprice").alias("exam_frequency"))
    return events.by_priority(rows, 50).select("id", "exam_priority")


@query("""SELECT user_id, count(*) AS n FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY user_id""")
def user_scan(spark, sf):
    """All rows of one user, whose key reaches the scan."""
    rows = table(spark, sf, "events")
    one = rows.agg(F.min("user_id")).first()[0]
    return rows.where(F.col("user_id") == one).groupBy("user_id").agg(F.count("*").alias("n"))
