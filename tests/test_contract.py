import json

from pyspark.sql import functions as F

from loam.operators import contract


def test_stages_without_joins(spark):
    """Several outcomes of a stage, stages without one, unknown stages and a null batch; the plan has no join that could be broadcast."""
    rows = [("a", s, True) for s in contract.STAGES] + [("b", contract.STAGES[0], True), ("b", contract.STAGES[1], True), ("b", contract.STAGES[1], False), ("b", contract.STAGES[2], True)]
    rows += [("c", contract.STAGES[1], True), ("d", "unknown", True), ("e", contract.STAGES[0], None), (None, contract.STAGES[0], True)]
    found = contract.stage_results(spark.createDataFrame(rows, "batch_id string, stage string, ok boolean"))
    assert "Join" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("pos").collect():
        assert r.stage == contract.STAGES[r.pos]
        got.setdefault(r.batch_id, []).append(r.status)
    skipped = ["skipped"] * 9
    assert got == {"a": ["success"] * 9, "b": ["success", "failed", *skipped[2:]], "c": skipped, "d": skipped, "e": skipped, None: skipped}


def test_a_reply_is_parsed_once(spark):
    """However many parts of the contract are read; fenced or not, malformed, empty and null replies."""
    replies = ['{"nodes": [{"id": "F-01"}]}', 'x ```json\n{"edges": [{"source_id": "F-01"}]}\n``` y', "{", '{"nodes": []}', None]
    rows = spark.createDataFrame(list(enumerate(replies)), "doc_id long, reply string").select("doc_id", contract.parse_reply(F.col("reply")).alias("contract"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1
    got = {r.doc_id: r.contract and [len(r.contract[p]) for p in contract.PARTS] for r in rows.collect()}
    assert got == {0: [1, 0, 0, 0], 1: [0, 1, 0, 0], 2: None, 3: None, 4: None}


def test_violations_without_shuffles(spark):
    """References stay within their contract, also where two have one doc_id, and nothing is moved to look them up."""
    law, term = ("LAW-001", "LAW"), ("TERM-001", "TERM")
    one = [{"id": i, "type": t, "title": "t", "content": "c", "truth_weight": 5} for i, t in (law, term, law, (None, "LAW"), ("F-1", "FORMULA"))]
    edge = {"source_id": "LAW-001", "target_id": "TERM-001", "edge_type": "CROSS_REF"}
    rows = [(1, json.dumps({"nodes": one, "edges": [edge, {"source_id": "", "target_id": "x", "edge_type": "?"}]})), (1, json.dumps({"edges": [edge]})), (None, None)]
    contracts = spark.createDataFrame(rows, "doc_id long, reply string").select("doc_id", contract.parse_reply(F.col("reply")).alias("contract"))
    plan = contract.report(contracts)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted((r.part, r.idx, r.code, r.field) for r in contract.validate(contracts).collect())
    assert got == sorted([
        ("nodes", 2, "DUPLICATE_NODE_ID", "id"), ("nodes", 3, "MISSING_REQUIRED_FIELD", "id"), ("nodes", 4, "INVALID_NODE_ID", "id"), ("edges", 1, "MISSING_REQUIRED_FIELD", "source_id"),
        ("edges", 1, "INVALID_NODE_REFERENCE", "target_id"), ("edges", 1, "DANGLING_REFERENCE", "target_id"), ("edges", 1, "INVALID_EDGE_TYPE", "edge_type"),
        ("edges", 0, "DANGLING_REFERENCE", "source_id"), ("edges", 0, "DANGLING_REFERENCE", "target_id"),
    ])
    shown = sorted((r.doc_id or 0, r.n_errors, r.valid, len(r.samples)) for r in contract.report(contracts).collect())
    assert shown == [(0, 0, False, 0), (1, 2, False, 2), (1, 7, False, 3)]
