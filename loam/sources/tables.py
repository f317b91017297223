"""The twelve tables of the service, as schemas, and their constraints as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.types import StructType

from loam.operators import rules as r

# Columns by table, ! where null is not allowed.
TABLES = {
    "knowledge_nodes": "id string! type string! name string! description string lv1_insurance string lv2_crop string lv3_investigation string page_ref string batch_id string version_year int! superseded_by string truth_weight int! status string! created_at string! updated_at string! exam_scope string",
    "knowledge_edges": "id string! from_node string! to_node string! edge_type string! condition string priority int is_active int created_at string!",
    "formulas": "id string! name string! equation_template string! equation_display string variables_schema string! constraints string expected_inputs string graceful_degradation string page_ref string node_id string version_year int! superseded_by string created_at string!",
    "constants": "id string! category string! name string! value string! numeric_value double applies_to string! insurance_type string confusion_risk string confusion_level string unit string page_ref string version_year int! exam_frequency int related_formula string created_at string! exam_scope string",
    "revision_changes": "id string! version_year int! revision_date string! category string! target_section string target_crops string change_type string! before_value string after_value string exam_priority int related_constants string related_nodes string created_at string!",
    "exam_questions": "id string! year int! round int question_number int subject string content string! answer string explanation string valid_from string valid_until string superseded_by string related_nodes string related_constants string status string! created_at string! exam_type string topic_cluster string memorization_type string confusion_type string",
    "mnemonic_cards": "id string! target_type string! target_id string! confusion_type string memorization_method string! content string! reverse_verified int exam_scope string status string created_at string!",
    "user_progress": "id string! user_id string! node_id string card_id string card_type string! fsrs_difficulty double fsrs_stability double fsrs_interval int fsrs_next_review string total_reviews int correct_count int last_confusion_type string created_at string! updated_at string!",
    "topic_clusters": "id string! name string! lv1 string lv2 string lv3 string exam_frequency int question_ids string is_covered int source string created_at string!",
    "users": "id string! email string! password_hash string! password_salt string! password_iterations int! subscription_plan string subscribed_exams string subscription_started_at string subscription_expires_at string last_login_at string status string! created_at string! updated_at string! name string",
    "webhook_events": "id string! provider string! event_id string! event_type string! payload string! signature string received_at string! processed_at string status string! error_message string",
    "sessions": "id string! user_id string! refresh_token_hash string! created_at string! last_used_at string! expires_at string! revoked_at string user_agent string ip_hash string",
}
FOREIGN_KEYS = [("knowledge_edges", "from_node", "knowledge_nodes"), ("knowledge_edges", "to_node", "knowledge_nodes"), ("formulas", "node_id", "knowledge_nodes"), ("user_progress", "node_id", "knowledge_nodes"), ("sessions", "user_id", "users")]
APPEND_ONLY = ["knowledge_nodes", "formulas", "constants", "revision_changes", "exam_questions"]
NODE_TYPES = "LAW FORMULA INVESTIGATION INSURANCE CROP CONCEPT TERM".split()
CONSTANT_CATEGORIES = "threshold coefficient date ratio sample deductible insurance_rate".split()


def schema(table: str) -> StructType:
    words = TABLES[table].split()
    return StructType.fromDDL(", ".join(f"{n} {t.removesuffix('!')}{' NOT NULL' if t.endswith('!') else ''}" for n, t in zip(words[::2], words[1::2], strict=True)))


def constraints(table: str) -> dict[str, Column]:
    """The table's rules: not null, enumerations, not blank, shapes."""
    found = {f"{f.name} not null": r.not_null(f.name) for f in schema(table).fields if not f.nullable}
    match table:
        case "knowledge_nodes":
            found |= {"type known": r.one_of("type", NODE_TYPES), "status known": r.one_of("status", [*r.WORKFLOW, "flagged"])}
        case "constants":
            found |= {"category known": r.one_of("category", CONSTANT_CATEGORIES), "confusion_level known": r.one_of("confusion_level", ["safe", "warn", "danger"])}
        case "users":
            found |= {"email shaped": r.like_email("email"), "iterations": r.at_least("password_iterations", 600_000)}
        case "webhook_events":
            found |= {f"{c} not blank": r.not_blank(c) for c in ("provider", "event_id", "event_type", "payload")}
            found |= {"status known": r.one_of("status", list(r.EVENT_STATUSES))}
        case "sessions":
            found |= {f"{c} not blank": r.not_blank(c) for c in ("user_id", "refresh_token_hash", "expires_at")}
            found |= {"hash length": r.length_is("refresh_token_hash", 64)}
    return found
