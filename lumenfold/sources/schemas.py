"""Explicit schemas of the ledger's tables, and readers of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables and their columns.
SCHEMAS = {
    "sessions": "session_id string, source string, app_name string, started_at long, ended_at long, risk_score long",
    "events": "event_id long, session_id string, event_type string, payload_json string, redacted_text string, prev_hash string, event_hash string, created_at long, chain_version int",
    "decisions": "decision_id string, session_id string, decision string, risk_score long, reasons_json string, policy_ids_json string, created_at long",
    "invocations": "invocation_id string, session_id string, server_id string, tool_name string, args_redacted_json string, descriptor_hash string, requested_at long",
    "leases": "lease_id string, session_id string, server_id string, tool_name string, secret_ref string, injection_method string, created_at long, expires_at long, revoked_at long",
    "approvals": "approval_id string, decision_id string, session_id string, server_id string, tool_name string, args_hash string, status string, scope string, title string, summary string, effect_json string, created_at long, expires_at long, resolved_at long, resolved_by string",
    "outbox_items": "outbox_id string, invocation_id string, session_id string, kind string, preview_json string, approval_id string, status string, created_at long, approved_at long, executed_at long",
    "server_profiles": "server_id string, transport string, trust_level string, command_json string, command_hash string, pending_command_json string, pending_command_hash string, resolved_program_path string, pending_resolved_program_path string, last_drift_at long",
    "tool_descriptors": "server_id string, tool_name string, descriptor_hash string, first_seen_at long, approved_at long, pending_hash string, last_seen_hash string, last_seen_at long, last_drift_at long",
    "oauth_token_metadata": "token_ref string, issuer string, authorization_server string, resource string, scope_set_json string, kind string, expires_at long, bound_event_id long",
    "sandbox_profiles": "profile_id string, profile_json string, profile_hash string, created_at long",
    "secret_refs": "secret_ref string, label string, fingerprint string, created_at long",
    "tool_secret_bindings": "binding_id string, server_id string, tool_name string, secret_ref string, injection_method string, env_key string",
    "redaction_scans": "scan_id string, session_id string, source string, ts long, len_bucket int, fingerprint string",
    "redaction_findings": "finding_id long, scan_id string, label string, offset_bucket int, placeholder string, fingerprint string, action_taken string",
}
SAMPLE = (
    "id string, text string, lang string, lang_review_status string, eval_role string, expected_findings array<struct<label:string,start:int,end:int,extracted_text:string,risk_tier:string,redact_action:string>>, "
    "source string, source_template string, created_by string, created_at string, metadata struct<script:string,category:string>"
)


def open_table(spark: SparkSession, folder: str, name: str, suffix: str = "") -> DataFrame:
    """A ledger table of Parquet files; columns that older files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}{suffix}")


def open_ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: open_table(spark, folder, name) for name in SCHEMAS}


def empty_ledger(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled samples, one JSON file each, in folders by bucket; adds the bucket's name."""
    from pyspark.sql import functions as F

    got = spark.read.schema(SAMPLE).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*/*.json")
    return got.withColumn("bucket", F.element_at(F.split(F.input_file_name(), "/"), -2))
