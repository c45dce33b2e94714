"""The relations that operators exchange, as Spark DDL, and inline rows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FILES = "relative_path string, size long, content string, walk_pos long"
RULES = (
    "pack_id string, rule_id string, title string, severity string, evidence_level string, confidence string, extensions array<string>, path_prefixes array<string>, "
    "path_suffixes array<string>, exclude_prefixes array<string>, contains_any array<string>, contains_all array<string>, excludes array<string>, case_sensitive boolean, emit_when string"
)
SIGNALS = (
    "id string, fingerprint string, engine string, rule_id string, title string, description string, severity string, evidence_level string, confidence string, "
    "path string, line int, column int, end_line int, snippet string, cwe array<string>, owasp array<string>, tags array<string>, remediation string, metadata map<string,string>, routes array<string>, ord long"
)
FINDINGS = "id string, fingerprint string, title string, severity string, evidence_level string, status string, signal_ids array<string>, attack_path_id string, reason string, expires string"
COVERAGE = "domain string, engine string, status string, required boolean, version string, reason string"
SUPPRESSIONS = "fingerprint string, reason string, expires string"
ATTACK_PATHS = "id string, fingerprint string, title string, summary string, severity string, evidence_level string, signal_ids array<string>, place int, ord long"
RESPONSES = "case_id string, account string, url string, status int, headers map<string,string>, set_cookie array<string>, body string"


def rows(spark: SparkSession, data: list[dict], ddl: str) -> DataFrame:
    """Inline rows; fields that a row lacks are null."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in data], schema)
