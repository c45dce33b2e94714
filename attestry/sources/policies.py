"""Policies, rule packs and manifests from YAML, with the digest of their bytes; rows from a few small files."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from attestry import relations as R
from attestry.operators.findings import DEFAULT_GATE

MAX_BYTES = 256 << 10


def read_yaml(path: str) -> tuple[dict, str]:
    """What a file says and the SHA-256 of its bytes."""
    import yaml

    data = Path(path).read_bytes()
    if len(data) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    return yaml.safe_load(data) or {}, hashlib.sha256(data).hexdigest()


def policy(path: str, target: str | None = None) -> dict:
    """gate, blocking and required rules, suppressions and digest. A policy within what it judges is refused."""
    if target and Path(path).resolve().is_relative_to(Path(target).resolve()):
        raise ValueError("a policy must lie outside the project that it judges")
    found, digest = read_yaml(path)
    gate = found.get("gate", {})
    named = found.get("rules", {})
    if extra := {*named.get("block", [])} - {*named.get("required", [])}:
        raise ValueError(f"blocking rules that are not required: {sorted(extra)}")
    return {
        "digest": digest,
        "gate": {"minimum_severity": gate.get("minimumSeverity", DEFAULT_GATE["minimum_severity"]), "include_inferred": gate.get("includeInferred", False), "require_no_suppressions": gate.get("requireNoSuppressions", False)},
        "blocking_rules": list(named.get("block", [])),
        "required_rules": list(named.get("required", [])),
        "suppressions": [{"fingerprint": s["fingerprint"].lower(), "reason": s["reason"], "expires": str(s["expires"])} for s in found.get("suppressions", [])],
    }


def rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a pack as rows."""
    found, _ = read_yaml(path)
    rows = []
    for r in found["rules"]:
        files, match = r["files"], r["match"]
        rows.append({
            "pack_id": found["packId"], "rule_id": r["ruleId"], "title": r["title"], "severity": r["severity"], "evidence_level": r["evidenceLevel"], "confidence": r.get("confidence", "high"), "extensions": files["extensions"],
            "path_prefixes": files.get("pathPrefixes", []), "path_suffixes": files.get("pathSuffixes", []), "exclude_prefixes": files.get("excludePathPrefixes", []), "contains_any": match["containsAny"], "contains_all": match.get("containsAll", []),
            "excludes": match.get("excludes", []), "case_sensitive": match.get("caseSensitive", True), "emit_when": match.get("emitWhen", "present"),
        })
    return R.rows(spark, rows, R.RULES)
