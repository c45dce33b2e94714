"""Rule packs over the documents: from files to signals, findings and a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.durable import kept
from attestry.operators import findings as fi
from attestry.operators import rulepack as rp
from attestry.operators import scan as sc
from attestry.plans.common import FILES, files, fingerprint_sql, rank_sql, rows, signal_id_sql, snippet_sql, values

RULES = [
    {"pack_id": "house", "rule_id": "house.licence-line", "title": "Licence notice in a text", "severity": "low", "evidence_level": "static_confirmed", "confidence": "high", "extensions": [".en", ".fr", ".de", ".es"], "contains_any": ["licensed under", "released under"], "excludes": ["mit license"], "case_sensitive": False, "emit_when": "present"},
    {"pack_id": "house", "rule_id": "house.token-value", "title": "Token value in a text", "severity": "high", "evidence_level": "static_confirmed", "confidence": "high", "extensions": [".en", ".fr", ".de", ".es"], "path_prefixes": ["src"], "contains_any": ["token", "api_key"], "contains_all": ["="], "case_sensitive": True},
    {"pack_id": "house", "rule_id": "house.no-notice", "title": "German text without a notice", "severity": "medium", "evidence_level": "inferred", "confidence": "medium", "extensions": [".de"], "exclude_prefixes": ["src0/", "src1/"], "path_suffixes": ["1.de", "3.de"], "contains_any": ["License"], "emit_when": "absent"},
    {"pack_id": "other", "rule_id": "other.nothing", "title": "Selects nothing", "severity": "info", "evidence_level": "inferred", "confidence": "low", "extensions": [".go"], "contains_any": ["x"], "emit_when": "absent"},
]
SUPPRESSIONS = [{"fingerprint": "0" * 64, "reason": "nobody", "expires": "2999-01-01", "ord": 0}]
AS_OF = "2026-06-01T00:00:00Z"


def _rules(spark: SparkSession) -> DataFrame:
    return rows(spark, RULES, R.RULES)


RULES_SQL = values("rules", RULES, R.RULES)
_EMPTY = "coalesce(len({0}), 0) = 0"
_SELECTED = (
    "list_contains(r.extensions, lower(regexp_extract(f.relative_path, '[^/](\\.[^./]*)$', 1)))"
    " AND (coalesce(len(r.path_prefixes), 0) = 0 OR len(list_filter(r.path_prefixes, lambda p: starts_with(f.relative_path, p))) > 0)"
    " AND (coalesce(len(r.path_suffixes), 0) = 0 OR len(list_filter(r.path_suffixes, lambda p: ends_with(f.relative_path, p))) > 0)"
    " AND (coalesce(len(r.exclude_prefixes), 0) = 0 OR len(list_filter(r.exclude_prefixes, lambda p: starts_with(f.relative_path, p))) = 0)"
)
_PAIRS = f"pairs AS (SELECT f.*, r.* FROM files f JOIN rules r ON {_SELECTED})"
_FOLD = "(CASE WHEN coalesce(case_sensitive, true) THEN {0} ELSE lower({0}) END)"
_LINES = "lines AS (SELECT * EXCLUDE (ws), unnest(ws) AS line, generate_subscripts(ws, 1) AS line_no FROM (SELECT *, string_split(content, chr(10)) AS ws FROM pairs))"


def _has(column: str) -> str:
    return f"len(list_filter(coalesce({column}, []), lambda x: contains({_FOLD.format('l')}, {_FOLD.format('x')})))"


_MATCHED = f"matched AS (SELECT *, rtrim(line, chr(13)) AS l FROM lines), hits AS (SELECT * FROM matched WHERE {_has('excludes')} = 0 AND {_has('contains_any')} > 0 AND {_has('contains_all')} = coalesce(len(contains_all), 0))"
_CHAIN = f"{FILES}, {RULES_SQL}, {_PAIRS}, {_LINES}, {_MATCHED}"
_OUT = "SELECT {id} AS id, fingerprint, 'rule-pack' AS engine, rule_id, title, severity, evidence_level, relative_path AS path, line_no AS line, snippet, pack_id, coalesce(emit_when, 'present') AS emit_when FROM "
_PRESENT = _OUT.format(id=signal_id_sql("fingerprint", "line_no")) + f"(SELECT *, {fingerprint_sql(chr(39) + 'rule-pack' + chr(39), 'rule_id', 'relative_path', 'snippet')} AS fingerprint FROM (SELECT * REPLACE (CAST(line_no AS INTEGER) AS line_no), {snippet_sql('l')} AS snippet FROM hits WHERE coalesce(emit_when, 'present') = 'present'))"
_ABSENT = _OUT.format(id=signal_id_sql("fingerprint", "line_no")) + f"(SELECT *, {fingerprint_sql(chr(39) + 'rule-pack' + chr(39), 'rule_id', 'relative_path', 'snippet')} AS fingerprint FROM (SELECT p.*, CAST(NULL AS INTEGER) AS line_no, CAST(NULL AS VARCHAR) AS snippet FROM pairs p WHERE emit_when = 'absent' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.rule_id = p.rule_id AND h.relative_path = p.relative_path)))"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.pack_signals(files(spark, sf_dir), _rules(spark))


_SIGNALS = f"{_CHAIN}, unordered AS ({_PRESENT} UNION ALL {_ABSENT}), signals AS (SELECT u.*, (rule_id, f.walk_pos, coalesce(line, 0)) AS ord, (pack_id, rule_id, f.walk_pos, coalesce(line, 0)) AS full_ord FROM unordered u JOIN files f ON u.path = f.relative_path)"


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = kept(fi.distinct_signals(signals(spark, sf_dir)), "signals")
    return fi.suppressed(fi.merged(found, fi.no_paths(found)), rows(spark, SUPPRESSIONS, R.SUPPRESSIONS + ", ord long"), AS_OF), found


def rulepack_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.pairs(files(spark, sf_dir), _rules(spark)).select("rule_id", "relative_path")


def rulepack_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.present(files(spark, sf_dir), _rules(spark))


def rulepack_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.absent(files(spark, sf_dir), _rules(spark))


def rulepack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.coverage(files(spark, sf_dir), _rules(spark))


def rulepack_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rp.preview(files(spark, sf_dir), _rules(spark), 20)
    return got.withColumn("paths", F.array_join("paths", ","))


def rulepack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"bytes": 3_000_000, "literal_bytes": 5_000_000, "lines": 20_000}
    return rp.within_budgets(rp.pairs(files(spark, sf_dir), _rules(spark)), limits).groupBy("rule_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def signal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = signals(spark, sf_dir).where("rule_id = 'house.licence-line'")
    return fi.distinct_signals(one.unionByName(one)).select("id", "fingerprint", "path", "line")


def signal_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.capped(signals(spark, sf_dir), 20, "rule_id").groupBy("rule_id").agg(F.count("*").alias("n"), F.bool_or("partial").alias("partial"), F.max_by("path", "ord").alias("last_path"))


def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _findings(spark, sf_dir)
    return found.select("id", "fingerprint", "title", "severity", "evidence_level", "status", F.size("signal_ids").cast("long").alias("n_signals"), F.array_join("signal_ids", ",").alias("signal_ids"))


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _findings(spark, sf_dir)
    return fi.summarised(found, rows(spark, [], R.ATTACK_PATHS))


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to decision: the flagship."""
    found, of = _findings(spark, sf_dir)
    got = fi.decided(found, rp.coverage(files(spark, sf_dir), _rules(spark)), of)
    return got.select("decision", F.array_join("reasons", "; ").alias("reasons"))


_COVERAGE = """coverage AS (SELECT pack_id, list_sort(list(rule_id) FILTER (emit_when = 'absent' AND n = 0)) AS idle FROM
  (SELECT r.pack_id, r.rule_id, coalesce(r.emit_when, 'present') AS emit_when, (SELECT count(*) FROM pairs p WHERE p.rule_id = r.rule_id) AS n FROM rules r) GROUP BY pack_id)"""
_FINDINGS = "findings AS (SELECT fingerprint, arg_min(title, full_ord) AS title, arg_min(severity, full_ord) AS severity, arg_min(evidence_level, full_ord) AS evidence_level, list(id ORDER BY full_ord) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY full_ord) AS rn FROM signals) WHERE rn = 1 GROUP BY fingerprint)"
_LIMITED = "(SELECT *, sum(size) OVER w AS b, sum(size * greatest(1, coalesce(len(contains_any), 0) + coalesce(len(contains_all), 0) + coalesce(len(excludes), 0))) OVER w AS lb, sum(len(string_split(content, chr(10)))) OVER w AS n FROM pairs WINDOW w AS (ORDER BY pack_id, rule_id, walk_pos ROWS UNBOUNDED PRECEDING))"

QUERIES = {f.__name__: f for f in (rulepack_select, rulepack_present, rulepack_absent, rulepack_coverage, rulepack_preview, rulepack_budget, signal_dedup, signal_cap, finding_merge, finding_summary, decision)}
SQL = {
    "rulepack_select": f"WITH {FILES}, {RULES_SQL}, {_PAIRS} SELECT rule_id, relative_path FROM pairs",
    "rulepack_present": f"WITH {_CHAIN} {_PRESENT}",
    "rulepack_absent": f"WITH {_CHAIN} {_ABSENT}",
    "rulepack_coverage": f"""WITH {FILES}, {RULES_SQL}, {_PAIRS}, {_COVERAGE}
SELECT 'rule-pack:' || pack_id AS domain, 'rule-pack' AS engine, CASE WHEN len(idle) > 0 THEN 'partial' ELSE 'complete' END AS status, true AS required,
  CASE WHEN len(idle) > 0 THEN 'custom absent rule ' || idle[1] || ' selected no files' || CASE WHEN len(idle) > 1 THEN '; ' || (len(idle) - 1) || ' additional absent rule(s) also selected no files' ELSE '' END END AS reason FROM coverage""",
    "rulepack_preview": f"""WITH {FILES}, {RULES_SQL}, {_PAIRS} SELECT r.pack_id, r.rule_id, count(p.relative_path) AS n_files,
  coalesce(array_to_string(list_slice(list(p.relative_path ORDER BY p.walk_pos) FILTER (p.relative_path IS NOT NULL), 1, 20), ','), '') AS paths, greatest(count(p.relative_path) - 20, 0) AS omitted
  FROM rules r LEFT JOIN pairs p ON r.rule_id = p.rule_id GROUP BY ALL""",
    "rulepack_budget": f"WITH {FILES}, {RULES_SQL}, {_PAIRS} SELECT rule_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM {_LIMITED} WHERE b <= 3000000 AND lb <= 5000000 AND n <= 20000 GROUP BY rule_id",
    "signal_dedup": f"WITH {_SIGNALS} SELECT DISTINCT id, fingerprint, path, line FROM signals WHERE rule_id = 'house.licence-line'",
    "signal_cap": f"WITH {_SIGNALS}, n AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY full_ord) AS rn, count(*) OVER (PARTITION BY rule_id) AS c FROM signals) SELECT rule_id, count(*) AS n, bool_or(c > 20) AS partial, arg_max(path, full_ord) AS last_path FROM n WHERE rn <= 20 GROUP BY rule_id",
    "finding_merge": f"WITH {_SIGNALS}, {_FINDINGS} SELECT 'finding_' || substr(fingerprint, 1, 16) AS id, fingerprint, title, severity, evidence_level, 'open' AS status, len(ids) AS n_signals, array_to_string(ids, ',') AS signal_ids FROM findings",
    "finding_summary": f"""WITH {_SIGNALS}, {_FINDINGS} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, 0 AS suppressed, 0 AS attack_paths FROM findings""",
    "decision": f"""WITH {_SIGNALS}, {_FINDINGS}, {_COVERAGE}, n AS (SELECT count(*) FILTER ({rank_sql('severity')} >= 3 AND evidence_level <> 'inferred') AS gate, count(*) FILTER ({rank_sql('severity')} >= 2) AS review FROM findings),
  g AS (SELECT string_agg('rule-pack:' || pack_id || ': partial (custom absent rule ' || idle[1] || ' selected no files)', '; ' ORDER BY pack_id) AS gaps FROM coverage WHERE len(idle) > 0)
SELECT CASE WHEN gate > 0 THEN 'block' WHEN gaps IS NOT NULL THEN 'incomplete' WHEN review > 0 THEN 'review' ELSE 'no_blockers_found' END AS decision,
  CASE WHEN gate > 0 THEN gate || ' high or critical evidence-backed finding(s)' WHEN gaps IS NOT NULL THEN gaps WHEN review > 0 THEN review || ' medium-risk or inferred finding(s) require review' ELSE 'No blocking findings were detected within the completed coverage' END AS reasons FROM n, g""",
}
