"""Queries over manifests, options, baselines, CI reports and a corpus manifest, one of each document in the inline shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import manifests as M
from attestry.operators.web import MUTATING, READING
from attestry.plans.common import TYPES, keyed, keyed_sql, quoted, rows, values

TYPES["array<int>"] = "INTEGER[]"

_URLS = (
    ("ok", "https://shop.test/app", "test", ["Shop.test"]), ("local", "http://10.1.2.3:8080/", "local", ["10.1.2.3"]), ("loop", "http://[::1]:3000", "local", ["::1"]),
    ("unlisted", "https://a.test", "staging", ["b.test"]), ("meta", "http://169.254.169.254/latest", "local", ["169.254.169.254"]), ("inner", "https://db.internal", "test", ["db.internal"]),
    ("plain", "http://shop.test", "staging", ["shop.test"]), ("private", "https://192.168.1.9", "test", ["192.168.1.9"]), ("user", "https://me:x@shop.test/#top", "test", ["shop.test"]),
    ("ftp", "ftp://shop.test", "test", None), ("v6", "https://[2001:db9::1]/", "test", ["2001:db9::1"]), ("far", "http://172.32.0.1", "local", ["172.32.0.1"]), ("none", None, None, None),
)
TARGETS = [dict(zip(("manifest_id", "target", "environment", "allowed_hosts"), x, strict=True)) for x in _URLS]
_PLAN = {"data_prefix": "synthetic", "max_requests": 8, "username_field": "user", "password_field": "pass", "token_path": "a.token", "identity_path": "a.id", "login_path": "/auth/login"}
PLANS = [
    _PLAN | {"manifest_id": "good"},
    _PLAN | {"manifest_id": "tight", "max_requests": 5, "username_field": "pass", "identity_path": "a.token", "login_path": "/me/delete"},
    _PLAN | {"manifest_id": "bare", "login_path": "/createSession%2525"},
]
ACCOUNTS = [{"manifest_id": m, "label": a, "username_env": f"U_{a}", "password_env": p} for m, a, p in (("good", "ann", "P_1"), ("good", "bo", "P_2"), ("tight", "ann", "P_1"), ("tight", "ann", "P_1"))]
_GOOD = {"owner": "ann", "other": "bo", "method": "GET", "path": "/orders/7", "data_label": "synthetic-1", "match": "value", "expected": "synthetic-1", "json_path": "data.label"}
CASES = [
    {"manifest_id": "good"} | _GOOD | x
    for x in (
        {"case_id": "fine"}, {"case_id": "twice"}, {"case_id": "twice", "path": "/orders/8"}, {"case_id": "same", "other": "ann"}, {"case_id": "label", "data_label": "other", "expected": "else"},
        {"case_id": "cancel", "path": "/orders/cancelOrder"}, {"case_id": "post", "method": "POST"}, {"case_id": "find", "method": "POST", "path": "/orders/find", "body": '{"q": ["a,b", {"k": 1}]}'},
        {"case_id": "body", "body": '{"resetAll": true}'}, {"case_id": "echo", "path": "/orders/Synthetic%2D1"}, {"case_id": "sent", "method": "POST", "path": "/search", "body": '{"synthetic-1": {"a": ["x SYNTHETIC-1"]}}'},
        {"case_id": "owner", "match": "ownerIdentity", "json_path": "o.ownerId", "path": "/orders/7?OwnerID=3"}, {"case_id": "named", "match": "ownerIdentity", "json_path": "o.ownerId", "method": "POST", "path": "/list", "body": '{"a": [{"ownerid": "x"}]}'},
        {"case_id": "away", "path": "//evil.test/x"}, {"case_id": "key", "method": "POST", "path": "/list", "body": '{"synthetic-1": "a"}'},
    )
]
CASES.append({"manifest_id": "tight", "case_id": "t1"} | _GOOD)
CASES.append({"manifest_id": "tight", "case_id": "t2"} | _GOOD | {"path": None})
OPTIONS = [
    {"scan_id": "default"}, {"scan_id": "native", "profile": "native", "max_files": 100_000, "artifacts": ["a.apk"]}, {"scan_id": "odd", "profile": "fast", "max_files": 0, "timeout_ms": 1_800_001},
    {"scan_id": "large", "max_file_bytes": (16 << 20) + 1, "max_total_bytes": 1 << 40, "policy_path": " "}, {"scan_id": "lists", "artifacts": [f"{i}.apk" for i in range(11)], "rule_packs": [*map(str, range(8)), " "]},
]
_POLICY = "scan_id string, source string, digest string, base_source string, base_digest string"
POLICIES = [dict(zip(("scan_id", "source", "digest", "base_source", "base_digest"), x, strict=True)) for x in (("same", "operator", "d1", "operator", "d1"), ("gone", "default", None, "operator", "d1"), ("other", "operator", "d2", "operator", "d1"), ("added", "operator", "d1", None, None), ("plain", "default", None, "default", None))]
_PACK = "scan_id string, side string, pack_id string, digest string, rule_count int"
PACKS = [dict(zip(("scan_id", "side", "pack_id", "digest", "rule_count"), x, strict=True)) for x in (("same", "now", "p", "a", 2), ("same", "base", "p", "a", 2), ("gone", "base", "p", "a", 2), ("other", "now", "p", "a", 3), ("other", "base", "p", "a", 2), ("plain", "now", "q", "b", 1))]
_REPORT = {"exit_code": 0, "n_open": 0, "by_severity": [0, 0, 0, 0, 0], "total": 2, "complete": 2, "gaps": 0, "omitted_coverage": 0, "omitted_findings": 0, "compared": False, "n_new": 0, "n_remaining": 0}
REPORTS = [
    _REPORT | {"report_id": "pass", "decision": "pass"},
    _REPORT | {"report_id": "block", "decision": "block", "exit_code": 1, "n_open": 2, "by_severity": [1, 1, 0, 0, 0], "compared": True, "n_new": 1},
    _REPORT | {"report_id": "gap", "decision": "review", "exit_code": 2, "gaps": 22, "omitted_coverage": 1, "total": 20},
    _REPORT | {"report_id": "empty", "decision": "incomplete", "exit_code": 2, "n_open": 3, "omitted_findings": 4},
]
_NOTE = {"kind": "decision", "level": "notice", "title": "t", "message": "m"}
_FOUND = {"kind": "finding", "level": "error", "title": "t", "message": "m", "path": "src/a.ts", "start_line": 3, "end_line": 3, "fingerprint": "f1", "status": "open", "blocks": True, "baseline_state": "new"}
ANNOTATIONS = [
    {"report_id": "pass"} | _NOTE,
    *({"report_id": "block"} | x for x in (_NOTE | {"level": "error"}, _FOUND, _FOUND | {"baseline_state": None}, _FOUND | {"fingerprint": "f2", "level": "warning"}, _FOUND | {"fingerprint": "f3", "path": "a/../b", "end_line": 2})),
    *({"report_id": "gap"} | x for x in (_NOTE | {"title": " t"}, _NOTE | {"level": "warning", "path": "a"}, _NOTE | {"kind": "coverage", "level": "error"}, _FOUND | {"level": "notice", "blocks": False, "status": "suppressed"})),
    *({"report_id": "gap"} | _FOUND | {"fingerprint": "f9", "start_column": 4, "end_column": 2, "baseline_state": None, "message": m} for m in ("a\nb",)),
]
CORPUS = [dict(zip(("case_id", "category", "framework", "variant", "path", "artifact", "expected", "near"), x, strict=True)) for x in (
    ("a", "auth", "fastapi", "positive", "a", None, ["r1"], None), ("a-near", "auth", "fastapi", "near_miss", "b", None, [], ["r1"]), ("dup", "data", "node", "positive", "c", None, ["r2"], []), ("dup", "data", "node", "positive", "c", None, ["r2"], []),
    ("both", "data", "node", "near_miss", "c", "d.apk", ["r1"], []), ("odd", "", "node", "other", None, None, [], ["r9"]), ("none", "data", "node", "positive", "e", "", [], None),
)]
_CATALOG = "rule_id string, category string"
CATALOG = [{"rule_id": "r1", "category": "auth"}, {"rule_id": "r2", "category": "data"}, {"rule_id": "r3", "category": "data"}]

_keys = lambda data, key: list(dict.fromkeys(d[key] for d in data))
_BY = {
    "targets": (TARGETS, M.TARGETS, "manifest_id", _keys(TARGETS, "manifest_id")), **{n: (d, ddl, "manifest_id", _keys(PLANS, "manifest_id")) for n, d, ddl in (("plans", PLANS, M.PLANS), ("accounts", ACCOUNTS, M.ACCOUNTS), ("cases", CASES, M.CASES))},
    "options": (OPTIONS, M.OPTIONS, "scan_id", _keys(OPTIONS, "scan_id")), **{n: (d, ddl, "scan_id", _keys([*POLICIES, *PACKS], "scan_id")) for n, d, ddl in (("policies", POLICIES, _POLICY), ("packs", PACKS, _PACK))},
    **{n: (d, ddl, "report_id", _keys(REPORTS, "report_id")) for n, d, ddl in (("reports", REPORTS, M.CI), ("notes", ANNOTATIONS, M.ANNOTATIONS))}, "corpus": (CORPUS, M.CORPUS, "case_id", _keys(CORPUS, "case_id")),
}


def _given(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [keyed(spark, sf_dir, *_BY[n]) for n in names]


def _given_sql(*names: str) -> str:
    return ", ".join(keyed_sql(n, *_BY[n]) for n in names)


def address_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 addresses made of each document's number by whether requests may reach them."""
    n = F.col("doc_id").cast("long") * 7919 * 65537 % (1 << 32)
    parts = [F.floor(n / (1 << s)).cast("long") % 256 for s in (24, 16, 8, 0)]
    address = F.concat_ws(".", *(p.cast("string") for p in parts))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", address.alias("address"))
    return docs.select("doc_id", "address", M.within(F.col("address"), M.UNSAFE_NETWORKS).alias("unsafe"), M.within(F.col("address"), M.LOCAL_NETWORKS).alias("local"))


def target_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_faults(*_given(spark, sf_dir, "targets"))


def plan_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.plan_faults(*_given(spark, sf_dir, "plans", "accounts", "cases"))


def case_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.case_faults(*_given(spark, sf_dir, "plans", "accounts", "cases")).distinct()


def option_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.option_faults(*_given(spark, sf_dir, "options"))


def baseline_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.baseline_faults(*_given(spark, sf_dir, "policies", "packs"))


def ci_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ci_faults(*_given(spark, sf_dir, "reports", "notes"))


def corpus_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.corpus_faults(*_given(spark, sf_dir, "corpus"), rows(spark, CATALOG, _CATALOG))


def _each(key: str, of: str, *conditions: tuple[str, str]) -> str:
    return " UNION ".join(f"SELECT {key}, '{name}' AS fault FROM {of} WHERE {cond}" for name, cond in conditions)


_NETS = lambda name, nets: f"{name}(lo, hi) AS (VALUES " + ", ".join(f"({lo}::BIGINT, {hi}::BIGINT)" for lo, hi in M.network_bounds(nets)) + ")"
_WORDS = lambda x: f"list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
_ANY = lambda x, of: f"list_has_any({x}, [{', '.join(map(quoted, of))}])"
_DECODED = lambda x: f"(CASE WHEN NOT contains(url_decode({x}), '%') THEN url_decode({x}) END)"
_MANIFESTS = _given_sql("plans", "accounts", "cases")
_FINDING = "kind = 'finding' AND "
SQL = {
    "address_class": f"""WITH {_NETS("bad", M.UNSAFE_NETWORKS)}, {_NETS("own", M.LOCAL_NETWORKS)}, d AS (SELECT doc_id, (doc_id::BIGINT * 7919 * 65537) % 4294967296 AS n FROM documents)
SELECT doc_id, concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256) AS address, EXISTS (SELECT 1 FROM bad WHERE n BETWEEN lo AND hi) AS "unsafe", EXISTS (SELECT 1 FROM own WHERE n BETWEEN lo AND hi) AS "local" FROM d""",
    "target_constraints": f"""WITH {_given_sql("targets")}, p AS (SELECT *, lower(regexp_extract(target, {quoted(M.URL)}, 1)) AS scheme, regexp_extract(target, {quoted(M.URL)}, 2) AS who, lower(regexp_replace(regexp_extract(target, {quoted(M.URL)}, 3), '^\\[|\\]$', '', 'g')) AS host, regexp_extract(target, {quoted(M.URL)}, 5) AS hash FROM targets),
q AS (SELECT *, regexp_matches(host, '^(10|127|192\\.168|172\\.(1[6-9]|2[0-9]|3[01]))\\.[0-9.]+$') AS priv FROM p) """
    + _each(
        "manifest_id", "q", ("scheme", "scheme NOT IN ('http', 'https')"), ("host_not_listed", "NOT coalesce(list_contains(list_transform(allowed_hosts, lambda h: lower(h)), host), false)"),
        ("forbidden_host", f"host IN ({', '.join(map(quoted, M.METADATA_HOSTS))}) OR ends_with(host, '.internal') OR ends_with(host, '.local') OR ends_with(host, '.localhost')"),
        ("local_elsewhere", "environment = 'local' AND NOT (host IN ('localhost', '::1') OR priv)"), ("without_https", "environment <> 'local' AND scheme <> 'https'"), ("private_address", "environment <> 'local' AND (priv OR host = '::1')"),
        ("credentials", "who <> ''"), ("fragment", "hash <> ''"), ("ipv6", "contains(host, ':') AND host <> '::1'"),
    ),
    "plan_constraints": f"""WITH {_MANIFESTS}, p AS (SELECT *, {_WORDS(_DECODED("login_path"))} AS ws, (SELECT count(DISTINCT label) FROM accounts a WHERE a.manifest_id = plans.manifest_id) AS labels, (SELECT count(*) FROM cases c WHERE c.manifest_id = plans.manifest_id) AS n,
(SELECT count(v) - count(DISTINCT v) FROM (SELECT manifest_id, username_env AS v FROM accounts UNION ALL SELECT manifest_id, password_env FROM accounts) a WHERE a.manifest_id = plans.manifest_id) AS shared FROM plans) """
    + _each(
        "manifest_id", "p", ("two_accounts", "labels <> 2"), ("credentials_shared", "shared > 0"), ("login_fields", "username_field = password_field"), ("login_paths", "token_path = identity_path"),
        ("login_endpoint", f"NOT coalesce({_ANY('ws', ('login', 'signin', 'session', 'token'))}, false)"), ("login_marker", _ANY("ws", [w for w in MUTATING if w not in ("create", "start")])), ("request_budget", "max_requests < 2 + 2 * n"),
    ),
    "case_constraints": f"""WITH {_MANIFESTS}, c AS (SELECT c.*, data_prefix, {_DECODED("path")} AS d, (SELECT list(label) FROM accounts a WHERE a.manifest_id = c.manifest_id) AS labels, count(*) OVER (PARTITION BY c.manifest_id, case_id) AS n, regexp_extract_all(coalesce(CAST(CAST(body AS JSON) AS VARCHAR), ''), {quoted(M.JSON_STRING)}) AS ss FROM cases c JOIN plans USING (manifest_id)),
w AS (SELECT *, {_WORDS("d")} AS ws, {_WORDS("array_to_string(ss, ' ')")} AS bs, list_transform(list_filter(ss, lambda x: ends_with(x, ':')), lambda x: lower(trim(x, '":'))) AS keys, list_transform(list_filter(ss, lambda x: NOT ends_with(x, ':')), lambda x: lower(x)) AS texts, lower(list_last(string_split(json_path, '.'))) AS f FROM c) """
    + _each(
        "manifest_id, case_id", "w", ("case_twice", "n > 1"), ("accounts", "NOT coalesce(list_contains(labels, owner) AND list_contains(labels, other), false) OR owner = other"), ("label_prefix", "NOT regexp_matches(data_label, '^' || data_prefix || '[-_]')"),
        ("expected_label", "match <> 'ownerIdentity' AND expected <> data_label"), ("path", "path IS NULL OR d IS NULL OR path[1] <> '/' OR path[2] = '/' OR contains(path, '#')"), ("path_marker", _ANY("ws", MUTATING)), ("post_reads_nothing", f"method = 'POST' AND NOT {_ANY('ws', READING)}"),
        ("post_without_body", "method = 'POST' AND body IS NULL"), ("get_with_body", "method = 'GET' AND body IS NOT NULL"), ("body_marker", _ANY("bs", MUTATING)),
        ("marker_sent", "match <> 'ownerIdentity' AND (contains(lower(d), lower(expected)) OR len(list_filter(texts, lambda x: contains(x, lower(expected)))) > 0)"),
        ("owner_sent", "match = 'ownerIdentity' AND (regexp_matches(lower(path), '[?&]' || f || '(=|&|$)') OR list_contains(keys, f))"),
    ),
    "option_constraints": f"WITH {_given_sql('options')} "
    + _each(
        "scan_id", "options", ("profile", "profile NOT IN ('predeploy', 'native')"), *((f"{k}_bound", f"{k} NOT BETWEEN 1 AND {v}") for k, v in M.HARD_LIMITS.items()), ("artifacts", "list_contains(list_transform(artifacts, lambda x: trim(x)), '')"), ("artifacts_count", "len(artifacts) > 10"),
        ("rule_packs", "list_contains(list_transform(rule_packs, lambda x: trim(x)), '')"), ("rule_packs_count", "len(rule_packs) > 8"), ("policy_path", "trim(policy_path) = ''"),
    ),
    "baseline_constraints": f"WITH {_given_sql('policies', 'packs')} "
    + _each("scan_id", "policies", ("policy_missing", "base_source = 'operator' AND source IS DISTINCT FROM 'operator'"), ("policy_changed", "base_source = 'operator' AND source = 'operator' AND digest IS DISTINCT FROM base_digest"), ("policy_added", "source = 'operator' AND base_source IS DISTINCT FROM 'operator'"))
    + " UNION SELECT scan_id, 'rule_packs' FROM (SELECT coalesce(a.scan_id, b.scan_id) AS scan_id, a.side AS x, b.side AS y FROM (FROM packs WHERE side = 'now') a FULL JOIN (FROM packs WHERE side = 'base') b ON a.scan_id = b.scan_id AND a.pack_id = b.pack_id AND a.digest = b.digest AND a.rule_count = b.rule_count) WHERE x IS NULL OR y IS NULL",
    "ci_constraints": f"""WITH {_given_sql("reports", "notes")}, k AS (SELECT r.*, count(*) FILTER (kind = 'decision') AS ds, max(level) FILTER (kind = 'decision') AS dl, count(*) FILTER (kind = 'coverage') AS cs, count(*) FILTER (kind = 'coverage' AND level <> 'error') AS cm,
count(*) FILTER (kind = 'finding') AS fs, count(*) FILTER (kind = 'finding' AND blocks) AS bs, count(*) FILTER (baseline_state = 'new') AS news, count(*) FILTER (baseline_state = 'unchanged') AS olds FROM reports r LEFT JOIN notes USING (report_id) GROUP BY ALL), e AS (SELECT n.*, compared FROM notes n JOIN reports USING (report_id)) """
    + _each(
        "report_id", "k", ("exit_code", "exit_code <> CASE decision WHEN 'block' THEN 1 WHEN 'incomplete' THEN 2 ELSE 0 END"), ("open_total", "n_open <> list_sum(by_severity)"), ("coverage_total", "total <> complete + gaps"), ("incomplete_without_gap", "decision = 'incomplete' AND gaps = 0"),
        ("accepted_with_gap", "gaps > 0 AND decision NOT IN ('block', 'incomplete')"), ("one_decision", "ds <> 1"), ("decision_level", "dl <> CASE WHEN decision IN ('block', 'incomplete') THEN 'error' WHEN decision = 'review' THEN 'warning' ELSE 'notice' END"),
        ("coverage_shown", "cs <> least(gaps, 20) OR cm > 0"), ("coverage_omitted", "omitted_coverage <> greatest(gaps - 20, 0)"), ("findings_shown", "fs > 50"), ("findings_omitted", "omitted_findings > 0 AND fs <> 50"), ("block_without_finding", "decision = 'block' AND bs = 0"), ("states_exceed", "compared AND (news > n_new OR olds > n_remaining)"),
    )
    + " UNION "
    + _each(
        "report_id", "e", ("single_line", "regexp_matches(title || message, '[\\x00-\\x1f\\x7f]') OR trim(title) <> title OR trim(message) <> message"), ("path", "path <> '' AND regexp_matches(path, '(^|/)\\.\\.(/|$)')"), ("line_order", "end_line < start_line"), ("column_order", "end_line = start_line AND end_column < start_column"),
        ("place_without_finding", "kind <> 'finding' AND coalesce(path, fingerprint, status, baseline_state, start_line::VARCHAR, blocks::VARCHAR) IS NOT NULL"), ("state_without_baseline", _FINDING + "NOT compared AND baseline_state IS NOT NULL"), ("finding_level", _FINDING + "(level = 'error') <> coalesce(blocks, false)"), ("suppressed_shown", _FINDING + "status = 'suppressed' AND NOT coalesce(blocks, false)"),
    )
    + " UNION SELECT report_id, 'finding_twice' FROM notes WHERE kind = 'finding' GROUP BY report_id, fingerprint HAVING count(*) > 1",
    "corpus_constraints": f"""WITH {_given_sql("corpus")}, cases AS (FROM corpus), {values("rules", CATALOG, _CATALOG)}, u AS (SELECT case_id, category, 'positive' AS k, unnest(expected) AS rule_id FROM cases UNION ALL SELECT case_id, category, 'near_miss', unnest(near) FROM cases) """
    + _each(
        "case_id AS subject", "cases", ("metadata", "coalesce(category, '') = '' OR coalesce(framework, '') = '' OR variant NOT IN ('positive', 'near_miss')"), ("one_source", "(coalesce(path, '') = '') = (coalesce(artifact, '') = '')"),
        ("positive_expects_none", "variant = 'positive' AND coalesce(len(expected), 0) = 0"), ("near_miss_incomplete", "variant = 'near_miss' AND (len(expected) > 0 OR coalesce(len(near), 0) = 0)"),
    )
    + " UNION SELECT case_id, 'case_twice' FROM cases GROUP BY 1 HAVING count(*) > 1 UNION SELECT case_id, 'rule_of_category' FROM u WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.rule_id = u.rule_id AND r.category = u.category)"
    + "".join(f" UNION SELECT rule_id, 'no_{k}' FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM u WHERE k = '{k}')" for k in ("positive", "near_miss")),
}
QUERIES = {f.__name__: f for f in (address_class, target_constraints, plan_constraints, case_constraints, option_constraints, baseline_constraints, ci_constraints, corpus_constraints)}
