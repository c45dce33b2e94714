"""Findings, attack paths, comparison, presentation, tool reports, captured responses and constraints.

Each document stands for one signal, one endpoint or one checked object, in one of the inline shapes by its id; the tests
take the shapes alone as a small scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.functions import text as T
from attestry.operators import contracts as co
from attestry.operators import correlate as cr
from attestry.operators import findings as fi
from attestry.operators import presentation as pr
from attestry.operators import web
from attestry.plans import scans
from attestry.plans.common import fingerprint_sql, keyed, keyed_sql, quoted, rank_sql, redacted_sql, rows, table, values
from attestry.sources import tools


def _sig(n: int, engine: str, rule: str, severity: str, level: str, path: str = "src/a.ts", line: int | None = None, tags: tuple[str, ...] = (), **metadata: str) -> dict:
    routes = metadata.pop("routes", None)
    return {
        "id": f"sig_{n:02d}", "fingerprint": f"{n:02x}" * 32, "engine": engine, "rule_id": rule, "title": f"Title of {rule}", "description": f"{rule} at {path}", "severity": severity, "evidence_level": level, "confidence": "high",
        "path": path, "line": line or n, "snippet": f"s{n}", "tags": list(tags), "cwe": [], "metadata": metadata, "routes": routes.split("|") if routes else None, "ord": n,
    }


SIGNALS = [
    _sig(1, "native", "secret.client-public-privileged-variable", "critical", "static_confirmed", ".env", tags=("secret",)),
    _sig(2, "native", "supabase.table-without-rls", "high", "static_confirmed", "db/1.sql", tags=("supabase", "baas")),
    _sig(3, "native", "firebase.unconditional-access", "critical", "static_confirmed", "firestore.rules", tags=("firebase",)),
    _sig(4, "typescript", "ai.model-output-dangerous-sink", "critical", "static_confirmed", "src/ai.ts"),
    _sig(5, "native", "auth.sensitive-route-without-visible-guard", "high", "inferred", "app/api/admin/route.ts"),
    _sig(6, "typescript", "dataflow.sql-injection", "high", "static_confirmed", "src/db.ts"),
    _sig(7, "python", "fastapi.auth.sensitive-route-without-guard", "high", "inferred", "app/main.py", handler="create_report", route="POST /reports/generate"),
    _sig(8, "python", "fastapi.auth.sensitive-route-without-guard", "high", "inferred", "app/main.py", handler="quiet", route="GET /users"),
    _sig(9, "native", "docker.config.unguarded-service-published", "high", "inferred", "docker-compose.prod.yml", service="api"),
    _sig(10, "python", "python.dataflow.ssrf", "high", "static_confirmed", "app/net.py", function="run_generation"),
    _sig(11, "python", "fastapi.auth.whitelisted-sensitive-route", "high", "static_confirmed", "app/auth.py", route="GET /orders/list"),
    _sig(12, "python", "fastapi.authorization.object-without-ownership-check", "high", "inferred", "app/orders.py", handler="read_order", route="GET /orders/{id}", routes="GET /orders/{id}|GET /v2/orders/{id}"),
    _sig(13, "python", "fastapi.authorization.object-without-ownership-check", "high", "inferred", "app/notes.py", handler="read_note", route="GET /notes/{id}"),
    _sig(14, "python", "fastapi.config.route-raw-exception-response", "medium", "static_confirmed", "app/orders.py", 40, handler="a", routes="GET /orders/{id}", findingGroup="g1", exceptionSerialization="str", responseSink="detail"),
    _sig(15, "python", "fastapi.config.route-raw-exception-response", "medium", "static_confirmed", "app/orders.py", 20, handler="b", route="GET /orders", findingGroup="g1", exceptionSerialization="repr"),
    _sig(16, "python", "fastapi.config.route-raw-exception-response", "medium", "static_confirmed", "app/other.py", 5, handler="c", route="GET /x", findingGroup="g1"),
    _sig(17, "gitleaks", "generic-api-key", "critical", "static_confirmed", "old.txt", tags=("secret",)),
    _sig(18, "native", "privacy.sensitive-logging", "medium", "inferred", "src/../log.ts", tags=("privacy",)),
    _sig(19, "trivy", "CVE-1", "low", "static_confirmed", "package-lock.json"),
    _sig(20, "rule-pack", "house.x", "info", "static_confirmed", "a b.md", rulePackId="house"),
]
COVERAGE = [
    {"domain": "application-config", "engine": "native", "status": "complete", "required": True},
    {"domain": "baas-authorization", "engine": "native", "status": "complete", "required": True},
    {"domain": "python-dataflow", "engine": "python", "status": "partial", "required": True, "reason": "bounded"},
    {"domain": "secrets-history", "engine": "gitleaks", "status": "not_run", "required": True, "reason": "not installed"},
    {"domain": "dependencies-iac", "engine": "trivy", "status": "complete", "required": False},
    {"domain": "rule-pack:house", "engine": "rule-pack", "status": "complete", "required": True},
]
SUPPRESSIONS = [{"fingerprint": s["fingerprint"].upper(), "reason": f"r{i}", "expires": e, "ord": i} for i, (s, e) in enumerate(((SIGNALS[5], "2026-06-01"), (SIGNALS[17], "2026-05-31"), (SIGNALS[18], "2026-06-01T00:00:01Z"), (SIGNALS[18], "2999-01-01")))]
AS_OF = "2026-06-01T00:00:00Z"
BASELINE = [{**s, "ord": i} for i, s in enumerate([SIGNALS[16], SIGNALS[17], SIGNALS[18], SIGNALS[19], SIGNALS[1], _sig(30, "native", "privacy.sensitive-logging", "medium", "inferred", tags=("privacy",)), _sig(31, "python", "python.dataflow.ssrf", "high", "static_confirmed"), _sig(32, "trivy", "CVE-0", "high", "static_confirmed"), _sig(33, "gitleaks", "generic", "critical", "static_confirmed"), _sig(34, "rule-pack", "house.y", "low", "inferred", rulePackId="house")])]


#: Documents in the shapes t, as SQL that Spark and DuckDB read alike but for the names of the digest and of columns left out.
_FP = "{sha}(CAST({x} AS {string}){more})"
_DIALECT = {True: {"sha": "sha2", "string": "string", "more": ", 256"}, False: {"sha": "sha256", "string": "VARCHAR", "more": ""}}
_OWN = {"id": "'sig_' || doc_id", "fingerprint": "<doc_id>", "path": "coalesce(source, 'none') || '/' || t.path", "line": "CAST(t.line + doc_id % 50 AS int)", "ord": "doc_id"}
SUPPRESSED = 11
_SUPPRESSION = "k int, " + R.SUPPRESSIONS


def _digested(sql: str, spark: bool) -> str:
    own = re.sub(r"<([^<>]+)>", lambda m: _FP.format(x=m[1], **_DIALECT[spark]), sql)
    return own if spark else own.replace("* EXCEPT (", "* EXCLUDE (")


def _columns(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


_SIGNAL = "SELECT " + ", ".join(f"{_OWN.get(c, f't.{c}')} AS {c}" for c in _columns(R.SIGNALS)) + f" FROM {{documents}} d JOIN {{shapes}} t ON t.k = d.doc_id % {len(SIGNALS)}"
_SUPPRESS = f"SELECT upper(<doc_id>) AS fingerprint, t.reason || doc_id AS reason, t.expires, doc_id AS ord FROM {{documents}} d JOIN {{shapes}} t ON t.k = d.doc_id % {SUPPRESSED}"
_BEFORE = "SELECT * EXCEPT (id, fingerprint), id, fingerprint FROM {signals} WHERE ord % 3 > 0 UNION ALL SELECT * EXCEPT (id, fingerprint), 'gone_' || ord, <'gone' || ord> FROM {signals} WHERE ord % 5 = 0"


def _numbered(data: list[dict]) -> list[dict]:
    return [{**d, "k": k} for k, d in enumerate(data)]


def _shaped(spark: SparkSession, sf_dir: str, sql: str, **shapes: DataFrame) -> DataFrame:
    return spark.sql(_digested(sql, True), documents=table(spark, sf_dir, "documents"), **{k: F.broadcast(v) for k, v in shapes.items()})  # shapes are a few inline rows


def _signals(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """A signal of each document, or the shapes as they are."""
    if sf_dir is None:
        return rows(spark, SIGNALS, R.SIGNALS)
    return _shaped(spark, sf_dir, _SIGNAL, shapes=rows(spark, _numbered(SIGNALS), f"k int, {R.SIGNALS}"))


def _suppressions(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    if sf_dir is None:
        return rows(spark, SUPPRESSIONS, R.SUPPRESSIONS + ", ord long")
    return _shaped(spark, sf_dir, _SUPPRESS, shapes=rows(spark, _numbered(SUPPRESSIONS), _SUPPRESSION))


def _baseline(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Two thirds of the signals, and ones that are gone since."""
    if sf_dir is None:
        return rows(spark, BASELINE, R.SIGNALS)
    return spark.sql(_digested(_BEFORE, True), signals=_signals(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    s = _signals(spark, sf_dir)
    return fi.suppressed(fi.merged(s, cr.attack_paths(s)), _suppressions(spark, sf_dir), AS_OF)


def _plain(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """Findings without correlation, as presentation gets them from most scans."""
    return fi.suppressed(fi.merged(_signals(spark, sf_dir), rows(spark, [], R.ATTACK_PATHS)), _suppressions(spark, sf_dir), AS_OF)


def compared(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    before = _baseline(spark, sf_dir)
    return fi.compared(_plain(spark, sf_dir), rows(spark, COVERAGE, R.COVERAGE), fi.merged(before, rows(spark, [], R.ATTACK_PATHS)), before)


def attack_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.attack_paths(_signals(spark, sf_dir)).select("id", "fingerprint", "title", "severity", "evidence_level", F.array_join("signal_ids", ",").alias("signal_ids"))


def evidence_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each order's lines, with the return flag as a level."""
    level = F.when(F.col("l_returnflag") == "R", "verified").when(F.col("l_returnflag") == "A", "static_confirmed").otherwise("inferred")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cr.evidence(level).alias("evidence"))


def finding_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).select("fingerprint", "status", "reason", "expires")


def finding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after correlation: what paths stand for is gone, what is stronger stays."""
    return _findings(spark, sf_dir).select("title", "severity", "evidence_level", "status", F.array_join("signal_ids", ",").alias("signal_ids"))


def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of five policies over the same findings."""
    f, s, c = _plain(spark, sf_dir), _signals(spark, sf_dir), rows(spark, COVERAGE, R.COVERAGE)
    weak = f.where(T.severity_rank(F.col("severity")) <= 2)
    calm = rows(spark, [COVERAGE[0]], R.COVERAGE)
    cases = [
        ("default", fi.decided(f, c, s)),
        ("rule", fi.decided(f, c, s, blocking_rules=["CVE-1", "house.x"])),
        ("suppressions", fi.decided(weak, c, s, {"minimum_severity": "critical", "include_inferred": False, "require_no_suppressions": True}, operator_policy=True)),
        ("gaps", fi.decided(weak, c, s)),
        ("inferred", fi.decided(f, c, s, {"minimum_severity": "medium", "include_inferred": True, "require_no_suppressions": False}, operator_policy=True)),
        ("review", fi.decided(weak, calm, s)),
    ]
    out = None
    for name, got in cases:
        got = got.select(F.lit(name).alias("policy"), "decision", F.array_join("reasons", "; ").alias("reasons"))
        out = got if out is None else out.unionByName(got)
    return out


def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)


def finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pr.groups(_plain(spark, sf_dir), _signals(spark, sf_dir))
    return got.select("group_id", "status", "severity", "rule_id", "path", "n_members", "n_findings", *(F.array_join(c, ",").alias(c) for c in ("handlers", "routes", "patterns")))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.top_members(_plain(spark, sf_dir), _signals(spark, sf_dir), 2).select("finding_id", "group_id", "path", "line", F.col("rank").cast("long").alias("rank"))


def route_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.cards(_plain(spark, sf_dir), _signals(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


def deployment_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.deployments(_plain(spark, sf_dir), _signals(spark, sf_dir))


def ci_top_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pr.annotated(_plain(spark, sf_dir), _signals(spark, sf_dir), compare_reports(spark, sf_dir), blocking_rules=("CVE-1",))
    return pr.top_annotations(got, 12).select("id", "level", "title", "message", "path", "start_line", "blocks_release", "baseline_state")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a scan of the documents."""
    return pr.coverage_gaps(scans.scan_coverage(spark, sf_dir))


def sarif_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.sarif_results(_findings(spark, sf_dir), _signals(spark, sf_dir))


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.sarif_rules(_signals(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


def fix_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    paths = cr.attack_paths(s).withColumn("summary", F.concat(F.lit("Path: "), "title"))
    return co.fix_contract(_findings(spark, sf_dir), s, paths).select("title", "severity", F.array_join("evidence", "; ").alias("evidence"), "summary")


_LEFT, _TWICE = "ord % 7 <> 3", "ord % 11 = 5"


def report_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a report breaks each of its rules, where some signals are missing and some are there twice."""
    s = _signals(spark, sf_dir)
    return co.report_checks(s.where(_LEFT).unionByName(s.where(_TWICE)), _plain(spark, sf_dir), rows(spark, COVERAGE, R.COVERAGE))


GITLEAKS = '[{"Description":"Key","StartLine":3,"File":"a/b.txt","RuleID":"generic-api-key","Match":"api_key = abcdefghijkl","Commit":"c1"},{"File":"","StartLine":1,"Match":""},{"RuleID":"x","File":"c.txt"}]'
OPENGREP = '{"results":[{"check_id":"rules.sast.python.unsafe-pickle-load","path":"a.py","start":{"line":2,"col":1},"end":{"line":2,"col":9},"extra":{"message":"Pickle","severity":"ERROR","lines":"pickle.loads(x)","metadata":{"cwe":["CWE-502"],"technology":["python"]}}},{"check_id":"other.rule","extra":{"severity":"WARNING","metadata":{"cwe":"CWE-1"}}},{}],"errors":["e"]}'
TRIVY = '{"SchemaVersion":2,"Results":[{"Target":"lock","Vulnerabilities":[{"VulnerabilityID":"CVE-1","PkgName":"p","Severity":"HIGH"},{"PkgName":"q","Severity":"UNKNOWN"}],"Secrets":[{"RuleID":"aws","Severity":"","StartLine":4,"Match":"AKIA' + 'ABCDEFGHIJKL"}]},{"Target":"Dockerfile","Misconfigurations":[{"ID":"DS001","Message":"m","Severity":"LOW","CauseMetadata":{"StartLine":1,"Code":{"Lines":[{"Content":"FROM x"},{"Content":"USER root"}]}}}]}]}'
RUNS = [
    {"engine": "gitleaks", "installed": True, "exit_code": 1, "timed_out": False, "json": GITLEAKS},
    {"engine": "opengrep", "installed": True, "exit_code": 0, "timed_out": False, "json": OPENGREP},
    {"engine": "trivy", "installed": True, "exit_code": 0, "timed_out": False, "json": TRIVY.replace('"SchemaVersion":2', '"SchemaVersion":1')},
    {"engine": "gitleaks", "installed": False, "exit_code": None, "timed_out": False, "json": None},
    {"engine": "opengrep", "installed": True, "exit_code": 2, "timed_out": False, "json": "{}"},
    {"engine": "trivy", "installed": True, "exit_code": 0, "timed_out": True, "json": "{"},
    {"engine": "gitleaks", "installed": True, "exit_code": 0, "timed_out": False, "json": "oops"},
]
_RUN = "engine string, installed boolean, exit_code int, timed_out boolean, json string"


#: A third of the documents gives a report of each tool; places and names of its first finding have the document's number.
REPORTERS = (GITLEAKS, OPENGREP, TRIVY)
_REPORTS = "SELECT replace(replace(replace({}, 'a/b.txt', 'a/' || doc_id || '.txt'), '\"a.py\"', '\"a' || doc_id || '.py\"'), '\"p\"', '\"p' || doc_id || '\"') AS json FROM {documents} WHERE doc_id % 3 = {k}"


def tool_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda text: spark.sql(_REPORTS.format(quoted(text).replace("{", "{{").replace("}", "}}").replace("\\", "\\\\"), k=REPORTERS.index(text), documents="{documents}"), documents=table(spark, sf_dir, "documents"))
    got = tools.gitleaks(of(GITLEAKS)).unionByName(tools.opengrep(of(OPENGREP))).unionByName(tools.trivy(of(TRIVY)))
    return got.select("engine", "rule_id", "title", "severity", "path", "line", "snippet", F.array_join(F.coalesce("cwe", F.array().cast("array<string>")), ",").alias("cwe"), F.array_join("tags", ",").alias("tags"))


_RUNS = ([{**r, "run": f"r{i}"} for i, r in enumerate(RUNS)], f"{_RUN}, run string", "run", [f"r{i}" for i in range(len(RUNS))])


def tool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's run of each document."""
    return tools.coverage(keyed(spark, sf_dir, *_RUNS))


DATABASES = [{"name": n, "json": j, "size": s} for n, j, s in (("a", None, 0), ("b", '{"Version":2,"NextUpdate":"2026-07-01T00:00:00Z"}', 5), ("c", '{"Version":2,"NextUpdate":"2026-05-01T00:00:00Z"}', 5), ("d", '{"Version":1,"NextUpdate":"2026-07-01T00:00:00Z"}', 5), ("e", '{"Version":2,"NextUpdate":"soon"}', 5), ("f", '{"Version":2,"NextUpdate":"2026-07-01T00:00:00Z"}', 0))]
_DATABASE = "name string, json string, size long"


def database_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.database_state(keyed(spark, sf_dir, DATABASES, _DATABASE, "name", [d["name"] for d in DATABASES]), AS_OF)


RESPONSES = [
    {"case_id": "c1", "account": "a", "url": "https://x.test/1", "status": 200, "headers": {"Content-Security-Policy": "x", "X-Content-Type-Options": "nosniff"}, "set_cookie": ["sid=abc123; Secure; HttpOnly; SameSite=Lax", "theme=dark"], "body": '{"o":{"m":"k1"}}'},
    {"case_id": "c1", "account": "b", "url": "https://x.test/1b", "status": 200, "headers": {"strict-transport-security": "max-age=1"}, "set_cookie": ["authToken=zzz; HttpOnly"], "body": '{"o":{"m":"k1"}}'},
    {"case_id": "c2", "account": "a", "url": "http://x.test/2", "status": 200, "headers": {}, "set_cookie": [], "body": '{"o":{"m":"k2"}}'},
    {"case_id": "c2", "account": "b", "url": "http://x.test/2b", "status": 403, "headers": {"x-content-type-options": "other"}, "set_cookie": ["session_id=1; Path=/"], "body": "no"},
    {"case_id": "c3", "account": "a", "url": "https://x.test/3", "status": 500, "headers": {}, "set_cookie": [], "body": None},
    {"case_id": "c3", "account": "b", "url": "https://x.test/3b", "status": 200, "headers": {}, "set_cookie": [], "body": '{"o":{"m":"k3"}}'},
    {"case_id": "c4", "account": "a", "url": "https://x.test/4", "status": 200, "headers": {}, "set_cookie": [], "body": '{"o":{"m":"k4"}}'},
    {"case_id": "c4", "account": "b", "url": "https://x.test/4b", "status": 200, "headers": {}, "set_cookie": [], "body": '{"o":{"m":"else"}}'},
]
CASES = [{"case_id": f"c{i}", "owner": "a", "other": "b", "marker_path": "o.m", "marker": f"k{i}"} for i in range(1, 6)]
CASES += [
    {"case_id": "t1", "owner": "a", "other": "b", "marker_path": "id", "marker": "7"},
    {"case_id": "t2", "owner": "a", "other": "b", "marker_path": "id", "marker": "7", "match": "ownerIdentity"},
    {"case_id": "t3", "owner": "a", "other": "b", "marker_path": "o.id", "marker": "x"},
]
RESPONSES += [{"case_id": c, "account": a, "url": "http://x", "status": 200, "headers": {}, "set_cookie": [], "body": b} for c in ("t1", "t2") for a, b in (("a", '{"id": 7}'), ("b", '{"id": "7"}'))]
RESPONSES += [{"case_id": "t3", "account": a, "url": "http://x", "status": 200, "headers": {}, "set_cookie": [], "body": b} for a, b in (("a", '{"o": {"id": "x"}}'), ("b", '{"o": {"id": true}}'))]
_CASE = "case_id string, owner string, other string, marker_path string, marker string, match string"
API = [{"method": m, "path": p, "handler": h} for m, p, h in (("GET", "/orders/{id}", "readOrder"), ("POST", "/orders", "createOrder"), ("GET", "/orders/{id}/cancel", None), ("GET", "/health", "ping"), ("GET", "/files/list", "downloadAll"), ("GET", "/orders/{id}", "getOrder"))]
_API = "method string, path string, handler string"


_CHECKED = f"FROM {{documents}} d JOIN {{cases}} t ON t.k = d.doc_id % {len(CASES)}"
_CASES = "SELECT t.case_id || '_' || doc_id AS case_id, t.owner, t.other, t.marker_path, t.marker, t.match " + _CHECKED
_RESPONSES = "SELECT r.case_id || '_' || doc_id AS case_id, r.account, r.url || '/' || doc_id AS url, r.status, r.headers, r.set_cookie, r.body " + _CHECKED + " JOIN {responses} r ON r.case_id = t.case_id"
_ENDPOINTS = f"SELECT t.method, '/' || coalesce(source, 'none') || t.path || CASE WHEN doc_id % 2 = 0 THEN '/' || doc_id ELSE '' END AS path, t.handler FROM {{documents}} d JOIN {{api}} t ON t.k = d.doc_id % {len(API)}"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two accounts got for the object that each document stands for."""
    return _shaped(spark, sf_dir, _RESPONSES, cases=rows(spark, _numbered(CASES), f"k int, {_CASE}"), responses=rows(spark, RESPONSES, R.RESPONSES))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, _CASES, cases=rows(spark, _numbered(CASES), f"k int, {_CASE}"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, _ENDPOINTS, api=rows(spark, _numbered(API), f"k int, {_API}"))


def header_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.headers_missing(responses(spark, sf_dir))


def cookie_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.weak_cookies(responses(spark, sf_dir))


def bola_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.object_access(_checked(spark, sf_dir), responses(spark, sf_dir))


def bola_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.access_coverage(bola_evaluate(spark, sf_dir))


def bola_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.route_kinds(endpoints(spark, sf_dir))


def bola_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.drafted(web.route_kinds(endpoints(spark, sf_dir)))


EXPECTED = [{"category": c, "case_id": i, "rule_id": r} for c, i, r in (("secrets", "s1", "secret.openai"), ("secrets", "s1", "secret.private-key"), ("secrets", "s2", None), ("mobile", "m1", "android.backup-enabled"), ("mobile", "m2", None), ("empty", "e1", None))]
ACTUAL = [{"case_id": i, "rule_id": r} for i, r in (("s1", "secret.openai"), ("s2", "secret.openai"), ("m1", "android.backup-enabled"), ("m1", "android.backup-enabled"), ("zz", "secret.openai"))]


_CASE_IDS = list(dict.fromkeys(x["case_id"] for x in (*EXPECTED, *ACTUAL)))
_EXPECTED = (EXPECTED, "category string, case_id string, rule_id string", "case_id", _CASE_IDS)
_ACTUAL = (ACTUAL, "case_id string, rule_id string", "case_id", _CASE_IDS)


def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the cases that the documents stand for."""
    return co.scored(keyed(spark, sf_dir, *_EXPECTED), keyed(spark, sf_dir, *_ACTUAL))


CATALOG = [{"rule_id": "a.one", "profiles": ["p1", "p2"]}, {"rule_id": "a.two", "profiles": ["p9"]}, {"rule_id": "a.two", "profiles": []}]


_CATALOG = (CATALOG, "rule_id string, profiles array<string>", "rule_id", ["a.one", "a.two"])


def catalog_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.catalog_checks(keyed(spark, sf_dir, *_CATALOG), rows(spark, [{"profile_id": "p1"}, {"profile_id": "p2"}], "profile_id string"))


#: Rules that a policy requires, rules that block, and rules that there are.
POLICY_RULES = ("abx", "bcy", "abc")
_ids = lambda xs: ([{"rule_id": x} for x in xs], "rule_id string", "rule_id", sorted(set("".join(POLICY_RULES))))


def policy_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.policy_checks(*(keyed(spark, sf_dir, *_ids(xs)) for xs in POLICY_RULES))


_PREVIEW_PACK = "pack_id string, rule_count int, status string, reasons array<string>, inventory_status string, file_count int"
_PREVIEW_RULE = "pack_id string, rule_id string, emit_when string, evaluated int, selected int, shown array<string>, omitted int, status string, reasons array<string>"
PREVIEW_PACKS = [
    {"pack_id": "house", "rule_count": 3, "status": "complete", "reasons": [], "inventory_status": "complete", "file_count": 5},
    {"pack_id": "yard", "rule_count": 2, "status": "partial", "reasons": ["budget"], "inventory_status": "complete", "file_count": 5},
    {"pack_id": "empty", "rule_count": 1, "status": "partial", "reasons": ["walk"], "inventory_status": "partial", "file_count": 2},
    {"pack_id": "calm", "rule_count": 0, "status": "partial", "reasons": [], "inventory_status": "complete", "file_count": 2},
]


def _preview_rule(pack: str, name: str, emit: str, evaluated: int, shown: int, omitted: int, selected: int, status: str, *reasons: str) -> dict:
    paths = [f"src/{i}.ts" for i in range(shown)]
    return {"pack_id": pack, "rule_id": name, "emit_when": emit, "evaluated": evaluated, "selected": selected, "shown": paths, "omitted": omitted, "status": status, "reasons": list(reasons)}


PREVIEW_RULES = [
    _preview_rule("house", "custom.house.a", "present", 5, 2, 1, 3, "complete"),
    _preview_rule("house", "custom.house.a", "absent", 5, 0, 0, 0, "complete"),
    _preview_rule("house", "custom.yard.b", "present", 6, 1, 0, 2, "complete"),
    _preview_rule("yard", "custom.yard.c", "present", 4, 5, 0, 5, "partial", "budget"),
    _preview_rule("yard", "custom.yard.d", "absent", 4, 0, 0, 0, "partial"),
]


_PREVIEW_IDS = [p["pack_id"] for p in PREVIEW_PACKS]
#: A rule's id under its pack's id, which ends in the document's number.
_OWN_RULE = "replace(rule_id, '.' || split_part(pack_id, '_', 1) || '.', '.' || pack_id || '.')"


def preview_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the previews of documents' packs break each of their rules."""
    packs = keyed(spark, sf_dir, PREVIEW_PACKS, _PREVIEW_PACK, "pack_id", _PREVIEW_IDS)
    shown = keyed(spark, sf_dir, PREVIEW_RULES, _PREVIEW_RULE, "pack_id", _PREVIEW_IDS).withColumn("rule_id", F.expr(_OWN_RULE))
    return co.preview_checks(packs, shown)


_DOCS = {"documents": "documents"}
_S = f"{values('signal_shapes', _numbered(SIGNALS), f'k int, {R.SIGNALS}')}, signals AS ({_digested(_SIGNAL, False).format(shapes='signal_shapes', **_DOCS)})"
_SUP = f"{values('suppression_shapes', _numbered(SUPPRESSIONS), _SUPPRESSION)}, suppressions AS ({_digested(_SUPPRESS, False).format(shapes='suppression_shapes', **_DOCS)})"
_C, _B = values("coverage", COVERAGE, R.COVERAGE), f"baseline AS ({_digested(_BEFORE, False).format(signals='signals')})"
_LIVE = f"(SELECT lower(fingerprint) AS fingerprint, arg_min(reason, ord) AS reason, arg_min(expires, ord) AS expires FROM suppressions WHERE CASE WHEN regexp_matches(expires, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN expires::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND ELSE replace(expires, 'Z', '')::TIMESTAMP END > TIMESTAMP '2026-06-01' GROUP BY 1)"
_PLAIN = f"plain AS (SELECT 'finding_' || substr(s.fingerprint, 1, 16) AS id, s.fingerprint, title, severity, evidence_level, CASE WHEN l.reason IS NULL THEN 'open' ELSE 'suppressed' END AS status, s.id AS signal_id, l.reason, l.expires FROM signals s LEFT JOIN {_LIVE} l ON s.fingerprint = l.fingerprint)"


def _path(key: str, where: str, level: str, parts: str, n: int, by: str = "()") -> str:
    t = quoted(cr.TITLES[key])
    return f"""SELECT sha256({t} || chr(0) || string_agg(fingerprint, chr(0) ORDER BY fingerprint)) AS fingerprint, {t} AS title, {level} AS evidence_level, string_agg(id, ',' ORDER BY part, ord) AS signal_ids
FROM (SELECT *, {parts} AS part FROM signals WHERE {where}) GROUP BY {by} HAVING count(DISTINCT part) = {n}"""


_LEVEL = "CASE WHEN bool_and(evidence_level = 'verified') THEN 'verified' WHEN bool_and(evidence_level <> 'inferred') THEN 'static_confirmed' ELSE 'inferred' END"
_NET = "regexp_matches(rule_id, 'python\\.dataflow\\.(?:ssrf|client-url-with-server-secret)')"
_HINT = lambda word, names: f"(regexp_matches(metadata['route'], '(?i){word}') AND EXISTS (SELECT 1 FROM signals n WHERE {_NET.replace('rule_id', 'n.rule_id')} AND regexp_matches(n.metadata['function'], '(?i){names}')))"
_ROOT = "list_filter(string_split(list_last(string_split({0}, ' ')), '/'), lambda p: p <> '')[1]"
_PATHS = f"""paths AS (
{_path("client_data", "regexp_matches(rule_id, 'client-public-privileged|artifact\\.embedded-secret|supabase\\.(?:table-without-rls|permissive-rls-policy)|firebase\\.unconditional-access')", _LEVEL, "CASE WHEN regexp_matches(rule_id, '^(supabase|firebase)') THEN 1 ELSE 0 END", 2)}
UNION ALL {_path("model", "contains(rule_id, 'ai.model-output-dangerous-sink')", _LEVEL, "0", 1, "id")}
UNION ALL {_path("injection", "regexp_matches(rule_id, 'auth\\.sensitive-route-without-visible-guard|dataflow\\.(?:sql-injection|command-injection)')", "'inferred'", "CASE WHEN starts_with(rule_id, 'auth') THEN 0 ELSE 1 END", 2)}
UNION ALL {_path("published", f"(rule_id = 'fastapi.auth.sensitive-route-without-guard' AND (EXISTS (SELECT 1 FROM signals n WHERE {_NET.replace('rule_id', 'n.rule_id')} AND n.metadata['function'] = signals.metadata['handler']) OR {_HINT('generate', 'generation|generate')} OR {_HINT('review', 'review')})) OR rule_id = 'docker.config.unguarded-service-published' OR {_NET}", "'inferred'", f"CASE WHEN {_NET} THEN 2 WHEN starts_with(rule_id, 'docker') THEN 1 ELSE 0 END", 3)}
UNION ALL {_path("bypass", f"rule_id = 'fastapi.auth.whitelisted-sensitive-route' OR (rule_id = 'fastapi.authorization.object-without-ownership-check' AND {_ROOT.format(chr(109) + 'etadata[' + quoted('route') + ']')} IN (SELECT {_ROOT.format('w.metadata[' + quoted('route') + ']')} FROM signals w WHERE w.rule_id = 'fastapi.auth.whitelisted-sensitive-route'))", "'inferred'", "CASE WHEN contains(rule_id, 'whitelisted') THEN 0 ELSE 1 END", 2)}
)"""
_CORRELATED = f"""{_S}, {_SUP}, {_PATHS}, used AS (SELECT unnest(string_split(signal_ids, ',')) AS id, evidence_level AS pl FROM paths),
consumed AS (SELECT DISTINCT u.id FROM used u JOIN signals s ON u.id = s.id WHERE pl <> 'inferred' OR s.evidence_level = 'inferred'),
found AS (SELECT fingerprint, title, 'critical' AS severity, evidence_level, signal_ids, 'path_' || substr(fingerprint, 1, 16) AS attack_path_id FROM paths UNION ALL SELECT fingerprint, title, severity, evidence_level, id, NULL FROM signals WHERE id NOT IN (SELECT id FROM consumed)),
findings AS (SELECT f.*, CASE WHEN l.reason IS NULL THEN 'open' ELSE 'suppressed' END AS status, 'finding_' || substr(f.fingerprint, 1, 16) AS id FROM found f LEFT JOIN {_LIVE} l ON f.fingerprint = l.fingerprint)"""
_GATE = f"count(*) FILTER (status = 'open' AND {rank_sql('severity')} >= {{0}} AND (evidence_level <> 'inferred' OR {{1}}))"
_GAPS = "(SELECT string_agg(domain || ': ' || status || ' (' || reason || ')', '; ' ORDER BY domain) FROM coverage WHERE required AND status <> 'complete')"
_WEAK = f"(SELECT * FROM plain WHERE {rank_sql('severity')} <= 2)"
_MEMBERS = """members AS (SELECT p.id AS finding_id, status, p.severity, s.rule_id, s.path, s.line, trim(s.metadata['findingGroup']) AS group_id, s.metadata['handler'] AS handler,
  nullif(concat_ws(' → ', s.metadata['exceptionSerialization'], s.metadata['responseSink']), '') AS pattern, list_sort(list_distinct(coalesce(s.routes, CASE WHEN s.metadata['route'] IS NOT NULL THEN [s.metadata['route']] ELSE [] END))) AS routes
  FROM plain p JOIN signals s ON p.signal_id = s.id WHERE s.metadata['findingGroup'] IS NOT NULL)"""
_CARDS = "dim(rule_id, framework, category, o) AS (VALUES " + ", ".join(f"('{k}', '{f}', '{c}', {pr.CATEGORIES.index(c)})" for k, (f, c) in pr.ROUTE_RULES.items()) + ")"
_FLAT = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CHECK = lambda *each: " UNION ALL ".join(f"SELECT '{n}' AS check_id, count(*) AS violations FROM ({q})" for n, q in each)
_COMPARED = f"""now AS (SELECT DISTINCT fingerprint FROM plain WHERE status = 'open'), complete AS (SELECT domain FROM coverage WHERE status = 'complete'),
old AS (SELECT fingerprint, CASE engine WHEN 'trivy' THEN 'dependencies-iac' WHEN 'gitleaks' THEN 'secrets-history' WHEN 'opengrep' THEN 'sast-general' WHEN 'artifact' THEN 'mobile-artifact-static' WHEN 'typescript' THEN 'js-ts-dataflow' WHEN 'rule-pack' THEN 'rule-pack:' || metadata['rulePackId']
  WHEN 'native' THEN CASE WHEN list_has_any(tags, ['supabase', 'firebase', 'baas']) THEN 'baas-authorization' WHEN list_has_any(tags, ['mobile', 'android', 'ios', 'flutter', 'react-native']) THEN 'mobile-source-config' WHEN list_contains(tags, 'secret') AND starts_with(rule_id, 'secret.') THEN 'secrets' ELSE 'application-config' END END AS domain FROM baseline),
compared AS (SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, CASE WHEN o.fingerprint IS NULL THEN 'new' WHEN n.fingerprint IS NOT NULL THEN 'remaining' WHEN o.domain IS NULL OR o.domain NOT IN (SELECT domain FROM complete) THEN 'not_rechecked' ELSE 'resolved' END AS state FROM now n FULL JOIN old o ON n.fingerprint = o.fingerprint)"""
_SHAPES = f"{values('case_shapes', _numbered(CASES), f'k int, {_CASE}')}, {values('response_shapes', RESPONSES, R.RESPONSES)}"
_R = f"{_SHAPES}, responses AS ({_RESPONSES.format(cases='case_shapes', responses='response_shapes', **_DOCS)})"
_K = f"cases AS ({_CASES.format(cases='case_shapes', **_DOCS)})"
_A = f"{values('api_shapes', _numbered(API), f'k int, {_API}')}, api AS ({_ENDPOINTS.format(api='api_shapes', **_DOCS)})"
_VERDICTS = f"""{_R}, {_K}, verdicts AS (SELECT c.case_id, CASE WHEN NOT coalesce(bool_or(account = owner AND status BETWEEN 200 AND 299 AND m), false) THEN 'inconclusive' WHEN coalesce(bool_or(account = other AND status BETWEEN 200 AND 299 AND m), false) THEN 'vulnerable'
  WHEN coalesce(bool_or(account = other AND status IN (401, 403, 404)), false) THEN 'protected' ELSE 'inconclusive' END AS verdict
  FROM cases c LEFT JOIN (SELECT r.*, k.case_id AS own, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.' || marker_path) = marker AND (json_type(body, '$.' || marker_path) = 'VARCHAR' OR (match = 'ownerIdentity' AND json_type(body, '$.' || marker_path) IN ('BIGINT', 'UBIGINT', 'DOUBLE'))), false) ELSE false END AS m
    FROM responses r JOIN cases k ON r.case_id = k.case_id) r ON c.case_id = r.case_id GROUP BY c.case_id)"""
_WORDS = lambda xs: "len(list_intersect(ws, [" + ", ".join(map(quoted, xs)) + "])) > 0"
_KINDS = f"""{_A}, worded AS (SELECT *, string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+') AS ws FROM api),
kinds AS (SELECT method, path, handler, CASE WHEN {_WORDS(web.MUTATING)} OR upper(method) NOT IN ('GET', 'POST') THEN 'mutation_excluded' WHEN upper(method) = 'GET' OR {_WORDS(web.READING)} THEN 'read_candidate' ELSE 'manual_review' END AS kind FROM worded)"""
_SCORED = f"{keyed_sql('expected', *_EXPECTED)}, {keyed_sql('actual', *_ACTUAL)}"

QUERIES = {
    f.__name__: f
    for f in (
        attack_paths, evidence_lattice, finding_suppress, finding_paths, decision_ladder, compare_reports, finding_groups, group_members, route_cards, deployment_contexts, ci_top_annotations, coverage_gaps, sarif_join, sarif_rules, fix_contracts, report_constraints,
        tool_json_flatten, tool_coverage, database_freshness, header_missing, cookie_flags, bola_evaluate, bola_coverage, bola_classify, bola_draft, benchmark_scores, catalog_fk, policy_constraints, preview_constraints,
    )
}
SQL = {
    "attack_paths": f"WITH {_S}, {_PATHS} SELECT 'path_' || substr(fingerprint, 1, 16) AS id, fingerprint, title, 'critical' AS severity, evidence_level, signal_ids FROM paths",
    "evidence_lattice": f"SELECT l_orderkey, {_LEVEL} AS evidence FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'verified' WHEN 'A' THEN 'static_confirmed' ELSE 'inferred' END AS evidence_level FROM lineitem) GROUP BY l_orderkey",
    "finding_suppress": f"WITH {_S}, {_SUP}, {_PLAIN} SELECT fingerprint, status, reason, expires FROM plain",
    "finding_paths": f"WITH {_CORRELATED} SELECT title, severity, evidence_level, status, signal_ids FROM findings",
    "decision_ladder": f"""WITH {_S}, {_SUP}, {_C}, {_PLAIN}
SELECT 'default' AS policy, 'block' AS decision, {_GATE.format(3, 'false')} || ' high or critical evidence-backed finding(s)' AS reasons FROM plain
UNION ALL SELECT 'rule', 'block', count(*) || ' finding(s) matched policy blocking rules' FROM plain p JOIN signals s ON p.signal_id = s.id WHERE s.rule_id IN ('CVE-1', 'house.x')
UNION ALL SELECT 'suppressions', 'block', count(*) FILTER (status = 'suppressed') || ' suppression(s) violate the policy no-suppression gate' FROM {_WEAK}
UNION ALL SELECT 'gaps', 'incomplete', {_GAPS}
UNION ALL SELECT 'inferred', 'block', {_GATE.format(2, 'true')} || ' finding(s) met policy gate severity medium including inferred evidence' FROM plain
UNION ALL SELECT 'review', 'review', {_GATE.format(2, 'true')} || ' medium-risk or inferred finding(s) require review' FROM {_WEAK}""",
    "compare_reports": f"WITH {_S}, {_SUP}, {_C}, {_B}, {_PLAIN}, {_COMPARED} SELECT fingerprint, state FROM compared",
    "finding_groups": f"""WITH {_S}, {_SUP}, {_PLAIN}, {_MEMBERS} SELECT group_id, status, severity, rule_id, path, count(*) AS n_members, count(DISTINCT finding_id) AS n_findings, string_agg(DISTINCT handler, ',' ORDER BY handler) AS handlers,
  array_to_string(list_sort(list_distinct(flatten(list(routes)))), ',') AS routes, coalesce(string_agg(DISTINCT pattern, ',' ORDER BY pattern), '') AS patterns FROM members GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""",
    "group_members": f"WITH {_S}, {_SUP}, {_PLAIN}, {_MEMBERS} SELECT * FROM (SELECT finding_id, group_id, path, line, row_number() OVER (PARTITION BY group_id, status, severity, rule_id, path ORDER BY line, handler, finding_id) AS rank FROM members) WHERE rank <= 2",
    "route_cards": f"""WITH {_S}, {_SUP}, {_PLAIN}, {_CARDS}, each_ AS (SELECT s.id AS sid, framework, category, o, unnest(list_distinct(list_prepend(s.metadata['route'], coalesce(s.routes, [])))) AS route FROM signals s JOIN dim USING (rule_id)),
a AS (SELECT e.*, p.id AS fid, status, {rank_sql('severity')} AS r FROM each_ e JOIN plain p ON p.signal_id = e.sid WHERE route IS NOT NULL)
SELECT framework, route, ['info', 'low', 'medium', 'high', 'critical'][coalesce(max(r) FILTER (status = 'open'), max(r)) + 1] AS severity, bool_or(status = 'open') AS has_open,
  array_to_string(list_transform(list_sort(list_distinct(list(o))), lambda x: [{', '.join(map(quoted, pr.CATEGORIES))}][x + 1]), ',') AS categories, count(DISTINCT fid) AS n_findings, count(DISTINCT sid) AS n_signals FROM a GROUP BY framework, route""",
    "deployment_contexts": f"WITH {_S}, {_SUP}, {_PLAIN} SELECT s.id AS signal_id, s.metadata['service'] AS service, p.severity, p.status = 'open' AS has_open FROM signals s JOIN plain p ON p.signal_id = s.id WHERE rule_id = 'docker.config.unguarded-service-published'",
    "ci_top_annotations": f"""WITH {_S}, {_SUP}, {_C}, {_B}, {_PLAIN}, {_COMPARED}, a AS (SELECT p.*, s.rule_id, s.description, s.path AS p0, s.line, rule_id = 'CVE-1' OR (status = 'open' AND {rank_sql('p.severity')} >= 3 AND p.evidence_level <> 'inferred') AS b, c.state FROM plain p JOIN signals s ON p.signal_id = s.id LEFT JOIN compared c ON c.fingerprint = p.fingerprint)
SELECT id, CASE WHEN b THEN 'error' WHEN {rank_sql('severity')} >= 2 THEN 'warning' ELSE 'notice' END AS level, title, severity || '/' || evidence_level || '/' || status || ' · ' || rule_id || ' · ' || description AS message,
  CASE WHEN NOT contains(p0, '..') THEN p0 END AS path, CASE WHEN NOT contains(p0, '..') THEN line END AS start_line, b AS blocks_release, CASE state WHEN 'new' THEN 'new' WHEN 'remaining' THEN 'unchanged' END AS baseline_state
FROM a WHERE status = 'open' OR b ORDER BY b DESC, coalesce(state, '') = 'new' DESC, {rank_sql('severity')} DESC, title, id LIMIT 12""",
    "coverage_gaps": f"WITH {scans._SIGNALS}, {scans._COVERAGE} SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS complete, string_agg(domain || ' ' || engine || ' ' || status, '; ' ORDER BY domain) FILTER (status <> 'complete') AS gaps FROM scan_coverage WHERE required",
    "sarif_join": f"""WITH {_CORRELATED}, each_ AS (SELECT id AS fid, status, title, {rank_sql('severity')} AS r, unnest(string_split(signal_ids, ',')) AS sid FROM findings), f AS (SELECT * FROM each_ QUALIFY row_number() OVER (PARTITION BY sid ORDER BY r DESC, title, fid) = 1)
SELECT s.id, rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, fingerprint, CASE WHEN NOT contains(path, '..') THEN replace(path, ' ', '%20') END AS uri, line, fid AS finding_id, coalesce(f.status, 'none') AS finding_status FROM signals s LEFT JOIN f ON f.sid = s.id""",
    "sarif_rules": f"""WITH {_S}, f AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY ord NULLS LAST, id) = 1)
SELECT rule_id, CASE WHEN {_FLAT.format('title')} = '' THEN rule_id ELSE {_FLAT.format('title')} END AS short_text, CASE WHEN {_FLAT.format('coalesce(remediation, description)')} = '' THEN 'Review the evidence and apply a constrained fix.' ELSE {_FLAT.format('coalesce(remediation, description)')} END AS help,
  coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(list_concat(coalesce(tags, []), coalesce(cwe, []))) AS t, generate_subscripts(list_concat(coalesce(tags, []), coalesce(cwe, [])), 1) AS i) GROUP BY t)), '') AS tags FROM f""",
    "fix_contracts": f"""WITH {_CORRELATED}, e AS (SELECT f.id, f.title, f.severity, attack_path_id, unnest(string_split(signal_ids, ',')) AS sid, generate_subscripts(string_split(signal_ids, ','), 1) AS pos FROM findings f)
SELECT e.title, e.severity, string_agg(s.rule_id || ' at ' || s.path || ':' || s.line, '; ' ORDER BY pos) AS evidence, CASE WHEN attack_path_id IS NULL THEN '' ELSE 'Path: ' || e.title END AS summary FROM e JOIN signals s ON s.id = e.sid GROUP BY e.id, e.title, e.severity, attack_path_id""",
    "report_constraints": f"WITH {_C}, {_SUP}, {_S}, {_PLAIN}, given AS (SELECT id FROM signals WHERE {_LEFT} UNION ALL SELECT id FROM signals WHERE {_TWICE}) " + _CHECK(("signal_id_unique", "SELECT id FROM given GROUP BY 1 HAVING count(*) > 1"), ("finding_fingerprint_unique", "SELECT fingerprint FROM plain GROUP BY 1 HAVING count(*) > 1"), ("finding_signals_exist", "SELECT 1 FROM plain WHERE signal_id NOT IN (SELECT id FROM given)"), ("finding_has_signals", "SELECT 1 FROM plain WHERE signal_id IS NULL"), ("finding_id_of_fingerprint", "SELECT 1 FROM plain WHERE id <> 'finding_' || substr(fingerprint, 1, 16)"), ("suppressed_has_reason", "SELECT 1 FROM plain WHERE status = 'suppressed' AND reason IS NULL"), ("gap_has_reason", "SELECT 1 FROM coverage WHERE status <> 'complete' AND coalesce(reason, '') = ''")),
    "tool_json_flatten": f"""WITH g AS (SELECT unnest(from_json(json, '[{{"Description":"VARCHAR","StartLine":"INTEGER","File":"VARCHAR","RuleID":"VARCHAR","Match":"VARCHAR","Commit":"VARCHAR"}}]')) AS f FROM ({_REPORTS.format(quoted(GITLEAKS), k=0, documents='documents')})),
o AS (SELECT unnest(CAST(json::JSON -> '$.results' AS JSON[])) AS f FROM ({_REPORTS.format(quoted(OPENGREP), k=1, documents='documents')})),
t AS (SELECT coalesce(nullif(r ->> '$.Target', ''), '.') AS path, r FROM (SELECT unnest(CAST(json::JSON -> '$.Results' AS JSON[])) AS r FROM ({_REPORTS.format(quoted(TRIVY), k=2, documents='documents')}))),
v AS (SELECT path, unnest(CAST(r -> '$.Vulnerabilities' AS JSON[])) AS f FROM t), m AS (SELECT path, unnest(CAST(r -> '$.Misconfigurations' AS JSON[])) AS f FROM t), s AS (SELECT path, unnest(CAST(r -> '$.Secrets' AS JSON[])) AS f FROM t)
SELECT 'gitleaks' AS engine, coalesce(f.RuleID, 'gitleaks.secret') AS rule_id, coalesce(f.Description, 'Secret detected by Gitleaks') AS title, 'critical' AS severity, coalesce(nullif(f.File, ''), '.') AS path, f.StartLine AS line,
  CASE WHEN coalesce(f.Match, '') <> '' THEN {redacted_sql('f.Match')} ELSE '[REDACTED]' END AS snippet, 'CWE-798' AS cwe, 'secret,gitleaks,' || CASE WHEN f.Commit IS NOT NULL THEN 'git-history' ELSE 'working-tree' END AS tags FROM g
UNION ALL SELECT 'opengrep', CASE WHEN f ->> '$.check_id' IS NULL THEN 'opengrep.unknown' WHEN regexp_matches(f ->> '$.check_id', '(?i)(?:^|[./])sast\\.') THEN regexp_extract(f ->> '$.check_id', '(?i)(?:^|[./])(sast\\.[a-z0-9][a-z0-9._-]*)$', 1) ELSE f ->> '$.check_id' END AS rule_id,
  coalesce(f ->> '$.extra.message', f ->> '$.check_id', 'opengrep.unknown'), CASE lower(f ->> '$.extra.severity') WHEN 'error' THEN 'high' ELSE 'medium' END, coalesce(f ->> '$.path', '.'), CAST(f ->> '$.start.line' AS INTEGER), f ->> '$.extra.lines',
  CASE WHEN f ->> '$.extra.metadata.cwe' IS NULL THEN '' ELSE regexp_replace(f ->> '$.extra.metadata.cwe', '[\\[\\]"]', '', 'g') END, 'sast,opengrep' || coalesce(',' || (f ->> '$.extra.metadata.technology[0]'), '') FROM o
UNION ALL SELECT 'trivy', coalesce(f ->> '$.VulnerabilityID', 'trivy.vulnerability'), coalesce(f ->> '$.VulnerabilityID', 'Vulnerability') || ' in ' || (f ->> '$.PkgName'), CASE lower(f ->> '$.Severity') WHEN 'high' THEN 'high' ELSE 'medium' END, path, NULL, NULL, '', 'sca,dependency,' || (f ->> '$.PkgName') FROM v
UNION ALL SELECT 'trivy', f ->> '$.ID', f ->> '$.ID', lower(f ->> '$.Severity'), path, CAST(f ->> '$.CauseMetadata.StartLine' AS INTEGER), array_to_string(list_transform(CAST(f -> '$.CauseMetadata.Code.Lines' AS JSON[]), lambda x: x ->> '$.Content'), chr(10)), '', 'iac,misconfiguration' FROM m
UNION ALL SELECT 'trivy', f ->> '$.RuleID', 'Secret detected by Trivy', 'high', path, CAST(f ->> '$.StartLine' AS INTEGER), {redacted_sql("(f ->> '$.Match')")}, 'CWE-798', 'secret,trivy' FROM s""",
    "tool_coverage": f"""WITH {keyed_sql('runs', *_RUNS)}, j AS (SELECT *, coalesce(json_valid(json) AND CASE engine WHEN 'gitleaks' THEN starts_with(json, '[') ELSE starts_with(json, '{{') END, false) AND CASE WHEN engine = 'trivy' AND json_valid(json) THEN coalesce(json ->> '$.SchemaVersion', '') = '2' ELSE true END AS good,
  CASE WHEN engine = 'opengrep' AND json_valid(json) THEN coalesce(json_array_length(json -> '$.errors'), 0) ELSE 0 END AS errors FROM runs),
r AS (SELECT *, CASE WHEN NOT installed THEN engine || ' executable not installed' WHEN timed_out THEN engine || ' timed out' WHEN exit_code <> 0 AND NOT (engine = 'gitleaks' AND exit_code = 1) THEN engine || ' exited ' || exit_code WHEN NOT good THEN engine || ' returned an unexpected report' WHEN errors > 0 THEN errors || ' parse or scan errors' END AS reason FROM j)
SELECT CASE engine WHEN 'gitleaks' THEN 'secrets-history' WHEN 'opengrep' THEN 'sast-general' ELSE 'dependencies-iac' END AS domain, engine, CASE WHEN NOT installed THEN 'not_run' WHEN reason IS NULL THEN 'complete' WHEN ends_with(reason, 'parse or scan errors') THEN 'partial' ELSE 'failed' END AS status, true AS required, reason FROM r""",
    "database_freshness": "SELECT name || '_' || doc_id AS name, state FROM documents JOIN (VALUES (0, 'a', 'missing'), (1, 'b', 'ready'), (2, 'c', 'stale'), (3, 'd', 'invalid'), (4, 'e', 'invalid'), (5, 'f', 'invalid')) t(k, name, state) ON k = doc_id % 6",
    "header_missing": f"""WITH {_R}, h AS (SELECT url, list_transform(map_keys(headers), lambda k: lower(k)) AS ks, map_values(headers) AS vs FROM responses)
SELECT url, 'web.missing-csp' AS rule_id, 'medium' AS severity FROM h WHERE NOT list_contains(ks, 'content-security-policy')
UNION ALL SELECT url, 'web.missing-nosniff', 'medium' FROM h WHERE coalesce(lower(vs[list_position(ks, 'x-content-type-options')]), '') <> 'nosniff'
UNION ALL SELECT url, 'web.missing-hsts', 'medium' FROM h WHERE NOT list_contains(ks, 'strict-transport-security') AND starts_with(url, 'https://')""",
    "cookie_flags": f"""WITH {_R}, c AS (SELECT url, unnest(set_cookie) AS c FROM responses), l AS (SELECT url, regexp_replace(c, '^([^=]+)=[^;]*', '\\1=[REDACTED]') AS cookie, concat_ws(',', CASE WHEN NOT regexp_matches(c, '(?i);\\s*secure(?:;|\\s|$)') THEN 'Secure' END, CASE WHEN NOT regexp_matches(c, '(?i);\\s*httponly(?:;|\\s|$)') THEN 'HttpOnly' END, CASE WHEN NOT regexp_matches(c, '(?i);\\s*samesite=') THEN 'SameSite' END) AS lacks FROM c WHERE regexp_matches(c, {quoted(web.SESSION_COOKIE)}))
SELECT * FROM l WHERE lacks <> ''""",
    "bola_evaluate": f"WITH {_VERDICTS} SELECT case_id, verdict FROM verdicts",
    "bola_coverage": f"WITH {_VERDICTS} SELECT count(*) FILTER (verdict = 'vulnerable') AS vulnerable, count(*) FILTER (verdict = 'protected') AS protected, count(*) FILTER (verdict = 'inconclusive') AS inconclusive, CASE WHEN count(*) FILTER (verdict = 'inconclusive') > 0 THEN 'partial' ELSE 'complete' END AS status FROM verdicts",
    "bola_classify": f"WITH {_KINDS} SELECT method, path, handler, kind FROM kinds",
    "bola_draft": f"""WITH {_KINDS}, firsts AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY coalesce(handler, '')) = 1)
  SELECT CAST(row_number() OVER (ORDER BY kind, path, method) AS INTEGER) AS place, regexp_replace(regexp_replace(lower(method || '-' || path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS case_id, method, path, handler, kind FROM firsts""",
    "benchmark_scores": f"""WITH {_SCORED}, e AS (SELECT DISTINCT * FROM expected WHERE rule_id IS NOT NULL), a AS (SELECT DISTINCT c.category, a.case_id, a.rule_id FROM actual a JOIN (SELECT DISTINCT category, case_id FROM expected) c USING (case_id)),
n AS (SELECT coalesce(e.category, a.category) AS category, count(*) FILTER (e.rule_id IS NOT NULL AND a.rule_id IS NOT NULL) AS tp, count(*) FILTER (e.rule_id IS NULL) AS fp, count(*) FILTER (a.rule_id IS NULL) AS fn FROM e FULL JOIN a ON e.category = a.category AND e.case_id = a.case_id AND e.rule_id = a.rule_id GROUP BY 1),
t AS (SELECT * FROM n UNION ALL SELECT 'all', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM n), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM t)
SELECT category, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""",
    "catalog_fk": "SELECT check_id, (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS violations FROM (VALUES ('rule_id_unique'), ('profile_known'), ('has_profile')) t(check_id)",
    "preview_constraints": f"WITH {keyed_sql('packs', PREVIEW_PACKS, _PREVIEW_PACK, 'pack_id', _PREVIEW_IDS)}, {keyed_sql('given', PREVIEW_RULES, _PREVIEW_RULE, 'pack_id', _PREVIEW_IDS)}, rules AS (SELECT * REPLACE ({_OWN_RULE} AS rule_id) FROM given), w AS (SELECT p.*, (SELECT count(*) FROM rules r WHERE r.pack_id = p.pack_id) AS n, (SELECT count(*) FROM rules r WHERE r.pack_id = p.pack_id AND r.status = 'partial') AS k FROM packs p) "
    + _CHECK(
        ("pack_unique", "SELECT pack_id FROM packs GROUP BY 1 HAVING count(*) > 1"),
        ("rule_unique", "SELECT rule_id FROM rules GROUP BY 1 HAVING count(*) > 1"),
        ("rule_count", "SELECT 1 FROM w WHERE rule_count <> n"),
        ("rule_prefix", "SELECT 1 FROM rules WHERE NOT starts_with(rule_id, 'custom.' || pack_id || '.')"),
        ("file_counts", "SELECT 1 FROM rules r JOIN packs p USING (pack_id) WHERE r.evaluated > p.file_count OR r.selected > r.evaluated"),
        ("selected_counts", "SELECT 1 FROM rules WHERE len(shown) + omitted <> selected"),
        ("rule_status", "SELECT 1 FROM rules WHERE (status = 'partial') <> (len(reasons) > 0)"),
        ("absent_partial", "SELECT 1 FROM rules WHERE emit_when = 'absent' AND selected = 0 AND status <> 'partial'"),
        ("pack_status", "SELECT 1 FROM w WHERE (status = 'partial') <> (inventory_status = 'partial' OR k > 0) OR (status = 'partial') <> (len(reasons) > 0)"),
    ),
    "policy_constraints": f"WITH {', '.join(keyed_sql(n, *_ids(xs)) for n, xs in zip(('req', 'blk', 'cat'), POLICY_RULES, strict=True))} " + _CHECK(("required_known", "SELECT rule_id FROM req EXCEPT SELECT rule_id FROM cat"), ("blocking_known", "SELECT rule_id FROM blk EXCEPT SELECT rule_id FROM cat"), ("blocking_required", "SELECT rule_id FROM blk EXCEPT SELECT rule_id FROM req")),
}
