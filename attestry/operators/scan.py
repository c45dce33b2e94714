"""A whole scan: detectors over a tree, scanners' reports, packages and rule packs become signals, paths, findings, coverage and a decision.

Each detector runs if the tree shows what it is for; its signals are numbered in its own order and cut at MOST (gathered() alone can take all), and every
detector leaves one row of coverage, whether it ran or not. Of equal signals the first in the order of detectors, tools,
packages and packs stays. Signals are computed once and written, since findings, paths, blocking rules and coverage all
read them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry import relations as R
from attestry.durable import kept, sized_in_memory
from attestry.functions import text as T
from attestry.operators import baas, correlate, findings, js_code, python_code, rulepack, rules
from attestry.sources import tree

MOST = 2000
#: Sources after the detectors, in the order of a scan.
TOOLS, PACKAGES, PACKS = 20, 30, 40
#: Engine of each detector that isn't native.
ENGINES = {"js-ts-dataflow": "typescript", "node-api-security": "typescript", "fastapi-authentication": "python", "fastapi-object-authorization": "python", "python-dataflow": "python", "python-api-configuration": "python"}
#: What a detector needs to see and says if it doesn't; detectors without a line here always run.
GATES = {
    "mobile-source-config": ("mobile", "No supported mobile project detected"),
    "node-api-security": ("node", "No Express or NestJS project detected"),
    "fastapi-authentication": ("fastapi", "No FastAPI project detected"),
    "fastapi-object-authorization": ("fastapi", "No FastAPI project detected"),
    "python-dataflow": ("python", "No Python project detected"),
    "python-api-configuration": ("python", "No Python project detected"),
}
#: What the readers of sources don't follow, said wherever they ran.
BOUNDED = {
    "js-ts-dataflow": "flows are read statement by statement within a file",
    "node-api-security": "routes are read from text; computed routes, injected providers and imported wrappers are not followed",
    "python-dataflow": "flows are bounded",
}
#: Detector, severity, evidence, confidence, CWE, OWASP and tags of the rules that source readers decide.
CODE_RULES = (
    ("supabase.table-without-rls", 1, "high", "static_confirmed", "high", "CWE-862", "A01:2021", "supabase,database,authorization"),
    ("supabase.permissive-rls-policy", 1, "high", "static_confirmed", "high", "CWE-862", "A01:2021", "supabase,database,authorization"),
    ("supabase.authenticated-policy-without-row-filter", 1, "high", "static_confirmed", "high", "CWE-862", "A01:2021", "supabase,database,authorization"),
    ("supabase.user-metadata-authorization", 1, "high", "static_confirmed", "high", "CWE-863", "A01:2021", "supabase,database,authorization"),
    ("firebase.unconditional-access", 1, "critical", "static_confirmed", "high", "CWE-862", "A01:2021", "firebase,authorization"),
    ("firebase.authenticated-access-without-resource-check", 1, "high", "static_confirmed", "high", "CWE-862", "A01:2021", "firebase,authorization"),
    ("firebase.storage-upload-without-size-limit", 1, "medium", "static_confirmed", "high", "CWE-770", "A04:2021", "firebase,storage"),
    ("dataflow.sql-injection", 4, "high", "static_confirmed", "high", "CWE-89", "A03:2021", "dataflow,injection"),
    ("dataflow.command-injection", 4, "critical", "static_confirmed", "high", "CWE-78", "A03:2021", "dataflow,injection"),
    ("dataflow.ssrf", 4, "high", "static_confirmed", "high", "CWE-918", "A10:2021", "dataflow,ssrf"),
    ("ai.model-output-dangerous-sink", 4, "critical", "static_confirmed", "high", "CWE-74", "LLM02", "ai,dataflow"),
    ("dataflow.dom-xss", 4, "high", "static_confirmed", "high", "CWE-79", "A03:2021", "dataflow,xss"),
    ("dataflow.react-xss", 4, "high", "static_confirmed", "high", "CWE-79", "A03:2021", "dataflow,xss"),
    *((f"{kind}.{rule}", 5, "high", "inferred", "medium", cwe, owasp, f"{kind},api,{tag}") for kind in ("express", "nestjs") for rule, cwe, owasp, tag in (
        ("auth.sensitive-route-without-guard", "CWE-306", "A01:2021,A07:2021", "auth"),
        ("authorization.object-without-ownership-check", "CWE-639", "A01:2021,API1:2023", "authorization"),
        ("authorization.privileged-operation-without-role-check", "CWE-862", "A01:2021,API5:2023", "authorization"),
    )),
    ("fastapi.auth.whitelisted-sensitive-route", 6, "high", "static_confirmed", "high", "CWE-306,CWE-862", "A01:2021,A07:2021", "fastapi,api,auth,authorization,whitelist"),
    ("fastapi.auth.sensitive-route-without-guard", 6, "high", "inferred", "medium", "CWE-306,CWE-862", "A01:2021,A07:2021", "fastapi,api,auth,authorization"),
    ("fastapi.authorization.object-without-ownership-check", 7, "high", "inferred", "medium", "CWE-639", "A01:2021,API1:2023", "fastapi,api,authorization"),
    ("python.dataflow.ssrf", 8, "high", "static_confirmed", "high", "CWE-918", "A10:2021", "python,dataflow,ssrf"),
    ("python.dataflow.untrusted-file-path", 8, "high", "static_confirmed", "high", "CWE-22", "A01:2021", "python,dataflow"),
    ("python.dataflow.sql-injection", 8, "high", "static_confirmed", "high", "CWE-89", "A03:2021", "python,dataflow,injection"),
    ("python.dataflow.client-url-with-server-secret", 8, "critical", "static_confirmed", "high", "CWE-918", "A10:2021", "python,dataflow,credential"),
    ("fastapi.config.wildcard-cors-with-credentials", 9, "medium", "static_confirmed", "high", "CWE-942", "A05:2021,API8:2023", "fastapi,cors"),
    ("fastapi.config.raw-exception-response", 9, "medium", "static_confirmed", "high", "CWE-209", "A05:2021,API8:2023", "fastapi,errors"),
    ("fastapi.config.route-raw-exception-response", 9, "medium", "static_confirmed", "high", "CWE-209", "A05:2021,API8:2023", "fastapi,errors"),
    ("docker.config.unguarded-service-published", 9, "high", "inferred", "medium", "CWE-306", "A05:2021,A07:2021,API8:2023", "docker,deployment"),
)


class Scan(NamedTuple):
    signals: DataFrame
    paths: DataFrame
    findings: DataFrame
    coverage: DataFrame


def shown(files: DataFrame) -> DataFrame:
    """One row: whether the tree has what each gate needs."""
    path = F.col("relative_path")
    uses = tree.dependencies(files).agg(*(F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False)).alias(k) for k, names in (("native", ("react-native",)), ("node", ("express", "@nestjs/core", "@nestjs/common")))))
    seen = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    python = path.endswith(".py")
    found = files.agg(
        seen(path.rlike(r"AndroidManifest\.xml$|Info\.plist$|(?:^|/)Podfile(?:\.lock)?$|(?:^|/)pubspec\.yaml$")).alias("mobile_file"),
        seen(python).alias("python"),
        seen(python & F.col("content").rlike(r"\bFastAPI\b|\bAPIRouter\b")).alias("fastapi"),
        seen(path.rlike(r"\.[cm]?[jt]sx?$") & F.col("content").rlike(r"express\s*\(|@Controller\s*\(|\bRouter\s*\(")).alias("routed"),
        seen(path.rlike(r"\.[cm]?[jt]sx?$")).alias("script"),
        seen(path.rlike(r"\.(?:sql|rules)$")).alias("stores"),
    )
    return found.crossJoin(uses).select((F.col("mobile_file") | F.col("native")).alias("mobile"), (F.col("node") | F.col("routed")).alias("node"), "fastapi", "python", "script", "stores")  # one row each


def _like_signals(rows: DataFrame) -> DataFrame:
    """rows with all columns of a signal; those that it lacks are null."""
    schema = [f for f in StructType.fromDDL(R.SIGNALS) if f.name != "ord"]
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), "ord")


def _coded(found: DataFrame, files: DataFrame) -> DataFrame:
    """Signals of rows of rule_id, relative_path, line and, where they are known, snippet, metadata and routes."""
    number = {rule[0]: i for i, rule in enumerate(CODE_RULES)}
    ddl = "rule_id string, detector int, severity string, evidence_level string, confidence string, cwe array<string>, owasp array<string>, tags array<string>, rule int, engine string"
    dim = [(r[0], *r[1:5], *(x.split(",") for x in r[5:]), number[r[0]], ENGINES.get(rules.DETECTORS[r[1]], "native")) for r in CODE_RULES]
    got = found.join(F.broadcast(found.sparkSession.createDataFrame(dim, ddl)), "rule_id").join(files.select("relative_path", "walk_pos"), "relative_path")
    if "snippet" not in got.columns:
        got = got.withColumn("snippet", F.col("rule_id"))
    got = got.withColumn("snippet", T.snippet(F.col("snippet"))).withColumn("path", F.col("relative_path")).withColumn("title", F.col("rule_id"))
    got = got.withColumn("fingerprint", T.fingerprint(F.col("engine"), F.col("rule_id"), F.col("path"), F.col("snippet")))
    got = got.withColumn("id", T.signal_id(F.col("fingerprint"), F.col("line"))).withColumn("description", F.concat_ws(" ", "rule_id", F.lit("in"), "path"))
    return _like_signals(got.withColumn("ord", rules.order(F.col("detector"), F.col("walk_pos"), F.col("rule"), F.col("line"))))


def _meta(**values: Column) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("string") for v in values.values()))), lambda k, v: v.isNotNull())


def _guards(found: DataFrame) -> DataFrame:
    return found.withColumn("metadata", _meta(route=F.col("route"), handler=F.col("handler"))).withColumn("snippet", F.col("route"))


def python_signals(files: DataFrame) -> list[DataFrame]:
    code = kept(python_code.code_rows(files), "python")
    routes = kept(python_code.routes(code), "routes")
    flows = python_code.taint_findings(code, python_code.tainted(code)).withColumn("metadata", _meta(function=F.col("function"), sink=F.col("sink"))).withColumn("snippet", F.concat_ws(" ", "function", "sink"))
    services = python_code.published(files, routes).withColumn("line", F.lit(1)).withColumn("metadata", _meta(service=F.col("service"))).withColumn("snippet", F.concat_ws(" ", "service", F.array_join("ports", ",")))
    errors = python_code.exception_findings(code, routes).withColumn("snippet", F.col("handler"))
    return [_guards(python_code.route_findings(routes)), flows, errors, python_code.config_findings(code), services]


def script_signals(files: DataFrame) -> list[DataFrame]:
    code = kept(js_code.code_rows(files), "script")
    return [js_code.flow_findings(code), _guards(js_code.route_findings(js_code.routes(code)))]


def code_signals(files: DataFrame, has: dict[str, bool]) -> list[DataFrame]:
    """Signals of the readers of migrations, access rules, Python, JavaScript and compose files, of those that the tree has."""
    parts = [baas.findings(files).withColumn("snippet", F.col("name"))] if has["stores"] else []
    parts += script_signals(files) if has["script"] else []
    parts += python_signals(files) if has["python"] else []
    return [_coded(p, files) for p in parts]


def pack_signals(files: DataFrame, packs: DataFrame) -> DataFrame:
    """Signals of rule packs, ordered by pack, rule, file and line."""
    numbered = rulepack.numbered(packs)
    got = rulepack.present(files, numbered).unionByName(rulepack.absent(files, numbered))
    meta = F.map_from_arrays(F.array(F.lit("rulePackId")), F.array("pack_id"))
    at = rules.order(F.lit(PACKS), F.col("rule_no"), F.col("walk_pos").cast("int"), F.coalesce("line", F.lit(0)))
    return _like_signals(got.withColumn("metadata", meta).withColumn("description", F.col("title")).withColumn("ord", at))


def tool_signals(*reports: DataFrame) -> DataFrame:
    """Signals of scanners' reports (sources.tools), one after the other."""
    parts = [_like_signals(r.withColumn("ord", rules.order(F.lit(TOOLS), F.lit(i), F.lit(0), F.col("ord")))) for i, r in enumerate(reports)]
    return reduce(DataFrame.unionByName, parts)


def package_signals(corpus: DataFrame) -> DataFrame:
    got = rules.signals(corpus, rules.ARTIFACT_RULES, "artifact")
    return _like_signals(got.withColumn("ord", rules.order(F.lit(PACKAGES), F.col("ord.walk_pos"), F.col("ord.rule"), F.col("ord.place"))))


def _source() -> Column:
    return F.col("ord.detector")


def all_signals(parts: list[DataFrame], most: int | None = MOST) -> DataFrame:
    """Signals of all sources, each cut at most, with partial where it was; None cuts nothing. Of equal ids the first."""
    rows = reduce(DataFrame.unionByName, parts).withColumn("source", _source())
    return findings.distinct_signals(rows.withColumn("partial", F.lit(False)) if most is None else findings.capped(rows, most, "source"))


def detector_coverage(gates: DataFrame, signals: DataFrame) -> DataFrame:
    """A row for each detector: not_run without its gate, partial if it was cut or doesn't follow everything, else complete. signals: all_signals()."""
    cut = signals.where("partial").select(F.col("source").alias("detector")).distinct().withColumn("cut", F.lit(True))
    rows = [(i, d, ENGINES.get(d, "native"), *GATES.get(d, (None, None)), BOUNDED.get(d)) for i, d in enumerate(rules.DETECTORS)]
    each = gates.sparkSession.createDataFrame(rows, "detector int, domain string, engine string, gate string, missing string, bound string")
    open_gates = gates.select(F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in gates.columns)), lambda x: x.isNotNull()).alias("open"))
    got = each.crossJoin(F.broadcast(open_gates)).join(F.broadcast(cut), "detector", "left")  # one row, and a row for a detector at most
    ran = F.col("gate").isNull() | F.array_contains("open", F.col("gate"))
    reasons = F.array_join(F.filter(F.array("bound", F.when(F.col("cut"), f"finding output reached the {MOST} signal safety limit")), lambda x: x.isNotNull()), "; ")
    status = F.when(~ran, "not_run").when(reasons != "", "partial").otherwise("complete")
    return got.select("domain", "engine", status.alias("status"), ran.alias("required"), F.lit(None).cast("string").alias("version"), F.when(~ran, F.col("missing")).otherwise(F.nullif(reasons, F.lit(""))).alias("reason"))


def gathered(files: DataFrame, packs: DataFrame | None = None, tools: list[DataFrame] | None = None, packages: DataFrame | None = None, most: int | None = MOST) -> tuple[DataFrame, DataFrame]:
    """shown() and all_signals() of a scan. files are those that the inventory takes."""
    with sized_in_memory(files.sparkSession):
        gates = kept(shown(files), "gates")
        has = gates.first().asDict()  # one row of flags
        own = tuple(r for r in rules.RULES if has["mobile"] or rules.DETECTORS[r.detector] != "mobile-source-config")
        parts = [_like_signals(rules.signals(files, own)), *code_signals(files, has)]
        parts += [tool_signals(*tools)] if tools else []
        parts += [package_signals(packages)] if packages is not None else []
        parts += [pack_signals(files, packs)] if packs is not None else []
        return gates, kept(all_signals(parts, most), "signals")


def scanned(files: DataFrame, packs: DataFrame | None = None, tools: list[DataFrame] | None = None, packages: DataFrame | None = None, suppressions: DataFrame | None = None, as_of: str = "1970-01-01T00:00:00Z", more_coverage: DataFrame | None = None) -> Scan:
    """All of a scan. files are those that the inventory takes; more_coverage has rows for tools, packages and the inventory."""
    spark: SparkSession = files.sparkSession
    gates, signals = gathered(files, packs, tools, packages)
    coverage = detector_coverage(gates, signals)
    if more_coverage is not None:
        coverage = coverage.unionByName(more_coverage, allowMissingColumns=True)
    if packs is not None:
        coverage = coverage.unionByName(rulepack.coverage(files, packs), allowMissingColumns=True)
    paths = kept(correlate.attack_paths(signals), "paths")
    none = R.rows(spark, [], R.SUPPRESSIONS + ", ord long")
    found = findings.suppressed(findings.merged(signals, paths), none if suppressions is None else suppressions, as_of)
    return Scan(signals, paths, kept(found, "findings"), coverage)
