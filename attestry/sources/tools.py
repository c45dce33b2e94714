"""Reports of outside scanners as signals. JSON is read with explicit schemas; a report that doesn't parse is a failed coverage row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T

GITLEAKS = "array<struct<Description:string,StartLine:int,File:string,RuleID:string,Secret:string,Match:string,Commit:string>>"
OPENGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,`end`:struct<line:int,col:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:string,category:string,technology:array<string>>>>>,errors:array<string>>"
TRIVY = (
    "struct<SchemaVersion:int,Results:array<struct<Target:string,"
    "Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string,PrimaryURL:string>>,"
    "Misconfigurations:array<struct<ID:string,Title:string,Description:string,Message:string,Severity:string,Resolution:string,CauseMetadata:struct<StartLine:int,EndLine:int,Code:struct<Lines:array<struct<Content:string>>>>>>,"
    "Secrets:array<struct<RuleID:string,Category:string,Title:string,Severity:string,StartLine:int,EndLine:int,Match:string>>>>>"
)
#: Rule ids that our own rules have inside a scanner's longer names.
OWN_RULE = r"(?i)(?:^|[./])(sast\.[a-z0-9][a-z0-9._-]*)$"


def _signal(rows: DataFrame, engine: str, **fields: Column) -> DataFrame:
    lacking = {"line": F.lit(None).cast("int"), "snippet": F.lit(None).cast("string"), "cwe": F.lit(None).cast("array<string>")}
    got = rows.select("ord", *(c.alias(k) for k, c in (lacking | fields).items()))
    fp = T.fingerprint(F.lit(engine), F.col("rule_id"), F.col("path"), F.col("snippet"))
    got = got.withColumn("fingerprint", fp).withColumn("engine", F.lit(engine)).withColumn("evidence_level", F.lit("static_confirmed"))
    return got.select(T.signal_id(F.col("fingerprint"), F.col("line")).alias("id"), "fingerprint", "engine", "rule_id", "title", "severity", "evidence_level", "path", "line", "snippet", "cwe", "tags", "ord")


def _or(c: str, default: str) -> Column:
    """An empty or missing field as a default."""
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def gitleaks(reports: DataFrame) -> DataFrame:
    """reports: json. Raw values never reach a signal."""
    rows = reports.select(F.posexplode(F.from_json("json", GITLEAKS)).alias("ord", "f"))
    shown = F.when(F.coalesce(F.col("f.Match"), F.lit("")) != "", T.redact_snippet(F.col("f.Match"))).otherwise("[REDACTED]")
    place = F.when(F.coalesce(F.col("f.Commit"), F.lit("")) != "", "git-history").otherwise("working-tree")
    return _signal(rows, "gitleaks", rule_id=_or("f.RuleID", "gitleaks.secret"), title=_or("f.Description", "Secret detected by Gitleaks"), severity=F.lit("critical"), path=_or("f.File", "."), line=F.col("f.StartLine"), snippet=shown, cwe=F.array(F.lit("CWE-798")), tags=F.array(F.lit("secret"), F.lit("gitleaks"), place))


def opengrep_rule(check_id: Column) -> Column:
    own = F.regexp_extract(check_id, OWN_RULE, 1)
    return F.when(F.coalesce(check_id, F.lit("")) == "", "opengrep.unknown").when(own != "", own).otherwise(check_id)


def opengrep(reports: DataFrame) -> DataFrame:
    rows = reports.select(F.posexplode(F.from_json("json", OPENGREP)["results"]).alias("ord", "f"))
    cwe = F.col("f.extra.metadata.cwe")
    listed = F.when(cwe.startswith("["), F.from_json(cwe, "array<string>")).when(cwe.isNotNull(), F.array(cwe))
    technology = F.coalesce("f.extra.metadata.technology", F.array().cast("array<string>"))
    rule = opengrep_rule(F.col("f.check_id"))
    return _signal(rows, "opengrep", rule_id=rule, title=F.coalesce("f.extra.message", rule), severity=T.normalize_severity(F.col("f.extra.severity")), path=_or("f.path", "."), line=F.col("f.start.line"), snippet=T.redact_snippet(F.nullif(F.col("f.extra.lines"), F.lit(""))), cwe=listed, tags=F.concat(F.array(F.lit("sast"), F.lit("opengrep")), technology))


def trivy(reports: DataFrame) -> DataFrame:
    """Per target its vulnerabilities, then misconfigurations, then secrets."""
    targets = reports.select(F.posexplode(F.from_json("json", TRIVY)["Results"]).alias("t", "r"))

    def of(field: str, kind: int) -> DataFrame:
        rows = targets.select("t", _or("r.Target", ".").alias("path"), F.posexplode(f"r.{field}").alias("i", "f"))
        return rows.withColumn("ord", F.col("t") * 1_000_000_000 + kind * 100_000_000 + F.col("i"))

    v, m, s = of("Vulnerabilities", 0), of("Misconfigurations", 1), of("Secrets", 2)
    name = F.concat(F.coalesce("f.VulnerabilityID", F.lit("Vulnerability")), F.lit(" in "), F.coalesce("f.PkgName", F.lit("dependency")))
    code = F.array_join(F.transform(F.coalesce("f.CauseMetadata.Code.Lines", F.array().cast("array<struct<Content:string>>")), lambda x: F.coalesce(x["Content"], F.lit(""))), "\n")
    shown = F.when(F.coalesce(F.col("f.Match"), F.lit("")) != "", T.redact_snippet(F.col("f.Match"))).otherwise("[REDACTED]")
    out = _signal(v, "trivy", rule_id=F.coalesce("f.VulnerabilityID", F.lit("trivy.vulnerability")), title=F.coalesce("f.Title", name), severity=T.normalize_severity(F.col("f.Severity")), path=F.col("path"), tags=F.array(F.lit("sca"), F.lit("dependency"), F.coalesce("f.PkgName", F.lit("unknown"))))
    out = out.unionByName(_signal(m, "trivy", rule_id=F.coalesce("f.ID", F.lit("trivy.misconfiguration")), title=F.coalesce("f.Title", "f.ID", F.lit("Infrastructure misconfiguration")), severity=T.normalize_severity(F.col("f.Severity")), path=F.col("path"), line=F.col("f.CauseMetadata.StartLine"), snippet=T.redact_snippet(code), tags=F.array(F.lit("iac"), F.lit("misconfiguration"))))
    return out.unionByName(_signal(s, "trivy", rule_id=F.coalesce("f.RuleID", F.lit("trivy.secret")), title=F.coalesce("f.Title", "f.Category", F.lit("Secret detected by Trivy")), severity=T.normalize_severity(F.col("f.Severity"), "high"), path=F.col("path"), line=F.col("f.StartLine"), snippet=shown, cwe=F.array(F.lit("CWE-798")), tags=F.array(F.lit("secret"), F.lit("trivy"))))


#: What each scanner covers, its report's schema and the versions whose reports are understood.
DOMAINS = {"gitleaks": "secrets-history", "opengrep": "sast-general", "trivy": "dependencies-iac"}
SCHEMAS = {"gitleaks": GITLEAKS, "opengrep": OPENGREP, "trivy": TRIVY}


def coverage(runs: DataFrame, native_only: bool = False) -> DataFrame:
    """A row for each scanner's run: engine, installed, exit_code, timed_out, json. Anything but a readable report is a failure."""
    shape = F.when(F.col("engine") == "gitleaks", F.trim("json").startswith("[")).otherwise(F.trim("json").startswith("{"))
    good = {"gitleaks": F.col("exit_code").isin(0, 1), "opengrep": F.col("exit_code") == 0, "trivy": F.col("exit_code") == 0}
    exit_ok = F.when(F.lit(False), True)
    for engine, ok in good.items():
        exit_ok = exit_ok.when(F.col("engine") == engine, ok)
    readable = shape & F.try_parse_json("json").isNotNull()
    version = F.col("engine") == "trivy"
    schema_ok = ~version | (F.get_json_object("json", "$.SchemaVersion") == "2")
    errors = F.when(F.col("engine") == "opengrep", F.coalesce(F.size(F.from_json("json", OPENGREP)["errors"]), F.lit(0))).otherwise(0)
    reason = (
        F.when(F.lit(native_only), "only native detectors were asked for")
        .when(~F.col("installed"), F.concat("engine", F.lit(" executable not installed")))
        .when(F.col("timed_out"), F.concat("engine", F.lit(" timed out")))
        .when(~exit_ok, F.concat("engine", F.lit(" exited "), F.col("exit_code").cast("string")))
        .when(~F.coalesce(readable & schema_ok, F.lit(False)), F.concat("engine", F.lit(" returned an unexpected report")))
        .when(errors > 0, F.concat(errors.cast("string"), F.lit(" parse or scan errors")))
    )
    status = F.when(F.lit(native_only) | ~F.col("installed"), "not_run").when(reason.isNull(), "complete").when(reason.endswith("parse or scan errors"), "partial").otherwise("failed")
    domain = F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv))[F.col("engine")]
    return runs.select(domain.alias("domain"), "engine", status.alias("status"), F.lit(not native_only).alias("required"), reason.alias("reason"))


def database_state(metadata: DataFrame, as_of: str) -> DataFrame:
    """engine and state of a scanner's database: json (null: missing), size."""
    due = F.try_to_timestamp(F.get_json_object("json", "$.NextUpdate"))
    valid = (F.get_json_object("json", "$.Version") == "2") & due.isNotNull()
    state = F.when(F.col("json").isNull(), "missing").when((F.col("size") == 0) | ~F.coalesce(valid, F.lit(False)), "invalid").when(due <= F.to_timestamp(F.lit(as_of)), "stale").otherwise("ready")
    return metadata.select("name", state.alias("state"))


def inline_suppressions(files: DataFrame) -> DataFrame:
    """How often files ask a scanner to look away; any makes its coverage partial."""
    return files.agg(F.coalesce(F.sum(F.regexp_count("content", F.lit(r"(?i)trivy:ignore(?::|\b)"))), F.lit(0)).cast("long").alias("n"))
