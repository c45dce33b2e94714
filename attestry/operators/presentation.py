"""What reports show: finding groups, route cards, deployment contexts and CI annotations, all as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators.findings import DEFAULT_GATE, blocks

CATEGORIES = ("authentication", "object_authorization", "privileged_authorization", "exception_disclosure")
#: The rules that speak of a route, with framework and category.
ROUTE_RULES = {
    "fastapi.auth.whitelisted-sensitive-route": ("FastAPI", "authentication"),
    "fastapi.auth.sensitive-route-without-guard": ("FastAPI", "authentication"),
    "fastapi.authorization.object-without-ownership-check": ("FastAPI", "object_authorization"),
    "fastapi.config.route-raw-exception-response": ("FastAPI", "exception_disclosure"),
    "express.auth.sensitive-route-without-guard": ("Express", "authentication"),
    "express.authorization.object-without-ownership-check": ("Express", "object_authorization"),
    "express.authorization.privileged-operation-without-role-check": ("Express", "privileged_authorization"),
    "nestjs.auth.sensitive-route-without-guard": ("NestJS", "authentication"),
    "nestjs.authorization.object-without-ownership-check": ("NestJS", "object_authorization"),
    "nestjs.authorization.privileged-operation-without-role-check": ("NestJS", "privileged_authorization"),
}
MAX_ALIASES = 128


def _meta(key: str) -> Column:
    return T.non_blank(F.col("metadata")[key])


def members(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Findings with their signals, of those whose signals all exist and share group, rule and path."""
    each = findings.where("attack_path_id IS NULL").select(F.col("id").alias("finding_id"), "status", "severity", F.size("signal_ids").alias("wanted"), F.posexplode("signal_ids").alias("pos", "signal_id"))
    own = signals.select(F.col("id").alias("signal_id"), "rule_id", "title", "path", "line", _meta("findingGroup").alias("group_id"), _meta("handler").alias("handler"), _meta("exceptionSerialization").alias("how"), _meta("responseSink").alias("sink"), _meta("route").alias("route"), F.coalesce("routes", F.array().cast("array<string>")).alias("routes"))
    rows = each.join(own, "signal_id")
    whole = rows.groupBy("finding_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted"), F.count_distinct("group_id", "rule_id", "path").alias("kinds"), F.count_if(F.col("group_id").isNull() | F.col("path").isNull()).alias("lacking")).where("n = wanted AND kinds = 1 AND lacking = 0")
    listed = F.filter(F.transform("routes", F.trim), lambda r: r != "")
    routes = F.when(F.size(listed) > 0, listed).when(F.col("route").isNotNull(), F.array("route")).otherwise(F.array().cast("array<string>"))
    return rows.join(whole.select("finding_id"), "finding_id").withColumn("routes", F.array_sort(F.array_distinct(routes))).withColumn("pattern", F.nullif(F.concat_ws(" → ", "how", "sink"), F.lit("")))


def groups(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Groups of more than one member by group, status, severity, rule and path."""
    by = ("group_id", "status", "severity", "rule_id", "path")
    got = members(findings, signals).groupBy(*by).agg(
        F.count("*").cast("long").alias("n_members"),
        F.count_distinct("finding_id").alias("n_findings"),
        F.sort_array(F.collect_set("handler")).alias("handlers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"),
        F.sort_array(F.collect_set("pattern")).alias("patterns"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("handler", F.lit("")).alias("handler"), "finding_id"))), lambda m: m["finding_id"]).alias("members"),
    )
    return got.where("n_members > 1")


def sorted_groups(found: DataFrame) -> DataFrame:
    return found.orderBy((F.col("status") != "open"), T.severity_rank(F.col("severity")).desc(), "path", "rule_id")


def top_members(findings: DataFrame, signals: DataFrame, most: int = 3) -> DataFrame:
    """The first members of each group, by line, handler and id."""
    w = Window.partitionBy("group_id", "status", "severity", "rule_id", "path").orderBy(F.coalesce("line", F.lit(0)), F.coalesce("handler", F.lit("")), "finding_id")
    return members(findings, signals).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def associations(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Route, category, signal and finding, for the rules that speak of routes; at most MAX_ALIASES routes of a signal."""
    spark = signals.sparkSession
    dim = F.broadcast(spark.createDataFrame([(k, *v) for k, v in ROUTE_RULES.items()], "rule_id string, framework string, category string"))  # ten rows
    aliases = F.slice(F.array_distinct(F.filter(F.transform(F.concat(F.array(F.col("metadata")["route"]), F.coalesce("routes", F.array().cast("array<string>"))), T.normalized_route), lambda r: r.isNotNull())), 1, MAX_ALIASES)
    each = signals.join(dim, "rule_id").select(F.col("id").alias("signal_id"), "framework", "category", F.explode(aliases).alias("route"))
    own = findings.select(F.col("id").alias("finding_id"), "status", "severity", F.explode(F.array_distinct("signal_ids")).alias("signal_id"))
    return each.join(own, "signal_id")


def _highest() -> Column:
    """The highest severity of open findings, or of all without open ones."""
    rank = T.severity_rank(F.col("severity"))
    return T.severity_of(F.coalesce(F.max(F.when(F.col("status") == "open", rank)), F.max(rank)))


def cards(findings: DataFrame, signals: DataFrame) -> DataFrame:
    order = F.array(*map(F.lit, CATEGORIES))
    return associations(findings, signals).groupBy("framework", "route").agg(
        _highest().alias("severity"), F.bool_or(F.col("status") == "open").alias("has_open"),
        F.filter(order, lambda c: F.array_contains(F.collect_set("category"), c)).alias("categories"),
        F.count_distinct("finding_id").alias("n_findings"), F.count_distinct("signal_id").alias("n_signals"),
    )


def sorted_cards(found: DataFrame) -> DataFrame:
    return found.orderBy(~F.col("has_open"), F.size("categories").desc(), T.severity_rank(F.col("severity")).desc(), "framework", "route")


def deployments(findings: DataFrame, signals: DataFrame) -> DataFrame:
    own = findings.select(F.col("id").alias("finding_id"), "status", "severity", F.explode(F.array_distinct("signal_ids")).alias("signal_id"))
    rows = signals.where("rule_id = 'docker.config.unguarded-service-published'").select(F.col("id").alias("signal_id"), _meta("service").alias("service"))
    return rows.join(own, "signal_id").groupBy("signal_id", "service").agg(_highest().alias("severity"), F.bool_or(F.col("status") == "open").alias("has_open"))


def annotated(findings: DataFrame, signals: DataFrame, comparison: DataFrame, gate: dict = DEFAULT_GATE, blocking_rules: tuple[str, ...] = ()) -> DataFrame:
    """An annotation for each finding that is open or blocks: level, whether it is new, its first signal's place."""
    each = findings.select(F.col("id").alias("finding_id"), F.posexplode("signal_ids").alias("pos", "signal_id")).join(signals.select(F.col("id").alias("signal_id"), "rule_id", "description", "path", "line", "ord"), "signal_id")
    ruled = F.col("rule_id").isin(*blocking_rules) if blocking_rules else F.lit(False)
    safe = T.safe_relative_path(F.col("path"))
    got = each.groupBy("finding_id").agg(F.bool_or(ruled).alias("ruled"), F.min_by("description", "ord").alias("description"), F.min_by(F.struct(safe.alias("path"), F.col("line").alias("start_line")), F.when(safe.isNotNull(), F.col("ord"))).alias("at"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    rows = findings.join(got, findings["id"] == got["finding_id"], "left").join(comparison.select("fingerprint", "state"), "fingerprint", "left")
    is_open = F.col("status") == "open"
    stops = F.coalesce("ruled", F.lit(False)) | F.when(is_open, blocks(gate)).otherwise(F.lit(bool(gate["require_no_suppressions"])))
    rows = rows.withColumn("blocks_release", stops).where(is_open | F.col("blocks_release"))
    level = F.when(F.col("blocks_release"), "error").when(T.severity_rank(F.col("severity")) >= 2, "warning").otherwise("notice")
    said = F.concat(F.concat_ws("/", "severity", "evidence_level", "status"), F.when(F.size("rules") > 0, F.concat(F.lit(" · "), F.array_join(F.slice("rules", 1, 5), ", "))).otherwise(""), F.lit(" · "), F.coalesce("description", F.lit("Correlated security evidence")))
    state = F.when(F.col("state") == "new", "new").when(F.col("state") == "remaining", "unchanged")
    return rows.select("id", "fingerprint", level.alias("level"), T.single_line(F.col("title"), 200).alias("title"), T.single_line(said, 2000).alias("message"), "at.path", "at.start_line", "severity", "blocks_release", state.alias("baseline_state"))


def top_annotations(rows: DataFrame, most: int = 50) -> DataFrame:
    """The first annotations; Spark keeps only that many of each partition."""
    return rows.orderBy(F.col("blocks_release").desc(), (F.coalesce("baseline_state", F.lit("")) == "new").desc(), T.severity_rank(F.col("severity")).desc(), "title", "id").limit(most)


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    """One row: required records, complete ones, and the gaps."""
    gap = F.when(F.col("status") != "complete", F.concat_ws(" ", "domain", "engine", "status"))
    return coverage.where("required").agg(F.count("*").cast("long").alias("total"), F.count_if(F.col("status") == "complete").cast("long").alias("complete"), F.array_join(F.array_sort(F.collect_list(gap)), "; ").alias("gaps"))


def sarif_results(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals with the first finding that holds each, if any does."""
    own = findings.select(F.col("id").alias("finding_id"), F.col("status").alias("finding_status"), T.severity_rank(F.col("severity")).alias("rank"), "title", F.explode("signal_ids").alias("signal_id"))
    first = own.groupBy("signal_id").agg(F.min_by(F.struct("finding_id", "finding_status"), F.struct(-F.col("rank"), "title", "finding_id")).alias("f"))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return signals.join(first, signals["id"] == first["signal_id"], "left").select("id", "rule_id", level.alias("level"), "fingerprint", T.sarif_uri(F.col("path")).alias("uri"), "line", F.col("f.finding_id").alias("finding_id"), F.coalesce("f.finding_status", F.lit("none")).alias("finding_status"))


def sarif_rules(signals: DataFrame) -> DataFrame:
    """A row for each rule, from its first signal: rule_id, short text, help and tags; nearly all of a hot rule's rows end before the shuffle."""
    first = signals.groupBy("rule_id").agg(F.min_by(F.struct("title", "description", "remediation", "tags", "cwe"), F.struct(F.col("ord").isNull(), "ord", "id")).alias("s"))
    none = F.array().cast("array<string>")
    advice = T.single_line(F.coalesce("s.remediation", "s.description"), 4000, "Review the evidence and apply a constrained fix.")
    return first.select("rule_id", T.single_line(F.col("s.title"), 500, F.col("rule_id")).alias("short_text"), advice.alias("help"), F.array_distinct(F.concat(F.coalesce("s.tags", none), F.coalesce("s.cwe", none))).alias("tags"))
