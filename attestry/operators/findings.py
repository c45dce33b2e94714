"""Signals and attack paths to findings, a decision, a summary and a comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T

#: The gate that holds without a policy.
DEFAULT_GATE = {"minimum_severity": "high", "include_inferred": False, "require_no_suppressions": False}


def distinct_signals(signals: DataFrame) -> DataFrame:
    """One signal for each id, the first in order."""
    return signals.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_rn = 1").drop("_rn")


def capped(signals: DataFrame, most: int = 2000, by: str = "engine") -> DataFrame:
    """The first signals of each detector and whether there were more; the cut is a group limit before the shuffle."""
    kept = signals.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).where(F.col("_rn") <= most + 1)
    return kept.withColumn("partial", F.max("_rn").over(Window.partitionBy(by)) > most).where(F.col("_rn") <= most).drop("_rn")


def no_paths(signals: DataFrame) -> DataFrame:
    """An empty relation of attack paths whose order is that of signals."""
    return signals.limit(0).select("id", "fingerprint", "title", F.col("title").alias("summary"), "severity", "evidence_level", F.array("id").alias("signal_ids"), F.lit(0).alias("place"), "ord")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then by title; equal ones by id."""
    return findings.orderBy(T.severity_rank(F.col("severity")).desc(), "title", "id")


def sorted_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(T.severity_rank(F.col("severity")).desc(), "rule_id", "path", "id")


def consumed(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids of signals that a path stands for; an inferred path doesn't stand for stronger signals."""
    used = paths.select(F.explode("signal_ids").alias("id"), F.col("evidence_level").alias("path_level"))
    return used.join(signals.select("id", "evidence_level"), "id", "left").where("path_level <> 'inferred' OR evidence_level = 'inferred'").select("id").distinct()


def merged(signals: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings by fingerprint: the first one's fields, all signal ids in order. Paths come before signals."""
    from_paths = paths.select("fingerprint", "title", "severity", "evidence_level", "signal_ids", F.col("id").alias("attack_path_id"), F.lit(0).alias("kind"), "place", "ord")
    alone = signals.join(consumed(signals, paths), "id", "left_anti")
    from_signals = alone.select("fingerprint", "title", "severity", "evidence_level", F.array("id").alias("signal_ids"), F.lit(None).cast("string").alias("attack_path_id"), F.lit(1).alias("kind"), F.lit(0).alias("place"), "ord")
    rows = from_paths.unionByName(from_signals)
    first = F.min_by(F.struct("title", "severity", "evidence_level", "attack_path_id"), F.struct("kind", "place", "ord")).alias("first")
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "ord", "signal_ids"))), lambda x: x["signal_ids"]))).alias("signal_ids")
    got = rows.groupBy("fingerprint").agg(first, ids)
    return got.select(F.concat(F.lit("finding_"), F.col("fingerprint").substr(1, 16)).alias("id"), "fingerprint", "first.title", "first.severity", "first.evidence_level", F.lit("open").alias("status"), "signal_ids", "first.attack_path_id")


def suppressed(findings: DataFrame, suppressions: DataFrame, as_of: str) -> DataFrame:
    """Findings with the first suppression of theirs that is still in force. suppressions has an order, ord."""
    live = suppressions.where(T.expiry(F.col("expires")) > F.to_timestamp(F.lit(as_of)))
    first = live.groupBy(F.lower("fingerprint").alias("fingerprint")).agg(F.min_by(F.struct("reason", "expires"), "ord").alias("s"))
    out = findings.join(first, "fingerprint", "left")
    return out.withColumn("status", F.when(F.col("s").isNotNull(), "suppressed").otherwise(F.col("status"))).withColumn("reason", F.col("s.reason")).withColumn("expires", F.col("s.expires")).drop("s")


def blocks(gate: dict) -> Column:
    """Whether an open finding meets a gate."""
    strong = F.lit(True) if gate["include_inferred"] else F.col("evidence_level") != "inferred"
    return (T.severity_rank(F.col("severity")) >= T.SEVERITIES.index(gate["minimum_severity"])) & strong


def rule_blocked(findings: DataFrame, signals: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Findings, suppressed ones too, with a signal of a blocking rule."""
    bad = signals.where(F.col("rule_id").isin(*rule_ids)).select(F.col("id").alias("signal_id")) if rule_ids else signals.limit(0).select(F.col("id").alias("signal_id"))
    hit = findings.select(F.col("id").alias("finding_id"), F.explode("signal_ids").alias("signal_id")).join(bad, "signal_id", "left_semi").select("finding_id").distinct()
    return findings.join(hit, findings["id"] == hit["finding_id"], "left_semi")


def decided(findings: DataFrame, coverage: DataFrame, signals: DataFrame, gate: dict = DEFAULT_GATE, blocking_rules: list[str] | None = None, operator_policy: bool = False) -> DataFrame:
    """One row: decision and reasons. The first that holds of blocking rule, forbidden suppression, gate, gap, review."""
    is_open = F.col("status") == "open"
    counts = findings.agg(
        F.count_if(F.col("status") == "suppressed").alias("n_suppressed"),
        F.count_if(is_open & blocks(gate)).alias("n_gate"),
        F.count_if(is_open & (T.severity_rank(F.col("severity")) >= 2)).alias("n_review"),
    )
    ruled = rule_blocked(findings, signals, blocking_rules or []).agg(F.count("*").alias("n_ruled"))
    gap = F.concat(F.col("domain"), F.lit(": "), F.col("status"), F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" ("), "reason", F.lit(")"))).otherwise(""))
    gaps = coverage.where("required AND status IN ('failed', 'not_run', 'partial')").agg(F.array_sort(F.collect_list(gap)).alias("gaps"))
    suffix = " including inferred evidence" if gate["include_inferred"] else " with evidence-backed results only"
    met = f" finding(s) met policy gate severity {gate['minimum_severity']}{suffix}" if operator_policy else " high or critical evidence-backed finding(s)"
    say = lambda n, what: F.array(F.concat(F.col(n).cast("string"), F.lit(what)))
    no_suppressions = F.lit(bool(gate["require_no_suppressions"])) & (F.col("n_suppressed") > 0)
    ladder = [
        (F.col("n_ruled") > 0, "block", say("n_ruled", " finding(s) matched policy blocking rules")),
        (no_suppressions, "block", say("n_suppressed", " suppression(s) violate the policy no-suppression gate")),
        (F.col("n_gate") > 0, "block", say("n_gate", met)),
        (F.size("gaps") > 0, "incomplete", F.col("gaps")),
        (F.col("n_review") > 0, "review", say("n_review", " medium-risk or inferred finding(s) require review")),
    ]
    decision = reasons = None
    for when, what, why in ladder:
        decision = F.when(when, what) if decision is None else decision.when(when, what)
        reasons = F.when(when, why) if reasons is None else reasons.when(when, why)
    calm = F.array(F.lit("No blocking findings were detected within the completed coverage"))
    return counts.crossJoin(ruled).crossJoin(gaps).select(decision.otherwise("no_blockers_found").alias("decision"), reasons.otherwise(calm).alias("reasons"))  # one row each


def summarised(findings: DataFrame, paths: DataFrame) -> DataFrame:
    is_open = F.col("status") == "open"
    counts = findings.agg(*(F.count_if(is_open & (F.col("severity") == s)).alias(s) for s in reversed(T.SEVERITIES)), F.count_if(~is_open).alias("suppressed"))
    return counts.crossJoin(paths.agg(F.count("*").alias("attack_paths")))


def rechecked_domain() -> Column:
    """The coverage that a baseline signal needs to be complete before its absence counts; null where nothing does."""
    has = lambda *tags: F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    native = (
        F.when(has("supabase", "firebase", "baas"), "baas-authorization")
        .when(has("mobile", "android", "ios", "flutter", "react-native"), "mobile-source-config")
        .when(has("secret") & F.col("rule_id").startswith("secret."), "secrets")
        .otherwise("application-config")
    )
    by_engine = {"trivy": "dependencies-iac", "gitleaks": "secrets-history", "opengrep": "sast-general", "artifact": "mobile-artifact-static", "typescript": "js-ts-dataflow"}
    out = F.when(F.col("engine") == "native", native)
    for engine, domain in by_engine.items():
        out = out.when(F.col("engine") == engine, domain)
    return out.when(F.col("engine") == "rule-pack", F.concat(F.lit("rule-pack:"), F.col("metadata")["rulePackId"]))


def compared(now: DataFrame, coverage: DataFrame, before: DataFrame, before_signals: DataFrame) -> DataFrame:
    """fingerprint and state (new, remaining, resolved, not_rechecked) of the open findings of either scan."""
    complete = coverage.where("status = 'complete'").select("domain").distinct()
    unchecked = before_signals.withColumn("domain", rechecked_domain()).join(complete, "domain", "left_anti").select(F.col("id").alias("signal_id"))
    old = before.where("status = 'open'")
    doubtful = old.select("fingerprint", F.explode("signal_ids").alias("signal_id")).join(unchecked, "signal_id", "left_semi").select("fingerprint").distinct().withColumn("doubtful", F.lit(True))
    a = now.where("status = 'open'").select("fingerprint").distinct().withColumn("is_now", F.lit(True))
    b = old.select("fingerprint").distinct().withColumn("was", F.lit(True))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNotNull(), "remaining").when(F.col("doubtful"), "not_rechecked").otherwise("resolved")
    return a.join(b, "fingerprint", "full_outer").join(doubtful, "fingerprint", "left").select("fingerprint", state.alias("state"))
