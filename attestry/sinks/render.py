"""Reports as text. Every row is rendered by column functions; only the few rows that a report shows reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import presentation as pr

#: How many findings, groups and members reports show.
SHOWN = {"annotations": 50, "cards": 500, "members": 3, "gaps": 20}
EXIT_CODES = {"block": 1, "incomplete": 2}


def github_lines(annotations: DataFrame) -> DataFrame:
    """A workflow command for each annotation."""
    at = F.when(F.col("path").isNotNull(), F.concat(F.lit(",file="), T.github_property(F.col("path")), F.coalesce(F.concat(F.lit(",line="), F.col("start_line").cast("string")), F.lit("")))).otherwise("")
    return annotations.select("id", F.concat(F.lit("::"), "level", F.lit(" title="), T.github_property(F.col("title")), at, F.lit("::"), T.github_data(F.col("message"))).alias("line"))


def markdown_rows(annotations: DataFrame) -> DataFrame:
    place = F.concat(F.coalesce("path", F.lit("not recorded")), F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string")), F.lit("")))
    cells = (T.markdown_text(c, n) for c, n in ((F.col("level"), 20), (F.col("title"), 200), (place, 1100), (F.coalesce("baseline_state", F.lit("not compared")), 40)))
    return annotations.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def html_cards(cards: DataFrame) -> DataFrame:
    badge: Column = F.when(F.col("has_open"), "open").otherwise("suppressed")
    return cards.select("framework", "route", F.concat(F.lit('<article class="'), badge, F.lit('"><h3>'), T.html_text(F.col("route")), F.lit("</h3><p>"), T.html_text(F.concat_ws(" · ", "framework", "severity", F.array_join("categories", ", "))), F.lit("</p></article>")).alias("html"))


def sarif(findings: DataFrame, signals: DataFrame) -> str:
    """A SARIF 2.1.0 log: distinct rules, and a result for each signal."""
    rows = pr.sarif_results(findings, signals)
    place = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.when(F.col("uri").isNotNull(), place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.struct(F.col("finding_id").alias("findingId"), F.col("finding_status").alias("findingStatus")).alias("properties")))
    results = [json.loads(r["r"]) for r in rows.orderBy("rule_id", "id").select(result.alias("r")).toLocalIterator()]
    rules = [
        {"id": r["rule_id"], "name": r["rule_id"], "shortDescription": {"text": r["short_text"]}, "help": {"text": r["help"]}, "properties": {"tags": r["tags"]}}
        for r in pr.sarif_rules(signals).orderBy("rule_id").collect()  # as many as there are rules
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "attestry", "rules": rules}}, "results": results}]}, ensure_ascii=False)


def ci_report(decision: DataFrame, findings: DataFrame, signals: DataFrame, coverage: DataFrame, comparison: DataFrame) -> dict:
    """A decision with its counts, gaps and first annotations, as a plain dictionary."""
    d, gaps = decision.first(), pr.coverage_gaps(coverage).first()
    rows = pr.annotated(findings, signals, comparison)
    shown = [r.asDict() for r in pr.top_annotations(rows, SHOWN["annotations"]).collect()]
    states = {r["state"]: r["count"] for r in comparison.groupBy("state").count().collect()}
    counts = {r["severity"]: r["count"] for r in findings.where("status = 'open'").groupBy("severity").count().collect()}
    return {"decision": d["decision"], "reasons": list(d["reasons"])[:64], "exit_code": EXIT_CODES.get(d["decision"], 0), "counts": counts, "required_coverage": gaps.asDict(), "comparison": states, "annotations": shown, "omitted": max(0, rows.count() - SHOWN["annotations"])}


def markdown(report: dict, lines: list[str]) -> str:
    """The summary of a CI report; lines are those of markdown_rows()."""
    counts = " · ".join(f"{report['counts'].get(s, 0)} {s}" for s in reversed(T.SEVERITIES))
    table = ["| Level | Finding | Location | Baseline |", "| --- | --- | --- | --- |", *lines] if lines else ["No finding annotations were emitted."]
    return "\n".join(["# Security acceptance", "", f"**Decision:** {report['decision']}  ", f"**Risk:** {counts}", "", "## Decision reasons", "", *(f"- {r}" for r in report["reasons"]), "", "## Findings", "", *table, ""])


def html(cards: list[str], decision: str) -> str:
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Security acceptance</title><body><h1>{decision}</h1>{"".join(cards)}</body></html>'


def terminal(report: dict) -> str:
    lines = [f"Decision: {report['decision']}", *(f"  {r}" for r in report["reasons"])]
    return "\n".join([*lines, *(f"[{a['severity']}] {a['title']} {a['path'] or ''}:{a['start_line'] or ''}" for a in report["annotations"])]) + "\n"


def save(reports: DataFrame, path: str) -> None:
    """Reports as JSON by project; the latest of each project is a query over them, not a copy."""
    reports.write.mode("append").partitionBy("project_id").json(path)


def latest(reports: DataFrame) -> DataFrame:
    """The last report of each project. reports: project_id, scan_id, finished_at and more."""
    last = reports.groupBy("project_id").agg(F.max(F.struct("finished_at", "scan_id")).alias("last")).select("project_id", "last.scan_id")
    return reports.join(last, ["project_id", "scan_id"], "left_semi")


def catalog_markdown(rules: DataFrame) -> DataFrame:
    """A table row for each rule, by category."""
    cells = (T.table_cell(c) for c in (F.concat(F.lit("`"), "rule_id", F.lit("`")), F.col("evidence_level"), F.array_join("cwe", ", "), F.col("title")))
    return rules.select("category", "rule_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
