"""Rendering, policies, rule packs from files, trees, tool reports and the stream."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.operators import findings as fi
from attestry.operators import presentation as pr
from attestry.operators import rulepack, rules
from attestry.plans import packs, reports, trees
from attestry.sinks import render
from attestry.sources import policies, tree
from attestry.streaming import signals as stream
from tests.conftest import same


def _parts(spark):
    return reports._plain(spark), reports._signals(spark), R.rows(spark, reports.COVERAGE, R.COVERAGE)


def test_ci_report_and_renderings(spark, sf_dir):
    found, signals, coverage = _parts(spark)
    comparison = reports.compared(spark)
    report = render.ci_report(fi.decided(found, coverage, signals), found, signals, coverage, comparison)
    assert report["decision"] == "block" and report["exit_code"] == 1
    assert report["required_coverage"]["total"] == 5
    shown = pr.top_annotations(pr.annotated(found, signals, comparison), 5)
    lines = [r["line"] for r in render.github_lines(shown).collect()]
    assert all(x.startswith("::") and "\n" not in x for x in lines)
    text = render.markdown(report, [r["line"] for r in render.markdown_rows(shown).collect()])
    assert "**Decision:** block" in text and text.count("| ") >= 5
    assert "Decision: block" in render.terminal(report)
    cards = [r["html"] for r in render.html_cards(pr.cards(found, signals)).collect()]
    assert "&lt;" not in cards[0] and render.html(cards, "block").count("<article") == len(cards)


def test_sarif(spark):
    found, signals, _ = _parts(spark)
    log = json.loads(render.sarif(found, signals))
    run = log["runs"][0]
    assert len(run["results"]) == len(reports.SIGNALS) and len({r["id"] for r in run["tool"]["driver"]["rules"]}) == len(run["tool"]["driver"]["rules"])


def test_latest_report(spark, tmp_path):
    rows = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2), ("q", "s3", 1)], "project_id string, scan_id string, finished_at int")
    render.save(rows, str(tmp_path / "r"))
    back = spark.read.schema("project_id string, scan_id string, finished_at int").json(str(tmp_path / "r"))
    assert {r["scan_id"] for r in render.latest(back).collect()} == {"s2", "s3"}


def test_policy_and_pack_files(spark, tmp_path):
    (tmp_path / "p.yml").write_text("gate: {minimumSeverity: medium, includeInferred: true}\nrules: {required: [a], block: [a]}\nsuppressions: [{fingerprint: AB, reason: r, expires: 2030-01-01}]\n")
    got = policies.policy(str(tmp_path / "p.yml"), str(tmp_path / "elsewhere"))
    assert got["gate"]["minimum_severity"] == "medium" and got["suppressions"][0] == {"fingerprint": "ab", "reason": "r", "expires": "2030-01-01"}
    with pytest.raises(ValueError):
        policies.policy(str(tmp_path / "p.yml"), str(tmp_path))
    (tmp_path / "k.yml").write_text("packId: k\nrules:\n  - {ruleId: k.a, title: t, severity: low, evidenceLevel: inferred, files: {extensions: [.en]}, match: {containsAny: [x], emitWhen: absent}}\n")
    pack = policies.rule_pack(spark, str(tmp_path / "k.yml"))
    assert pack.first()["emit_when"] == "absent"
    with pytest.raises(ValueError):
        rulepack.checked(pack.unionByName(pack))


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("console.log(password)\n")
    (tmp_path / "logo.png").write_bytes(b"x")
    files = tree.read_tree(spark, str(tmp_path))
    assert [r["relative_path"] for r in files.collect()] == ["src/a.ts"]
    assert [r["rule_id"] for r in rules.signals(files).collect()] == ["privacy.sensitive-logging"]


def test_nothing_found_in_empty_tables(spark):
    empty = R.rows(spark, [], R.FILES)
    assert rules.signals(empty).count() == 0 and rulepack.present(empty, packs._rules(spark)).count() == 0
    none, signals = R.rows(spark, [], R.ATTACK_PATHS), R.rows(spark, [], R.SIGNALS)
    got = fi.decided(fi.merged(signals, none).withColumn("reason", F.lit("")), R.rows(spark, [], R.COVERAGE), signals).first()
    assert got["decision"] == "no_blockers_found"


def test_near_misses_stay_quiet(spark):
    quiet = [c for c in trees.CODE if c["relative_path"] in ("app/api/users/[id]/route.ts", "deploy/ok.prod.yml")]
    assert rules.signals(R.rows(spark, quiet, R.FILES)).count() == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:00", "a", "f1"), ("2026-01-01 00:01:00", "a", "f1"), ("2026-01-01 00:02:00", "b", "f2")], "ts string, rule_id string, fingerprint string")
    rows.select(F.to_timestamp("ts").alias("ts"), "rule_id", "fingerprint").write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("ts timestamp, rule_id string, fingerprint string").parquet(str(tmp_path / "in"))
    stream.append_findings(read, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = stream.by_window(read).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["rule_id"], r["n"]) for r in spark.table("windows").collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("name", ["attack_paths", "finding_paths", "fix_contracts", "sarif_join"])
def test_paths_name_every_signal(spark, tmp_path, name):
    """2,100 signals of each shape."""
    n = 2100 * len(reports.SIGNALS)
    spark.range(n).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "concat('s', id % 3) AS source", "0L AS n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(reports.QUERIES[name](spark, str(tmp_path)), con, reports.SQL[name])
