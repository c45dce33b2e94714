"""The inline project as one scan, packages with cuts, and trees in the order of a walk."""

import io
import zipfile

from attestry import relations as R
from attestry.durable import numbered
from attestry.operators import findings as fi
from attestry.operators import scan as sc
from attestry.plans import code, packs, scans
from attestry.sources import archives, property_lists, tree


def test_project_scan(spark):
    got = scans.project_scan(spark)
    found = [(r["rule_id"], r["path"]) for r in scans._numbered(got.signals).orderBy("n").select("rule_id", "path").collect()]
    rules = [r for r, _ in found]
    assert [r.split(".")[0] for r in rules[:1]] == ["firebase"] and rules.index("supabase.table-without-rls") < rules.index("android.cleartext-enabled") < rules.index("ci.github-expression-command-injection")
    assert rules.index("privacy.sensitive-logging") < rules.index("dataflow.sql-injection") < rules.index("nestjs.auth.sensitive-route-without-guard") < rules.index("fastapi.auth.whitelisted-sensitive-route")
    assert rules.index("python.dataflow.ssrf") < rules.index("jwt.config.committed-signing-secret") < rules.index("artifact.embedded-secret")
    assert {"docker.config.unguarded-service-published", "fastapi.config.route-raw-exception-response", "artifact.ios-ats-disabled"} <= set(rules)
    assert len({r for r in rules}) > 40
    status = {r["domain"]: r["status"] for r in got.coverage.collect()}
    assert status["secrets"] == status["mobile-source-config"] == "complete" and status["node-api-security"] == "partial" and status["rule-pack:house"] == "partial"
    assert got.paths.count() == 4  # client data, model output, injection, published service
    assert fi.decided(got.findings, got.coverage, got.signals).first()["decision"] == "block"
    used = {r["id"] for r in fi.consumed(got.signals, got.paths).collect()}
    assert used and not used & {i for r in got.findings.where("attack_path_id IS NULL").collect() for i in r["signal_ids"]}


def test_scan_of_nothing(spark):
    got = sc.scanned(R.rows(spark, [], R.FILES), packs._rules(spark))
    assert got.signals.count() == got.findings.count() == got.paths.count() == 0
    status = {r["domain"]: r["status"] for r in got.coverage.collect()}
    assert status["fastapi-authentication"] == "not_run" and status["secrets"] == "complete"


def test_gates(spark):
    files = [{"relative_path": "src/net.ts", "content": 'const a = "http://api.shop.test/v1"', "size": 40, "walk_pos": 0}]
    assert sc.scanned(R.rows(spark, files, R.FILES)).signals.count() == 0
    files.append({"relative_path": "package.json", "content": '{"dependencies": {"react-native": "1"}}', "size": 40, "walk_pos": 1})
    assert [r["rule_id"] for r in sc.scanned(R.rows(spark, files, R.FILES)).signals.collect()] == ["mobile.insecure-http-endpoint"]


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def test_packages_say_what_they_lack(spark, monkeypatch):
    many = {f"assets/{i:02}.json": b"{}" for i in range(30)} | {"classes.dex": b"abcd"}
    cases = [("a.apk", _zip(many)), ("b.apk", b"not a zip"), ("c.apk", _zip({"../x": b"x"})), ("d.apk", _zip({"classes.dex": b"x" * 40, "other": b"y"})), ("e.apk", b"")]
    rows = archives.entries(spark.createDataFrame(cases, "artifact string, content binary")).collect()
    reason = {r["artifact"]: r["reason"] for r in rows if r["idx"] is None}
    assert reason == {"a.apk": "only 25 of 31 entries were read", "b.apk": "archive cannot be read", "c.apk": "unsafe entry name", "d.apk": None, "e.apk": "archive cannot be read"}
    read = [(r["artifact"], r["name"]) for r in rows if r["idx"] is not None]
    assert read[0] == ("a.apk", "classes.dex") and len(read) == 26 and read[-1] == ("d.apk", "classes.dex")
    told = archives.coverage(archives.entries(spark.createDataFrame(cases, "artifact string, content binary"))).first()
    assert told["status"] == "partial" and told["reason"].startswith("a.apk: only 25")
    assert archives.coverage(archives.entries(spark.createDataFrame([], "artifact string, content binary"))).first()["status"] == "not_run"


def test_walk_goes_down_at_once(spark, tmp_path):
    for p in ("a-b.ts", "a.ts", "a/b.ts", "B.ts", "c/d/e.ts", "c/a.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = [r["relative_path"] for r in tree.read_tree(spark, str(tmp_path)).orderBy("walk_pos").collect()]
    assert got == ["a/b.ts", "a-b.ts", "a.ts", "B.ts", "c/a.ts", "c/d/e.ts"]


def test_entries_beyond_the_limit(spark):
    files = [{"relative_path": f"f{i}.ts", "content": "x", "size": 1, "walk_pos": i} for i in range(30)]
    limits = tree.LIMITS | {"max_files": 3}
    files[:12] = [{**f, "relative_path": f["relative_path"].replace(".ts", ".png")} for f in files[:12]]
    skips = {r["reason"]: r["n"] for r in tree.skip_counts(tree.judged(R.rows(spark, files, R.FILES), limits)).collect()}
    assert skips == {"not_text": 12, "entry_limit": 15}


def test_signals_beyond_the_limit(spark):
    keys = "\n".join(f"AKIA{i:016d}" for i in range(2100))
    files = R.rows(spark, [{"relative_path": "a.txt", "content": keys, "size": len(keys), "walk_pos": 0}], R.FILES)
    whole = sc.gathered(files, most=None)[1]
    assert whole.count() == whole.where("NOT partial").count() == 2100
    assert [r["line"] for r in numbered(whole, ["ord", "id"]).orderBy("n").collect()] == list(range(1, 2101))
    assert sc.scanned(files).signals.where("partial").count() == sc.MOST  # a scan's SQL states the cut


def test_joins_that_grow_stay_off_the_driver(spark):
    found = archives.opened(spark.createDataFrame(code.packages(), "artifact string, content binary"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan")[0]
    assert plan(found).count("BroadcastHashJoin") == 0
    assert plan(archives.corpus_of(found)).count("BroadcastHashJoin") == 1  # the ranges of names, a row for each
    lists = found.where("idx IS NOT NULL").select("artifact", "bytes")
    assert "BroadcastHashJoin" not in plan(property_lists.decoded(lists, 1000))
