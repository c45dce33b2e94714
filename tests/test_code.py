"""What readers of sources and packages find in the inline files, against what a person finds there."""

import re

import pyarrow as pa
import pytest

from attestry import durable
from attestry.operators import baas, js_code, parsing, python_code
from attestry.plans import code

EXPECTED = {
    "rls_anti": {("supabase/1.sql", "notes", 2), ("supabase/1.sql", "teammembers", 3)},
    "router_closure": {("app.main:app", "", False, False), ("app.routers.open_area:router", "", False, False), ("app.routers.orders:router", "/v1/orders", False, True), ("guarded.main:app", "", True, False)},
    "fastapi_findings": {
        ("fastapi.auth.sensitive-route-without-guard", "POST /reports", "create", "app/routers/open_area.py", 8),
        ("fastapi.auth.whitelisted-sensitive-route", "GET /admin/list", "listing", "guarded/main.py", 7),
        ("fastapi.auth.whitelisted-sensitive-route", "GET /reports/all", "files", "guarded/main.py", 10),
        ("fastapi.authorization.object-without-ownership-check", "GET /v1/orders/{order_id}", "read_order", "app/routers/orders.py", 6),
    },
    "enclosing_interval": {("__init__", "ModelClient"), ("send", "ModelClient")},
    "taint_fixpoint": {("create", x) for x in ("client", "name", "sql", "target", "url")} | {("fetch", "address"), ("fetch", "part"), ("inner", "u"), ("read_order", "order_id"), ("remove", "order_id"), ("remove", "row")},
    "python_flows": {
        ("python.dataflow.client-url-with-server-secret", "app/routers/open_area.py", 14, "create", "ModelClient"),
        ("python.dataflow.sql-injection", "app/routers/open_area.py", 13, "create", "db.execute"),
        ("python.dataflow.sql-injection", "app/routers/open_area.py", 13, "create", "text"),
        ("python.dataflow.ssrf", "app/net.py", 9, "inner", "httpx.get"),
        ("python.dataflow.untrusted-file-path", "app/routers/open_area.py", 16, "create", "open"),
    },
    "published_services": {("docker.config.unguarded-service-published", "docker-compose.prod.yml", "api", "8000:8000")},
    "node_findings": {
        ("express.auth.sensitive-route-without-guard", "GET /users", "src/app.js"),
        ("express.authorization.object-without-ownership-check", "GET /v1/orders/:id", "src/orders.js"),
        ("express.authorization.privileged-operation-without-role-check", "GET /admin/stats", "src/app.js"),
        ("nestjs.auth.sensitive-route-without-guard", "GET /notes/open/users", "src/notes.controller.ts"),
        ("nestjs.auth.sensitive-route-without-guard", "POST /users", "src/notes.controller.ts"),
        ("nestjs.authorization.object-without-ownership-check", "GET /notes/:id", "src/notes.controller.ts"),
    },
    "whitelist_prefix": {
        ("DELETE", "/v1/orders/{order_id}", "remove", True, False, None, None),
        ("GET", "/admin/list", "listing", False, True, "/admin/list", "exact"),
        ("GET", "/admin/other", "other", False, True, None, None),
        ("GET", "/reports/all", "files", False, True, "/reports/", "prefix"),
        ("GET", "/health", "health", False, False, None, None),
        ("GET", "/v1/orders/{order_id}", "read_order", True, False, None, None),
        ("POST", "/reports", "create", False, False, None, None),
    },
    "fastapi_exceptions": {
        ("fastapi.config.route-raw-exception-response", "app/routers/open_area.py", 17, "create", "POST /reports", "str", "detail"),
        ("fastapi.config.wildcard-cors-with-credentials", "app/main.py", 6, None, None, None, None),
        ("fastapi.config.raw-exception-response", "app/main.py", 15, None, None, None, None),
    },
    "middleware_asof": {
        ("express", "GET", "/health", False, ""),
        ("express", "GET", "/users", False, ""),
        ("express", "GET", "/admin/stats", True, ""),
        ("express", "GET", "/v1/orders/:id", True, "object"),
        ("express", "POST", "/v1/orders", True, ""),
        ("express", "GET", "/v1/orders", True, ""),
        ("express", "GET", "/v1/mine/:id", True, "owner,object"),
        ("nestjs", "GET", "/notes/:id", True, "object"),
        ("nestjs", "GET", "/notes/open/users", False, ""),
        ("nestjs", "POST", "/users", False, ""),
    },
    "js_flows": {("dataflow.command-injection", "src/flows.test.ts", 1), ("ai.model-output-dangerous-sink", "src/flows.ts", 9), ("dataflow.dom-xss", "src/flows.ts", 5), ("dataflow.sql-injection", "src/flows.ts", 2), ("dataflow.ssrf", "src/flows.ts", 7)},
}


FINDERS = {f.__name__: (f, files) for f, files in code.FOUND.items()}


def found_inline(spark, name):
    find, files = FINDERS[name]
    return find(code._rows(spark, files))


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_found(spark, name):
    width = len(next(iter(EXPECTED[name])))  # some end in the path
    assert {tuple(r)[:width] for r in found_inline(spark, name).collect()} == EXPECTED[name]


@pytest.mark.parametrize("name", ["js_flows", "python_flows", "published_services"])
def test_found_in_each_project_of_documents(spark, sf_dir, name):
    got = {}
    for r in code.QUERIES[name](spark, sf_dir).collect():
        folder, _, path = r["relative_path"].partition("/")
        got.setdefault(folder, set()).add(tuple(path if c == "relative_path" else r[c] for c in r.asDict()))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count() // len(FINDERS[name][1])  # projects with all their files
    assert n > 5 and all(got[f"p{k}"] == EXPECTED[name] for k in range(n))


def test_store_rules(spark):
    found = {(r["rule_id"], r["line"]) for r in found_inline(spark, "store_rules").collect()}
    assert ("supabase.permissive-rls-policy", 5) in found and ("supabase.permissive-rls-policy", 7) not in found
    assert ("supabase.user-metadata-authorization", 10) in found
    assert ("firebase.storage-upload-without-size-limit", 3) in found and ("firebase.storage-upload-without-size-limit", 2) not in found
    assert ("firebase.unconditional-access", 6) not in found  # a comment


def test_packages(spark, sf_dir):
    shapes = spark.createDataFrame(code.packages(), "artifact string, content binary")
    found = {(r["rule_id"], r["path"]) for r in code.packages_found(shapes).collect()}
    assert found == {("artifact.embedded-secret", "a.apk!classes.dex"), ("artifact.cleartext-endpoint", "a.apk!classes.dex"), ("artifact.ios-ats-disabled", "b.ipa!Payload/App.app/Info.plist")}
    each = {(r["rule_id"], r["path"]) for r in code.package_rules(spark, sf_dir).collect()}
    assert {("artifact.embedded-secret", "p9/a.apk!classes.dex"), ("artifact.ios-ats-disabled", "p10/b.ipa!Payload/App.app/Info.plist")} <= each
    assert not any("c.apk" in path for _, path in each)


@pytest.mark.parametrize(
    ("condition", "kind"),
    [("true", "unconditional"), ("((TRUE))", "unconditional"), ("auth.uid() is not null", "authentication_only"), ("auth.uid() is not null and true", "authentication_only"), ("auth.uid() is not null or owner = 1", "authentication_only"), ("owner = 'or true'", "constrained"), ("a = 1 and true", "constrained"), ("x or true", "unconditional")],
)
def test_grants(condition, kind):
    assert baas.grant(condition, "sql") == kind


def test_masking_keeps_places():
    text = "a -- b;\n'x;y' /* c\nd */ e"
    out = parsing.masked(text, "sql")
    assert len(out) == len(text) and ";" not in out and out.count("\n") == text.count("\n")


def test_guard_names_and_paths():
    for name in ("requireAuth", "auth", "passport.authenticate('jwt')", "sessionAuthGuard", "jwtGuard({a: 1})", "middleware.protect", "[limit, verifyToken]", "my_auth"):
        assert js_code.guards([name])
    for name in ("author", "authorize", "unauth", "requireAuthor", "limit", "jwtGuardian"):
        assert not js_code.guards([name])
    skipped = lambda p, pattern: bool(re.search(pattern, p))
    assert not any(skipped(p, js_code._NOT_RUNTIME) for p in ("docs/server.ts", "e2e/api.ts", "src/testing.d/x.ts", "a/latest.ts"))
    assert all(skipped(p, js_code._NOT_RUNTIME) for p in ("old-archive/a.ts", "mocks/a.ts", "src/debug-server.ts", "src/exampleApp.mjs", "Tests/a.js"))
    assert not any(skipped(p, python_code._NOT_RUNTIME) for p in ("docs/api/main.py", "migrations/env_api.py", "mocks/a.py"))
    assert all(skipped(p, python_code._NOT_RUNTIME) for p in ("old-archive/a.py", "src/debug_main.py", "scripts/a.py"))


def test_a_reader_is_run_once_for_what_is_asked(spark):
    """Migrations are read once for all store rules; routes are read without flows and flows without routes, and both together give the same."""
    files = code._rows(spark, code.STORES)
    assert baas.findings(files)._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    files = code._rows(spark, code.JS)
    listed = lambda rows: sorted(map(str, rows.collect()))
    routes, flows = js_code.code_rows(files, flows=False), js_code.code_rows(files, routes=False)
    assert {r["kind"] for r in flows.collect()} == {"flow"} and routes.where("kind = 'flow'").isEmpty()
    assert sorted(listed(routes) + listed(flows)) == listed(js_code.code_rows(files))


def test_whole_files_come_in_bounded_batches(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"n": batch.num_rows}])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        got = [r["n"] for r in durable.in_batches(spark.range(0, 3000, 1, 1), run, "n long").collect()]
        assert sum(got) == 3000 and max(got) <= durable.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_of_many_files_share_a_batch():
    import pyarrow as pa

    from attestry.operators import parsing

    files = [(pa.scalar(f"f{i}"), pa.scalar("ab" * i)) for i in range(100)]
    found = list(parsing.row_batches(iter(files), lambda path, content: ({"a": c} for c in content), [("a", pa.string())], most=1000))
    assert [b.num_rows for b in found] == [1000] * 9 + [900]
    assert [r["relative_path"] for b in found for r in b.to_pylist()] == [f"f{i}" for i in range(100) for _ in range(2 * i)]


def test_one_archive_is_made_of_a_document(monkeypatch):
    made, zipped = [], code._zipped
    monkeypatch.setattr(code, "_zipped", lambda entries: (made.append(1), zipped(entries))[1])
    every = code.packages("t")
    made.clear()
    assert [(code.PACKAGES[k], code.package(k, "t")) for k in range(3)] == every and len(made) == 3
    made.clear()
    code.package(1, "t")
    assert len(made) == 1
