"""Code queries over documents in the shapes of inline files: store rules, Python routes and taint, JavaScript routes and flows, packaged applications."""

from __future__ import annotations

import io
import json
import plistlib
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.durable import in_batches, kept
from attestry.operators import baas, js_code, parsing, python_code, rules
from attestry.operators.parsing import SESSION_PATH
from attestry.plans.common import quoted, rows, table, values
from attestry.sources import archives


def _files(texts: dict[str, str]) -> list[dict]:
    return [{"relative_path": p, "content": c, "size": len(c), "walk_pos": i} for i, (p, c) in enumerate(texts.items())]


STORES = _files({
    "supabase/1.sql": """-- create table commented (id int);
create table public.profiles (id uuid); CREATE TABLE notes (id int);
create table if not exists "Team Members" (id int); create table auth.x (id int);
alter table profiles enable row level security;
create policy "open" on public.profiles for select using (true);
create policy p2 on notes to authenticated using (auth.uid() is not null);
create policy p3 on notes as restrictive to anon using (true);
create policy p4 on notes using ((select auth.uid()) is not null or owner = auth.uid()) with check (owner = auth.uid());
create policy p5 on notes to service_role using (true);
create policy p6 on notes using ((auth.jwt() -> 'user_metadata' ->> 'role') = 'admin');
create policy p7 on notes using (owner = auth.uid() and (true or auth.uid() is not null));
""",
    "firestore.rules": """service cloud.firestore {
  function signedIn() { return request.auth != null; }
  function owns(id) { return signedIn() && request.auth.uid == id; }
  match /a/{id} { allow read: if true; allow write: if signedIn(); }
  match /b/{id} { allow get, list: if owns(id); allow delete; }
  // allow read: if true;
}
""",
    "storage.rules": """service firebase.storage {
  match /up/{f} { allow write: if request.auth != null && request.resource.size < 5 * 1024 * 1024; }
  match /big/{f} { allow create, update: if request.auth.uid == f; }
}
""",
})

PYTHON = _files({
    "app/main.py": """from fastapi import FastAPI, Depends
from starlette.middleware.cors import CORSMiddleware
from .routers import orders, open_area
from app.auth import get_current_user
app = FastAPI()
app.add_middleware(CORSMiddleware, allow_origins=["*"], allow_credentials=True)
app.include_router(orders.router, prefix="/v1", dependencies=[Depends(get_current_user)])
app.include_router(open_area.router)

@app.get("/health")
def health():
    return {}

@app.exception_handler(Exception)
async def failed(request, exc):
    return JSONResponse(content={"detail": str(exc)})
""",
    "app/routers/__init__.py": "",
    "app/routers/orders.py": """from fastapi import APIRouter
from app.store import load
router = APIRouter(prefix="/orders")

@router.get("/{order_id}")
def read_order(order_id: int, db: Session = Depends(get_db)):
    return db.get(Order, order_id)

@router.delete("/{order_id}")
def remove(order_id: int, user=Depends(get_current_user)):
    row = db.get(Order, order_id)
    if row.owner_id != user.id:
        raise HTTPException(403)
    db.delete(row)
""",
    "app/routers/open_area.py": """from fastapi import APIRouter
import requests
from app.net import fetch as pull
from app.clients import ModelClient
router = APIRouter()

@router.post("/reports")
def create(url: str, name: str):
    target = url.strip()
    safe = sanitize_name(name)
    pull(target, name=safe)
    sql = f"SELECT * FROM t WHERE n = '{name}'"
    db.execute(text(sql))
    client = ModelClient(base_url=url)
    try:
        return open(name).read()
    except Exception as e:
        raise HTTPException(500, detail=str(e))
""",
    "app/net.py": """import httpx

def fetch(address, name=None):
    for part in [address]:
        inner(part)
    open(name)

def inner(u):
    return httpx.get(u)

def unrelated(u):
    return httpx.get("https://fixed.test/" + u)
""",
    "app/clients.py": """import os, requests
class ModelClient:
    def __init__(self, base_url=None, api_key=None):
        self.base_url = base_url or os.getenv("URL")
        self.api_key = api_key or os.getenv("KEY")
    def send(self):
        return requests.post(self.base_url, headers={"Authorization": f"Bearer {self.api_key}"})
""",
    "guarded/main.py": """from fastapi import FastAPI
PUBLIC_PATHS = ["/admin/list", "/reports/*"]
app = FastAPI()
app.add_middleware(AuthMiddleware)

@app.get("/admin/list")
def listing(): ...

@app.get("/reports/all")
def files(): ...

@app.get("/admin/other")
def other(): ...
""",
    "broken.py": "def (:\n",
    "tests/test_x.py": "import requests\n",
    "docker-compose.prod.yml": "services:\n  api:\n    image: x\n    ports:\n      - \"8000:8000\"\n      - \"127.0.0.1:9:9\"\n  db:\n    ports:\n      - \"5432:5432\"\n",
})

JS = _files({
    "src/app.js": """const express = require('express');
const orders = require('./orders');
const app = express();
// app.get('/users/hidden', h)
app.get('/health', (req, res) => res.end());
app.get('/users', (req, res) => res.json(all()));
app.use('/admin', requireAuth);
app.get('/admin/stats', (req, res) => res.json({}));
app.use('/v1', requireAuth, orders);
""",
    "src/orders.js": """const { Router } = require('express');
const router = Router();
router.get('/orders/:id', async (req, res) => res.json(await Order.findOne(req.params.id)));
router.route('/orders').post((req, res) => res.json(Order.create(req.body))).get((req, res) => res.end());
router.get('/mine/:id', async (req, res) => res.json(await Order.findOne({ userId: req.user.id })));
module.exports = router;
""",
    "src/notes.controller.ts": """@UseGuards(AuthGuard)
@Controller('notes')
export class NotesController {
  @Get(':id')
  async one(@Param('id') id: string) { return this.repo.findOne(id); }
  @Public()
  @Get('open/users')
  open() { return []; }
}
@Controller('users')
class UsersController {
  @Post()
  create(@Body() b: any) { return this.repo.save(b); }
}
""",
    "src/flows.ts": """const id = req.query.id;
db.query(`select * from t where id = ${id}`);
const clean = sanitize(req.body.html);
el.innerHTML = clean;
el.innerHTML = req.body.html;
const url = req.body.url;
fetch(url);
const out = await openai.chat.create(p);
exec(out);
exec("ls");
""",
    "src/flows.test.ts": "exec(req.body.x);\n",
})


#: What starts a comment, by the ending of the path.
_COMMENT = {"py": "#", "yml": "#", "sql": "--"}


def _rows(spark: SparkSession, files: list[dict]) -> DataFrame:
    return rows(spark, files, R.FILES)


def projects(spark: SparkSession, sf_dir: str, files: list[dict]) -> DataFrame:
    """Documents as the inline files of projects p0, p1, ...: each is the file that its number names, with its text as a comment at the end."""
    shapes = [{"k": k, "path": f["relative_path"], "code": f["content"], "mark": "\n" + _COMMENT.get(f["relative_path"].rpartition(".")[2], "//") + " "} for k, f in enumerate(files)]
    folder = F.concat(F.lit("p"), F.floor(F.col("doc_id") / len(files)).cast("string"))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x00]+", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", folder.alias("folder"), said.alias("said"), F.expr(f"CAST(doc_id % {len(files)} AS int)").alias("k"))
    got = docs.join(F.broadcast(rows(spark, shapes, "k int, path string, code string, mark string")), "k")  # a few inline rows
    own = F.replace("code", F.lit("from app."), F.concat(F.lit("from "), "folder", F.lit(".app.")))  # modules are named from the top
    return got.select(F.concat_ws("/", "folder", "path").alias("relative_path"), F.concat(own, "mark", "said").alias("content"), F.col("doc_id").alias("walk_pos")).withColumn("size", F.octet_length("content").cast("long"))


def rls_anti(files: DataFrame) -> DataFrame:
    return baas.bare_tables(kept(baas.sql_rows(files), "code")).select("relative_path", "name", "line")


def store_rules(files: DataFrame) -> DataFrame:
    return baas.findings(files)


def _python(files: DataFrame) -> DataFrame:
    """What the reader finds, written once: routers, routes, calls and flows all come from it."""
    return kept(python_code.code_rows(files), "code")


def router_closure(files: DataFrame) -> DataFrame:
    return python_code.routers(_python(files))


def whitelist_prefix(files: DataFrame) -> DataFrame:
    got = python_code.routes(_python(files))
    return got.select("method", "path", "handler", "guarded", "middleware", F.col("whitelist.entry").alias("entry"), F.col("whitelist.entry_kind").alias("entry_kind"), "relative_path")


def fastapi_findings(files: DataFrame) -> DataFrame:
    return python_code.route_findings(python_code.routes(_python(files)))


def fastapi_exceptions(files: DataFrame) -> DataFrame:
    code = _python(files)
    got = python_code.exception_findings(code, python_code.routes(code)).withColumn("routes", F.array_join("routes", ","))
    more = python_code.config_findings(code)
    return got.unionByName(more, allowMissingColumns=True)


def enclosing_interval(files: DataFrame) -> DataFrame:
    return python_code.enclosing(_python(files)).select("name", "class_name", F.substring_index("fid", "#", 1).alias("relative_path"))


def taint_fixpoint(files: DataFrame) -> DataFrame:
    return python_code.tainted(_python(files)).select(F.regexp_extract("fid", "#([^@]+)@", 1).alias("function"), "name", F.substring_index("fid", "#", 1).alias("relative_path"))


def python_flows(files: DataFrame) -> DataFrame:
    code = _python(files)
    return python_code.taint_findings(code, python_code.tainted(code))


def published_services(files: DataFrame) -> DataFrame:
    return python_code.published(files, python_code.routes(_python(files))).withColumn("ports", F.array_join("ports", ","))


def _js(files: DataFrame) -> DataFrame:
    """What the readers of routes find, written once: routes, mounts, guards and exports all come from it."""
    return kept(js_code.code_rows(files, flows=False), "code")


def middleware_asof(files: DataFrame) -> DataFrame:
    return js_code.routes(_js(files)).select("framework", "method", "path", "guarded", F.array_join("items", ",").alias("items"), "relative_path")


def node_findings(files: DataFrame) -> DataFrame:
    return js_code.route_findings(js_code.routes(_js(files))).select("rule_id", "route", "relative_path")


def js_flows(files: DataFrame) -> DataFrame:
    return js_code.flow_findings(js_code.code_rows(files, routes=False)).select("rule_id", "relative_path", "line")


def _zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


#: The names of the two applications and of the archive with an unsafe name.
PACKAGES = ("a.apk", "b.ipa", "c.apk")


def package(k: int, text: str = "") -> bytes:
    """The archive that PACKAGES names at k; text stands in an asset of it."""
    asset = {"assets/x.json": json.dumps({"u": "http://localhost/a", "text": text}).encode()}
    if k == 1:
        info = plistlib.dumps({"NSAppTransportSecurity": {"NSAllowsArbitraryLoads": True}}, fmt=plistlib.FMT_BINARY)
        return _zipped({"Payload/App.app/Info.plist": info} | asset)
    dex = b"\x00\x01" + b"AKIA" + b"ABCDEFGHIJKLMNOP" + b"\x00" + "http://api.shop.test/v1".encode("utf-16-le") + b"\x00\x00ab\x00"
    return _zipped(({"classes.dex": dex, "other.bin": b"zzzz"} if k == 0 else {"../evil.js": b"x", "classes.dex": dex}) | asset)


def packages(text: str = "") -> list[tuple[str, bytes]]:
    """Two applications and one archive with an unsafe name, as bytes; text stands in an asset of each."""
    return [(name, package(k, text)) for k, name in enumerate(PACKAGES)]


def packaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of each document, in the shape that its number names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text in ((n.as_py(), t.as_py()) for n, t in zip(batch.column(0), batch.column(1), strict=True)):
                k = n % len(PACKAGES)
                yield pa.RecordBatch.from_pylist([{"artifact": f"p{n}/{PACKAGES[k]}", "content": package(k, text or "")}])

    return in_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), run, "artifact string, content binary")


def package_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages_found(packaged(spark, sf_dir))


def packages_found(found: DataFrame) -> DataFrame:
    return rules.signals(archives.corpus(found), rules.ARTIFACT_RULES, "artifact").select("rule_id", "path", "line", "snippet")


def _over(find: Callable[[DataFrame], DataFrame], files: list[dict]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: find(projects(spark, sf_dir, files))


#: What is found in files, and the inline files whose shapes documents take for it.
FOUND = {f: STORES for f in (rls_anti, store_rules)}
FOUND |= {f: PYTHON for f in (router_closure, whitelist_prefix, fastapi_findings, fastapi_exceptions, enclosing_interval, taint_fixpoint, python_flows, published_services)}
FOUND |= {f: JS for f in (middleware_asof, node_findings, js_flows)}
QUERIES = {f.__name__: _over(f, files) for f, files in FOUND.items()} | {"package_rules": package_rules}


def _parsed(files: list[dict], due: Callable[[str], bool], own: Callable[[str], str], ddl: str, *readers: Callable) -> str:
    """What the readers yield for the inline files as a common table, for each document the rows of its file: SQL takes over where source text has become rows. own: a column with the project's name put in."""
    found = [{"k": k, "relative_path": f["relative_path"]} | row for k, f in enumerate(files) if due(f["relative_path"]) for read in readers for row in read(f["relative_path"], f["content"])]
    place = f"'p' || (doc_id // {len(files)})"
    columns = [c.split(" ")[0] for c in ddl.split(", ")]
    each = ", ".join(f"{own(c).format(place=place)} AS {c}" for c in columns)
    shapes = values("parsed_shapes", found, f"k int, relative_path string, {ddl}")
    return f"{shapes}, parsed AS (SELECT {place} || '/' || t.relative_path AS relative_path, {each} FROM documents JOIN parsed_shapes t ON t.k = doc_id % {len(files)})"


def _of(kind: str, **columns: str) -> str:
    return f"(SELECT relative_path, {', '.join(f'{c} AS {n}' for n, c in columns.items())} FROM parsed WHERE kind = '{kind}')"


#: Columns that hold a module, a router or a function's id, by the kinds of rows where they do.
_MODULES = {"a": "true", "b": "kind IN ('import', 'mount')", "c": "kind = 'function'", "d": "kind = 'route'"}
_PY_OWN = lambda c: f"CASE WHEN {_MODULES[c]} THEN regexp_replace({c}, '^(app|guarded)([./:])', {{place}} || '\\2\\1\\2') ELSE {c} END" if c in _MODULES else c
_PY = _parsed(PYTHON, lambda p: p.endswith(".py") and not re.search(python_code._NOT_RUNTIME, p), _PY_OWN, python_code._DDL, python_code.read_python)
_JS_OWN = lambda c: f"replace({c}, 'src/', {{place}} || '/src/')" if c in "abcde" else c  # noqa: E731  all files stand in src/
_JS = _parsed(JS, lambda p: bool(re.search(js_code._SOURCE, p)) and not re.search(js_code._NOT_RUNTIME, p), _JS_OWN, python_code._DDL, js_code.read_express, js_code.read_nest, js_code.read_flows)
_STORE = _parsed(STORES, lambda p: True, lambda c: c, baas._DDL, lambda p, c: baas.read_sql(p, c) if p.endswith(".sql") else baas.read_rules(p, c))
_BARE = """made AS (SELECT relative_path, name, line FROM parsed WHERE kind = 'table' AND NOT regexp_matches(name, '^(auth|storage)[.]')),
protected AS (SELECT DISTINCT name FROM parsed WHERE kind = 'enabled'), bare AS (SELECT * FROM made WHERE name NOT IN (SELECT name FROM protected) AND regexp_extract(name, '[^.]*$') NOT IN (SELECT name FROM protected) AND 'public.' || name NOT IN (SELECT name FROM protected))"""
_CLIENTS = "[" + ", ".join(map(quoted, baas.CLIENT_ROLES)) + "]"
_STORE_RULES = "".join(f" UNION ALL SELECT {quoted(rule)}, relative_path, name, line FROM parsed WHERE kind = '{kind}' AND {test}" for rule, kind, test in (
    ("supabase.permissive-rls-policy", "policy", f"list_has_any(roles, {_CLIENTS}) AND NOT restrictive AND list_contains(grants, 'unconditional')"),
    ("supabase.authenticated-policy-without-row-filter", "policy", f"list_has_any(roles, {_CLIENTS}) AND NOT restrictive AND list_contains(grants, 'authentication_only')"),
    ("supabase.user-metadata-authorization", "policy", f"list_has_any(roles, {_CLIENTS}) AND metadata"),
    ("firebase.unconditional-access", "allow", "list_contains(grants, 'unconditional')"),
    ("firebase.authenticated-access-without-resource-check", "allow", "list_contains(grants, 'authentication_only')"),
    ("firebase.storage-upload-without-size-limit", "allow", "metadata"),
))
_JOINED = lambda x: f"(CASE WHEN trim({x}, '/') = '' THEN '/' ELSE regexp_replace(regexp_replace('/' || {x}, '/{{2,}}', '/', 'g'), '/$', '') END)"
_MOUNTED = f"""WITH RECURSIVE {_PY}, r AS (SELECT module || ':' || name AS router, own_prefix, own_guard, is_app FROM {_of("router", module="a", name="b", own_prefix="c", own_guard="flag", is_app="m")}), mnt AS {_of("mount", parent="a", child="b", prefix="c", guard="flag")},
walk AS (SELECT router, own_prefix AS path, EXISTS (SELECT 1 FROM parsed p WHERE p.kind = 'middleware' AND p.a = router) AS middleware, own_guard AS guarded, [router] AS through FROM r WHERE is_app = 1
  UNION ALL SELECT child, path || prefix || own_prefix, middleware, guarded OR guard OR own_guard, list_append(through, child) FROM walk JOIN mnt ON parent = walk.router JOIN r ON r.router = child WHERE NOT list_contains(through, child)),
mounted AS (SELECT DISTINCT router, path, middleware, guarded FROM walk)"""
_ROUTES = f"""{_MOUNTED}, plain AS (SELECT DISTINCT relative_path, method, {_JOINED("path || place")} AS path, fid, handler, line, own_guard OR guarded AS guarded, middleware, owned = 1 AS owned, ids
  FROM {_of("route", router="a", method="b", place="c", fid="d", handler="e", own_guard="flag", line="n", owned="m", ids="items")} JOIN mounted USING (router)),
routes AS (SELECT p.*, entry, entry_kind FROM plain p LEFT JOIN (SELECT path AS listed, arg_min(w.e, (w.l, w.e)) AS entry, arg_min(w.k, (w.l, w.e)) AS entry_kind FROM (SELECT DISTINCT path FROM plain)
  JOIN {_of("whitelist", e="a", k="b", l="n")} w ON CASE WHEN w.k = 'exact' THEN path = w.e ELSE starts_with(path, w.e) END GROUP BY path) ON path = listed)"""
_SESSION = SESSION_PATH
_SENSITIVE = f"NOT regexp_matches(path, {quoted(python_code.PUBLIC_PATH)}) AND (method IN ('POST', 'PUT', 'PATCH', 'DELETE') OR regexp_matches(path, {quoted(parsing.SENSITIVE_PATH)}))"
_ROUTE = "method || ' ' || path AS route, handler, relative_path, line FROM routes WHERE"
_EDGES = f"""WITH RECURSIVE {_PY}, f AS {_of("function", fid="a", fname="b", module="c")}, i AS {_of("import", l="a", module="b", original="c")}, home AS (SELECT DISTINCT relative_path, module FROM f), args AS {_of("argument", fid="a", call="n", pos="m", keyword="b", src="unnest(items)")},
called AS (SELECT c.fid, c.call, coalesce(i.original, c.callee) AS fname, coalesce(i.module, CASE WHEN h.module IS NOT NULL THEN h.module || CASE WHEN h.original = '' THEN '' ELSE '.' || h.original END END, home.module) AS module
  FROM {_of("call", fid="a", callee="b", dotted="c", call="n")} c LEFT JOIN i ON i.original <> '' AND c.relative_path = i.relative_path AND c.callee = i.l LEFT JOIN i h ON contains(c.dotted, '.') AND c.relative_path = h.relative_path AND string_split(c.dotted, '.')[1] = h.l LEFT JOIN home ON home.relative_path = c.relative_path),
edges AS (SELECT a AS fid, b AS src, a AS to_fid, c AS dst FROM parsed WHERE kind = 'flow' UNION SELECT called.fid, src, f.fid, p.name FROM called JOIN f USING (fname, module) JOIN args ON args.fid = called.fid AND args.call = called.call
  JOIN {_of("parameter", fid="a", name="b", spot="n")} p ON p.fid = f.fid AND CASE WHEN pos >= 0 THEN pos = spot ELSE keyword = p.name END),
reach AS (SELECT a AS fid, b AS name FROM parsed WHERE kind = 'parameter' AND flag UNION SELECT to_fid, dst FROM reach JOIN edges ON reach.fid = edges.fid AND src = name)"""
_NODE = f"""WITH RECURSIVE {_JS}, g AS {_of("middleware", receiver="a", guard_at="n", guard_path="d")}, m AS (SELECT m.receiver AS parent, coalesce(nullif(m.child, ''), x.b) AS child, prefix, coalesce(shielded, false) OR EXISTS (SELECT 1 FROM g WHERE g.receiver = m.receiver AND guard_at < m.ord AND (guard_path = '' OR starts_with(prefix, guard_path))) AS guard
  FROM {_of("mount", receiver="a", child="b", module="c", ord="n", prefix="d", shielded="flag")} m LEFT JOIN (SELECT a, b FROM parsed WHERE kind = 'export') x ON x.a = m.module),
walk AS (SELECT a AS receiver, '' AS above, false AS guarded, [a] AS through FROM parsed WHERE kind = 'receiver' AND flag UNION ALL SELECT child, above || prefix, guarded OR guard, list_append(through, child) FROM walk JOIN m ON parent = receiver WHERE child IS NOT NULL AND NOT list_contains(through, child)),
routes AS (SELECT DISTINCT 'express' AS framework, o.relative_path, method, {_JOINED("above || place")} AS path, handler, line, own_guard OR guarded OR EXISTS (SELECT 1 FROM g WHERE g.receiver = o.receiver AND guard_at < o.ord AND (guard_path = '' OR starts_with(place, guard_path))) AS guarded, kinds
  FROM {_of("route", receiver="a", method="b", place="d", handler="e", ord="n", line="m", own_guard="flag", kinds="items")} o JOIN walk USING (receiver)
  UNION SELECT 'nestjs', relative_path, b, {_JOINED("concat_ws('/', c, d)")}, e, m, flag, items FROM parsed WHERE kind = 'nest')"""
_IS = lambda p: f"regexp_matches(path, {quoted(p)})"
_LOOSE = f"CASE WHEN {_IS(js_code.PRIVILEGED_PATH)} THEN NOT {_IS(js_code.LOGIN_PATH)} ELSE NOT {_IS(js_code.PUBLIC_PATH)} AND (method IN ('POST', 'PUT', 'PATCH', 'DELETE', 'ALL') OR {_IS(parsing.SENSITIVE_PATH)}) END"
_NODE_ROUTE = "method || ' ' || path AS route, relative_path FROM routes WHERE"
#: Source text is no table for SQL, so the readers' rows stand in it; tests hold all of these queries against what a person finds in the inline files.
SQL: dict[str, str] = {
    "router_closure": f"{_MOUNTED} SELECT router, path, middleware, guarded FROM mounted",
    "whitelist_prefix": f"{_ROUTES} SELECT method, path, handler, guarded, middleware, entry, entry_kind, relative_path FROM routes",
    "fastapi_findings": f"""{_ROUTES} SELECT 'fastapi.auth.whitelisted-sensitive-route' AS rule_id, {_ROUTE} {_SENSITIVE} AND NOT guarded AND middleware AND entry IS NOT NULL
UNION ALL SELECT 'fastapi.auth.sensitive-route-without-guard', {_ROUTE} {_SENSITIVE} AND NOT guarded AND NOT middleware
UNION ALL SELECT 'fastapi.authorization.object-without-ownership-check', {_ROUTE} (guarded OR (middleware AND entry IS NULL)) AND NOT owned AND len(ids) > 0 AND NOT regexp_matches(path, {quoted(_SESSION)})""",
    "fastapi_exceptions": f"""{_ROUTES}, raw AS {_of("raw_route", fid="a", serialization="b", sink="c", line="n")} SELECT 'fastapi.config.route-raw-exception-response' AS rule_id, raw.relative_path, raw.line, handler, string_agg(DISTINCT method || ' ' || path, ',' ORDER BY method || ' ' || path) AS routes, serialization, sink FROM raw JOIN routes USING (fid) GROUP BY ALL
UNION ALL SELECT CASE kind WHEN 'cors' THEN 'fastapi.config.wildcard-cors-with-credentials' ELSE 'fastapi.config.raw-exception-response' END, relative_path, min(n), NULL, NULL, NULL, NULL FROM parsed WHERE kind IN ('cors', 'raw_handler') GROUP BY kind, relative_path""",
    "enclosing_interval": f"WITH {_PY} SELECT f.b AS name, arg_max(c.a, c.n) AS class_name, f.relative_path FROM parsed f JOIN parsed c ON f.kind = 'function' AND c.kind = 'class' AND f.relative_path = c.relative_path AND c.n < f.n AND f.m <= c.m GROUP BY f.a, f.b, f.relative_path",
    "taint_fixpoint": f"{_EDGES} SELECT regexp_extract(fid, '#([^@]+)@', 1) AS function, name, regexp_extract(fid, '^[^#]*') AS relative_path FROM reach",
    "rls_anti": f"WITH {_STORE}, {_BARE} SELECT * FROM bare",
    "store_rules": f"WITH {_STORE}, {_BARE} SELECT 'supabase.table-without-rls' AS rule_id, * FROM bare{_STORE_RULES}",
    "middleware_asof": f"{_NODE} SELECT framework, relative_path, method, path, guarded, array_to_string(kinds, ',') AS items FROM routes",
    "node_findings": f"""{_NODE} SELECT framework || '.auth.sensitive-route-without-guard' AS rule_id, {_NODE_ROUTE} {_LOOSE} AND NOT guarded
UNION ALL SELECT framework || '.authorization.object-without-ownership-check', {_NODE_ROUTE} guarded AND list_contains(kinds, 'object') AND NOT list_has_any(kinds, ['owner', 'role']) AND NOT {_IS(SESSION_PATH)}
UNION ALL SELECT framework || '.authorization.privileged-operation-without-role-check', {_NODE_ROUTE} guarded AND {_IS(js_code.PRIVILEGED_PATH)} AND NOT list_contains(kinds, 'role')""",
}
