"""Inventory, profile, text functions and pattern rules, over documents and pages.

Documents are prose, so each takes the form of one of some file, path, snippet or route shapes by its id, and keeps its
own text in it: trees, code and strings grow with the documents, and near misses stand among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import relations as R
from attestry.functions import text as T
from attestry.operators import assets
from attestry.operators import rules as ru
from attestry.plans.common import FILES, files, fingerprint_sql, joined_sql, quoted, redacted_sql, rows, semantic_sql, signal_id_sql, snippet_sql, table, values
from attestry.sources import tools, tree

TREE = [
    {"walk_pos": i, "relative_path": p, "content": c, "size": len(c) if n is None else n}
    for i, (p, c, n) in enumerate([
        ("package.json", '{"dependencies": {"next": "14", "react": "18"}, "devDependencies": {"react": "18", "vitest": "1"}}', None),
        ("node_modules/x/index.js", "x", None),
        ("src/a.ts", "const a = 1\n", None),
        ("src/.env.local", "NEXT_PUBLIC_SERVICE_ROLE_KEY=abcdefghijkl\n", None),
        ("src/logo.png", "", 10),
        ("src/big.sql", "select 1", 3_000_000),
        ("src/nul.md", "a\0b", None),
        ("Dockerfile.prod", "FROM x\n", None),
        ("lib/main.dart", "void main() {}\n", None),
        ("pnpm-lock.yaml", "lock: 1\n", None),
        ("broken/package.json", "{oops", None),
        ("a/dist/b.js", "y", None),
        ("tools/run.py", "print(1)\n# trivy:ignore: all\n# TRIVY:IGNORE\n", None),
    ])
]
CODE = [
    {"walk_pos": i, "relative_path": p, "content": c, "size": len(c)}
    for i, (p, c) in enumerate([
        ("android/app/src/main/AndroidManifest.xml", '<application\n android:usesCleartextTraffic="true"\n android:allowBackup = "true">'),
        ("ios/App/Info.plist", "<key>NSAllowsArbitraryLoads</key>\n <true/>"),
        ("src/net.ts", 'const a = "http://api.shop.test/v1"\nconst b = "http://localhost:3000"\nconst c = `http://example.com/x`\n'),
        ("src/store.tsx", "AsyncStorage.setItem('accessToken', t)\nAsyncStorage.setItem('theme', t)\n"),
        ("lib/store.dart", "prefs.setString('password', p);\nsetJavaScriptMode(JavaScriptMode.unrestricted);\nclient.badCertificateCallback = (a, b, c) => true;\n"),
        (".github/workflows/ci.yml", "jobs:\n  a:\n    steps:\n      - run: |\n          echo ${{ github.event.issue.title }}\n"),
        ("src/log.js", "console.log('x', password)\nconsole.info(cookie.value); console.warn('ok')\n"),
        ("app/api/admin/route.ts", "export async function GET() {\n  return db.all()\n}\n"),
        ("app/api/users/[id]/route.ts", "export const POST = async () => { await requireAuth() }\n"),
        ("deploy/app.prod.yml", "JWT_SECRET: 'abcdefgh12345678'\nACCESS_TOKEN_EXPIRE_MINUTES: 2880\n"),
        ("deploy/ok.prod.yml", "JWT_SECRET: replace-me-please\nACCESS_TOKEN_EXPIRE_MINUTES: 60\n"),
        ("web/eval.js", "eval(code)\nnew Function('a')\ncreateHash('md5')\nobj.eval(x)\n"),
        ("web/load.py", "pickle.loads(data)\nhashlib.sha1(x)\n"),
        ("web/view.kt", "settings.javaScriptEnabled = true\nweb.addJavascriptInterface(b, 'n')\n"),
    ])
]
SNIPPETS = [{"s": s} for s in ("key = AKIA" + "ABCDEFGHIJKL", "t ghp" + "_abcdefghijklmnop end", "MY_API_KEY=abcdef12345 # c", "password: 'hunter22'", "secret = x", "use ${DB_PASSWORD:-opensesame} here", "token=abcdefghij, next", "plain text 12 and b3", "API_TOKEN = abc")]
PATHS = [{"s": s} for s in ("src/a b.ts", "./x//y/./z", "../up", "a/../b", "/abs", "C:/win", "c:\\win\\x", "http://x/y", "a%2e/b", "a\tb", "", "é/ü+.js", "ok")]
SHOWN = [{"s": s} for s in ("see https://x.test or www.y.test", "a|b *c* _d_ [e](f)", "mail me@x.test\nnow", "100% sure: a,b", "<b>&'\"", "   ", "x" * 60, "back\\slash `tick` #1!")]
APP = [
    {"walk_pos": i, "relative_path": p, "content": c, "size": len(c)}
    for i, (p, c) in enumerate([
        ("package.json", '{"dependencies": {"next": "14", "openai": "4", "ai": "3", "react-native": "1"}}'),
        ("supabase/migrations/1.sql", "select 1"),
        ("android/AndroidManifest.xml", "<manifest/>"),
        ("rules/firestore.rules", "x"),
    ])
]
_DECLARED = "SELECT CASE WHEN doc_id % 2 = 0 THEN 'GET /' ELSE 'POST /' END || coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS route FROM {}"
URLS = [{"url": s} for s in ("http://api.shop.test:80/x", "http://localhost/", "http://127.0.0.1/", "http://u:p@[::1]:8/x", "http://www.w3.org/1999", "http://a.example.com", "http://badexample.com", "http://10.0.2.2:1")]
ROUTES = [{"s": s} for s in ("GET /a/b", "  POST   /x/:id ", "get /a", "GET a", "PATCH /with space", "ALL /", "TRACE /" + "a" * 481)]


#: A document (doc_id, text, source, lang) in a shape t, as SQL that Spark and DuckDB read alike.
_CONTENT = """CASE WHEN t.relative_path LIKE '%package.json' THEN replace(t.content, '"dependencies": {', '"dependencies": {"' || coalesce(source, 'none') || '": "1", ') ELSE t.content || chr(10) || coalesce(text, '') END"""
_FILE = f"SELECT 'p' || doc_id || '/' || t.relative_path AS relative_path, coalesce(t.size, length({_CONTENT})) AS size, {_CONTENT} AS content, doc_id AS walk_pos FROM"
_NAMED = "t.s || '/' || coalesce(source, 'none') || '/' || doc_id || '.' || coalesce(lang, 'none')"
_TEXT = "t.s || ' ' || coalesce(text, '')"
_SHAPE = "k int, relative_path string, size long, content string"
LIMITS = {"max_files": 60, "max_file_bytes": 2 << 20, "max_total_bytes": 60_000, "max_depth": 64}


def _shapes(data: list[dict]) -> list[dict]:
    """Shapes numbered from 0; a file has a size of its own only where that isn't its content's."""
    return [{**d, "k": k, "size": d["size"] if d.get("size", 0) != len(d.get("content", "")) else None} for k, d in enumerate(data)]


def _shaped(spark: SparkSession, sf_dir: str, select: str, data: list[dict], ddl: str) -> DataFrame:
    """Each document in the shape that its id names."""
    shapes = F.broadcast(rows(spark, _shapes(data), ddl))  # a few inline rows
    select = select.replace("{", "{{").replace("}", "}}")  # braces of its own
    return spark.sql(f"{select} {{documents}} d JOIN {{shapes}} t ON t.k = d.doc_id % {len(data)}", documents=table(spark, sf_dir, "documents"), shapes=shapes)


def shaped_files(spark: SparkSession, sf_dir: str, data: list[dict]) -> DataFrame:
    return _shaped(spark, sf_dir, _FILE, data, _SHAPE)


def _strings(spark: SparkSession, sf_dir: str, form: str, data: list[dict]) -> DataFrame:
    return _shaped(spark, sf_dir, f"SELECT doc_id, {form} AS s FROM", data, "k int, s string")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.judged(shaped_files(spark, sf_dir, TREE), LIMITS)


def inventory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("relative_path")
    return shaped_files(spark, sf_dir, TREE).select("relative_path", tree.is_text(p).alias("is_text"), tree.is_excluded(p).alias("is_excluded"))


def inventory_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("relative_path", F.coalesce("skip", F.lit("taken")).alias("skip"))


def inventory_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.skip_counts(_inventory(spark, sf_dir))


def inventory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.inventory_coverage(tree.skip_counts(_inventory(spark, sf_dir)))


def inventory_size_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order until their sizes exceed a budget."""
    run = tree.running_before(files(spark, sf_dir), F.col("size"), 256)
    cut = run.agg(F.min(F.when(F.col("before") + F.col("size") > 500_000, F.col("walk_pos"))).alias("cut"))
    return run.crossJoin(F.broadcast(cut)).where("cut IS NULL OR walk_pos < cut").select("relative_path", "size")  # one row


def package_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dependencies(shaped_files(spark, sf_dir, TREE))


def profile_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tree.profile(shaped_files(spark, sf_dir, TREE))
    return got.select(F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"), "package_manager", "file_count")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the documents' languages and sources, most of them declared many times."""
    return spark.sql(_DECLARED.format("{documents}"), documents=table(spark, sf_dir, "documents"))


def asset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.graph(assets.facts(shaped_files(spark, sf_dir, APP), _declared(spark, sf_dir)), "shop")[0]


def asset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.graph(assets.facts(shaped_files(spark, sf_dir, APP), _declared(spark, sf_dir)), "shop")[1]


def last_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type: routes declared twice are kept the same way."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return assets.last_of(e.withColumn("place", F.col("event_id")), ["user_id", "event_type"], "place").drop("place")


def inline_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.inline_suppressions(shaped_files(spark, sf_dir, TREE))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document and the longest one."""
    each = files(spark, sf_dir).select("relative_path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return each.groupBy("relative_path").agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


def line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("content", " the ")
    return files(spark, sf_dir).where(at > 0).select("relative_path", T.line_number(F.col("content"), at - 1).cast("long").alias("line"))


def signal_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("snippet", T.snippet(F.col("content")))
    fp = T.fingerprint(F.lit("native"), F.lit("doc.head"), F.col("relative_path"), F.col("snippet"))
    return f.select("relative_path", fp.alias("fingerprint"), T.signal_id(fp, F.lit(1)).alias("id"))


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.stable_id("page", F.col("url"), F.lit(""), F.col("page_id")).alias("id"))


def redact_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _TEXT, SNIPPETS).select("doc_id", T.redact_snippet(F.col("s")).alias("redacted"), T.semantic(F.col("s")).alias("semantic"))


def safe_relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMED, PATHS).select("doc_id", T.safe_relative_path(F.col("s")).alias("safe"))


def sarif_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMED, PATHS).select("doc_id", T.sarif_uri(F.col("s")).alias("uri"))


def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _TEXT, SHOWN).select("doc_id", T.markdown_text(F.col("s"), 40).alias("markdown"), T.html_text(F.col("s")).alias("html"), T.table_cell(F.col("s")).alias("cell"))


def github_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _TEXT, SHOWN).select("doc_id", T.github_property(F.col("s")).alias("property"), T.github_data(F.col("s")).alias("data"))


def route_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strings(spark, sf_dir, _NAMED, ROUTES).select("doc_id", T.normalized_route(F.col("s")).alias("route"))


def severity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(T.normalize_severity(F.regexp_extract("o_orderpriority", r"-\s*(\w+)", 1)).alias("severity")).agg(F.count("*").alias("n"))


def cleartext_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleartext endpoints of pages and inline ones by host, and whether they count."""
    urls = table(spark, sf_dir, "pages").select("url").unionByName(rows(spark, URLS, "url string")).where("startswith(url, 'http://')")
    return urls.groupBy(T.url_host(F.col("url")).alias("host"), T.ignored_endpoint(F.col("url")).alias("ignored")).agg(F.count("*").alias("n"))


def _code_signals(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    got = ru.signals(shaped_files(spark, sf_dir, CODE)).where(F.col("rule_id").rlike(pattern))
    return got.select("id", "fingerprint", "rule_id", "severity", "evidence_level", "path", "line", "snippet")


def android_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^android")


def mobile_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^(react-native|flutter)")


def mobile_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^(mobile|ios)")


def ci_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^ci")


def sensitive_logging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^privacy")


def route_without_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^auth")


def jwt_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^jwt")


def sast_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code_signals(spark, sf_dir, "^sast")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the documents and in inline files."""
    inline = rows(spark, [{"relative_path": "s.txt", "content": "\n".join(s["s"] for s in SNIPPETS) + "\nsk_li" + "ve_ABCDEFGHIJKL12 AKIA" + "ABCDEFGHIJKLMNOP", "walk_pos": 0, "size": 1}], R.FILES)
    got = ru.signals(files(spark, sf_dir).unionByName(inline)).where("rule_id LIKE 'secret.%'")
    return got.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("n_distinct"))




def _files_sql(name: str, data: list[dict]) -> str:
    return f"{values(f'{name}_shapes', _shapes(data), _SHAPE)}, {name} AS ({_FILE} documents d JOIN {name}_shapes t ON t.k = d.doc_id % {len(data)})"


def _strings_sql(form: str, data: list[dict]) -> str:
    return f"{values('shapes', _shapes(data), 'k int, s string')}, t AS (SELECT doc_id, {form} AS s FROM documents d JOIN shapes t ON t.k = d.doc_id % {len(data)})"


_TREE = _files_sql("tree", TREE)
_EXT = "lower(regexp_extract(relative_path, '[^/](\\.[^./]*)$', 1))"
_NAME = "list_last(string_split(relative_path, '/'))"
_IN = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
_IS_TEXT = f"({_NAME} IN {_IN(tree.MANIFESTS)} OR starts_with({_NAME}, '.env') OR starts_with({_NAME}, 'Dockerfile') OR {_EXT} IN {_IN(tree.EXTENSIONS)})"
_IS_EXCLUDED = f"len(list_intersect(list_slice(string_split(relative_path, '/'), 1, -2), [{', '.join(map(quoted, tree.EXCLUDED))}])) > 0"
_WALK = f"""{_TREE}, plain AS (SELECT *, CASE WHEN {_IS_EXCLUDED} THEN 'excluded_directory' WHEN NOT {_IS_TEXT} THEN 'not_text' WHEN size > 2097152 THEN 'oversized_file' END AS p FROM tree),
run AS (SELECT *, row_number() OVER o - 1 AS seen, coalesce(sum(size) FILTER (p IS NULL) OVER b, 0) AS bytes, count(*) FILTER (p IS NULL AND NOT contains(content, chr(0))) OVER b AS taken FROM plain
  WINDOW o AS (ORDER BY walk_pos), b AS (ORDER BY walk_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT min(walk_pos) FILTER (seen >= {5 * LIMITS["max_files"]}) AS last, min(walk_pos) FILTER (p IS NULL AND taken >= {LIMITS["max_files"]}) AS full, min(walk_pos) FILTER (p IS NULL AND bytes + size > {LIMITS["max_total_bytes"]}) AS cut FROM run),
walk AS (SELECT relative_path, coalesce(p, CASE WHEN walk_pos >= cuts.last THEN 'entry_limit' WHEN walk_pos >= cuts.full THEN 'file_limit' WHEN walk_pos >= cuts.cut THEN 'total_byte_limit' WHEN contains(content, chr(0)) THEN 'binary' END) AS skip FROM run, cuts)"""
_SNIPPETS, _PATHS, _SHOWN, _ROUTES, _CODE = _strings_sql(_TEXT, SNIPPETS), _strings_sql(_NAMED, PATHS), _strings_sql(_TEXT, SHOWN), _strings_sql(_NAMED, ROUTES), _files_sql("code", CODE)
_SAFE = """CASE WHEN NOT regexp_matches(s, '[\\x00-\\x1f\\x7f]') AND NOT regexp_matches(replace(s, '\\', '/'), '^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)')
  AND len(list_filter(ps, lambda p: p = '..' OR regexp_matches(p, '(?i)%(?:2e|2f|5c)'))) = 0 AND len(ps) > 0 AND len(array_to_string(ps, '/')) <= 1024 THEN array_to_string(ps, '/') END"""
_PARTS = "(SELECT doc_id, s, list_filter(string_split(replace(s, '\\', '/'), '/'), lambda p: p <> '' AND p <> '.') AS ps FROM t)"


def _single(x: str, most: int) -> str:
    flat = f"coalesce(nullif(trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), ''), 'not recorded')"
    return f"CASE WHEN len({flat}) <= {most} THEN {flat} ELSE substr({flat}, 1, {most - 1}) || '…' END"


_MARKDOWN = _single("s", 40)
for _p, _t in (("(?i)\\bhttps:", "hxxps:"), ("(?i)\\bhttp:", "hxxp:"), ("(?i)\\bmailto:", "mailto[:]"), ("(?i)\\bwww\\.", "www[.]"), ("@", "[at]")):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_p}', '{_t}', 'g')"
_MARKDOWN = f"regexp_replace(replace({_MARKDOWN}, '\\', '\\\\'), '([`*_\\[\\]{{}}()<>#!|])', '\\\\\\1', 'g')"
_DATA = f"replace({_single('s', 2000)}, '%', '%25')"
_VERB = "^(CONNECT|DELETE|GET|HEAD|OPTIONS|PATCH|POST|PUT|TRACE|ALL) +(/[^\\s\\x7f]{0,480})$"


def _rules_sql(pattern: str) -> str:
    """Signals of the rules of a family: matches from the pieces around them."""
    import re

    parts = []
    for i, r in enumerate(ru.RULES):
        if not re.search(pattern, r.rule_id):
            continue
        head = f"SELECT relative_path, {i} AS rule, {quoted(r.rule_id)} AS rule_id, {quoted(r.severity)} AS severity, {quoted(r.evidence_level)} AS evidence_level, "
        if r.whole_file:
            parts.append(head + f"1 AS line, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, {quoted(r.pattern)}))[1] AS m FROM code WHERE regexp_matches(relative_path, {quoted(r.paths)}) AND regexp_matches(content, {quoted(r.pattern)}) AND NOT regexp_matches(content, {quoted(r.unless)})")
            continue
        inner = f"SELECT relative_path, regexp_split_to_array(content, {quoted(r.pattern)}) AS gaps, regexp_extract_all(content, {quoted(r.pattern)}) AS ms FROM code WHERE regexp_matches(relative_path, {quoted(r.paths)})"
        before = "array_to_string(list_slice(gaps, 1, i), '') || array_to_string(list_slice(ms, 1, i - 1), '')"
        where = f" WHERE NOT regexp_matches(m, {quoted(r.unless)})" if r.unless else ""
        parts.append(head + f"1 + len(string_split({before}, chr(10))) - 1 AS line, m FROM (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM ({inner})){where}")
    fp = fingerprint_sql("'native'", "rule_id", "relative_path", "snippet")
    return f"WITH {_CODE}, found AS ({' UNION ALL '.join(parts)}), shown AS (SELECT *, {snippet_sql('m')} AS snippet FROM found), named AS (SELECT *, {fp} AS fingerprint FROM shown) SELECT {signal_id_sql('fingerprint', 'line')} AS id, fingerprint, rule_id, severity, evidence_level, relative_path AS path, line, snippet FROM named"


_ID = lambda k, x: f"'asset_' || substr(sha256({k} || chr(0) || {x}), 1, 16)"
_ASSETS = f"""{_files_sql("app", APP)}, declared AS ({_DECLARED.format("documents")}), shown(place, kind, label, relation, deps, pattern) AS (VALUES {", ".join(f"({i}, {quoted(k)}, {quoted(label)}, {quoted(r)}, [{', '.join(map(quoted, d))}]::VARCHAR[], {quoted(p) if p else 'NULL'})" for i, (k, label, r, d, p) in enumerate(assets.SHOWN_BY))}),
deps AS (SELECT unnest(json_keys(content::JSON -> '$.dependencies')) AS name FROM app WHERE {_NAME} = 'package.json'),
hits AS (SELECT * FROM shown s WHERE EXISTS (SELECT 1 FROM deps WHERE list_contains(s.deps, name)) OR EXISTS (SELECT 1 FROM app WHERE regexp_matches(relative_path, s.pattern))),
facts AS (SELECT kind, label, relation FROM hits WHERE kind NOT IN ('mobile_app', 'llm') UNION ALL SELECT 'auth', label || ' Auth', relation FROM hits WHERE kind = 'database'
  UNION ALL SELECT kind, string_agg(label, ' + ' ORDER BY place), relation FROM hits WHERE kind IN ('mobile_app', 'llm') GROUP BY kind, relation UNION ALL SELECT DISTINCT 'api_route', route, 'exposes' FROM declared)"""

QUERIES = {
    f.__name__: f
    for f in (
        inventory_candidates, inventory_walk, inventory_skip_counts, inventory_coverage, inventory_size_budget, package_dependencies, profile_languages, asset_nodes, asset_edges, last_declared, inline_suppressions, lines, line_number, signal_fingerprint, stable_id,
        redact_snippet, safe_relative_path, sarif_uri, markdown_escape, github_escape, route_normalize, severity_normalize, cleartext_urls, android_manifest, mobile_storage, mobile_network, ci_injection, sensitive_logging, route_without_guard, jwt_config, sast_general, secret_scan,
    )
}
_SECRET_PATTERNS = {r.rule_id: r.pattern for r in ru.RULES if r.rule_id.startswith("secret.") and r.paths == "." and not r.unless}
_SECRET_TEXT = "\n".join(s["s"] for s in SNIPPETS) + "\nsk_li" + "ve_ABCDEFGHIJKL12 AKIA" + "ABCDEFGHIJKLMNOP"
SQL = {
    "inventory_candidates": f"WITH {_TREE} SELECT relative_path, {_IS_TEXT} AS is_text, {_IS_EXCLUDED} AS is_excluded FROM tree",
    "inventory_walk": f"WITH {_WALK} SELECT relative_path, coalesce(skip, 'taken') AS skip FROM walk",
    "inventory_skip_counts": f"WITH {_WALK} SELECT skip AS reason, count(*) AS n FROM walk WHERE skip IS NOT NULL GROUP BY skip",
    "inventory_coverage": f"""WITH {_WALK}, r AS (SELECT string_agg(skip || ': ' || n, ', ' ORDER BY skip) AS reason FROM (SELECT skip, count(*) AS n FROM walk WHERE skip IN {_IN(tree.PARTIAL)} GROUP BY skip))
SELECT 'project-inventory' AS domain, 'native' AS engine, CASE WHEN reason IS NULL THEN 'complete' ELSE 'partial' END AS status, true AS required, reason FROM r""",
    "inventory_size_budget": f"WITH {FILES}, run AS (SELECT *, sum(size) OVER (ORDER BY walk_pos ROWS UNBOUNDED PRECEDING) AS upto FROM files) SELECT relative_path, size FROM run WHERE walk_pos < coalesce((SELECT min(walk_pos) FROM run WHERE upto > 500000), 9223372036854775807)",
    "package_dependencies": f"""WITH {_TREE} SELECT DISTINCT relative_path, unnest(json_keys(content -> '$.dependencies') || json_keys(content -> '$.devDependencies')) AS name
  FROM (SELECT relative_path, CASE WHEN json_valid(content) THEN content::JSON END AS content FROM tree WHERE {_NAME} = 'package.json') WHERE content IS NOT NULL""",
    "profile_languages": f"""WITH {_TREE}, known(ext, language) AS (VALUES {', '.join(f"('{e}', '{k}')" for k, es in tree.LANGUAGES.items() for e in es)}), used(name, framework) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in tree.FRAMEWORKS.items())}),
deps AS (SELECT unnest(json_keys(content -> '$.dependencies') || json_keys(content -> '$.devDependencies')) AS name FROM (SELECT CASE WHEN json_valid(content) THEN content::JSON END AS content FROM tree WHERE {_NAME} = 'package.json') WHERE content IS NOT NULL)
SELECT (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM tree JOIN known ON {_EXT} = ext) AS languages, (SELECT string_agg(DISTINCT framework, ',' ORDER BY framework) FROM deps JOIN used USING (name)) AS frameworks,
  (SELECT CASE WHEN bool_or({_NAME} = 'pnpm-lock.yaml') THEN 'pnpm' WHEN bool_or({_NAME} = 'yarn.lock') THEN 'yarn' WHEN bool_or({_NAME} = 'package-lock.json') THEN 'npm' END FROM tree) AS package_manager, (SELECT count(*) FROM tree) AS file_count""",
    "asset_nodes": f"WITH {_ASSETS} SELECT {_ID('kind', 'label')} AS id, kind, label FROM facts UNION ALL SELECT {_ID(quoted('project'), quoted('shop'))}, 'project', 'shop'",
    "asset_edges": f"WITH {_ASSETS} SELECT {_ID(quoted('project'), quoted('shop'))} AS from_id, {_ID('kind', 'label')} AS to_id, relation FROM facts UNION ALL SELECT {_ID(quoted('auth'), chr(108) + 'abel || ' + quoted(' Auth'))}, {_ID('kind', 'label')}, 'authorizes' FROM facts WHERE kind = 'database'",
    "last_declared": "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "inline_suppressions": f"WITH {_TREE} SELECT CAST(sum(len(regexp_extract_all(content, '(?i)trivy:ignore(?::|\\b)'))) AS BIGINT) AS n FROM tree",
    "lines": f"WITH {FILES} SELECT relative_path, len(string_split(content, chr(10))) AS n, list_max(list_transform(string_split(content, chr(10)), lambda x: len(x))) AS longest FROM files",
    "line_number": f"WITH {FILES} SELECT relative_path, len(string_split(substr(content, 1, instr(content, ' the ') - 1), chr(10))) AS line FROM files WHERE instr(content, ' the ') > 0",
    "signal_fingerprint": f"WITH {FILES}, s AS (SELECT relative_path, {fingerprint_sql(quoted('native'), quoted('doc.head'), 'relative_path', snippet_sql('content'))} AS fingerprint FROM files) SELECT *, {signal_id_sql('fingerprint', '1')} AS id FROM s",
    "stable_id": f"SELECT page_id, 'page_' || substr(sha256({joined_sql('url', 'page_id')}), 1, 16) AS id FROM pages",
    "redact_snippet": f"WITH {_SNIPPETS} SELECT doc_id, {redacted_sql('s')} AS redacted, {semantic_sql('s')} AS semantic FROM t",
    "safe_relative_path": f"WITH {_PATHS} SELECT doc_id, {_SAFE} AS safe FROM {_PARTS}",
    "sarif_uri": f"WITH {_PATHS}, safe AS (SELECT doc_id, s, {_SAFE} AS p FROM {_PARTS}) SELECT doc_id, CASE WHEN p IS NOT NULL THEN array_to_string(list_transform(string_split(p, '/'), lambda x: url_encode(x)), '/') END AS uri FROM safe",
    "markdown_escape": f"WITH {_SHOWN} SELECT doc_id, {_MARKDOWN} AS markdown, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, regexp_replace(replace(s, '|', '\\|'), '\\r?\\n', ' ', 'g') AS cell FROM t",
    "github_escape": f"WITH {_SHOWN} SELECT doc_id, replace(replace({_DATA}, ':', '%3A'), ',', '%2C') AS property, {_DATA} AS data FROM t",
    "route_normalize": f"WITH {_ROUTES} SELECT doc_id, CASE WHEN regexp_matches(trim(s), '{_VERB}') THEN regexp_extract(trim(s), '{_VERB}', 1) || ' ' || regexp_extract(trim(s), '{_VERB}', 2) END AS route FROM t",
    "severity_normalize": r"SELECT CASE WHEN w IN ('critical') THEN 'critical' WHEN w IN ('error', 'high') THEN 'high' WHEN w IN ('low', 'note') THEN 'low' WHEN w IN ('info', 'informational') THEN 'info' ELSE 'medium' END AS severity, count(*) AS n FROM (SELECT lower(regexp_extract(o_orderpriority, '-\s*(\w+)', 1)) AS w FROM orders) GROUP BY 1",
    "cleartext_urls": f"WITH {values('inline', URLS, 'url string')}, h AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^:/?#\\s]*)', 1)) AS host FROM (SELECT url FROM pages UNION ALL SELECT url FROM inline) WHERE starts_with(url, 'http://')) SELECT host, NOT (contains(host, '.') OR contains(host, ':')) OR starts_with(host, '127.') OR host = '10.0.2.2' OR regexp_matches(host, '(^|\\.)example\\.(com|org|net)$') OR host IN {_IN(T.PLAIN_HOSTS)} AS ignored, count(*) AS n FROM h GROUP BY ALL",
    **{k: _rules_sql(p) for k, p in (("android_manifest", "^android"), ("mobile_storage", "^(react-native|flutter)"), ("mobile_network", "^(mobile|ios)"), ("ci_injection", "^ci"), ("sensitive_logging", "^privacy"), ("route_without_guard", "^auth"), ("jwt_config", "^jwt"), ("sast_general", "^sast"))},
    "secret_scan": f"WITH {FILES}, every AS (SELECT relative_path, content FROM files UNION ALL SELECT 's.txt', {quoted(_SECRET_TEXT)}), m AS ("
    + " UNION ALL ".join(f"SELECT relative_path, {quoted(k)} AS rule_id, unnest(regexp_extract_all(content, {quoted(p)})) AS m FROM every" for k, p in _SECRET_PATTERNS.items())
    + f" UNION ALL SELECT relative_path, 'secret.concrete-interpolation-fallback', unnest(list_filter(regexp_extract_all(content, {quoted(next(r.pattern for r in ru.RULES if 'fallback' in r.rule_id))}), lambda x: NOT regexp_matches(x, '(?i)replace-me|changeme|example'))) FROM every"
    + f") SELECT rule_id, count(*) AS n, count(DISTINCT {fingerprint_sql(quoted('native'), 'rule_id', 'relative_path', snippet_sql('m'))}) AS n_distinct FROM m GROUP BY rule_id",
}
