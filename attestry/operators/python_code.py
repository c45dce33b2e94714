"""Python sources as relations: functions, parameters, calls, data flow within a function, imports, routers and routes.

Each file is parsed where it is with the standard library's ast; a file that doesn't parse gives one row of kind
'unparsed', which makes the coverage partial. Everything across functions and files is joins: routes inherit what
their routers' mounts add (a loop of joins from the applications down, which no router enters twice), and tainted variables spread over
the edges of assignments and calls until nothing new is reached.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.durable import kept
from attestry.functions import text as T
from attestry.operators.parsing import SENSITIVE_PATH, SESSION_PATH, rows_of

#: Fixed value: paths that aren't part of a running application.
_NOT_RUNTIME = r"(?i)(?:^|/)(?:test|tests|fixtures|examples?|scripts|old-archive)(?:/|$)|(?:^|/)(?:debug|test|example)[^/]*\.py$"
_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
#: Our own: names that tell a guard, an owner check, a sanitiser and a dependency that no client controls.
GUARD = re.compile(r"(?i)(?:get_current_user|current_user|require_auth|require_user|verify_token|verify_api_key|get_user|authenticate|oauth2|httpbearer|api_key_header|login_required|\w*auth(?:enticated|orized)?\w*_?user|auth_(?:required|dependency|guard|user))")
OWNERSHIP = re.compile(r"(?i)(?:owner_id|user_id\s*==|\.user_id|tenant_id|created_by|is_admin|is_superuser|require_role|check_permission|has_permission|ensure_owner|check_owner)")
SANITISER = re.compile(r"(?i)(?:sanitize|validate_url|is_safe_url|allowlist|whitelist|basename|secure_filename|ensure_public)\w*\s*\(")
DEPENDENCY = re.compile(r"(?i)\b(?:Depends|Security|Session|AsyncSession|BackgroundTasks|Response)\b|^(?:self|cls|db|session)$")
ID_NAME = re.compile(r"(?i)^(?:\w+_id|id|uuid)$")
OBJECT_ACCESS = re.compile(r"(?i)(?:\b(?:db|session)\s*\.\s*(?:get|delete|exec|execute|query|add|merge|commit)\s*\(|\b\w*(?:crud|repository|service|manager|dao)\w*\s*\.\s*\w*(?:get|find|delete|remove|update|save|download)\w*\s*\(|\.\s*(?:where|filter|delete|update)\s*\()")


def _names(node: ast.AST) -> list[str]:
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)})


def _dotted(node: ast.AST) -> str:
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def module_of(path: str) -> str:
    name = path.removesuffix(".py").replace("/", ".")
    return name.removesuffix(".__init__")


def _row(kind: str, **fields) -> dict:
    return {"kind": kind, **fields}


def read_python(path: str, content: str) -> Iterator[dict]:
    """The rows of one file. Columns mean by kind: a, b, c names; n, m numbers; flag; items a list."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        yield _row("unparsed", a=path)
        return
    module, package = module_of(path), module_of(path) if path.endswith("__init__.py") else module_of(path).rpartition(".")[0]
    imports: dict[str, tuple[str, str]] = {}
    every = list(ast.walk(tree))
    for node in every:
        if isinstance(node, ast.ImportFrom):
            base = ".".join(package.split(".")[: len(package.split(".")) - node.level + 1]) if node.level else ""
            source = ".".join(x for x in (base, node.module) if x)
            imports |= {a.asname or a.name: (source, a.name) for a in node.names}
        elif isinstance(node, ast.Import):
            imports |= {a.asname or a.name: (a.name, "") for a in node.names}
    yield from (_row("import", a=local, b=source, c=name) for local, (source, name) in imports.items())

    def target(expression: ast.AST) -> tuple[str, str]:
        """Module and variable of a router that an expression names."""
        first, _, rest = _dotted(expression).partition(".")
        if first in imports:
            source, name = imports[first]
            return (f"{source}.{name}" if name else source, rest) if rest else (source, name)
        return module, first

    for node in tree.body:
        value = getattr(node, "value", None)
        names = [t.id for t in getattr(node, "targets", []) if isinstance(t, ast.Name)] or ([node.target.id] if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) else [])
        if isinstance(value, ast.Call) and _dotted(value.func).split(".")[-1] in ("FastAPI", "APIRouter"):
            guard = _keyword(value, "dependencies")
            yield from (_row("router", a=module, b=n, c=_text(_keyword(value, "prefix")) or "", flag=bool(guard and GUARD.search(ast.unparse(guard))), m=int(_dotted(value.func).endswith("FastAPI"))) for n in names)
        if names and re.search(r"(?i)whitelist|public_paths|exempt|skip_auth", names[0]) and isinstance(value, (ast.List, ast.Tuple, ast.Set)):
            for item in value.elts:
                if text := _text(item):
                    prefix = text.endswith("*") or "prefix" in names[0].lower()
                    yield _row("whitelist", a=text.rstrip("*"), b="prefix" if prefix else "exact", n=item.lineno)
    for node in every:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            if node.func.attr == "include_router" and node.args:
                child, guard = target(node.args[0]), _keyword(node, "dependencies")
                parent = target(node.func.value)
                yield _row("mount", a=f"{parent[0]}:{parent[1]}", b=f"{child[0]}:{child[1]}", c=_text(_keyword(node, "prefix")) or "", flag=bool(guard and GUARD.search(ast.unparse(guard))), n=node.lineno)
            if node.func.attr == "add_middleware" and node.args:
                name = _dotted(node.args[0])
                if re.search("(?i)auth", name):
                    yield _row("middleware", a=":".join(target(node.func.value)), n=node.lineno)
                origins, credentials = _keyword(node, "allow_origins"), _keyword(node, "allow_credentials")
                if name.endswith("CORSMiddleware") and isinstance(origins, (ast.List, ast.Tuple, ast.Set)) and any(_text(x) == "*" for x in origins.elts) and isinstance(credentials, ast.Constant) and credentials.value is True:
                    yield _row("cors", n=node.lineno)

    def functions(body: list, owner: str) -> Iterator[tuple[str, ast.AST]]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield f"{owner}{node.name}", node
                yield from functions(node.body, f"{owner}{node.name}.")
            elif isinstance(node, ast.ClassDef):
                yield _row("class", a=node.name, n=node.lineno, m=node.end_lineno), node
                yield from functions(node.body, f"{owner}{node.name}.")

    for name, node in functions(tree.body, ""):
        if isinstance(node, ast.ClassDef):
            yield name
            source = ast.get_source_segment(content, node) or ""
            base, key = (re.search(rf"self\.{x}\s*=\s*[^\n]*\b{x}\b[^\n]*(?:os\.getenv|settings\.|profile\.|config\.)", source) for x in ("base_url", "api_key"))
            if base and key and re.search(r"[\"']Authorization[\"']\s*:\s*f?[\"'][^\n]*self\.api_key", source) and re.search(r"self\.base_url[\s\S]*(?:urlopen|urlretrieve|requests\.|httpx\.|Request\s*\()", source):
                yield _row("client", a=node.name, n=node.lineno)
            continue
        yield from _function(path, module, content, name, node, target)


def _function(path: str, module: str, content: str, name: str, node: ast.FunctionDef, target) -> Iterator[dict]:
    fid = f"{path}#{name}@{node.lineno}"
    source = ast.get_source_segment(content, node) or ""
    arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    defaults = [None] * (len(node.args.posonlyargs + node.args.args) - len(node.args.defaults)) + list(node.args.defaults) + list(node.args.kw_defaults)
    declared = {a.arg: " ".join(ast.unparse(x) for x in (a.annotation, d) if x is not None) for a, d in zip(arguments, defaults, strict=True)}
    guarded = any(GUARD.search(t) and re.search("Depends|Security", t) for t in declared.values()) or bool(re.search(r"(?i)\b(?:require_auth|verify_token|authenticate\w*)\s*\(", source))
    owned = bool(OWNERSHIP.search(source))
    routed = False
    for d in node.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
            verbs = [d.func.attr] if d.func.attr in _VERBS else [x for x in (_text(e) for e in getattr(_keyword(d, "methods"), "elts", [])) if x] if d.func.attr == "api_route" else []
            place = _text(d.args[0]) if d.args else _text(_keyword(d, "path"))
            extra = _keyword(d, "dependencies")
            for verb in verbs if place is not None else []:
                routed = True
                ids = [a for a in declared if ID_NAME.match(a)] + re.findall(r"(?i)\{(\w+_id|id|uuid)\}", place) + re.findall(r"(?i)\b(?:request|payload|body|data|params|query)\s*(?:\.\s*|\[\s*[\"']|\.get\s*\(\s*[\"'])(\w+_id|id|uuid)\b", source)
                yield _row("route", a=":".join(target(d.func.value)), b=verb.upper(), c=place, d=fid, e=node.name, flag=guarded or bool(extra and GUARD.search(ast.unparse(extra))), n=node.lineno, m=int(owned), items=sorted({*ids}) if OBJECT_ACCESS.search(source) else [])
            if d.func.attr == "exception_handler" and d.args and _dotted(d.args[0]) == "Exception" and re.search(r"(?:content|detail|msg|message)[\"']?\s*[:=][\s\S]{0,160}(?:str\s*\(\s*(?:exc|e|error)\s*\)|\b(?:exc|error)\.args\b)", source):
                yield _row("raw_handler", a=fid, n=node.lineno)
    every = list(ast.walk(node))
    for t in (x for x in every if isinstance(x, ast.Try)):
        for h in t.handlers:
            if h.name and (h.type is None or _dotted(h.type) in ("Exception", "BaseException")):
                body = "\n".join(ast.unparse(s) for s in h.body)
                v = re.escape(h.name)
                how = next((k for k, p in (("repr", rf"repr\(\s*{v}\s*\)"), ("str", rf"str\(\s*{v}\s*\)"), ("args", rf"\b{v}\.args\b"), ("interpolation", rf"f['\"][^\n]*\{{\s*{v}")) if re.search(p, body)), None)
                sink = next((k for k, p in (("detail", r"HTTPException\([^\n]*detail"), ("return", r"\breturn\b"), ("content", r"(?:JSON|Plain\w*)Response\(")) if re.search(p, body)), None)
                if how and sink:
                    yield _row("raw_route", a=fid, b=how, c=sink, n=h.lineno)
    raw_sql = bool(re.search(r"(?i)\btext\s*\(\s*f?[\"']\s*(?:select|insert|update|delete|with)\b", source))
    yield _row("function", a=fid, b=node.name, c=module, n=node.lineno, m=node.end_lineno, flag=routed)
    at = 0
    for arg in arguments:
        free = not (DEPENDENCY.search(declared[arg.arg]) or DEPENDENCY.search(arg.arg))
        yield _row("parameter", a=fid, b=arg.arg, n=-1 if arg.arg in ("self", "cls") else at, flag=free and (routed or raw_sql))
        at += arg.arg not in ("self", "cls")
    calls = 0
    own = {id(x) for f in every if f is not node and isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in ast.walk(f)}
    for x in every:
        if id(x) in own:
            continue
        flows: list[tuple[ast.AST, list[str]]] = []
        if isinstance(x, ast.Assign):
            flows = [(x.value, [n for t in x.targets for n in _names(t)])]
        elif isinstance(x, (ast.AnnAssign, ast.AugAssign)) and x.value is not None:
            flows = [(x.value, _names(x.target))]
        elif isinstance(x, (ast.For, ast.AsyncFor)):
            flows = [(x.iter, _names(x.target))]
        for value, targets in flows:
            code = ast.unparse(value)
            if not SANITISER.search(code):
                dynamic = bool(re.search(r"(?i)f[\"']\s*(?:select|insert|update|delete|with)\b", code) and "{" in code)
                yield from (_row("flow", a=fid, b=s, c=t, flag=dynamic) for s in _names(value) for t in targets)
        if isinstance(x, ast.Call):
            callee, given = ast.unparse(x.func), list(x.args)
            wrapper = callee.rpartition(".")[2]
            skip = {"to_thread": 1, "run_in_executor": 2}.get(wrapper, 0)
            inner = _dotted(given[skip - 1]) if skip and len(given) >= skip else callee
            yield _row("call", a=fid, b=inner.rpartition(".")[2], c=callee, n=calls, m=x.lineno, d=ast.unparse(x)[:300])
            for i, g in enumerate(given[skip:] if skip else given):
                yield _row("argument", a=fid, n=calls, m=i, items=_names(g), d=ast.unparse(g)[:500])
            for k in x.keywords:
                if k.arg:
                    yield _row("argument", a=fid, n=calls, m=-1, b=k.arg, items=_names(k.value), d=ast.unparse(k.value)[:500])
            if isinstance(x.func, ast.Attribute):
                yield _row("receiver", a=fid, n=calls, items=_names(x.func.value))
            calls += 1


_DDL = "kind string, a string, b string, c string, d string, e string, n int, m int, flag boolean, items array<string>"
_KINDS = [*((k, pa.string()) for k in ("kind", "a", "b", "c", "d", "e")), ("n", pa.int32()), ("m", pa.int32()), ("flag", pa.bool_()), ("items", pa.list_(pa.string()))]


def code_rows(files: DataFrame) -> DataFrame:
    """All rows of the runtime Python files, in a table that the relations below filter; cache or write it before use."""
    path = F.col("relative_path")
    return rows_of(files.where(path.endswith(".py") & ~path.rlike(_NOT_RUNTIME)), read_python, _DDL, _KINDS)


def _of(rows: DataFrame, kind: str, *columns: tuple[str, str]) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("relative_path", *(F.col(c).alias(n) for c, n in columns))


def routers(rows: DataFrame) -> DataFrame:
    """Each router's mounts from an application down: router, prefix and whether something above guards it."""
    known = _of(rows, "router", ("a", "module"), ("b", "name"), ("c", "own_prefix"), ("flag", "own_guard"), ("m", "is_app")).withColumn("router", F.concat_ws(":", "module", "name")).select("router", "own_prefix", "own_guard", "is_app")
    mounts = _of(rows, "mount", ("a", "parent"), ("b", "child"), ("c", "prefix"), ("flag", "guard")).drop("relative_path")
    shielded = _of(rows, "middleware", ("a", "router")).select("router").distinct().withColumn("shield", F.lit(True))
    front = known.where("is_app = 1").join(shielded, "router", "left").select("router", F.col("own_prefix").alias("path"), F.coalesce("shield", F.lit(False)).alias("middleware"), F.col("own_guard").alias("guarded"), F.array("router").alias("through"))
    found = front
    while True:
        down = front.withColumnRenamed("router", "parent").join(mounts, "parent").join(known.withColumnRenamed("router", "child"), "child").where(~F.array_contains("through", F.col("child")))
        front = kept(down.select(F.col("child").alias("router"), F.concat("path", "prefix", "own_prefix").alias("path"), "middleware", (F.col("guarded") | F.col("guard") | F.col("own_guard")).alias("guarded"), F.concat("through", F.array("child")).alias("through")).distinct(), "mounts")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.drop("through").distinct()


def unresolved_mounts(rows: DataFrame) -> DataFrame:
    known = _of(rows, "router", ("a", "module"), ("b", "name")).select(F.concat_ws(":", "module", "name").alias("child"))
    return _of(rows, "mount", ("b", "child")).join(known, "child", "left_anti")


def routes(rows: DataFrame) -> DataFrame:
    """method, path, handler and place of each route with its guards and, where a whitelist has it, the entry that does."""
    own = _of(rows, "route", ("a", "router"), ("b", "method"), ("c", "place"), ("d", "fid"), ("e", "handler"), ("flag", "own_guard"), ("n", "line"), ("m", "owned"), ("items", "ids"))
    got = own.join(routers(rows).withColumnRenamed("path", "above"), "router")
    got = got.select("relative_path", "method", T.joined_route(F.concat("above", "place")).alias("path"), "fid", "handler", "line", (F.col("own_guard") | F.col("guarded")).alias("guarded"), "middleware", (F.col("owned") == 1).alias("owned"), "ids").distinct()
    listed = _of(rows, "whitelist", ("a", "entry"), ("b", "entry_kind"), ("n", "entry_line")).drop("relative_path").distinct()
    paths = got.select("path").distinct()
    heads = paths.select("path", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("entry"))
    whole = paths.withColumn("entry", F.col("path")).join(listed.where("entry_kind = 'exact'"), "entry")
    paths = whole.unionByName(heads.join(listed.where("entry_kind <> 'exact'"), "entry"))
    first = paths.groupBy("path").agg(F.min_by(F.struct("entry", "entry_kind"), F.struct("entry_line", "entry")).alias("whitelist"))
    return got.join(first, "path", "left")


#: Paths that are public by design.
PUBLIC_PATH = r"(?i)(?:^|/)(?:login|log-in|register|sign-up|signup|health|healthz|ready|readiness|live|liveness|favicon\.ico|docs|redoc|openapi\.json)/?$"


def _sensitive(path: Column, method: Column) -> Column:
    return ~path.rlike(PUBLIC_PATH) & (method.isin("POST", "PUT", "PATCH", "DELETE") | path.rlike(SENSITIVE_PATH))


def route_findings(found: DataFrame) -> DataFrame:
    """rule_id, route, handler and place of routes that lack a guard, or an owner check on the object they name."""
    shield = F.col("guarded") | (F.col("middleware") & F.col("whitelist").isNull())
    sensitive = _sensitive(F.col("path"), F.col("method"))
    session = F.col("path").rlike(SESSION_PATH)
    rules = (
        ("fastapi.auth.whitelisted-sensitive-route", sensitive & ~F.col("guarded") & F.col("middleware") & F.col("whitelist").isNotNull()),
        ("fastapi.auth.sensitive-route-without-guard", sensitive & ~F.col("guarded") & ~F.col("middleware")),
        ("fastapi.authorization.object-without-ownership-check", shield & ~F.col("owned") & (F.size("ids") > 0) & ~session),
    )
    each = F.explode(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules)), lambda x: x.isNotNull()))
    return found.select(each.alias("rule_id"), F.concat_ws(" ", "method", "path").alias("route"), "handler", "relative_path", "line")


def exception_findings(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Broad handlers of routes that return the exception's text, with all routes of the handler."""
    raw = _of(rows, "raw_route", ("a", "fid"), ("b", "serialization"), ("c", "sink"), ("n", "at"))
    by = found.groupBy("fid", "handler").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "method", "path"))).alias("routes"))
    return raw.join(by, "fid").select(F.lit("fastapi.config.route-raw-exception-response").alias("rule_id"), "relative_path", F.col("at").alias("line"), "handler", "routes", "serialization", "sink")


def config_findings(rows: DataFrame) -> DataFrame:
    cors = _of(rows, "cors", ("n", "line")).select(F.lit("fastapi.config.wildcard-cors-with-credentials").alias("rule_id"), "relative_path", "line")
    raw = _of(rows, "raw_handler", ("n", "line")).select(F.lit("fastapi.config.raw-exception-response").alias("rule_id"), "relative_path", "line")
    return cors.groupBy("rule_id", "relative_path").agg(F.min("line").alias("line")).unionByName(raw.groupBy("rule_id", "relative_path").agg(F.min("line").alias("line")))


def enclosing(rows: DataFrame) -> DataFrame:
    """Functions with the innermost class around them: an interval join within a file, then the latest start."""
    f = _of(rows, "function", ("a", "fid"), ("b", "name"), ("n", "start"), ("m", "stop"))
    c = _of(rows, "class", ("a", "class_name"), ("n", "from_line"), ("m", "to_line"))
    inside = f.join(c, (f["relative_path"] == c["relative_path"]) & (c["from_line"] < f["start"]) & (f["stop"] <= c["to_line"])).select("fid", "name", "class_name", "from_line")
    return inside.groupBy("fid", "name").agg(F.max_by("class_name", "from_line").alias("class_name"))


def tainted(rows: DataFrame) -> DataFrame:
    """fid and name of every variable that client data reaches.

    Edges are assignments within a function and arguments into parameters of the functions that calls name, in the same
    module or the one that an import names. The set grows by a join with the edges from what was new until nothing is.
    """
    parameters = _of(rows, "parameter", ("a", "fid"), ("b", "name"), ("n", "at"), ("flag", "source")).drop("relative_path")
    functions = _of(rows, "function", ("a", "fid"), ("b", "fname"), ("c", "module")).drop("relative_path")
    imports = _of(rows, "import", ("a", "local"), ("b", "module"), ("c", "original")).where("original <> ''")
    calls = _of(rows, "call", ("a", "fid"), ("b", "callee"), ("c", "dotted"), ("n", "call"))
    homes = _of(rows, "function", ("c", "module")).distinct()  # a module for each file
    named = calls.join(imports, (calls["relative_path"] == imports["relative_path"]) & (calls["callee"] == imports["local"]), "left").select("fid", "call", calls["relative_path"], "module", F.coalesce("original", "callee").alias("fname"), "dotted", "callee")
    whole = _of(rows, "import", ("a", "head"), ("b", "head_module"), ("c", "head_name"))
    head = F.substring_index("dotted", ".", 1)
    named = named.join(whole.withColumnRenamed("relative_path", "p"), (F.col("relative_path") == F.col("p")) & (head == F.col("head")) & F.col("dotted").contains("."), "left").drop("p")
    own = homes.withColumnRenamed("module", "own_module")
    through = F.when(F.col("head_module").isNotNull(), F.when(F.col("head_name") == "", F.col("head_module")).otherwise(F.concat_ws(".", "head_module", "head_name")))
    named = named.join(own, "relative_path", "left").select("fid", "call", "fname", F.coalesce("module", through, "own_module").alias("fmodule"))
    arguments = _of(rows, "argument", ("a", "fid"), ("n", "call"), ("m", "pos"), ("b", "keyword"), ("items", "names")).drop("relative_path").select("fid", "call", "pos", "keyword", F.explode("names").alias("src"))
    defined = functions.select(F.col("fid").alias("to_fid"), "fname", F.col("module").alias("fmodule"))
    into = named.join(defined, ["fname", "fmodule"]).join(arguments, ["fid", "call"])
    target = parameters.select(F.col("fid").alias("to_fid"), F.col("name").alias("dst"), "at")
    by_place = into.where("pos >= 0").join(target, (into["to_fid"] == target["to_fid"]) & (into["pos"] == target["at"])).select("fid", "src", target["to_fid"], "dst")
    by_name = into.where("pos < 0").join(target, (into["to_fid"] == target["to_fid"]) & (into["keyword"] == target["dst"])).select("fid", "src", target["to_fid"], "dst")
    local = _of(rows, "flow", ("a", "fid"), ("b", "src"), ("c", "dst")).select("fid", "src", F.col("fid").alias("to_fid"), "dst")
    edges = kept(local.unionByName(by_place).unionByName(by_name).distinct(), "edges")
    new = kept(parameters.where("source").select("fid", "name").distinct(), "tainted")
    found = new
    while True:
        step = new.join(edges, (new["fid"] == edges["fid"]) & (new["name"] == edges["src"])).select(F.col("to_fid").alias("fid"), F.col("dst").alias("name")).distinct()
        new = kept(step.join(found, ["fid", "name"], "left_anti"), "tainted")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


_NETWORK = r"(?i)(?:^|\.)(?:urlopen|urlretrieve)$|(?:^|\.)(?:requests|httpx|aiohttp)\.(?:get|post|put|patch|delete|request|stream)$|(?:client|session)\.(?:get|post|put|patch|delete|request|stream)$"
_FILE = r"(?i)(?:^|\.)open$|(?:^|\.)os\.(?:remove|unlink|rename|replace)$"
_FILE_OF = r"(?i)\.(?:read_text|read_bytes|write_text|write_bytes|unlink|rename)$"
_SQL = r"(?i)(?:^|\.)(?:text|execute|exec|query|exec_driver_sql)$"


def taint_findings(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """rule_id, function and place of calls that client data makes dangerous."""
    functions = _of(rows, "function", ("a", "fid"), ("b", "function")).drop("relative_path")
    calls = _of(rows, "call", ("a", "fid"), ("c", "callee"), ("n", "call"), ("m", "line"), ("b", "base"))
    first = _of(rows, "argument", ("a", "fid"), ("n", "call"), ("m", "pos"), ("b", "keyword"), ("items", "names"), ("d", "code")).drop("relative_path")
    receiver = _of(rows, "receiver", ("a", "fid"), ("n", "call"), ("items", "names")).drop("relative_path")
    hot = reached.withColumnRenamed("name", "var")

    def touched(names: DataFrame) -> DataFrame:
        return names.withColumn("var", F.explode("names")).join(hot, ["fid", "var"]).drop("names", "var").distinct()

    a = touched(first.where("pos = 0"))
    dynamic = _of(rows, "flow", ("a", "fid"), ("c", "var"), ("flag", "dynamic")).where("dynamic").select("fid", "var").join(hot, ["fid", "var"]).distinct()
    built = first.where("pos = 0").withColumn("var", F.explode("names")).join(dynamic, ["fid", "var"]).select("fid", "call").distinct()
    inline = a.where(F.col("code").rlike(r"(?i)f[\"']\s*(?:select|insert|update|delete|with)\b")).select("fid", "call")
    at = ["fid", "call"]
    clients = _of(rows, "client", ("a", "base")).select("base").distinct()
    url = touched(first.where("keyword = 'base_url'")).select("fid", "call")
    parts = (
        ("python.dataflow.ssrf", calls.where(F.col("callee").rlike(_NETWORK)).join(a.select(*at).distinct(), at)),
        ("python.dataflow.untrusted-file-path", calls.where(F.col("callee").rlike(_FILE)).join(a.select(*at).distinct(), at).unionByName(calls.where(F.col("callee").rlike(_FILE_OF)).join(touched(receiver).unionByName(a.select(*at)).distinct(), at))),
        ("python.dataflow.sql-injection", calls.where(F.col("callee").rlike(_SQL)).join(built.unionByName(inline).distinct(), at)),
        ("python.dataflow.client-url-with-server-secret", calls.join(clients, "base").join(url.distinct(), at)),
    )
    out = None
    for rule, found in parts:
        got = found.join(functions, "fid").select(F.lit(rule).alias("rule_id"), "relative_path", "line", "function", F.col("callee").alias("sink"))
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def published(files: DataFrame, found: DataFrame) -> DataFrame:
    """Services of production compose files that publish a port on all interfaces while a route lacks a guard."""
    compose = files.where(F.col("relative_path").rlike(r"(?i)(?:^|/)(?:docker-)?compose[^/]*prod[^/]*\.ya?ml$"))
    block = F.explode(F.regexp_extract_all(F.regexp_extract("content", r"(?ms)^services:[^\n]*\n(.*?)(?=^\S|\z)", 1), F.lit(r"(?m)^  [A-Za-z0-9_.-]+:[^\n]*\n(?:(?:    [^\n]*|[ \t]*)(?:\n|\z))*"), F.lit(0)))
    services = compose.select("relative_path", block.alias("block")).select("relative_path", F.regexp_extract("block", r"^  ([A-Za-z0-9_.-]+):", 1).alias("service"), F.regexp_extract_all(F.regexp_extract("block", r"(?m)^    ports:[^\n]*\n((?:      [^\n]*(?:\n|\z))*)", 1), F.lit(r"-\s*[\"']?([0-9.:]+)"), F.lit(1)).alias("ports"))
    wide = F.filter("ports", lambda p: p.contains(":") & ~p.startswith("127."))
    bare = found.where(~F.col("middleware") & ~F.col("guarded") & ~F.col("path").rlike(r"(?i)health|ready|live|docs|openapi")).agg(F.count("*").alias("n"))
    rows = services.withColumn("ports", wide).where((F.size("ports") > 0) & F.col("service").rlike(r"(?i)algorithm|chat|worker|internal|model|ai|api"))
    return rows.crossJoin(F.broadcast(bare)).where("n > 0").select(F.lit("docker.config.unguarded-service-published").alias("rule_id"), "relative_path", "service", "ports")  # bare: one row


def coverage(rows: DataFrame) -> DataFrame:
    n = rows.where("kind = 'unparsed'").agg(F.count("*").alias("n"))
    return n.select(F.lit("python-dataflow").alias("domain"), F.lit("python").alias("engine"), F.lit("partial").alias("status"), F.lit(True).alias("required"), F.concat(F.lit("flows are bounded; "), F.col("n").cast("string"), F.lit(" file(s) did not parse")).alias("reason"))
