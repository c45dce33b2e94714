"""JavaScript and TypeScript sources as relations: routes of two server frameworks, mounts, guards, and request data in sinks.

No parser of the language is at hand, so the reader works on text in which comments and strings are blanked, and its
coverage is always partial: values that are computed, wrapped or imported under another name are not followed. What it
reads are rows; mounts are followed by a loop of joins that no router enters twice, and middleware guards the routes that stand after it in
its file under its prefix (a join on receiver and order).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.durable import kept
from attestry.functions import text as T
from attestry.operators.parsing import SENSITIVE_PATH, SESSION_PATH, closing, line_at, masked, rows_of, split_top

_SOURCE = r"\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$"
#: Paths that aren't part of a running application; names of guards that authenticate, control access or check roles, on a guard's own expression.
_NOT_RUNTIME = r"(?i)(?:^|/)(?:test|tests|fixtures|examples?|scripts|mocks?|__tests__|old-archive)(?:/|$)|(?:^|/)(?:debug|test|example)[^/]*\.(?:[cm]?[jt]sx?)$"
AUTH_GUARD = re.compile(
    r"(?i)(?:^|[._])(?:auth(?:Middleware|Guard)?|authenticate|authenticated|authentication(?:Middleware)?|requireAuth|requireUser|ensureAuthenticated|isAuthenticated|verifyToken|verifySession|jwtAuth(?:Guard)?|jwtGuard|"
    r"sessionAuth(?:Guard)?|bearerAuth|protect|passport\.authenticate)(?:$|[.(])"
)
ACCESS_GUARD = re.compile(
    r"(?i)(?:^|[._])(?:require|verify|check|ensure|authorize|assert|can)[A-Za-z0-9_]*(?:access|owner|ownership|permission|policy|role|admin|tenant)|"
    r"(?:owner|ownership|permission|policy|ability|role|admin|tenant)[A-Za-z0-9_]*(?:guard|check)(?:$|[.(])"
)
ROLE_GUARD = re.compile(
    r"(?i)(?:^|[._])(?:require|verify|check|ensure|authorize|assert|can)[A-Za-z0-9_]*(?:permission|policy|role|admin)|(?:permission|policy|ability|role|admin)[A-Za-z0-9_]*(?:guard|check|only|middleware)(?:$|[.(])"
)
NEST_GUARD = re.compile(r"(?i)(?:auth|jwt|session|identity|loggedIn|signedIn|user|role|permission|policy|ability|access|owner|admin)")
#: Our own: what in a handler's text stands for an owner check, a role check and access to an object, where no call is followed.
OWNER = re.compile(r"(?i)\b(?:owner(?:Id)?|userId|tenantId|createdBy)\b\s*(?:[:=!]==?|:)|\b(?:req\.user|user)\.(?:id|sub)\b|checkOwner\w*|canAccess\w*|ensureOwner\w*")
ROLE = re.compile(r"(?i)\b(?:\w*(?:requireRole|requireAdmin|isAdmin|hasRole|checkPermission|hasPermission|RolesGuard)\w*|Roles)\b")
OBJECT_ID = re.compile(r"(?i):(?:\w*id|uuid)\b|\b(?:params|body|query)\s*\.\s*(?:\w*Id|id|uuid)\b|@Param\(")
ACCESS = re.compile(r"(?i)\.(?:find\w*|get\w*|delete\w*|remove\w*|update\w*|save|destroy|create|query)\s*\(")
_VERBS = "get|post|put|patch|delete|all"


def guards(expressions: list[str], names: re.Pattern = AUTH_GUARD) -> bool:
    """Whether one of some middleware expressions, or of arrays of them, is a guard by its name."""
    return any(names.search(x.strip()) for e in expressions for x in (e.strip()[1:-1].split(",") if e.strip().startswith("[") else [e]))


def _string(text: str) -> str | None:
    m = re.fullmatch(r"\s*(['\"`])(.*)\1\s*", text, re.S)
    return m[2] if m and "${" not in m[2] else None


def _arguments(content: str, shape: str, at: int) -> tuple[list[str], int] | None:
    end = closing(shape, at)
    if end is None:
        return None
    inner = content[at + 1 : end]
    return [a.strip() for a in split_top(inner, ",", shape[at + 1 : end])] if inner.strip() else [], end


def _resolved(path: str, source: str) -> str:
    """The path that a relative import names, without its extension."""
    parts = path.split("/")[:-1]
    for step in source.split("/"):
        parts = parts[:-1] if step == ".." else parts if step == "." else [*parts, step]
    return re.sub(r"\.[cm]?[jt]sx?$", "", "/".join(parts))


def read_express(path: str, content: str) -> Iterator[dict]:
    shape, module = masked(content, "c"), re.sub(r"(?:/index)?\.[cm]?[jt]sx?$", "", path)
    names = {m[1]: m[2] for m in re.finditer(r"(?m)\b(?:const|let|var)\s+(\w+)\s*=\s*(?:express\s*\(\s*\)|(?:express\s*\.\s*)?Router\s*\()", shape) for m in [re.match(r".*?(\w+)\s*=\s*((?:express\s*\.\s*)?\w+)", m[0])]}
    imports = {m[1]: _resolved(path, m[2]) for m in re.finditer(r"import\s+(\w+)\s+from\s*['\"](\.[^'\"]*)['\"]", content)}
    imports |= {m[1]: _resolved(path, m[2]) for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['\"](\.[^'\"]*)['\"]\s*\)", content)}
    exported = re.search(r"(?:export\s+default|module\.exports\s*=)\s*(\w+)", shape)
    if exported and exported[1] in names:
        yield {"kind": "export", "a": module, "b": f"{path}:{exported[1]}"}
    yield from ({"kind": "receiver", "a": f"{path}:{n}", "flag": "Router" not in k} for n, k in names.items())
    for m in re.finditer(rf"\b(\w+)\s*\.\s*(use|route|{_VERBS})\s*\(", shape):
        receiver, verb = m[1], m[2]
        got = _arguments(content, shape, m.end() - 1) if receiver in names else None
        if not got:
            continue
        arguments, end = got
        place, rest = (_string(arguments[0]), arguments[1:]) if arguments and _string(arguments[0]) is not None else (None, arguments)
        base = {"a": f"{path}:{receiver}", "n": m.start(), "m": line_at(content, m.start())}
        chain = [(verb, rest)]
        if verb == "route" and place is not None:  # a path's handlers chained to it
            chain = []
            while c := re.compile(rf"\s*\.\s*({_VERBS})\s*\(").match(shape, end + 1):
                more = _arguments(content, shape, c.end() - 1)
                if not more:
                    break
                chain.append((c[1], more[0]))
                end = more[1]
        for method, handlers in chain:
            if method == "use":
                for i, h in enumerate(handlers):
                    if h in names or h in imports:
                        shielded = guards(handlers[:i])
                        yield {"kind": "mount", **base, "flag": shielded, "b": f"{path}:{h}" if h in names else "", "c": imports.get(h, ""), "d": place or ""}
                    elif guards([h]):
                        yield {"kind": "middleware", **base, "d": place or ""}
            elif place is not None and handlers:
                body, before = handlers[-1], " ".join(handlers[:-1])
                handler = handlers[-1] if re.fullmatch(r"[\w.]+", handlers[-1]) else None
                if handler and (f := re.search(rf"(?:function\s+{re.escape(handler)}|(?:const|let)\s+{re.escape(handler)}\s*=)[^{{]*\{{", shape)):
                    stop = closing(shape, f.end() - 1)
                    body = content[f.start() : stop] if stop else body
                yield {"kind": "route", **base, "b": method.upper(), "d": place, "e": handler or "", "flag": bool(guards(handlers[:-1]) or re.search(r"(?i)\b(?:requireAuth|verifyToken)\s*\(", body)), "items": [k for k, p, named in (("owner", OWNER, ACCESS_GUARD), ("role", ROLE, ROLE_GUARD)) if p.search(before + body) or guards(handlers[:-1], named)] + (["object"] if OBJECT_ID.search(f"{place} {body}") and ACCESS.search(body) else [])}


def read_nest(path: str, content: str) -> Iterator[dict]:
    shape = masked(content, "c")
    for m in re.finditer(r"@Controller\s*\(", shape):
        got = _arguments(content, shape, m.end() - 1)
        start = re.compile(r"class\s+(\w+)[^{]*\{").search(shape, m.end())
        stop = closing(shape, start.end() - 1) if start else None
        if not got or stop is None:
            continue
        prefix = (_string(got[0][0]) if got[0] else "") or ""
        above = content[max(content.rfind("}", 0, m.start()), 0) : start.start()]
        for r in re.finditer(r"@(Get|Post|Put|Patch|Delete|All)\s*\(", shape[: stop]):
            if r.start() < start.end():
                continue
            own = _arguments(content, shape, r.end() - 1)
            f = re.compile(r"(?:async\s+)?(\w+)\s*\(").search(shape, own[1] + 1) if own else None
            while f and shape[f.start() - 1] == "@":
                inner = _arguments(content, shape, f.end() - 1)
                f = re.compile(r"(?:async\s+)?(\w+)\s*\(").search(shape, inner[1] + 1) if inner else None
            if not f:
                continue
            listed = _arguments(content, shape, f.end() - 1)
            opens = shape.find("{", listed[1]) if listed else -1
            ends = closing(shape, opens) if opens >= 0 else None
            text = content[max(content.rfind("}", start.end(), r.start()), start.end()) : ends or stop]
            public = bool(re.search(r"@(?:Public|AllowAnonymous)\s*\(", text))
            place = (_string(own[0][0]) if own[0] else "") or ""
            yield {
                "kind": "nest", "a": start[1], "b": r[1].upper(), "c": prefix, "d": place, "e": f[1], "n": r.start(), "m": line_at(content, r.start()), "flag": not public and any(NEST_GUARD.search(g) for g in re.findall(r"@UseGuards\(([^)]*)", above + text)),
                "items": [k for k, p in (("owner", OWNER), ("role", ROLE)) if p.search(above + text)] + (["object"] if OBJECT_ID.search(f"{place} {text}") and ACCESS.search(text) else []),
            }


_REQUEST = re.compile(r"\b(?:req|request|ctx)\s*\.\s*(?:body|query|params|headers|cookies)\b|\bsearchParams\.get\(|\bformData\(\)|\bevent\.data\b|\blocation\.(?:hash|search)\b")
_MODEL = re.compile(r"(?i)\b(?:completion|openai|anthropic|llm|model)\w*\s*\.\s*(?:\w+\s*\.\s*)*(?:create|generate\w*|complete|invoke)\s*\(|\.choices\[0\]")
_CLEAN = re.compile(r"(?i)\b(?:sanitize\w*|DOMPurify\.\w+|escapeHtml|encodeURIComponent|parseInt|Number|z\.\w+|validate\w*|allowlist\w*)\s*\(")
#: Rule, sink and whether its whole statement must be built from data.
SINKS = (
    ("dataflow.sql-injection", re.compile(r"(?i)\.\s*(?:query|execute|\$queryRawUnsafe|\$executeRawUnsafe|raw)\s*\("), "request"),
    ("dataflow.command-injection", re.compile(r"\b(?:exec|execSync|spawn|spawnSync|eval)\s*\(|new\s+Function\s*\("), "request"),
    ("dataflow.ssrf", re.compile(r"\b(?:fetch|axios(?:\.\w+)?|got(?:\.\w+)?|http\.get|https\.get)\s*\("), "request"),
    ("ai.model-output-dangerous-sink", re.compile(r"\b(?:exec|execSync|spawn|eval)\s*\(|new\s+Function\s*\(|\.\s*(?:query|execute)\s*\("), "model"),
    ("dataflow.dom-xss", re.compile(r"\.\s*(?:innerHTML|outerHTML)\s*=(?!=)|document\.write\s*\(|insertAdjacentHTML\s*\("), "request"),
    ("dataflow.react-xss", re.compile(r"dangerouslySetInnerHTML\s*="), "request"),
)


def read_flows(path: str, content: str) -> Iterator[dict]:
    """Sinks that request data or model output reaches, statement by statement in the order of the source."""
    shape = masked(content, "c", strings=False)
    dirty: dict[str, set[str]] = {"request": set(), "model": set()}
    at = 0
    for statement in re.split(r"(?<=[;\n{}])", shape):
        start, at = at, at + len(statement)
        if not statement or statement.isspace():  # a comment
            continue
        has = {k: bool(p.search(statement)) or any(re.search(rf"(?<![\w$.]){re.escape(n)}(?![\w$])", statement) for n in dirty[k]) for k, p in (("request", _REQUEST), ("model", _MODEL))}
        if _CLEAN.search(statement):
            has = dict.fromkeys(has, False)
        for rule, sink, source in SINKS:
            m = sink.search(statement)
            if m and has[source] and (rule != "dataflow.sql-injection" or re.search(r"\$\{|['\"`]\s*\+|\+\s*['\"`]|\(\s*\w+\s*\)", statement[m.end() - 1 :])):
                tail = statement[m.start() :]
                named = any(re.search(rf"(?<![\w$.]){re.escape(n)}(?![\w$])", tail) for n in dirty[source]) or (_REQUEST if source == "request" else _MODEL).search(tail)
                if named:
                    yield {"kind": "flow", "a": rule, "n": start + m.start(), "m": line_at(content, start + m.start()), "d": statement.strip()[:300]}
        if m := re.match(r"\s*(?:export\s+)?(?:(?:const|let|var)\s+)?(?:\{([^}=]*)\}|(\w+))(?:\s*:[^=]+)?\s*(?:\+)?=(?![=>])", statement):
            targets = re.findall(r"\w+", m[1]) if m[1] else [m[2]]
            for k, yes in has.items():
                dirty[k] = dirty[k] | {*targets} if yes else dirty[k] - {*targets}


_DDL = "kind string, a string, b string, c string, d string, e string, n int, m int, flag boolean, items array<string>"
_KINDS = [*((k, pa.string()) for k in ("kind", "a", "b", "c", "d", "e")), ("n", pa.int32()), ("m", pa.int32()), ("flag", pa.bool_()), ("items", pa.list_(pa.string()))]


def code_rows(files: DataFrame, routes: bool = True, flows: bool = True) -> DataFrame:
    """What the readers of routes and of flows find; one who asks for one of them alone doesn't read for the other."""
    path = F.col("relative_path")
    due = files.where(path.rlike(_SOURCE))

    def read(where: str, content: str) -> Iterator[dict]:
        """Routes of files that run; flows of all."""
        readers = (read_express, read_nest) if routes and not re.search(_NOT_RUNTIME, where) else ()
        for reader in (*readers, read_flows) if flows else readers:
            yield from reader(where, content)

    return rows_of(due, read, _DDL, _KINDS)


def mounted(rows: DataFrame) -> DataFrame:
    """Each receiver's mounts from the applications down: receiver, path, and whether a guard stands before the mount."""
    exports = rows.where("kind = 'export'").select(F.col("a").alias("module"), F.col("b").alias("exported"))
    guards = rows.where("kind = 'middleware'").select(F.col("a").alias("parent"), F.col("n").alias("guard_at"), F.col("d").alias("guard_path"))
    m = rows.where("kind = 'mount'").select(F.col("a").alias("parent"), F.col("b").alias("child"), F.col("c").alias("module"), F.col("n").alias("at"), F.col("d").alias("prefix"), F.coalesce("flag", F.lit(False)).alias("shielded")).join(exports, "module", "left")
    m = m.select("parent", F.coalesce(F.nullif("child", F.lit("")), "exported").alias("child"), "at", "prefix", "shielded").where("child IS NOT NULL")
    before = m.join(guards, "parent").where("guard_at < at AND (guard_path = '' OR startswith(prefix, guard_path))").select("parent", "child", "at").distinct().withColumn("guard", F.lit(True))
    m = kept(m.join(before, ["parent", "child", "at"], "left").select("parent", "child", "prefix", (F.col("shielded") | F.coalesce("guard", F.lit(False))).alias("guard")), "mounts")
    front = rows.where("kind = 'receiver' AND flag").select(F.col("a").alias("receiver"), F.lit("").alias("path"), F.lit(False).alias("guarded"), F.array("a").alias("through"))
    found = front
    while True:
        down = front.join(m, front["receiver"] == m["parent"]).where(~F.array_contains("through", F.col("child")))
        front = kept(down.select(F.col("child").alias("receiver"), F.concat("path", "prefix").alias("path"), (F.col("guarded") | F.col("guard")).alias("guarded"), F.concat("through", F.array("child")).alias("through")).distinct(), "mounts")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.drop("through").distinct()


def routes(rows: DataFrame) -> DataFrame:
    """framework, method, path, handler, place, guarded and what checks a route shows."""
    own = rows.where("kind = 'route'").select("relative_path", F.col("a").alias("receiver"), F.col("b").alias("method"), F.col("d").alias("place"), F.col("e").alias("handler"), F.col("n").alias("at"), F.col("m").alias("line"), F.col("flag").alias("own_guard"), "items")
    guards = rows.where("kind = 'middleware'").select(F.col("a").alias("receiver"), F.col("n").alias("guard_at"), F.col("d").alias("guard_path"))
    inside = own.join(guards, "receiver").where("guard_at < at AND (guard_path = '' OR startswith(place, guard_path))").select("receiver", "at").distinct().withColumn("inside", F.lit(True))
    express = own.join(inside, ["receiver", "at"], "left").join(mounted(rows), "receiver")
    express = express.select(F.lit("express").alias("framework"), "relative_path", "method", T.joined_route(F.concat("path", "place")).alias("path"), "handler", "line", (F.col("own_guard") | F.coalesce("inside", F.lit(False)) | F.col("guarded")).alias("guarded"), "items")
    nest = rows.where("kind = 'nest'").select(F.lit("nestjs").alias("framework"), "relative_path", F.col("b").alias("method"), T.joined_route(F.concat_ws("/", "c", "d")).alias("path"), F.col("e").alias("handler"), F.col("m").alias("line"), F.col("flag").alias("guarded"), "items")
    return express.unionByName(nest).distinct()


#: Paths that are public by design, log-in paths, and privileged ones.
PUBLIC_PATH = r"(?i)(?:^|/)(?:login|log-in|register|sign-up|signup|health|healthz|ready|readiness|live|liveness|favicon\.ico|docs|openapi(?:\.json)?|swagger)/?$"
LOGIN_PATH = r"(?i)(?:^|/)(?:login|log-in|sign-in)/?$"
PRIVILEGED_PATH = r"(?i)(?:^|/)(?:admin|internal|manage|management|permissions?|roles?)(?:/|$)"


def route_findings(found: DataFrame) -> DataFrame:
    has = lambda k: F.array_contains("items", k)
    path = F.col("path")
    plain = ~path.rlike(PUBLIC_PATH) & (F.col("method").isin("POST", "PUT", "PATCH", "DELETE", "ALL") | path.rlike(SENSITIVE_PATH))
    sensitive: Column = F.when(path.rlike(PRIVILEGED_PATH), ~path.rlike(LOGIN_PATH)).otherwise(plain)
    rules = (
        ("auth.sensitive-route-without-guard", sensitive & ~F.col("guarded")),
        ("authorization.object-without-ownership-check", F.col("guarded") & has("object") & ~has("owner") & ~has("role") & ~path.rlike(SESSION_PATH)),
        ("authorization.privileged-operation-without-role-check", F.col("guarded") & F.col("path").rlike(PRIVILEGED_PATH) & ~has("role")),
    )
    each = F.explode(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules)), lambda x: x.isNotNull()))
    got = found.select(each.alias("rule"), "framework", F.concat_ws(" ", "method", "path").alias("route"), "handler", "relative_path", "line")
    return got.select(F.concat_ws(".", "framework", "rule").alias("rule_id"), "route", "handler", "relative_path", "line")


def flow_findings(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'flow'").select(F.col("a").alias("rule_id"), "relative_path", F.col("m").alias("line"), F.col("d").alias("snippet")).distinct()
