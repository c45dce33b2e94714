"""Row security of SQL migrations and access rules of document stores.

A reader turns each file into rows (tables, enabled tables, policies, allows) with the kind of grant their conditions
give; which rows are findings is decided by joins and filters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.durable import kept
from attestry.operators.parsing import closing, line_at, masked, rows_of, split_top

_NAME = r'(?:"(?:[^"]|"")*"|[A-Za-z_][A-Za-z0-9_$]*)'
_RELATION = rf"({_NAME}(?:\s*\.\s*{_NAME})?)"
ROLES = ("public", "anon", "authenticated", "service_role", "postgres")
CLIENT_ROLES = ("public", "anon", "authenticated")
#: Conditions that only ask whether a caller is signed in.
SIGNED_IN = {
    "sql": {"auth.uidisnotnull", "auth.role='authenticated'", "'authenticated'=auth.role", "current_user='authenticated'", "'authenticated'=current_user"},
    "c": {"request.auth!=null", "request.auth.uid!=null"},
}
_OPERATORS = {"sql": (r"(?i)(?<![\w$])or\b", r"(?i)(?<![\w$])and\b"), "c": (r"\|\|", "&&")}
_METADATA = r"(?i)auth\s*\.\s*jwt\s*\(\s*\)\s*(?:(?:->>?|#>>?)\s*['\"](?:\{[^'\"]*)?|\[\s*['\"]|,\s*['\"])(?:raw_user_meta_data|user_metadata)\b"


def grant(condition: str, kind: str) -> str:
    """unconditional, authentication_only or constrained. Any branch of an OR may let a caller in, every part of an AND must."""
    text = condition.strip()
    while text.startswith("(") and closing(masked(text, kind), 0) == len(text) - 1:
        text = text[1:-1].strip()
    order = ("unconditional", "authentication_only", "constrained")
    for operator, pick in zip(_OPERATORS[kind], (min, max), strict=True):
        parts = split_top(text, operator, masked(text, kind))
        if len(parts) > 1:
            return order[pick(order.index(grant(p, kind)) for p in parts)]
    atom = re.sub(r"[\s()]", "", masked(text, kind, strings=False).lower())
    return "unconditional" if atom == "true" else "authentication_only" if atom in SIGNED_IN[kind] else "constrained"


def _plain_name(name: str) -> str:
    return re.sub(r"\s+", "", name.replace('"', "")).lower()


def _after(text: str, shape: str, pattern: str) -> str | None:
    m = re.search(pattern, shape)
    end = closing(shape, m.end() - 1) if m else None
    return text[m.end() : end] if m and end is not None else None


def read_sql(path: str, content: str) -> Iterator[dict]:
    shape, at = masked(content, "sql"), 0
    for statement in split_top(content, ";", shape.replace("(", " ").replace(")", " ")):
        own, start = shape[at : at + len(statement)], at
        at += len(statement) + 1
        line = lambda m: line_at(content, start + m.start())  # noqa: B023, E731
        if m := re.search(rf"(?i)\bcreate\s+(?:(?:unlogged|temporary|temp)\s+)?table(?:\s+if\s+not\s+exists)?\s+{_RELATION}", own):
            yield {"kind": "table", "name": _plain_name(m[1]), "line": line(m), "snippet": m[0]}
        if (m := re.search(rf"(?i)\balter\s+table(?:\s+only)?\s+{_RELATION}", own)) and re.search(r"(?i)\benable\s+row\s+level\s+security\b", own):
            yield {"kind": "enabled", "name": _plain_name(m[1]), "line": line(m), "snippet": m[0]}
        if m := re.search(rf"(?i)\bcreate\s+policy\s+{_NAME}\s+on(?:\s+only)?\s+{_RELATION}", own):
            text, form = statement[m.start() :], own[m.start() :]
            header = re.split(r"(?i)\b(?:using|with\s+check)\s*\(", form)[0]
            conditions = [c for c in (_after(text, form, r"(?i)\busing\s*\("), _after(text, form, r"(?i)\bwith\s+check\s*\(")) if c is not None]
            to = re.search(r"(?i)\bto\s+(.*)$", header.replace("\n", " "))
            named = [_plain_name(re.sub(r"(?i)^\s*group\s+", "", r)).rstrip(";") for r in to[1].split(",")] if to else ["public"]
            plain = [re.sub(r"(?i)\(\s*select\s+(auth\.(?:uid|role)\s*\(\s*\))\s*\)", r"\1", masked(c, "sql", strings=False)) for c in conditions]
            yield {
                "kind": "policy", "name": _plain_name(m[1]), "line": line(m), "snippet": text[:300], "roles": [r for r in named if r in ROLES] or ["custom"],
                "restrictive": bool(re.search(r"(?i)\bas\s+restrictive\b", header)), "grants": [grant(c, "sql") for c in plain] or ["unconditional"], "metadata": any(re.search(_METADATA, c) for c in conditions),
            }


_METHODS = r"((?:read|write|get|list|create|update|delete)(?:\s*,\s*(?:read|write|get|list|create|update|delete))*)"


def _expanded(condition: str, helpers: dict[str, tuple[list[str], str] | None]) -> tuple[str, bool]:
    """Calls of single-return helpers replaced by what they return, at most eight levels deep; whether a call is left."""
    for _ in range(8):
        m = next((m for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(", masked(condition, "c")) if m[1] in helpers), None)
        if not m:
            return condition, False
        end = closing(masked(condition, "c"), m.end() - 1)
        helper = helpers[m[1]]
        if end is None or helper is None or len(condition) > 65_536:
            return condition, True
        given = condition[m.end() : end]
        values = [a.strip() for a in split_top(given, ",", masked(given, "c"))] if given.strip() else []
        if len(values) != len(helper[0]):
            return condition, True
        body = helper[1]
        for name, value in zip(helper[0], values, strict=True):
            body = re.sub(rf"\b{name}\b", lambda _, v=value: f"({v})", body)
        condition = f"{condition[: m.start()]}({body}){condition[end + 1 :]}"
    return condition, True


def read_rules(path: str, content: str) -> Iterator[dict]:
    shape = masked(content, "c")
    service = "storage" if re.search(r"\bservice\s+firebase\s*\.\s*storage\b", shape) else "firestore" if re.search(r"\bservice\s+cloud\s*\.\s*firestore\b", shape) else "unknown"
    helpers: dict[str, tuple[list[str], str] | None] = {}
    for m in re.finditer(r"\bfunction\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*\{", shape):
        end = closing(shape, m.end() - 1)
        body = re.fullmatch(r"\s*return\b(.*?);\s*", content[m.end() : end], re.S) if end else None
        helpers[m[1]] = None if m[1] in helpers or not body else ([p.strip() for p in m[2].split(",") if p.strip()], body[1].strip())
    for m in re.finditer(rf"(?i)\ballow\s+{_METHODS}\s*(:\s*if\b([^;}}]*)|(?=[;}}]))", shape):
        condition = content[m.start(3) : m.end(3)] if m[3] is not None else "true"
        whole, left = _expanded(condition, helpers)
        methods = [x.strip() for x in m[1].lower().split(",")]
        upload = service == "storage" and bool({"write", "create", "update"} & {*methods})
        bounded = re.search(r"(?i)request\s*\.\s*resource\s*\.\s*size\s*<=?\s*[^=]|(?:\d|\bmax[a-z0-9_]*)[\w\s*+/_-]*>=?\s*request\s*\.\s*resource\s*\.\s*size", masked(whole, "c"))
        yield {"kind": "allow", "name": service, "line": line_at(content, m.start()), "snippet": content[m.start() : m.end()], "roles": methods, "restrictive": left, "grants": [grant(whole, "c")], "metadata": upload and not left and not bounded}


_DDL = "kind string, name string, line int, snippet string, roles array<string>, restrictive boolean, grants array<string>, metadata boolean"
_KINDS = [("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("snippet", pa.string()), ("roles", pa.list_(pa.string())), ("restrictive", pa.bool_()), ("grants", pa.list_(pa.string())), ("metadata", pa.bool_())]


def sql_rows(files: DataFrame) -> DataFrame:
    return rows_of(files.where("relative_path LIKE '%.sql'"), read_sql, _DDL, _KINDS)


def rule_rows(files: DataFrame) -> DataFrame:
    return rows_of(files.where("relative_path LIKE '%.rules'"), read_rules, _DDL, _KINDS)


def bare_tables(rows: DataFrame) -> DataFrame:
    """Tables of the application that no migration protects. A table matches by its full name, its own or public's."""
    made = rows.where("kind = 'table' AND NOT name RLIKE '^(auth|storage)[.]'").select("relative_path", "name", "line", "snippet")
    keys = F.array_distinct(F.array("name", F.substring_index("name", ".", -1), F.concat(F.lit("public."), "name")))
    on = rows.where("kind = 'enabled'").select(F.col("name").alias("key")).distinct()
    safe = made.select("relative_path", "name", F.explode(keys).alias("key")).join(on, "key", "left_semi").select("name").distinct()
    return made.join(safe, "name", "left_anti")


def policy_findings(rows: DataFrame) -> DataFrame:
    p = rows.where("kind = 'policy'").where(F.arrays_overlap("roles", F.array(*map(F.lit, CLIENT_ROLES))))
    firm = ~F.col("restrictive")
    rules = (
        ("supabase.permissive-rls-policy", firm & F.array_contains("grants", "unconditional")),
        ("supabase.authenticated-policy-without-row-filter", firm & F.array_contains("grants", "authentication_only")),
        ("supabase.user-metadata-authorization", F.col("metadata")),
    )
    return _found(p, rules)


def allow_findings(rows: DataFrame) -> DataFrame:
    rules = (
        ("firebase.unconditional-access", F.array_contains("grants", "unconditional")),
        ("firebase.authenticated-access-without-resource-check", F.array_contains("grants", "authentication_only")),
        ("firebase.storage-upload-without-size-limit", F.col("metadata")),
    )
    return _found(rows.where("kind = 'allow'"), rules)


def _found(rows: DataFrame, rules: tuple) -> DataFrame:
    each = F.explode(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules)), lambda x: x.isNotNull()))
    return rows.select(each.alias("rule_id"), "relative_path", "name", "line")


def findings(files: DataFrame) -> DataFrame:
    """rule_id, relative_path, name and line of all findings in migrations and access rules."""
    sql, rules = kept(sql_rows(files), "migrations"), rule_rows(files)
    bare = bare_tables(sql).select(F.lit("supabase.table-without-rls").alias("rule_id"), "relative_path", "name", "line")
    return bare.unionByName(policy_findings(sql)).unionByName(allow_findings(rules))
