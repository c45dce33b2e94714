"""Captured responses: header rules, cookies, and whether one account can read another's object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T

#: Rule, header, severity and title; HSTS counts for https only.
HEADER_RULES = (
    ("web.missing-csp", "content-security-policy", "medium", "Content Security Policy is missing"),
    ("web.missing-nosniff", "x-content-type-options", "medium", "MIME sniffing protection is missing"),
    ("web.missing-hsts", "strict-transport-security", "medium", "HTTP Strict Transport Security is missing"),
)
SESSION_COOKIE = r"(?i)^(?:[^=]*(?:session|sid|auth|token|jwt)[^=]*)="


def headers_missing(responses: DataFrame) -> DataFrame:
    found = []
    for rule, header, severity, _ in HEADER_RULES:
        own = f"map_values(map_filter(headers, (k, v) -> lower(k) = '{header}'))"
        value = F.expr(f"get({own}, 0)")
        lacks = ~F.coalesce(F.lower(value) == "nosniff", F.lit(False)) if header == "x-content-type-options" else value.isNull()
        if rule == "web.missing-hsts":
            lacks = lacks & F.col("url").startswith("https://")
        found.append(F.when(lacks, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))))
    each = F.filter(F.array(*found), lambda x: x.isNotNull())
    return responses.select("url", F.explode(each).alias("r")).select("url", "r.*")


def weak_cookies(responses: DataFrame) -> DataFrame:
    """Session cookies without Secure, HttpOnly or SameSite, their values hidden."""
    c = F.col("cookie")
    each = responses.select("url", F.explode("set_cookie").alias("cookie")).where(c.rlike(SESSION_COOKIE))
    flags = F.concat_ws(",", F.when(~c.rlike(r"(?i);\s*secure(?:;|\s|$)"), "Secure"), F.when(~c.rlike(r"(?i);\s*httponly(?:;|\s|$)"), "HttpOnly"), F.when(~c.rlike(r"(?i);\s*samesite="), "SameSite"))
    return each.select("url", T.hidden_cookie(c).alias("cookie"), flags.alias("lacks")).where("lacks <> ''")


def typed_value(body: Column, path: Column) -> Column:
    """kind (of JSON: STRING, BIGINT and so on) and text of the value at a path a.b.c; null where there is none."""
    above = F.when(path.contains("."), F.call_function("get_json_object", body, F.concat(F.lit("$."), F.regexp_replace(path, r"\.[^.]*$", "")))).otherwise(body)
    parent = F.from_json(above, "map<string,variant>")
    value = F.try_element_at(parent, F.substring_index(path, ".", -1))
    return F.struct(F.schema_of_variant(value).alias("kind"), F.call_function("get_json_object", body, F.concat(F.lit("$."), path)).alias("text"))


def object_access(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """A verdict for each case: the owner must see the marker at marker_path; the other account must not.

    cases: case_id, owner, other, marker_path (a.b.c), marker, and match: value (the default) wants a JSON string that
    equals the marker, ownerIdentity a string or number whose text does. One response for each case and account.
    """
    if "match" not in cases.columns:
        cases = cases.withColumn("match", F.lit("value"))
    seen = responses.join(cases, "case_id").withColumn("v", typed_value(F.col("body"), F.col("marker_path")))
    of_kind = (F.col("v.kind") == "STRING") | ((F.col("match") == "ownerIdentity") & F.col("v.kind").rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"))
    seen = seen.withColumn("has_marker", F.coalesce(of_kind & (F.col("v.text") == F.col("marker")), F.lit(False)))
    ok = F.col("status").between(200, 299)
    by = seen.groupBy("case_id").agg(
        F.bool_or((F.col("account") == F.col("owner")) & ok & F.col("has_marker")).alias("owner_sees"),
        F.bool_or((F.col("account") == F.col("other")) & ok & F.col("has_marker")).alias("other_sees"),
        F.bool_or((F.col("account") == F.col("other")) & F.col("status").isin(401, 403, 404)).alias("other_denied"),
    )
    got = cases.select("case_id").join(by, "case_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return got.select("case_id", F.when(no("owner_sees"), "inconclusive").when(F.col("other_sees"), "vulnerable").when(F.col("other_denied"), "protected").otherwise("inconclusive").alias("verdict"))


def access_coverage(verdicts: DataFrame) -> DataFrame:
    """One row: counts by verdict; any inconclusive case makes the check partial."""
    n = lambda v: F.count_if(F.col("verdict") == v).cast("long").alias(v)
    return verdicts.agg(n("vulnerable"), n("protected"), n("inconclusive"), F.when(F.count_if(F.col("verdict") == "inconclusive") > 0, "partial").otherwise("complete").alias("status"))


#: Words of a path that tell what a route does to its object.
MUTATING = (
    "create", "update", "delete", "remove", "save", "upload", "generate", "approve", "reject", "cancel", "submit", "publish", "archive", "restore", "assign", "grant", "revoke", "reset",
    "change", "logout", "register", "import", "execute", "run", "start", "stop", "retry", "edit", "modify", "insert", "enable", "disable", "activate", "deactivate", "attach", "detach",
)
READING = ("detail", "get", "list", "info", "search", "query", "read", "view", "preview", "status", "history", "stats", "statistics", "download", "export", "find", "lookup", "check")


def route_kinds(routes: DataFrame) -> DataFrame:
    """routes (method, path, handler) as read_candidate, mutation_excluded or manual_review; read-only checks take the first only."""
    words = T.marker_words(F.col("path"))
    has = lambda xs: F.arrays_overlap(words, F.array(*map(F.lit, xs)))
    method = F.upper("method")
    kind = F.when(has(MUTATING) | ~method.isin("GET", "POST"), "mutation_excluded").when((method == "GET") | has(READING), "read_candidate").otherwise("manual_review")
    return routes.select("method", "path", "handler", kind.alias("kind"))


def drafted(candidates: DataFrame) -> DataFrame:
    """One case for each method and path, the first declared, and its place in the order of kinds, paths and methods; candidates: method, path, handler, kind, and ord where order is known."""
    order = F.col("ord") if "ord" in candidates.columns else F.coalesce("handler", F.lit(""))
    first = candidates.groupBy("method", "path").agg(F.min_by(F.struct("handler", "kind"), order).alias("c"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("-", "method", "path")), "[^a-z0-9]+", "-"), "^-|-$", "")
    place = F.row_number().over(Window.orderBy("c.kind", "path", "method"))  # routes of one report
    return first.select(place.alias("place"), slug.alias("case_id"), "method", "path", "c.handler", "c.kind")


def draft_candidates(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """method, path, handler, kind and ord of the routes that signals about object access in open findings name."""
    still = findings.where("status = 'open'").select(F.explode("signal_ids").alias("id")).distinct()
    about = signals.where(F.arrays_overlap("tags", F.array(F.lit("bola"), F.lit("idor")))).join(still, "id", "left_semi")
    route = T.normalized_route(F.col("metadata")["route"])
    named = about.select(F.substring_index(route, " ", 1).alias("method"), F.substring_index(route, " ", -1).alias("path"), F.col("metadata")["handler"].alias("handler"), "ord").where("path IS NOT NULL")
    return route_kinds(named).join(named.select("method", "path", "ord"), ["method", "path"]).distinct()
