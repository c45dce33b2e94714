"""Queries of what code does, over rows that the orders, line items, customers and events give.

An order is a table of routes, a callable or a route; its line items are elements, statements, calls and arguments. The
relations are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attestry.durable import kept
from attestry.operators import semantics
from attestry.plans.common import table

_LINES = "SELECT l_orderkey AS k, l_linenumber AS l, min(l_partkey) AS p, min(l_suppkey) AS s, min(cast(l_quantity AS int)) AS q, min(l_returnflag) AS f, min(l_linestatus) AS o, min(cast(round(l_discount * 100) AS int)) AS d, min(cast(round(l_tax * 100) AS int)) AS x FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_NODES = """('p0', 0, NULL, 0, 'and', NULL), ('p0', 1, 0, 0, 'eq', NULL), ('p0', 2, 1, 0, 'field', 'mode'), ('p0', 3, 1, 1, 'value', 's:A'), ('p0', 4, 0, 1, 'not', NULL), ('p0', 5, 4, 0, 'field', 'flag'),
 ('p1', 0, NULL, 0, 'or', NULL), ('p1', 1, 0, 0, 'field', 'flag'), ('p1', 2, 0, 1, 'ne', NULL), ('p1', 3, 2, 0, 'field', 'size'), ('p1', 4, 2, 1, 'value', 'n:7'),
 ('p2', 0, NULL, 0, 'not', NULL), ('p2', 1, 0, 0, 'or', NULL), ('p2', 2, 1, 0, 'eq', NULL), ('p2', 3, 2, 0, 'value', 's:R'), ('p2', 4, 2, 1, 'field', 'mode'), ('p2', 5, 1, 1, 'and', NULL), ('p2', 6, 5, 0, 'field', 'flag'), ('p2', 7, 5, 1, 'field', 'late'),
 ('p3', 0, NULL, 0, 'or', NULL), ('p3', 1, 0, 0, 'eq', NULL), ('p3', 2, 1, 0, 'field', 'mode'), ('p3', 3, 1, 1, 'value', 'z:'), ('p3', 4, 0, 1, 'field', 'flag')"""
_ELEMENT = "k || ':' || l"
RELATIONS = {
    "predicates": f"SELECT predicate, cast(node AS int) AS node, cast(parent AS int) AS parent, cast(place AS int) AS place, op, cast(text AS string) AS text FROM (VALUES {_NODES}) AS t(predicate, node, parent, place, op, text)",
    "facts": f"""SELECT *, {_ELEMENT} AS element, CASE WHEN f = 'N' AND p % 2 = 0 THEN 'z:' ELSE 's:' || f END AS mode, CASE WHEN d <= 8 THEN CASE WHEN o = 'O' THEN 'b:true' ELSE 'b:false' END END AS flag,
  'n:' || (s % 10) AS size, CASE WHEN p % 9 = 0 THEN 's:x' WHEN x > 4 THEN 'b:true' ELSE 'b:false' END AS late FROM {{lines}}""",
    "values": "SELECT element, 'mode' AS field, mode AS value FROM {facts} UNION ALL SELECT element, 'flag', flag FROM {facts} UNION ALL SELECT element, 'size', size FROM {facts} UNION ALL SELECT element, 'late', late FROM {facts}",
    "filters": "SELECT 'o' || k AS \"table\", cast(1 AS int) AS ord, 'p' || (k % 4) AS predicate FROM {keys} WHERE k % 5 > 0 UNION ALL SELECT 'o' || k, 2, 'p1' FROM {keys} WHERE k % 3 = 0 AND k % 5 > 0 UNION ALL SELECT 'o' || k, 3, 'p1' FROM {keys} WHERE k % 50 = 0",
    "tables": "SELECT 'o' || k AS \"table\", element FROM {facts}",
    "registered": "SELECT 'site' || k AS site, 'o' || k AS \"table\", cast(k AS bigint) AS ord FROM {keys} WHERE k % 9 = 0",
    "shown": "SELECT 'o' || k AS \"table\", element, l AS place, CASE f WHEN 'A' THEN 'GET' WHEN 'R' THEN 'POST' ELSE 'ALL' END AS method, CASE WHEN p % 17 > 0 THEN '/x' || p END AS path FROM {facts}",
    "statements": """SELECT k AS callable, l AS node, cast(CASE WHEN l = 1 THEN NULL WHEN l <= 3 THEN 1 WHEN l <= 5 THEN 2 ELSE 3 END AS int) AS parent, l AS place,
  CASE WHEN l = 1 THEN 'if' WHEN l <= 3 THEN CASE WHEN p % 4 < 3 THEN 'block' ELSE 'throw' END ELSE CASE s % 6 WHEN 0 THEN 'throw' WHEN 1 THEN 'return' WHEN 2 THEN 'expression' WHEN 3 THEN 'variable' WHEN 4 THEN 'if' ELSE 'empty' END END AS kind,
  CASE l WHEN 2 THEN 'then' WHEN 3 THEN 'else' END AS role, f = 'R' OR q > 15 AS refuses, x < 5 AS bare FROM {lines}""",
    "comparisons": "SELECT k AS callable, cast(1 AS int) AS node, k % 2 = 0 AS equal, k % 3 = 0 AS negated FROM {keys}",
    "callables": "SELECT k AS callable, k % 41 = 0 AS guards, k % 17 = 0 AS roles, k % 5 = 0 AS object FROM {keys}",
    "calls": "SELECT a.k AS callable, a.k || ':' || n.l AS call, n.l AS place, b.k AS callee, n.f = 'A' AS denied, n.f = 'R' AS returned, n.o = 'O' AS filters FROM {m} a JOIN {lines} n ON n.k = a.k JOIN {m} b ON b.c = a.c WHERE n.l <= 4 AND (b.rn = a.rn + 1 + n.l % 3 OR (n.l = 3 AND b.rn = a.rn - 1))",
    "arguments": "SELECT call, name, parameter FROM (SELECT k || ':' || l AS call, 'n' || (p % 3) AS name, 'n' || (s % 3) AS parameter FROM {lines} UNION SELECT k || ':' || l, 'n' || (q % 3), 'n' || (d % 3) FROM {lines} WHERE q > 25) y",
    "bindings": "SELECT DISTINCT k AS callable, 'n' || (q % 3) AS root, 'n' || (x % 3) AS target FROM {lines} WHERE l = 2",
    "seeds": "SELECT DISTINCT k AS callable, 'n' || (p % 3) AS name FROM {lines} WHERE l = 1 AND f <> 'N'",
    "proofs": "SELECT DISTINCT k AS callable, 'n' || (s % 3) AS name, CASE p % 3 WHEN 0 THEN 'binding' WHEN 1 THEN 'filter' ELSE 'predicate' END AS kind FROM {lines} WHERE p % 5 = 0",
    "roots": "SELECT k AS root FROM {keys} WHERE k % 2 = 0",
    "known": "SELECT 'k' || k AS key, 'app' || k AS receiver FROM {keys} WHERE k % 4 = 0",
    "passes": """SELECT cast(n.p AS bigint) * 1000000000 + a.k * 10 + n.l AS ord, 'k' || a.k AS argument, 'k' || b.k AS parameter FROM {m} a JOIN {lines} n ON n.k = a.k JOIN {m} b ON b.c = a.c AND floor((b.rn - 1) / 6) = floor((a.rn - 1) / 6)
  WHERE (n.l <= 2 AND b.rn = a.rn + 1 + n.p % 2) OR (n.l = 3 AND b.rn = a.rn - 1)""",
    "applications": "SELECT user_id AS app, min(event_id) + CASE WHEN user_id % 3 = 0 THEN 400 ELSE -1 END AS bound FROM {events} GROUP BY user_id",
    "settings_read": """SELECT user_id AS app, event_id AS at, CASE WHEN event_id % 81 = 0 THEN 'close' WHEN event_id % 30 = 0 THEN 'prefix' WHEN event_id % 60 = 1 THEN 'versions' ELSE 'guards' END AS op, event_id % 47 > 0 OR value < 20 AS scoped,
  CASE WHEN event_id % 19 = 0 THEN 'unresolved' WHEN event_id % 23 = 0 THEN 'partial' ELSE 'resolved' END AS outcome, event_type || (event_id % 11) AS value FROM {events} WHERE event_id % 2 = 0 OR event_type = 'error' OR event_id % 60 = 1""",
    "routes": "SELECT o_orderkey AS route, o_custkey AS app, CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'ALL' ELSE 'POST' END AS method, 'o//' || (o_orderkey % 7) || '/' AS path FROM {orders}",
    "config": "SELECT c_custkey AS app, CASE WHEN c_custkey % 4 > 0 THEN '/api' ELSE '' END AS prefix, CASE WHEN c_nationkey % 3 = 0 THEN 'n' || c_nationkey ELSE '' END AS module_prefix, c_custkey % 3 > 0 AS versioned, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'v' END AS version_prefix FROM {customer}",
    "versions": "SELECT DISTINCT k AS route, CASE WHEN p % 5 > 0 THEN cast(s % 4 AS string) END AS version FROM {lines} WHERE f = 'A' AND l < 5",
    "defaults": "SELECT DISTINCT o_custkey AS app, CASE WHEN o_orderkey % 6 > 0 THEN 'd' || (o_orderkey % 3) END AS version FROM {orders} WHERE o_orderkey % 4 = 0",
    "exclusions": "SELECT o_custkey AS app, CASE WHEN c_nationkey % 3 = 0 THEN 'n' || c_nationkey || '/' ELSE '' END || 'o/' || (o_orderkey % 7) AS path, CASE o_orderkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ALL' END AS method FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderkey % 5 = 0",
}
_BLOCK = "SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}"
_SHARED = {"lines": _LINES, "keys": "SELECT o_orderkey AS k FROM {orders}", "m": _BLOCK}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        """A relation; what groups or ranks a table, which others read many times over, is written once."""
        if name in ("orders", "lineitem", "customer", "events"):
            return table(self.spark, self.sf_dir, name)
        if name in ("lines", "m"):
            if name not in self.kept:
                self.kept[name] = kept(self._read(name), name)
            return self.kept[name]
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        sql = (RELATIONS | _SHARED)[name].replace('"table"', "`table`")
        needs = [n for n in (*_SHARED, "facts", "orders", "lineitem", "customer", "events") if f"{{{n}}}" in sql]
        return self.spark.sql(sql, **{n: self[n] for n in needs})


def strict_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    elements = t["facts"].selectExpr("concat('p', k % 4) AS predicate", "element")
    return semantics.strict(t["predicates"], elements, elements.join(t["values"], "element").select("predicate", "element", "field", "value"))


def _tables(t: Tables) -> DataFrame:
    return semantics.static_tables(t["tables"], t["filters"], t["predicates"], t["values"])


def static_route_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(Tables(spark, sf_dir))


def route_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.expanded(t["registered"], t["shown"])[0]


def expansion_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.expanded(t["registered"], t["shown"])[1]


def denial_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.denials(Tables(spark, sf_dir)["statements"])


def enforced_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.enforced(t["comparisons"], t["statements"])


def identity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    lines = t["lines"].selectExpr("k AS callable", "concat('n', p % 7) AS root", "concat('n', s % 7) AS target")
    return semantics.aliases(t["seeds"].selectExpr("callable", "name AS start", "name"), lines)


def call_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.call_semantics(*(t[n] for n in ("roots", "callables", "calls", "arguments", "bindings", "seeds", "proofs")))


def receiver_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.receivers(t["known"], t["passes"])


def application_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.settings(t["applications"], t["settings_read"])


def versioned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return semantics.versioned_paths(*(t[n] for n in ("routes", "config", "versions", "defaults", "exclusions")))


QUERIES = {f.__name__: f for f in (strict_predicates, static_route_tables, route_expansion, expansion_sites, denial_paths, enforced_comparisons, identity_aliases, call_semantics, receiver_propagation, application_settings, versioned_paths)}


def _with(*names: str) -> str:
    known = RELATIONS | _SHARED
    needed, todo = [], list(names)
    while todo:
        n = todo.pop()
        needed = [n, *(x for x in needed if x != n)]
        todo += [x for x in known if f"{{{x}}}" in known[n]]
    out = []
    for n in needed:
        sql = known[n]
        for x in (*known, "orders", "lineitem", "customer", "events"):
            sql = sql.replace(f"{{{x}}}", f"{x}_" if x in known else x)
        out.append(f"{n}_ AS ({sql})")
    return ", ".join(out)


_BOOL = "(CASE {0} WHEN 'b:true' THEN true WHEN 'b:false' THEN false END)"
_FLAG, _LATE = _BOOL.format("flag"), _BOOL.format("late")
#: Each predicate written out; a null anywhere makes it null.
_TRUTH = f"""CASE {{0}} WHEN 'p0' THEN CASE WHEN mode IS NOT NULL AND {_FLAG} IS NOT NULL THEN mode = 's:A' AND NOT {_FLAG} END WHEN 'p1' THEN CASE WHEN size IS NOT NULL AND {_FLAG} IS NOT NULL THEN {_FLAG} OR size <> 'n:7' END
  WHEN 'p2' THEN CASE WHEN mode IS NOT NULL AND {_FLAG} IS NOT NULL AND {_LATE} IS NOT NULL THEN NOT (mode = 's:R' OR ({_FLAG} AND {_LATE})) END WHEN 'p3' THEN CASE WHEN mode IS NOT NULL AND {_FLAG} IS NOT NULL THEN mode = 'z:' OR {_FLAG} END END"""
_ONE, _TWO = _TRUTH.format("'p' || (k % 4)"), _TRUTH.format("'p1'")
_EXPANDED = f"""WITH {_with("registered", "shown")}, all_rows AS (SELECT r.site, r.ord, s.element, s.place, s.method, s.path FROM registered_ r JOIN shown_ s ON s."table" = r."table"),
first_rows AS (SELECT * FROM all_rows WHERE path IS NOT NULL ORDER BY ord, site, place, element LIMIT {semantics.EXPANSIONS})"""
_DENIES = f"""WITH RECURSIVE {_with("statements", "comparisons")}, st AS (SELECT *, coalesce(kind = 'return' AND bare AND lag(kind) OVER w = 'expression' AND lag(refuses) OVER w, false) AS sent FROM statements_ WINDOW w AS (PARTITION BY callable, parent ORDER BY place)),
reached AS (SELECT s.* FROM st s WHERE s.parent IS NULL OR (EXISTS (SELECT 1 FROM st r WHERE r.callable = s.callable AND r.node = 1) AND (s.parent = 1 OR EXISTS (SELECT 1 FROM st b WHERE b.callable = s.callable AND b.node = s.parent)))),
low AS (SELECT *, kind IN ('throw', 'return') AND refuses AS denies FROM reached WHERE node > 3),
blocks AS (SELECT b.*, CASE kind WHEN 'throw' THEN refuses ELSE EXISTS (SELECT 1 FROM low h WHERE h.callable = b.callable AND h.parent = b.node AND (h.denies OR h.sent)
  AND NOT EXISTS (SELECT 1 FROM low e WHERE e.callable = b.callable AND e.parent = b.node AND e.place < h.place AND e.kind NOT IN ('expression', 'variable', 'empty') AND NOT e.denies AND NOT e.sent)) END AS denies FROM reached b WHERE node IN (2, 3)),
tops AS (SELECT t.callable, t.node, count(DISTINCT b.node) = 2 AS denies FROM reached t LEFT JOIN blocks b ON b.callable = t.callable AND b.denies WHERE t.node = 1 GROUP BY ALL)"""


def _calls() -> str:
    """The call search level by level, as one common table after another."""
    key = "callable, carried, enforced, forwarded, filtered"
    out = [
        re.sub(r"\b(\w+_) AS \(", r"\1 AS MATERIALIZED (", _with("roots", "callables", "calls", "arguments", "bindings", "seeds", "proofs")),
        "begun AS (SELECT DISTINCT c.callee AS callable, a.parameter AS start, a.parameter AS name FROM calls_ c JOIN arguments_ a USING (call) UNION SELECT callable, '', name FROM seeds_)",
        "reach AS (SELECT * FROM begun UNION SELECT r.callable, r.start, b.target FROM reach r JOIN bindings_ b ON b.callable = r.callable AND b.root = r.name)",
        "s0 AS (SELECT root, root AS callable, '' AS carried, false AS enforced, 0 AS forwarded, false AS filtered, 1 AS rank FROM roots_)",
        "seen0 AS (SELECT * FROM s0)",
    ]
    for k in range(1, semantics.CALL_DEPTH + 1):
        out += [
            f"k{k} AS (SELECT DISTINCT s.root, s.rank, r.name FROM (SELECT root, rank, callable, unnest(string_split(carried, ',')) AS start FROM s{k - 1} UNION SELECT root, rank, callable, '' FROM s{k - 1}) s JOIN reach r ON r.callable = s.callable AND r.start = s.start)",
            f"c{k} AS (SELECT s.root, s.rank, s.enforced, s.forwarded, c.call, c.place, c.callee, c.denied, c.returned, c.filters FROM s{k - 1} s JOIN calls_ c ON c.callable = s.callable)",
            f"a{k} AS (SELECT c.root, c.rank, c.call, a.parameter, a.name FROM c{k} c JOIN arguments_ a ON a.call = c.call)",
            f"g{k} AS (SELECT a.root, a.rank, a.call, string_agg(DISTINCT a.parameter, ',' ORDER BY a.parameter) AS passed FROM a{k} a JOIN k{k} n ON n.root = a.root AND n.rank = a.rank AND n.name = a.name GROUP BY ALL)",
            f"""n{k} AS (SELECT root, {key}, min(via) AS via FROM (SELECT c.root, (c.rank, place, c.call) AS via, callee AS callable, coalesce(passed, '') AS carried, denied OR (enforced AND returned AND forwarded < {semantics.FORWARDS}) AS enforced,
  CASE WHEN NOT denied AND enforced AND returned AND forwarded < {semantics.FORWARDS} THEN forwarded + 1 ELSE 0 END AS forwarded, filters AS filtered FROM c{k} c LEFT JOIN g{k} g ON g.root = c.root AND g.rank = c.rank AND g.call = c.call) x GROUP BY ALL)""",
            f"h{k} AS (SELECT root, count(*) AS had FROM seen{k - 1} GROUP BY root)",
            f"m{k} AS (SELECT n.* FROM n{k} n ANTI JOIN seen{k - 1} e USING (root, {key}))",
            f"r{k} AS (SELECT m.root, {key}, had + row_number() OVER (PARTITION BY m.root ORDER BY via, {key}) AS rank FROM m{k} m JOIN h{k} h ON h.root = m.root)",
            f"s{k} AS (SELECT * FROM r{k} WHERE rank <= {semantics.CALLABLES})",
            f"seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT * FROM s{k})",
        ]
    last = semantics.CALL_DEPTH
    over = " UNION ".join(f"SELECT root FROM r{k} WHERE rank > {semantics.CALLABLES}" for k in range(1, last + 1))
    held = ", ".join(x if x.startswith("reach ") or " AS MATERIALIZED (" in x else x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out)
    return f"""WITH RECURSIVE {held}, proved AS (SELECT DISTINCT s.root FROM (SELECT *, unnest(list_append(string_split(carried, ','), '')) AS start FROM seen{last}) s JOIN reach r ON r.callable = s.callable AND r.start = s.start JOIN proofs_ p ON p.callable = s.callable AND p.name = r.name
  WHERE p.kind = 'binding' OR (p.kind = 'filter' AND s.filtered) OR (p.kind = 'predicate' AND s.enforced)),
facts AS (SELECT s.root, bool_or(c.guards) AS guards, bool_or(c.roles) AS roles, bool_or(c.object) AS object, count(*) AS n FROM seen{last} s JOIN callables_ c ON c.callable = s.callable GROUP BY s.root)
SELECT f.root, guards OR p.root IS NOT NULL AS owned, roles, object, n, o.root IS NULL AS whole FROM facts f LEFT JOIN proved p ON p.root = f.root LEFT JOIN ({over}) o ON o.root = f.root"""


_SLASHED = "'/' || regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '^/|/$', '', 'g')"
_SETTING = "(SELECT e.value FROM due e WHERE e.app = a.app AND e.op = '{0}' AND e.outcome <> 'unresolved' ORDER BY e.at DESC LIMIT 1)"
SQL = {
    "strict_predicates": f"WITH {_with('facts')} SELECT 'p' || (k % 4) AS predicate, element, {_ONE} AS result FROM facts_",
    "static_route_tables": f"""WITH {_with("facts")}, one AS (SELECT k, element, l, {_ONE} AS first, {_TWO} AS second FROM facts_), bad AS (SELECT DISTINCT k FROM one WHERE k % 5 > 0 AND (first IS NULL OR (k % 3 = 0 AND first AND second IS NULL)))
SELECT 'o' || k AS "table", element FROM one WHERE k NOT IN (SELECT k FROM bad) AND k % 50 > 0 AND (k % 5 = 0 OR (first AND (k % 3 > 0 OR second)))""",
    "route_expansion": f"{_EXPANDED} SELECT site, element, method, path FROM first_rows",
    "expansion_sites": f"{_EXPANDED} SELECT r.site, (SELECT count(*) FROM all_rows a WHERE a.site = r.site) > 0 AND (SELECT count(*) FROM all_rows a WHERE a.site = r.site) = (SELECT count(*) FROM first_rows f WHERE f.site = r.site) AS resolved FROM registered_ r",
    "denial_paths": f"{_DENIES} SELECT callable, node, denies FROM low UNION ALL SELECT callable, node, denies FROM blocks UNION ALL SELECT * FROM tops",
    "enforced_comparisons": f"{_DENIES} SELECT callable, node FROM comparisons_ c WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.callable = c.callable AND b.denies AND b.role = CASE WHEN (equal AND negated) OR NOT (equal OR negated) THEN 'then' ELSE 'else' END)",
    "identity_aliases": f"WITH RECURSIVE {_with('lines', 'seeds')}, r AS (SELECT callable, name AS start, name FROM seeds_ UNION SELECT callable, start, 'n' || (s % 7) FROM r JOIN lines_ ON k = callable AND 'n' || (p % 7) = name) SELECT callable, start, name FROM r",
    "call_semantics": _calls(),
    "receiver_propagation": f"""WITH RECURSIVE {_with("known", "passes")}, w AS (SELECT key, receiver, 1 AS turn, cast(-1 AS BIGINT) AS ord, [key] AS through, [(1, cast(-1 AS BIGINT))] AS labels FROM known_
  UNION ALL SELECT parameter, receiver, CASE WHEN p.ord > w.ord THEN turn ELSE turn + 1 END, p.ord, list_append(through, parameter), list_prepend((CASE WHEN p.ord > w.ord THEN turn ELSE turn + 1 END, p.ord), labels) FROM w JOIN passes_ p ON argument = key WHERE NOT list_contains(through, parameter))
SELECT key, arg_min(receiver, labels) AS receiver FROM w GROUP BY key""",
    "application_settings": f"""WITH {_with("applications", "settings_read")}, due AS (SELECT e.* FROM settings_read_ e JOIN applications_ a ON a.app = e.app WHERE e.scoped AND e.at > a.bound)
SELECT app, coalesce({_SETTING.format("prefix")}, '') AS prefix, {_SETTING.format("versions")} IS NOT NULL AS versioned, coalesce({_SETTING.format("versions")}, 'v') AS version_prefix, EXISTS (SELECT 1 FROM due e WHERE e.app = a.app AND e.op = 'close') AS closed,
  (SELECT count(*) FROM due e WHERE e.app = a.app AND e.op = 'guards') AS guards, NOT EXISTS (SELECT 1 FROM settings_read_ e WHERE e.app = a.app AND e.op <> 'close' AND (NOT e.scoped OR e.at <= a.bound OR (e.op <> 'guards' AND e.outcome <> 'resolved'))) AS resolved FROM applications_ a""",
    "versioned_paths": f"""WITH {_with("routes", "config", "versions", "defaults", "exclusions")}, variants AS (SELECT r.*, c.prefix, c.version_prefix, module_prefix || '/' || path AS local, v.version FROM routes_ r JOIN config_ c USING (app) JOIN versions_ v ON v.route = r.route WHERE versioned
  UNION ALL SELECT r.*, c.prefix, c.version_prefix, module_prefix || '/' || path, d.version FROM routes_ r JOIN config_ c USING (app) LEFT JOIN defaults_ d ON versioned AND d.app = r.app WHERE NOT versioned OR r.route NOT IN (SELECT route FROM versions_)),
ex AS (SELECT *, EXISTS (SELECT 1 FROM exclusions_ e WHERE e.app = v.app AND '/' || e.path = {_SLASHED.format("local")} AND (e.method IS NULL OR e.method = 'ALL')) AS every_one,
  EXISTS (SELECT 1 FROM exclusions_ e WHERE e.app = v.app AND '/' || e.path = {_SLASHED.format("local")} AND e.method IS NOT NULL) AS some_one, EXISTS (SELECT 1 FROM exclusions_ e WHERE e.app = v.app AND '/' || e.path = {_SLASHED.format("local")} AND e.method = v.method) AS this_one FROM variants v),
before AS (SELECT *, '' AS b FROM ex WHERE every_one OR this_one OR (method = 'ALL' AND some_one) UNION ALL SELECT *, prefix FROM ex WHERE NOT every_one AND ((method = 'ALL' AND some_one) OR NOT this_one))
SELECT DISTINCT route, method, {_SLASHED.format("b || '/' || CASE WHEN version IS NULL THEN '' ELSE version_prefix || version END || '/' || local")} AS path FROM before""",
}
