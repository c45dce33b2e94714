"""Predicates, denial, aliases, calls, settings and versions against what a person finds, near misses among them."""

from attestry.operators import semantics
from tests.test_modules import frame, got

TREE = "predicate string, node int, parent int, place int, op string, text string"


def strict(spark, trees, values):
    """trees: {name: nested tuples (op, operands...), constants as typed texts, fields as @name}."""
    rows = []

    def add(name, expression, parent, place):
        node = len(rows)
        if isinstance(expression, str):
            rows.append((name, node, parent, place, "field" if expression[0] == "@" else "value", expression.lstrip("@")))
            return
        rows.append((name, node, parent, place, expression[0], None))
        for i, operand in enumerate(expression[1:]):
            add(name, operand, node, i)

    for name, expression in trees.items():
        add(name, expression, None, 0)
    elements = frame(spark, "predicate string, element string", *((t, "e") for t in trees))
    given = frame(spark, "predicate string, element string, field string, value string", *((t, "e", k, v) for t in trees for k, v in values.items()))
    return {r["predicate"]: r["result"] for r in semantics.strict(frame(spark, TREE, *rows), elements, given).collect()}


def test_strict_predicates(spark):
    yes, no, lost = "b:true", "b:false", "@lost"
    trees = {
        "and of unknown and false": ("and", no, lost), "or of true and unknown": ("or", yes, lost), "not of unknown": ("not", lost), "true and false": ("and", yes, no), "true or false": ("or", yes, no),
        "numbers and texts differ": ("eq", "n:1", "s:1"), "null is null": ("eq", "z:", "@nothing"), "unknown is nothing": ("eq", "z:", lost), "differs": ("ne", "@mode", "s:GET"),
        "a text is no truth": ("and", yes, "@mode"), "a text alone": "@mode", "a truth alone": "@on", "compared expressions": ("eq", ("not", no), yes), "deep": ("not", ("and", ("or", "@on", no), ("ne", "@mode", "s:POST"))),
    }
    found = strict(spark, trees, {"mode": "s:GET", "on": "b:true", "nothing": "z:", "lost": None})
    assert found == {
        "and of unknown and false": None, "or of true and unknown": None, "not of unknown": None, "true and false": False, "true or false": True,
        "numbers and texts differ": False, "null is null": True, "unknown is nothing": None, "differs": False,
        "a text is no truth": None, "a text alone": None, "a truth alone": True, "compared expressions": None, "deep": False,
    }


def test_static_tables(spark):
    """An unknown leaves its whole table out, but not one that an earlier filter took away; limits are exact."""
    tables = [*((t, f"{t}{i}") for t in "abcd" for i in range(2)), *(("big", f"big{i}") for i in range(129)), *(("full", f"full{i}") for i in range(128))]
    on = {"a0": "b:true", "a1": "b:false", "b0": "b:true", "c0": "b:true", "c1": "b:false", "d0": "b:true", "d1": "b:true"}
    also = {"c0": "b:true", "a0": "b:true", "b0": "b:true", "b1": "b:true", "d0": "b:true", "d1": "b:true"}
    values = [(e, "on", v) for e, v in on.items()] + [(e, "also", v) for e, v in also.items()]
    filters = [("a", 1, "on"), ("b", 1, "on"), ("c", 1, "on"), ("c", 2, "also"), ("d", 1, "on"), ("d", 2, "also"), ("d", 3, "on")]
    trees = [("on", 0, None, 0, "field", "on"), ("also", 0, None, 0, "field", "also")]
    found = semantics.static_tables(frame(spark, "table string, element string", *tables), frame(spark, "table string, ord int, predicate string", *filters), frame(spark, TREE, *trees), frame(spark, "element string, field string, value string", *values))
    assert [r for r in got(found, "table", "element") if r[0] != "full"] == [("a", "a0"), ("c", "c0")] and found.where("table = 'full'").count() == 128


def test_expansion(spark):
    tables = frame(spark, "table string, element string, place int, method string, path string", ("t", "a", 0, "GET", "/a"), ("t", "b", 1, "POST", "/b"), ("u", "c", 0, "GET", None), ("u", "d", 1, "GET", "/d"))
    sites = frame(spark, "site string, table string, ord long", ("x", "t", 1), ("y", "u", 2), ("z", "t", 3), ("lost", "none", 0))
    routes, resolved = semantics.expanded(sites, tables, most=4)
    assert got(routes, "site", "path") == [("x", "/a"), ("x", "/b"), ("y", "/d"), ("z", "/a")]
    assert got(resolved, "site", "resolved") == [("lost", False), ("x", True), ("y", False), ("z", False)]


STATEMENT = "callable string, node int, parent int, place int, kind string, role string, refuses boolean, bare boolean"


def test_denials(spark):
    def tree(name, *children):
        return [(name, 0, None, 0, "block", None, False, False), *((name, i, 0, i, *c) for i, c in enumerate(children, 1))]

    refuse, reply, say, keep, leave = ("throw", None, True, False), ("return", None, True, False), ("expression", None, True, False), ("variable", None, False, False), ("return", None, False, True)
    branch = lambda name, *kinds: [(name, 0, None, 0, "if", None, False, False), *((name, i, 0, i, *k) for i, k in enumerate(kinds, 1))]
    then, other, mild = ("throw", "then", True, False), ("throw", "else", True, False), ("throw", "else", False, False)
    data = [
        *tree("after a variable", keep, refuse), *tree("after a loop", ("for", None, False, False), refuse), *tree("said and left", say, leave), *tree("said alone", say), *tree("left, then refused", leave, refuse),
        *tree("said, kept and left", say, keep, leave), *tree("replied", reply), *branch("both", then, other), *branch("one", then), *branch("mild", then, mild),
    ]
    found = {r["callable"]: r["denies"] for r in semantics.denials(frame(spark, STATEMENT, *data)).where("node = 0").collect()}
    assert {k for k, v in found.items() if v} == {"after a variable", "said and left", "replied", "both"} and len(found) == 10


def test_enforced(spark):
    """Of the four forms of a comparison each must refuse on its own branch."""
    forms, data = [(e, n) for e in (True, False) for n in (True, False)], []
    for i, _ in enumerate(forms):
        for role in ("then", "else"):
            data += [(f"{role}{i}", 0, None, 0, "if", None, False, False), (f"{role}{i}", 1, 0, 0, "throw", role, True, False)]
    compared = frame(spark, "callable string, node int, equal boolean, negated boolean", *((f"{role}{i}", 0, e, n) for i, (e, n) in enumerate(forms) for role in ("then", "else")))
    assert got(semantics.enforced(compared, frame(spark, STATEMENT, *data)), "callable") == [("else1",), ("else2",), ("then0",), ("then3",)]


def test_aliases(spark):
    steps = [("f", "user", "me"), ("f", "me", "id"), ("f", "id", "me"), ("g", "id", "other"), ("f", "body", "name")]
    found = semantics.aliases(frame(spark, "callable string, start string, name string", ("f", "user", "user"), ("g", "user", "user")), frame(spark, "callable string, root string, target string", *steps))
    assert got(found, "callable", "name") == [("f", "id"), ("f", "me"), ("f", "user"), ("g", "user")]


def test_calls(spark):
    """root -> check(identity) is enforced; a forward of it counts once; what isn't passed on proves nothing; limits are told."""
    calls = [
        ("a", "a1", 0, "check", True, False, False), ("b", "b1", 0, "check", False, False, False), ("c", "c1", 0, "pass", True, False, False), ("pass", "p1", 0, "check", False, True, False),
        ("d", "d1", 0, "pass2", True, False, False), ("pass2", "q1", 0, "pass", False, True, False), ("e", "e1", 0, "check", True, False, False), ("f", "f1", 0, "where", False, False, True), ("g", "g1", 0, "where", False, False, False),
        *((f"l{i}", f"l{i}", 0, f"l{i + 1}", False, False, False) for i in range(5)), *(("w", f"w{i}", i, f"x{i}", False, False, False) for i in range(32)), *(("v", f"v{i}", i, f"x{i}", False, False, False) for i in range(31)),
    ]
    passed = [(c, "user", "who") for c in ("a1", "b1", "c1", "d1", "f1", "g1")] + [("p1", "who", "who"), ("q1", "who", "who"), ("e1", "body", "who")]
    roots = ["a", "b", "c", "d", "e", "f", "g", "l0", "l1", "w", "v"]
    facts = frame(spark, "callable string, guards boolean, roles boolean, object boolean", ("l5", True, False, False), ("check", False, True, False), ("x31", False, False, True), ("x30", False, False, True))
    found = semantics.call_semantics(
        frame(spark, "root string", *((r,) for r in roots)), facts, frame(spark, "callable string, call string, place int, callee string, denied boolean, returned boolean, filters boolean", *calls),
        frame(spark, "call string, name string, parameter string", *passed), frame(spark, "callable string, root string, target string", ("check", "who", "me")),
        frame(spark, "callable string, name string", *((r, "user") for r in roots)), frame(spark, "callable string, name string, kind string", ("check", "me", "predicate"), ("where", "who", "filter")),
    )
    seen = {r["root"]: r for r in found.collect()}
    assert {r: v["owned"] for r, v in seen.items()} == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": True, "g": False, "l0": False, "l1": True, "w": False, "v": False}
    assert seen["a"]["roles"] and not seen["f"]["roles"]
    assert {r: v["whole"] for r, v in seen.items() if not v["whole"]} == {"w": False} and seen["w"]["n"] == seen["v"]["n"] == 32 and seen["v"]["object"]


def test_receivers(spark):
    """A later call of a round passes on what an earlier one gave, and comes before all calls of the next round."""
    known, passed = [("app", "A"), ("router", "R")], [(1, "p", "q"), (2, "router", "q2"), (3, "app", "p"), (4, "p", "q2"), (5, "p", "s"), (6, "router", "s"), (7, "q", "app"), (8, "lost", "t"), (9, "x", "y"), (10, "y", "x")]
    found = semantics.receivers(frame(spark, "key string, receiver string", *known), frame(spark, "ord long, argument string, parameter string", *passed))
    assert got(found, "key", "receiver") == [("app", "A"), ("p", "A"), ("q", "A"), ("q2", "R"), ("router", "R"), ("s", "A")]


def test_settings(spark):
    apps = frame(spark, "app string, bound long", *((a, 10) for a in "abcde"))
    events = [
        ("a", 11, "prefix", True, "resolved", "one"), ("a", 13, "prefix", True, "resolved", "two"), ("a", 12, "versions", True, "resolved", "w"), ("a", 20, "close", True, "resolved", None),
        ("b", 11, "prefix", True, "resolved", "one"), ("b", 12, "prefix", True, "partial", "two"), ("c", 11, "prefix", True, "resolved", "one"), ("c", 12, "prefix", True, "unresolved", "two"),
        ("d", 9, "prefix", True, "resolved", "early"), ("d", 12, "guards", True, "resolved", None), ("d", 13, "guards", True, "resolved", None), ("d", 14, "close", False, "resolved", None),
    ]
    found = semantics.settings(apps, frame(spark, "app string, at long, op string, scoped boolean, outcome string, value string", *events))
    assert got(found, "app", "prefix", "versioned", "version_prefix", "closed", "guards", "resolved") == [
        ("a", "two", True, "w", True, 0, True), ("b", "two", False, "v", False, 0, False), ("c", "one", False, "v", False, 0, False), ("d", "", False, "v", False, 2, False), ("e", "", False, "v", False, 0, True),
    ]


def test_versioned_paths(spark):
    routes = [("own", "a", "GET", "x/"), ("app", "a", "GET", "/y"), ("all", "a", "ALL", "z"), ("all2", "a", "ALL", "q"), ("post", "a", "POST", "z"), ("off", "b", "GET", "x"), ("own2", "b", "GET", "y")]
    config = [("a", "api", "m", True, "v"), ("b", "", "", False, "v")]
    versions = [("own", "2"), ("own", None), ("own2", "3")]
    excluded = [("a", "m/z", "GET"), ("a", "/m/q/", None), ("b", "other", None)]
    found = semantics.versioned_paths(
        frame(spark, "route string, app string, method string, path string", *routes), frame(spark, "app string, prefix string, module_prefix string, versioned boolean, version_prefix string", *config),
        frame(spark, "route string, version string", *versions), frame(spark, "app string, version string", ("a", "1")), frame(spark, "app string, path string, method string", *excluded),
    )
    assert got(found, "route", "path") == [
        ("all", "/api/v1/m/z"), ("all", "/v1/m/z"), ("all2", "/v1/m/q"), ("app", "/api/v1/m/y"), ("off", "/x"), ("own", "/api/m/x"), ("own", "/api/v2/m/x"), ("own2", "/y"), ("post", "/api/v1/m/z"),
    ]


def test_equal_cases_are_judged_once(spark, monkeypatch):
    """As many leaves are written for 500 elements that give a predicate the same two cases as for two."""
    rows, kept = {}, semantics.kept

    def counted(df, tag):
        out = kept(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(semantics, "kept", counted)
    trees = frame(spark, TREE, ("p", 0, None, 0, "and", None), ("p", 1, 0, 0, "field", "on"), ("p", 2, 0, 1, "field", "also"))
    elements = spark.range(500).selectExpr("'p' AS predicate", "concat('e', id) AS element")
    values = spark.range(500).selectExpr("'p' AS predicate", "concat('e', id) AS element", "explode(map('on', 'b:true', 'also', if(id % 2 = 0, 'b:true', 'b:false'), 'other', concat('n:', id))) AS (field, value)")
    found = semantics.strict(trees, elements, values)
    assert found.groupBy("result").count().orderBy("result").collect() == [(False, 250), (True, 250)]
    assert rows["predicate-leaves"] == 4


def test_passes_are_written_once(spark, monkeypatch):
    tags, kept = [], semantics.kept
    monkeypatch.setattr(semantics, "kept", lambda df, tag: tags.append(tag) or kept(df, tag))
    found = semantics.receivers(frame(spark, "key string, receiver string", ("a", "A")), frame(spark, "ord long, argument string, parameter string", (1, "b", "c"), (2, "a", "b")))
    assert got(found, "key", "receiver") == [("a", "A"), ("b", "A"), ("c", "A")] and tags.count("passes") == 1


def test_calls_are_packed_once(spark, monkeypatch):
    """Names are closed for bindings alone and not for each seed and parameter, and a round of the search writes one table."""
    rows, kept = {}, semantics.kept

    def counted(df, tag):
        out = kept(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(semantics, "kept", counted)
    none = lambda ddl: spark.createDataFrame([], ddl)
    calls = [(f"f{i}", f"c{i}", 0, f"g{i % 2}", True, False, False) for i in range(50)]
    found = semantics.call_semantics(
        frame(spark, "root string", *((f"f{i}",) for i in range(50))), none("callable string, guards boolean, roles boolean, object boolean"), frame(spark, "callable string, call string, place int, callee string, denied boolean, returned boolean, filters boolean", *calls),
        frame(spark, "call string, name string, parameter string", *((f"c{i}", "user", "who") for i in range(50))), frame(spark, "callable string, root string, target string", ("g0", "who", "me")),
        frame(spark, "callable string, name string", *((f"f{i}", "user") for i in range(50))), frame(spark, "callable string, name string, kind string", ("g0", "me", "predicate")),
    )
    assert found.groupBy("owned", "n").count().orderBy("owned").collect() == [(False, 2, 25), (True, 2, 25)]
    assert sum(rows["aliases"]) == 2 and rows["states"] == [50, 100, 100] and set(rows) == {"aliases", "bindings", "states"}


def test_statements_are_ordered_once(spark, monkeypatch):
    """What stands before a statement is found once, not again for each level of the trees."""
    plans, kept = [], semantics.kept
    monkeypatch.setattr(semantics, "kept", lambda df, tag: plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, tag))
    data = [("f", 0, None, 0, "if", None, False, False), ("f", 1, 0, 0, "block", "then", False, False), ("f", 2, 1, 0, "throw", None, True, False), ("f", 3, 0, 1, "throw", "else", True, False)]
    assert got(semantics.denials(frame(spark, STATEMENT, *data)), "node", "denies") == [(0, True), (1, True), (2, True), (3, True)]
    assert [tag for tag, plan in plans if "Window" in plan] == ["statements"]
