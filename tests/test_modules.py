"""Module relations against what a person finds: near misses of visibility, graphs, star exports and router trees."""

from attestry.operators import js_modules, modules
from attestry.relations import rows


def frame(spark, ddl, *data):
    names = [c.split()[0] for c in ddl.split(", ")]
    return rows(spark, [dict(zip(names, r, strict=True)) for r in data], ddl)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def edges(spark, *pairs):
    return frame(spark, "src string, dst string, place int", *((a, b, i) for i, (a, b) in enumerate(pairs)))


def symbols(spark, files, exports=(), stars=(), imports=(), asked=()):
    one = lambda ddl, data: frame(spark, ddl, *data)
    found = modules.symbols(
        one("file string", [(f,) for f in files]), one("file string, exported string, local string, module string, imported string", exports),
        one("file string, place int, module string", stars), one("file string, local string, module string, imported string", imports), one("file string, name string", asked),
    )
    return {(r["file"], r["name"]): (r["target"], r["local"]) for r in found.collect()}


def test_star_exports(spark):
    files = ["i.ts", "a.ts", "b/index.ts", "c.js", "d.ts"]
    stars = [("i.ts", 0, "./a"), ("i.ts", 1, "./b"), ("a.ts", 0, "./i.js"), ("a.ts", 1, "./d"), ("d.ts", 0, "./lost")]
    exports = [
        ("b/index.ts", "x", "inB", None, None), ("d.ts", "x", "inD", None, None), ("d.ts", "y", None, "./lost", "y"), ("b/index.ts", "y", "inB", None, None),
        ("a.ts", "z", None, "./lost", None), ("b/index.ts", "z", "far", None, None), ("i.ts", "w", "w", None, None), ("c.js", "w", "other", None, None), ("i.ts", "v", "gone", None, None), ("d.ts", "v", "near", None, None),
    ]
    imports = [("i.ts", "w", "./c.js", "w"), ("i.ts", "gone", "./lost", "v")]
    found = symbols(spark, files, exports, stars, imports, [("i.ts", n) for n in "xyzwvu"] + [("a.ts", "x")])
    assert found["i.ts", "x"] == ("d.ts", "inD")  # the first star's long way counts before the second star's short one, around a cycle
    assert found["a.ts", "x"] == ("b/index.ts", "inB")  # from inside the cycle the way back comes first
    assert found["i.ts", "y"] == ("b/index.ts", "inB") and found["i.ts", "z"] == ("b/index.ts", "far")  # a lost re-export leaves the stars open
    assert found["i.ts", "w"] == ("c.js", "other")
    assert found["i.ts", "v"] == (None, None)  # a local name that is a lost import hides the stars
    assert found["i.ts", "u"] == (None, None)


def whole(spark, cases, **limits):
    """For each case (its edges), whether the walk from m is whole; all cases in one run."""
    graph = edges(spark, *((f"{i}{a}", f"{i}{b}") for i, pairs in enumerate(cases) for a, b in pairs))
    found = modules.walks(graph, frame(spark, "start string", *((f"{i}m",) for i in range(len(cases)))), **limits)
    return [{r["whole"] for r in rows} for rows in ([r for r in found.collect() if r["start"] == f"{i}m"] for i in range(len(cases)))]


def test_walk_depth(spark):
    line = [("m" if i == 0 else f"m{i}", f"m{i + 1}") for i in range(9)]
    assert whole(spark, [line[:8], line]) == [{True}, {False}]


def test_walk_entries_and_last_distance(spark):
    """At the last distance only nodes that stand earlier in the walk may follow."""
    star = [("m", f"m{i}") for i in range(5)]
    last = [[("m", "a"), ("m", "b"), pair] for pair in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "m"))]
    assert whole(spark, [star[:4], star, *last], depth=1, entries=5) == [{True}, {False}, {False}, {True}, {True}, {True}]


def test_in_every_graph(spark):
    """A module under two applications has what both have; one in a cycle is its own root."""
    graph = edges(spark, ("app", "m"), ("other", "m"), ("app", "g"), ("other", "h"), ("app", "both"), ("other", "both"), ("p", "q"), ("q", "p"))
    every = frame(spark, "module string", *((m,) for m in ("app", "other", "m", "p")))
    of, graphs = modules.application_graphs(every, graph)
    assert got(of, "module", "root") == [("app", "app"), ("m", "app"), ("m", "other"), ("other", "other"), ("p", "p")]
    held = frame(spark, "node string, property string", ("g", "G"), ("both", "B"), ("h", "H"), ("q", "Q"))
    assert got(modules.in_every_graph(of, graphs, held), "module", "property") == [("app", "B"), ("app", "G"), ("m", "B"), ("other", "B"), ("other", "H"), ("p", "Q")]


def test_one_broken_root_leaves_no_graphs(spark):
    line = edges(spark, *((f"m{i}", f"m{i + 1}") for i in range(10)))
    every = frame(spark, "module string", ("m3",), ("x",))
    assert got(modules.application_graphs(every, line, frame(spark, "module string", ("m0",), ("m5",)))[0], "module", "root") == []
    assert got(modules.application_graphs(every, line, frame(spark, "module string", ("m3",), ("x",)))[0], "module", "root") == [("m3", "m3"), ("x", "x")]


def test_each_way_is_written_once(spark, monkeypatch):
    """A name five star exports away: a row for each file on the way."""
    rows = []
    monkeypatch.setattr(modules, "kept", lambda df, tag, keep=modules.kept: (rows.append(keep(df, tag)), rows[-1])[1] if tag == "symbols" else keep(df, tag))
    files = [f"f{i}.ts" for i in range(6)]
    stars = frame(spark, "file string, place int, module string", *((a, 0, f"./{b}") for a, b in zip(files, files[1:])))
    own = frame(spark, "file string, exported string, local string, module string, imported string", (files[-1], "x", "here", None, None))
    found = modules.symbols(frame(spark, "file string", *((f,) for f in files)), own, stars, frame(spark, "file string, local string, module string, imported string"), frame(spark, "file string, name string", (files[0], "x")))
    assert got(found, "file", "name", "target", "local") == [("f0.ts", "x", "f5.ts", "here")]
    assert sum(df.count() for df in rows) == len(files)


PROVIDER = "module string, token string, signature string, implementation string, alias string"


def visible(spark, cases, **limits):
    """What module m of each case sees under token t; all cases in one run, their modules told apart by the case's number."""
    of = lambda key: [(i, row) for i, (c, _) in enumerate(cases) for row in c.get(key, ())]
    pairs = lambda key, a, b, second=True: frame(spark, f"{a} string, {b} string", *((f"{i}{r[0]}", f"{i}{r[1]}" if second else r[1]) for i, r in of(key)))
    graph = edges(spark, *((f"{i}{a}", f"{i}{b}") for i, (a, b) in of("graph")))
    registered = modules.registered(frame(spark, PROVIDER, *((f"{i}{r[0]}", *r[1:]) for i, r in of("given"))))
    asked = frame(spark, "module string, token string", *((f"{i}m", "t") for i in range(len(cases))))
    found = modules.visible_providers(asked, graph, pairs("again", "src", "dst"), pairs("told", "module", "token", False), registered, pairs("everywhere", "module", "property"), **limits)
    seen = {r["module"]: r["implementation"] and f"{r['implementation']}@{r['provider_module'].lstrip('0123456789')}" for r in found.collect()}
    assert [seen[f"{i}m"] for i in range(len(cases))] == [expected for _, expected in cases]


def a_class(module, token, name):
    return (module, token, f"class:{name}", name, None)


def an_alias(module, token, other):
    return (module, token, f"alias:{other}", None, other)


def test_registered_twice(spark):
    data = [a_class("m", "t", "A"), a_class("m", "t", "A"), a_class("m", "u", "A"), a_class("m", "u", "B"), a_class("m", "v", "A"), ("m", "v", "unresolved", None, None), an_alias("m", "w", "t")]
    assert got(modules.registered(frame(spark, PROVIDER, *data)), "token", "implementation", "alias") == [("t", "A", None), ("u", None, None), ("v", None, None), ("w", None, "t")]


def test_visible(spark):
    two = [a_class("a", "t", "A"), a_class("b", "t", "B")]
    a, both, told = [("m", "a")], [("m", "a"), ("m", "b")], [("a", "t"), ("b", "t")]
    long = [(f"m{i}" if i else "m", f"m{i + 1}") for i in range(9)]
    steps = [an_alias("m", f"t{i}" if i else "t", f"t{i + 1}") for i in range(9)]
    far = lambda n: {"graph": long[:n], "told": [(f"m{n}", "t")], "given": [a_class(f"m{n}", "t", "A")], "again": long[1:n]}
    visible(spark, [
        ({"graph": a, "told": told, "given": [a_class("a", "t", "A")]}, "A@a"),
        ({"graph": a, "given": [a_class("a", "t", "A")]}, None),  # provided, not exported
        ({"graph": both, "told": told, "given": two}, None),
        ({"graph": both, "told": told, "given": [*two, a_class("b", "t", "C")]}, "A@a"),  # an ambiguous export tells nothing
        ({"graph": a, "told": told, "given": [a_class("a", "t", "A"), a_class("m", "t", "A"), a_class("m", "t", "B")]}, None),  # own ambiguity hides imports
        ({"graph": [*both, ("a", "c"), ("b", "c")], "told": [("c", "t")], "given": [a_class("c", "t", "A")], "again": [("a", "c"), ("b", "c")]}, "A@c"),  # one thing on two ways
        ({"graph": a, "told": [("c", "t")], "given": [a_class("c", "t", "A")], "again": [("a", "c")]}, None),  # re-exported, not imported
        ({"graph": a, "told": [("g", "t")], "given": [a_class("g", "t", "A")], "everywhere": [("m", "g"), ("m", "m")]}, "A@g"),
        ({"graph": a, "told": [("a", "u")], "given": [an_alias("m", "t", "u"), a_class("a", "u", "A")]}, "A@a"),
        ({"given": [an_alias("m", "t", "u"), an_alias("m", "u", "t")]}, None),
        ({"graph": [("m", "a"), ("a", "m"), ("a", "b")], "told": [("m", "t"), *told], "given": [a_class("b", "t", "B")]}, "B@b"),
        (far(8), "A@m8"),
        (far(9), None),
        ({"given": [*steps[:8], a_class("m", "t8", "A")]}, "A@m"),
        ({"given": [*steps, a_class("m", "t9", "A")]}, None),
    ])


def test_visible_beyond_entries(spark):
    given = {"told": [("a", "t")], "given": [a_class("a", "t", "A")]}
    visible(spark, [({"graph": [("m", "a"), ("m", "b")], **given}, None), ({"graph": [("m", "a")], **given}, "A@a")], entries=2)
    visible(spark, [({"graph": [("m", "a"), ("a", "b"), ("b", "c")], **given}, "A@a")], entries=2)  # near, but never asked


def test_questions_that_tell_nothing_are_not_followed(spark, monkeypatch):
    """Ways over five modules that all import and re-export each other, none of which provides what is asked: hundreds, which no round holds."""
    rows = []
    monkeypatch.setattr(modules, "kept", lambda df, tag, keep=modules.kept: (rows.append(keep(df, tag)), rows[-1])[1] if tag == "calls" else keep(df, tag))
    ways = [(x, y) for x in "mabcd" for y in "mabcd" if x != y]
    visible(spark, [({"graph": ways, "again": ways, "told": [(x, "t") for x in "abcd"], "given": [a_class("a", "u", "A")]}, None)])
    assert sum(df.count() for df in rows) == 0


def prefixes(spark, trees, **limits):
    """By tree, {(root, module): prefix, None where unresolved}; all trees in one run."""
    graphs = frame(spark, "root string, node string", *((f"{i}{r}", f"{i}{m}") for i in range(len(trees)) for r, m in (("r", "h"), ("r", "h2"), ("r", "a"), ("r", "b"), ("s", "a"))))
    data = [(f"{i}{site}", f"{i}{host}", x, parent, path, module and f"{i}{module}") for i, tree in enumerate(trees) for site, host, x, parent, path, module in tree]
    found = modules.module_prefixes(frame(spark, "site string, host string, id string, parent string, path string, module string", *data), graphs, **limits).collect()
    return [{(r["root"][1:], r["module"][1:]): r["prefix"] if r["resolved"] else None for r in found if r["root"][0] == str(i)} for i in range(len(trees))]


def test_router_prefixes(spark):
    tree = [("1", "h", "x", None, "api//", None), ("1", "h", "y", "x", "v1/", "a"), ("1", "h", "z", "y", None, "b")]
    bad = (("1", "h", "q", "x", "v2", "a"), ("1", "h", "q", "x", "idle", None), ("1", "h", "q", None, None, "b"))
    plain, torn, same, *broken = prefixes(spark, [tree, [*tree, ("2", "h2", "q", None, "other", "a")], [*tree, ("2", "h2", "q", None, "/api/v1", "a")], *([*tree, b] for b in bad)])
    assert plain == {("r", "h"): "", ("r", "h2"): "", ("r", "a"): "/api/v1", ("r", "b"): "/api/v1", ("s", "a"): ""}
    assert torn["r", "a"] is None and torn["r", "b"] == "/api/v1" and torn["s", "a"] == ""  # two sites disagree about one module alone
    assert same == plain
    for found in broken:
        assert found == {("r", "h"): None, ("r", "h2"): None, ("r", "a"): None, ("r", "b"): None, ("s", "a"): ""}
    assert prefixes(spark, [tree], depth=1)[0]["r", "a"] is None and prefixes(spark, [tree], entries=2)[0]["r", "h"] is None


SOURCES = {
    "app.module.ts": "import { Module } from '@nestjs/common';\nimport { UsersModule, Auth as AuthModule } from './users';\n// import { Fake } from './fake'\n@Module({ imports: [UsersModule, AuthModule], providers: [{ provide: 'KEY', useExisting: Tokens }, Own] })\nexport class AppModule {}\nclass Own {}\nimport { Tokens } from './users';",
    "users/index.ts": "export * from './users.module';\nexport { AuthModule as Auth, Tokens } from './auth.js';",
    "users/users.module.ts": "import { Users } from './users.service';\n@Module({ providers: [Users, { provide: 'DB', useClass: Users }], exports: [Users, forwardRef(() => Lost)] })\nexport class UsersModule {}",
    "users/users.service.ts": "export class Users {}",
    "users/auth.ts": "@Global()\n@Module({ providers: [Tokens, { provide: 'X', useFactory: () => 1 }], exports: [Tokens] })\nclass AuthModule {}\nexport class Tokens {}\nexport { AuthModule };",
    "odd.module.ts": "@Module({ imports: [...more, Dynamic.forRoot()], providers: list })\nexport default class OddModule {}\n@Module(options)\nclass Later {}",
}


def test_sources(spark):
    files = frame(spark, "relative_path string, content string", *SOURCES.items())
    read = js_modules.read(files)
    assert got(read.edges, "src", "dst") == [("app.module.ts#AppModule", "users/auth.ts#AuthModule"), ("app.module.ts#AppModule", "users/users.module.ts#UsersModule")]
    assert got(read.modules.where("is_global"), "module") == [("users/auth.ts#AuthModule",)]
    assert got(read.unread, "module", "list") == [("odd.module.ts#Later", "metadata"), ("odd.module.ts#OddModule", "imports"), ("odd.module.ts#OddModule", "imports"), ("odd.module.ts#OddModule", "providers")]
    seen = {(r["module"], r["token"]): r["implementation"] for r in js_modules.visible(files).collect()}
    app = "app.module.ts#AppModule"
    assert seen[app, "users/users.service.ts#Users"] == "users/users.service.ts#Users" and seen[app, "text:KEY"] == "users/auth.ts#Tokens"
    assert seen[app, "text:DB"] is None and seen[app, "text:X"] is None and seen[app, "app.module.ts#Own"] == "app.module.ts#Own"
    assert seen["users/users.module.ts#UsersModule", "users/auth.ts#Tokens"] == "users/auth.ts#Tokens"  # by a global module of its only application
    assert seen["users/auth.ts#AuthModule", "users/users.service.ts#Users"] is None


def test_ended_walks_are_left_alone(spark, monkeypatch):
    """Walks that came to nothing new are in no later round, and a round is one table."""
    rows, kept = [], modules.kept

    def counted(df, tag):
        out = kept(df, tag)
        rows.append((tag, out.count()))
        return out

    monkeypatch.setattr(modules, "kept", counted)
    edges = frame(spark, "src string, dst string, place int", *((f"m{i}", f"m{i + 1}", 0) for i in range(3)))
    found = modules.walks(edges, frame(spark, "start string", ("m0",), *((f"x{i}",) for i in range(50))))
    assert found.where("whole").count() == 54
    assert rows == [("walk", 51), ("walk", 52), ("walk", 3), ("walk", 4), ("walk", 4)]


def test_targets_try_no_name_against_all_files(spark):
    files = ["a/x.ts", "a/x.js", "a/x/index.ts", "a/y.ts.js", "a/y.ts", "a/z.TS", "a/index/index.js", "a/w/index.jsx", "a/q.css"]
    wanted = {"./x": "a/x.js", "./x.ts": "a/x.ts", "./x.mjs": "a/x.js", "./y.ts.js": "a/y.ts.js", "./y.ts.mjs": "a/y.ts", "./z.TS": "a/z.TS", "./z": None, "./index": "a/index/index.js", "./w": "a/w/index.jsx", "./q.css": "a/q.css", "x": None, "../a/./w/": "a/w/index.jsx"}
    got = modules.targets(frame(spark, "file string", *((f,) for f in files)), frame(spark, "file string, module string", *(("a/b.ts", m) for m in wanted)))
    assert {r["module"]: r["target"] for r in got.collect()} == {m: t for m, t in wanted.items() if t}
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # 18 rows for each name before
