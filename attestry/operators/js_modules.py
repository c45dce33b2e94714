"""Imports, exports and module metadata of JavaScript and TypeScript sources, as the relations that `modules` works on.

A small reader tells what stands in each file; names become (file, declaration) by joins, over all files at once. A class is
`file#name`, a module is its class, a token is a class or a quoted text. Metadata that isn't an array of names and plain
objects is told as `unread`, so that what depends on it can be called unresolved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.durable import kept
from attestry.operators import modules
from attestry.operators.parsing import closing, masked, rows_of, split_top

_SOURCE = r"\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$"
_IMPORT = re.compile(r"""\bimport\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s*(['"])([^'"\n]+)\2""")
_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+(\w+|\{[^}]*\})\s*=\s*require\(\s*(['"])([^'"\n]+)\2\s*\)""")
_FROM = re.compile(r"""\bexport\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*(['"])([^'"\n]+)\2""")
_LIST = re.compile(r"\bexport\s*\{([^}]*)\}(?!\s*from)")
_DECLARED = re.compile(r"\bexport\s+(default\s+)?(?:abstract\s+|async\s+|declare\s+)*(?:class|function\s*\*?|const|let|var|enum)\s+(\w+)")
_DEFAULT = re.compile(r"\bexport\s+default\s+(\w+)\s*(?:;|$)", re.M)
_COMMON = re.compile(r"(?m)^\s*(?:module\s*\.\s*)?exports(?:\s*\.\s*(\w+))?\s*=\s*(\w+)\s*(?:;|$)")
_LISTS = ("imports", "exports", "providers", "controllers")


def _names(clause: str) -> Iterator[tuple[str, str]]:
    """(name, alias) of `a, b as c, d: e`."""
    for item in clause.strip().strip("{}").split(","):
        words = re.sub(r"^\s*type\s+", "", item).replace(":", " as ").split()
        if words:
            yield words[0], words[-1]


def _metadata(content: str, shape: str, at: int, owner: str) -> Iterator[dict]:
    """The lists of a module's metadata object, which opens at a place."""
    stop = closing(shape, at)
    if stop is None:
        yield {"kind": "unread", "a": owner, "b": "metadata"}
        return
    for part, form in zip(split_top(content[at + 1 : stop], ",", shape[at + 1 : stop]), split_top(shape[at + 1 : stop], ",", shape[at + 1 : stop]), strict=True):
        named = re.match(r"\s*(\w+)\s*:\s*", form)
        if not named or named[1] not in _LISTS:
            continue
        value, inner = part[named.end() :].strip(), form[named.end() :].strip()
        if not (inner.startswith("[") and inner.endswith("]")):
            yield {"kind": "unread", "a": owner, "b": named[1]}
            continue
        items = zip(split_top(value[1:-1], ",", inner[1:-1]), split_top(inner[1:-1], ",", inner[1:-1]), strict=True)
        for place, (item, seen) in enumerate((i.strip(), s.strip()) for i, s in items if i.strip()):
            forward = re.fullmatch(r"forwardRef\(\s*\(\s*\)\s*=>\s*(\w+)\s*\)", item)
            if forward or re.fullmatch(r"\w+", item):
                yield {"kind": "item", "a": owner, "b": named[1], "c": forward[1] if forward else item, "n": place}
            elif seen.startswith("{") and named[1] in ("providers", "exports"):
                fields = {m[1]: v.strip()[m.end() :].strip() for v in split_top(item[1:-1], ",", seen[1:-1]) if (m := re.match(r"(\w+)\s*:\s*", v.strip()))}
                how = next((k for k in ("useClass", "useExisting") if k in fields), "")
                yield {"kind": "provider" if named[1] == "providers" else "told", "a": owner, "b": fields.get("provide", ""), "c": how, "d": fields.get(how, ""), "n": place}
            else:
                yield {"kind": "unread", "a": owner, "b": named[1]}


def read_modules(path: str, content: str) -> Iterator[dict]:
    shape = masked(content, "c")
    live = lambda m: shape[m.start() : m.start() + 3].strip() != ""
    for m in filter(live, _IMPORT.finditer(content)):
        for piece in re.findall(r"\{[^}]*\}|\*\s*as\s+\w+|\w+", m[1]):
            if piece[0] == "{":
                yield from ({"kind": "import", "a": alias, "b": m[3], "c": name} for name, alias in _names(piece))
            else:
                yield {"kind": "import", "a": piece.split()[-1], "b": m[3], "c": "*" if piece[0] == "*" else "default"}
    for m in filter(live, _REQUIRE.finditer(content)):
        yield from ({"kind": "import", "a": alias, "b": m[3], "c": name} for name, alias in (_names(m[1]) if m[1][0] == "{" else [("default", m[1])]))
    stars = 0
    for m in filter(live, _FROM.finditer(content)):
        if m[1] == "*":
            yield {"kind": "star", "a": m[3], "n": stars}
            stars += 1
        elif m[1][0] == "{":
            yield from ({"kind": "export", "a": alias, "c": m[3], "d": name} for name, alias in _names(m[1]))
    for m in _LIST.finditer(shape):
        yield from ({"kind": "export", "a": alias, "b": name} for name, alias in _names(m[1]))
    for m in _DECLARED.finditer(shape):
        yield {"kind": "export", "a": "default" if m[1] else m[2], "b": m[2]}
    for m in _DEFAULT.finditer(shape):
        yield {"kind": "export", "a": "default", "b": m[1]}
    for m in _COMMON.finditer(shape):
        yield {"kind": "export", "a": m[1] or "default", "b": m[2]}
    for m in re.finditer(r"@Module\s*\(", shape):
        stop = closing(shape, m.end() - 1)
        named = re.compile(r"\bclass\s+(\w+)").search(shape, stop or m.end())
        if stop is None or not named:
            continue
        above = shape[max(shape.rfind("}", 0, m.start()), 0) : named.start()] + shape[stop : named.start()]
        yield {"kind": "module", "a": named[1], "flag": bool(re.search(r"@Global\s*\(", above))}
        opens = shape.find("{", m.end())
        if opens >= 0 and opens < stop and not shape[m.end() : opens].strip():
            yield from _metadata(content, shape, opens, named[1])
        elif shape[m.end() : stop].strip():
            yield {"kind": "unread", "a": named[1], "b": "metadata"}


_DDL = "kind string, a string, b string, c string, d string, n int, flag boolean"
_TYPES = [("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("d", pa.string()), ("n", pa.int32()), ("flag", pa.bool_())]


class Read(NamedTuple):
    """What `modules` works on, read from sources."""

    files: DataFrame
    imports: DataFrame
    exports: DataFrame
    stars: DataFrame
    modules: DataFrame  # module, is_global
    edges: DataFrame  # src, dst, place
    reexports: DataFrame
    tokens: DataFrame  # module, token: what a module exports
    registrations: DataFrame
    unread: DataFrame  # module, list


def read(files: DataFrame) -> Read:
    """The relations of all sources among files (relative_path, content)."""
    rows = kept(rows_of(files.where(F.col("relative_path").rlike(_SOURCE)), read_modules, _DDL, _TYPES).withColumnRenamed("relative_path", "file"), "module-rows")
    of = lambda kind, *columns: rows.where(F.col("kind") == kind).select("file", *columns)
    named = files.select(F.col("relative_path").alias("file"))
    imports = of("import", F.col("a").alias("local"), F.col("b").alias("module"), F.col("c").alias("imported"))
    exports = of("export", F.col("a").alias("exported"), F.col("b").alias("local"), F.col("c").alias("module"), F.col("d").alias("imported"))
    stars = of("star", F.col("n").alias("place"), F.col("a").alias("module"))
    used = of("item", F.col("c").alias("name")).union(of("provider", "b")).union(of("provider", "d")).union(of("told", "b")).where("name rlike '^[A-Za-z_$][A-Za-z_$0-9]*$'").distinct()
    far = used.join(imports.withColumnRenamed("local", "name"), ["file", "name"]).where("imported <> '*'")
    far = kept(far.join(modules.targets(named, far), ["file", "module"]).select("file", "name", F.col("target").alias("there"), "imported"), "used-names")
    found = modules.symbols(named, exports, stars, imports, far.select(F.col("there").alias("file"), F.col("imported").alias("name")))
    meant = far.join(found.select(F.col("file").alias("there"), F.col("name").alias("imported"), "target", "local"), ["there", "imported"]).where("target IS NOT NULL")
    meant = meant.select("file", "name", F.concat_ws("#", "target", "local").alias("is"))
    near = used.join(imports.withColumnRenamed("local", "name"), ["file", "name"], "left_anti").select("file", "name", F.concat_ws("#", "file", "name").alias("is"))
    known = kept(meant.unionByName(near), "names")
    own = F.concat_ws("#", "file", "a")
    found_modules = kept(rows.where("kind = 'module'").select(own.alias("module"), F.col("flag").alias("is_global")), "modules")

    def stood(rows: DataFrame, column: str, alias: str) -> DataFrame:
        return rows.join(known.select("file", F.col("name").alias(column), F.col("is").alias(alias)), ["file", column], "left")

    def token(expression: str, resolved: str) -> Column:
        """A class or a quoted text; other expressions are no token."""
        text = F.regexp_extract(expression, r"^(['\"])(.*)\1$", 2)
        return F.when(F.col(expression).rlike(r"^(['\"]).*\1$"), F.concat(F.lit("text:"), text)).otherwise(F.col(resolved))

    items = kept(stood(rows.where("kind = 'item'"), "c", "is").select(own.alias("module"), F.col("b").alias("list"), "is", "n"), "items")
    members = found_modules.select(F.col("module").alias("is"))
    edges = kept(items.where("list = 'imports'").join(members, "is", "left_semi").groupBy("module", "is").agg(F.min("n").alias("place")).select(F.col("module").alias("src"), F.col("is").alias("dst"), "place"), "edges")
    told = items.where("list = 'exports' AND is IS NOT NULL")
    again = told.select(F.col("module").alias("src"), F.col("is").alias("dst")).join(edges, ["src", "dst"], "left_semi")
    exported = told.join(again.select(F.col("src").alias("module"), F.col("dst").alias("is")), ["module", "is"], "left_anti").select("module", F.col("is").alias("token"))
    exported = exported.unionByName(stood(rows.where("kind = 'told'"), "b", "is").select(own.alias("module"), token("b", "is").alias("token")).where("token IS NOT NULL"))
    direct = items.where("list = 'providers' AND is IS NOT NULL").select("module", F.col("is").alias("token"), F.concat(F.lit("class:"), "is").alias("signature"), F.col("is").alias("implementation"), F.lit(None).cast("string").alias("alias"))
    provided = stood(stood(rows.where("kind = 'provider'"), "b", "provides"), "d", "target").withColumn("token", token("b", "provides")).where("token IS NOT NULL")
    meant_class, meant_alias = F.when(F.col("c") == "useClass", F.col("target")), F.when(F.col("c") == "useExisting", token("d", "target"))
    signature = F.coalesce(F.concat(F.lit("class:"), meant_class), F.concat(F.lit("alias:"), meant_alias), F.lit("unresolved"))
    objects = provided.select(own.alias("module"), "token", signature.alias("signature"), meant_class.alias("implementation"), meant_alias.alias("alias"))
    unread = rows.where("kind = 'unread'").select(own.alias("module"), F.col("b").alias("list"))
    return Read(named, imports, exports, stars, found_modules, edges, again.distinct(), exported.distinct(), direct.unionByName(objects), unread)


def visible(files: DataFrame) -> DataFrame:
    """module, token, implementation and provider_module: what each module that provides, exports or imports something sees under the tokens of its application."""
    got = read(files)
    of, graphs = modules.application_graphs(got.modules, got.edges)
    held = got.modules.where("is_global").select(F.col("module").alias("node"), F.col("module").alias("property"))
    tokens = got.registrations.select(F.col("module").alias("node"), "token").distinct()
    asked = of.join(graphs, "root").join(tokens, "node").select("module", "token").distinct()
    return modules.visible_providers(asked, got.edges, got.reexports, got.tokens, modules.registered(got.registrations), modules.in_every_graph(of, graphs, held))
