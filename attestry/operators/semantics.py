"""What code does, from rows about it: strict predicates, static route tables, denial paths, identity aliases, calls, settings and versions.

Expressions and statements are rows of trees, evaluated from the leaves up, a level a round, with one aggregation for all
trees at once. Searches are loops of joins over what the last round found. Rounds are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.durable import bucketed, kept
from attestry.functions import arrays as A

#: Limits of static route tables and of call searches.
TABLE_ENTRIES, TABLE_FILTERS, EXPANSIONS = 128, 2, 512
CALL_DEPTH, CALLABLES, FORWARDS = 4, 32, 1
_GIVEN = "array<struct<field:string,value:string>>"


def joined_path(*parts: Column) -> Column:
    """Parts joined by single slashes, one in front and none at the end."""
    return F.regexp_replace(F.regexp_replace(F.concat_ws("/", F.lit(""), *parts), "/{2,}", "/"), "(?<=.)/$", "")


def levels(nodes: DataFrame, keys: list[str], most: int = 64) -> tuple[DataFrame, int]:
    """nodes (keys, node, parent) with their level below their root, and the deepest one. Nodes under no root, or deeper than `most`, are left out."""
    found = [kept(nodes.where("parent IS NULL").withColumn("level", F.lit(0)), "level")]
    while len(found) <= most:
        above = found[-1].select(*keys, F.col("node").alias("parent"))
        new = kept(nodes.where("parent IS NOT NULL").join(above, [*keys, "parent"], "left_semi").withColumn("level", F.lit(len(found))), "level")
        if new.isEmpty():
            break
        found.append(new)
    return reduce(DataFrame.unionByName, found), len(found) - 1


# -- strict predicates and static tables


def strict(predicates: DataFrame, elements: DataFrame, values: DataFrame) -> DataFrame:
    """predicate, element and result of every element of a predicate: true, false, or null where anything in it is unknown.

    predicates: predicate, node (int), parent (int), place (int), op (not, and, or, eq, ne, field, value), text; elements: predicate, element; values: predicate, element,
    field, value. Values carry their type: `s:text`, `n:1`, `b:true`, `z:` for null.

    Unlike SQL's, these AND and OR don't settle with one operand: an unknown one leaves the whole predicate unknown. `eq` and
    `ne` compare constants and fields alone, by type and value; what isn't a boolean is unknown under `not`, `and` and `or`, and as a result.
    """
    asked = predicates.where("op = 'field'").select("predicate", F.col("text").alias("field")).distinct()
    known = values.join(asked, ["predicate", "field"], "left_semi").groupBy("predicate", "element").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("given"))
    return _judged(predicates, elements.join(known, ["predicate", "element"], "left")).select("predicate", "element", "result")


def _judged(predicates: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with result. rows: predicate, given (array of field and value; null for none) and others. Those that give a predicate the same values are judged as one."""
    rows = kept(rows.withColumn("given", F.coalesce("given", F.expr("array()").cast(_GIVEN))), "predicate-given")
    cases = kept(rows.where("predicate IS NOT NULL").select("predicate", "given").distinct(), "predicate-cases")
    results = _results(predicates, cases.select("predicate", F.col("given").alias("element")), cases.select("predicate", F.col("given").alias("element"), F.inline("given")))
    return rows.join(kept(results.select("predicate", F.col("element").alias("given"), "result"), "predicate-results"), ["predicate", "given"], "left").drop("given")


def _results(predicates: DataFrame, elements: DataFrame, values: DataFrame) -> DataFrame:
    """predicate, element and result, from the leaves of each predicate up, for each element on its own."""
    tree, deepest = levels(predicates, ["predicate"])
    leaf = tree.where("op IN ('field', 'value')").join(elements, "predicate")
    known = values.select("predicate", "element", F.col("field").alias("text"), "value").withColumn("op", F.lit("field"))
    leaf = leaf.join(known, ["predicate", "element", "op", "text"], "left").withColumn("value", F.when(F.col("op") == "value", F.col("text")).otherwise(F.col("value")))
    leaf = kept(leaf.select("predicate", "element", "node", "parent", "place", "level", "value", F.lit(True).alias("plain")), "predicate-leaves")
    inner = tree.where("op NOT IN ('field', 'value')").select("predicate", "node", F.col("parent").alias("up"), F.col("place").alias("at"), "op")
    done = leaf.where(F.col("level") == deepest)
    for level in range(deepest - 1, -1, -1):
        operands = done.where("parent IS NOT NULL").groupBy("predicate", "element", F.col("parent").alias("node")).agg(
            F.count("*").alias("n"), F.count("value").alias("known"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("plain").alias("plain"),
            F.min(F.coalesce(F.col("value").isin("b:true", "b:false"), F.lit(False))).alias("booleans"),
        )
        truth = F.when(~F.col("booleans"), None)
        truth = truth.when((F.col("op") == "not") & (F.col("n") == 1), F.col("low") == "b:false")
        truth = truth.when((F.col("op") == "and") & (F.col("n") == 2), F.col("low") == "b:true").when((F.col("op") == "or") & (F.col("n") == 2), F.col("high") == "b:true")
        same = F.when((F.col("n") == 2) & (F.col("known") == 2) & F.col("plain"), F.when(F.col("op") == "eq", F.col("low") == F.col("high")).otherwise(F.col("low") != F.col("high")))
        result = F.when(F.col("op").isin("eq", "ne"), same).otherwise(truth)
        mine = operands.join(inner, ["predicate", "node"]).select("predicate", "element", "node", F.col("up").alias("parent"), F.col("at").alias("place"), F.lit(level).alias("level"), F.concat(F.lit("b:"), result.cast("string")).alias("value"), F.lit(False).alias("plain"))
        done = kept(mine.unionByName(leaf.where(F.col("level") == level)), "predicate-level")
    found = done.where("parent IS NULL").select("predicate", "element", F.when(F.col("value") == "b:true", True).when(F.col("value") == "b:false", False).alias("result"))
    return elements.join(found, ["predicate", "element"], "left")


def static_tables(tables: DataFrame, filters: DataFrame, predicates: DataFrame, values: DataFrame) -> DataFrame:
    """table and element of the elements that pass their table's filters, of tables that are resolved.

    tables: table, element; filters: table, ord (int, from 1), predicate; values: element, field, value. A table of more than 128 elements or with more than two
    filters is unresolved, and so is one in which a filter is unknown for an element that came to it.
    """
    size = tables.groupBy("table").count().where(F.col("count") <= TABLE_ENTRIES).select("table")
    over = filters.where(F.col("ord") > TABLE_FILTERS).select("table").distinct()
    held = values.groupBy("element").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("held"))
    left = tables.join(size, "table").join(over, "table", "left_anti").select("table", "element")
    left = kept(left.join(held, "element", "left").select("table", "element", "held"), "static-tables")
    asked = predicates.where("op = 'field'").groupBy("predicate").agg(F.collect_set("text").alias("fields"))
    for at in range(1, TABLE_FILTERS + 1):
        due = left.join(filters.where(F.col("ord") == at).select("table", "predicate"), "table", "left").join(asked, "predicate", "left")
        judged = _judged(predicates, due.withColumn("given", F.filter("held", lambda h: F.array_contains("fields", h["field"]))).drop("fields"))
        unknown = judged.where("predicate IS NOT NULL AND result IS NULL").select("table").distinct()
        left = kept(judged.where("predicate IS NULL OR result").join(unknown, "table", "left_anti").select("table", "element", "held"), "static-tables")
    return left.drop("held")


def expanded(registrations: DataFrame, tables: DataFrame, most: int = EXPANSIONS) -> tuple[DataFrame, DataFrame]:
    """Routes (site, element, method, path) that registrations give with the elements of their tables, and (site, resolved).

    registrations: site, table, ord (long); tables: table, element, place (int), method, path (null where unknown). The first `most` routes count, in order
    of their sites and places; a site that loses one, or has an element without method or path, or an unresolved table, isn't resolved.
    """
    rows = registrations.join(tables, "table").select("site", "ord", "element", "place", "method", "path")
    first = kept(rows.where("method IS NOT NULL AND path IS NOT NULL").orderBy("ord", "site", "place", "element").limit(most), "expanded")
    n = rows.groupBy("site").agg(F.count("*").alias("n"))
    got = first.groupBy("site").agg(F.count("*").alias("got"))
    sites = registrations.select("site").distinct().join(n, "site", "left").join(got, "site", "left").select("site", F.expr("n IS NOT NULL AND n = coalesce(got, 0)").alias("resolved"))
    return first.select("site", "element", "method", "path"), sites


# -- denial


def denials(statements: DataFrame) -> DataFrame:
    """callable, node and denies of every statement: whether all ways through it end in a refusal.

    statements: callable, node (int), parent (int), place (int), kind (throw, return, expression, if, block, variable, empty or another), role (then, else or null), refuses
    (boolean: it throws a refusal, or its expression sends one), bare (boolean: a return of nothing). An `if` denies with both branches. A block denies if a statement denies, or is a bare
    return right after an expression that refuses, and only expressions, variables and empty statements stand before it.
    """
    before = F.lag(F.struct("kind", "refuses")).over(Window.partitionBy("callable", "parent").orderBy("place", "node"))
    after = statements.withColumn("before", before).withColumn("sent", F.coalesce((F.col("kind") == "return") & F.col("bare") & (F.col("before.kind") == "expression") & F.col("before.refuses"), F.lit(False))).drop("before")
    tree, deepest = levels(kept(after, "statements"), ["callable"])
    own = F.when(F.col("kind").isin("throw", "return"), F.coalesce("refuses", F.lit(False))).otherwise(False)
    out, done = [], None
    for level in range(deepest, -1, -1):
        mine = tree.where(F.col("level") == level)
        if done is None:
            mine = mine.withColumn("denies", own)
        else:
            quiet = F.col("kind").isin("expression", "variable", "empty")
            hit = F.col("denies") | F.col("sent")
            below = done.groupBy("callable", F.col("parent").alias("node")).agg(
                F.min(F.when(hit, F.struct("place", "node"))).alias("hit"), F.min(F.when(~hit & ~quiet, F.struct("place", "node"))).alias("stop"),
                F.max(F.when(F.col("role") == "then", F.col("denies"))).alias("then"), F.max(F.when(F.col("role") == "else", F.col("denies"))).alias("other"),
            )
            block = F.col("hit").isNotNull() & (F.col("stop").isNull() | (F.col("hit") < F.col("stop")))
            denies = F.when(F.col("kind") == "block", block).when(F.col("kind") == "if", F.coalesce(F.col("then") & F.col("other"), F.lit(False))).otherwise(own)
            mine = mine.join(below, ["callable", "node"], "left").withColumn("denies", F.coalesce(denies, F.lit(False))).drop("hit", "stop", "then", "other")
        done = kept(mine.select("callable", "node", "parent", "place", "kind", "role", "sent", "denies"), "denials")
        out.append(done.select("callable", "node", "denies"))
    return reduce(DataFrame.unionByName, out)


def enforced(comparisons: DataFrame, statements: DataFrame) -> DataFrame:
    """callable and node of the `if`s whose comparison is enforced. comparisons: callable, node (the if), equal (boolean), negated (boolean).

    Access goes on where owner and identity are equal: `if (a !== b)` and `if (!(a === b))` must deny in what follows, the other two in
    their `else`.
    """
    branch = statements.where("role IS NOT NULL").join(denials(statements).where("denies"), ["callable", "node"]).select("callable", F.col("parent").alias("node"), "role").distinct()
    due = F.when(F.col("equal") == F.col("negated"), "then").otherwise("else")
    return comparisons.withColumn("role", due).join(branch, ["callable", "node", "role"], "left_semi").select("callable", "node").distinct()


# -- identity aliases and calls


def aliases(seeds: DataFrame, bindings: DataFrame) -> DataFrame:
    """callable, start and name: what each seed (callable, start, name) comes to through bindings (callable, root, target), delta by delta; each callable is closed on its own."""
    fresh = kept(seeds.select("callable", "start", "name").distinct(), "aliases")
    all_ = [fresh]
    steps = kept(bindings.select("callable", F.col("root").alias("name"), "target").distinct(), "bindings")
    while not fresh.isEmpty():
        new = fresh.join(steps, ["callable", "name"]).select("callable", "start", F.col("target").alias("name")).distinct()
        fresh = kept(new.join(reduce(DataFrame.unionByName, all_), ["callable", "start", "name"], "left_anti"), "aliases")
        all_.append(fresh)
    return reduce(DataFrame.unionByName, all_)


def call_semantics(roots: DataFrame, callables: DataFrame, calls: DataFrame, arguments: DataFrame, bindings: DataFrame, seeds: DataFrame, proofs: DataFrame, depth: int = CALL_DEPTH, most: int = CALLABLES, forwards: int = FORWARDS) -> DataFrame:
    """root, owned, roles, object, n (states seen) and whole of each root callable (roots: root).

    callables: callable, guards, roles, object (booleans); calls: callable, call, place (int), callee, denied (its caller refuses when it fails), returned (its result is the caller's), filters
    (its result is a filter); arguments: call, name (the caller's), parameter (the callee's); bindings and seeds (callable, name) as for
    `aliases`; proofs: callable, name, kind (binding, filter, predicate), what holds if the name carries the identity.

    A breadth-first search over states: a callable, the parameters that carry the caller's identity, whether its verdict is
    enforced, how often that was forwarded, and whether its result is a filter. Calls go `depth` deep; the first `most` states of a
    root count, in the order of the search, and a root with more isn't whole. A predicate proves ownership only where enforced.
    """
    nodes, state, facts = _callable_nodes(callables, calls, arguments, bindings, seeds, proofs), ["callable", "carried", "enforced", "forwarded", "filtered"], ["guards", "roles", "object", "proved"]
    carried = F.array_union(F.array(F.lit("")), F.split("carried", ","))

    def met(frontier: DataFrame) -> DataFrame:
        """The states with what is known of them (to: null), and what their calls lead to."""
        holds = lambda p: F.array_contains("names", p["start"]) & ((p["kind"] == "binding") | ((p["kind"] == "filter") & F.col("filtered")) | ((p["kind"] == "predicate") & F.col("enforced")))
        at = frontier.drop(*facts).join(nodes, "callable", "left").withColumn("names", carried).withColumn("proved", F.exists("proofs", holds))
        return at.select("root", *state, "rank", "level", *(F.coalesce(f, F.lit(False)).alias(f) for f in facts), "names", "calls")

    def called(c: Column) -> Column:
        passed = F.array_distinct(F.transform(F.filter(c["gives"], lambda g: F.array_contains("names", g["start"])), lambda g: g["parameter"]))
        forward = ~c["denied"] & F.col("enforced") & c["returned"] & (F.col("forwarded") < forwards)
        return F.struct(
            c["callee"].alias("callable"), F.array_join(F.array_sort(passed), ",").alias("carried"), (c["denied"] | forward).alias("enforced"), F.when(forward, F.col("forwarded") + 1).otherwise(0).alias("forwarded"),
            c["filters"].alias("filtered"), c["at"].alias("at"),
        )

    first = roots.select("root", F.col("root").alias("callable"), F.lit("").alias("carried"), F.lit(False).alias("enforced"), F.lit(0).alias("forwarded"), F.lit(False).alias("filtered"), F.lit(1).alias("rank"), F.lit(0).alias("level")).distinct()
    seen = kept(first.select("*", *(F.lit(None).cast("boolean").alias(f) for f in facts)), "states")
    order = Window.partitionBy("root").orderBy(F.col("rank").asc_nulls_last(), "via", *state)
    for level in range(depth):
        frontier = seen.where((F.col("level") == level) & (F.col("rank") <= most))
        if frontier.isEmpty():
            break
        here = met(frontier).withColumn("to", F.transform("calls", called)).drop("names", "calls")
        earlier = seen.where((F.col("level") < level) | (F.col("rank") > most))
        # one shuffle by root, calls within their caller's row, drops the states seen before and ranks the new ones after them
        one = here.unionByName(earlier, allowMissingColumns=True).repartition("root").withColumn("to", F.explode(F.concat(F.array(F.lit(None)), F.coalesce("to", F.array()))))
        own = F.col("to").isNull()
        one = one.select("root", *(F.when(own, F.col(c)).otherwise(F.col(f"to.{c}")).alias(c) for c in state), *(F.when(own, F.col(c)).alias(c) for c in ("rank", "level", *facts)), F.when(~own, F.struct("rank", "to.at")).alias("via"))
        one = one.groupBy("root", *state).agg(*(F.max(c).alias(c) for c in ("rank", "level", *facts)), F.min("via").alias("via"))
        one = one.withColumn("level", F.coalesce("level", F.lit(level + 1))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most + 1).drop("via")
        seen = kept(one, "states")
    last = met(seen.where((F.col("level") == depth) & (F.col("rank") <= most))).select(seen.columns)
    told = seen.where((F.col("level") < depth) | (F.col("rank") > most)).unionByName(last).groupBy("root").agg(*(F.max(F.coalesce(f, F.lit(False))).alias(f) for f in facts), F.count_if(F.col("rank") <= most).alias("n"), (F.max("rank") <= most).alias("whole"))
    return told.select("root", (F.col("guards") | F.col("proved")).alias("owned"), "roles", "object", "n", "whole")


def _callable_nodes(callables: DataFrame, calls: DataFrame, arguments: DataFrame, bindings: DataFrame, seeds: DataFrame, proofs: DataFrame) -> DataFrame:
    """A row for each callable, in buckets: guards, roles, object, its calls with what they pass on (gives: start and parameter), and its proofs by start.

    A start is a parameter that carries the identity, or "" for the callable's own seeds, whatever else is carried. It gives what a call passes under a name that it comes to.
    """
    back = aliases(bindings.select("callable", F.col("root").alias("start"), F.col("root").alias("name")), bindings.where("root <> target")).where("start <> name")
    passed = arguments.groupBy("call").agg(F.collect_set(F.struct("name", "parameter")).alias("passed"))
    parts = [
        callables.select("callable", "guards", "roles", "object"),
        calls.join(passed, "call", "left").select("callable", F.struct("place", "call", "callee", "denied", "returned", "filters", "passed").alias("call")),
        back.select("callable", F.struct("name", "start").alias("back")), seeds.select("callable", F.col("name").alias("seed")), proofs.select("callable", F.struct("name", "kind").alias("proof")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("callable").agg(
        F.max("guards").alias("guards"), F.max("roles").alias("roles"), F.max("object").alias("object"), F.sort_array(F.collect_list("call")).alias("calls"), F.collect_set("back").alias("backs"), F.collect_set("seed").alias("seeds"), F.collect_set("proof").alias("proofs"),
    )

    def starts(name: Column) -> Column:
        mine = F.concat(F.array(name), F.transform(F.filter("backs", lambda b: b["name"] == name), lambda b: b["start"]))
        return F.when(F.arrays_overlap(mine, "seeds"), F.concat(mine, F.array(F.lit("")))).otherwise(mine)

    def call(c: Column) -> Column:
        gives = F.flatten(F.transform(c["passed"], lambda a: F.transform(starts(a["name"]), lambda s: F.struct(s.alias("start"), a["parameter"].alias("parameter")))))
        return F.struct(*(c[n].alias(n) for n in ("callee", "denied", "returned", "filters")), F.coalesce(gives, F.array()).alias("gives"))

    def placed(calls: Column) -> Column:
        """Each call with its place in the order of place and call, the same for all callees of one."""
        key = lambda i: F.struct(F.get(calls, i)["place"], F.get(calls, i)["call"])
        first = F.transform(calls, lambda c, i: F.when(key(i).eqNullSafe(key(i - 1)), -1).otherwise(i))
        at = A.running(first, lambda a, b: F.greatest(a, b))
        return F.zip_with(F.transform(calls, call), F.zip_with(first, at, lambda own, before: F.greatest(own, before)), lambda c, i: c.withField("at", i))

    proved = F.flatten(F.transform("proofs", lambda p: F.transform(starts(p["name"]), lambda s: F.struct(s.alias("start"), p["kind"].alias("kind")))))
    return bucketed(rows.select("callable", "guards", "roles", "object", A.let(F.col("calls"), placed).alias("calls"), proved.alias("proofs")), "callable", "callables")


def receivers(known: DataFrame, passes: DataFrame) -> DataFrame:
    """key and receiver of names that stand for an application or router: the known ones, and parameters that were given one.

    known: key, receiver; passes: ord (long, the call's place among all), argument, parameter (keys). Calls are gone through in order, again and again, until nothing is new; the first
    receiver that comes to a parameter stays. So each key is labelled with the round and place at which it got its receiver:
    a call later in that round passes it on in the same round, an earlier one in the next. A round here extends the labels that became smaller.
    """
    best = kept(known.groupBy("key").agg(F.min(F.struct(F.lit(1).alias("turn"), F.lit(-1).cast("long").alias("ord"), "receiver")).alias("label")), "receivers")
    fresh, passes = best, kept(passes.select("ord", "argument", "parameter"), "passes")
    while not fresh.isEmpty():
        given = fresh.withColumnRenamed("key", "argument").join(passes, "argument")
        turn = F.when(F.col("ord") > F.col("label.ord"), F.col("label.turn")).otherwise(F.col("label.turn") + 1)
        new = given.groupBy(F.col("parameter").alias("key")).agg(F.min(F.struct(turn.alias("turn"), F.col("ord").alias("ord"), F.col("label.receiver").alias("receiver"))).alias("label"))
        old = best.select("key", F.col("label").alias("old"))
        nearer = "old IS NULL OR (label.turn, label.ord) < (old.turn, old.ord) OR ((label.turn, label.ord) = (old.turn, old.ord) AND label.receiver <> old.receiver)"  # one call, whose argument got another label
        fresh = kept(new.join(old, "key", "left").where(nearer).drop("old"), "receivers")
        best = kept(best.join(fresh, "key", "left_anti").unionByName(fresh), "receivers")
    return best.select("key", "label.receiver")


# -- settings of an application and versions of a route


def settings(applications: DataFrame, events: DataFrame) -> DataFrame:
    """app, prefix, versioned, version_prefix, closed, guards (how many) and resolved of every application.

    applications: app, bound (long: where its variable is bound); events: app, at (long), op (prefix, versions, guards, close), scoped (boolean: a plain statement of the block that binds it), outcome
    (resolved, partial, unresolved), value. The last prefix and the last versions win, of events after the binding; a partial one counts but leaves the
    application unresolved, one that can't be read or isn't scoped leaves what was before it. Closing holds wherever it stands.
    """
    found = applications.join(events, "app", "left").withColumn("due", F.col("scoped") & (F.col("at") > F.col("bound")))
    last = lambda op: F.max(F.when(F.col("due") & (F.col("op") == op) & (F.col("outcome") != "unresolved"), F.struct("at", "value")))["value"]
    spoilt = F.col("op").isin("prefix", "versions", "guards") & ~(F.col("due") & ((F.col("op") == "guards") | (F.col("outcome") == "resolved")))
    got = found.groupBy("app").agg(
        F.coalesce(last("prefix"), F.lit("")).alias("prefix"), last("versions").alias("version_prefix"),
        F.max(F.coalesce(F.col("due") & (F.col("op") == "close"), F.lit(False))).alias("closed"),
        F.sum(F.when(F.col("due") & (F.col("op") == "guards"), 1).otherwise(0)).alias("guards"), F.max(F.coalesce(spoilt, F.lit(False))).alias("spoilt"),
    )
    return got.select("app", "prefix", F.col("version_prefix").isNotNull().alias("versioned"), F.coalesce("version_prefix", F.lit("v")).alias("version_prefix"), "closed", "guards", (~F.col("spoilt")).alias("resolved"))


def versioned_paths(routes: DataFrame, config: DataFrame, versions: DataFrame, defaults: DataFrame, exclusions: DataFrame) -> DataFrame:
    """route, method and path, once for each prefix and version that the route answers under.

    routes: route, app, method, path; config: app, prefix, module_prefix, versioned (boolean), version_prefix; versions: route, version; defaults: app, version (null: the neutral one); exclusions: app,
    path, method (null: every one). Own versions come before the application's, and neither counts unless paths are versioned. An excluded path drops the
    prefix for its method; for every method if it names none; a route of every method answers with and without it.
    """
    rows = routes.join(config, "app").withColumn("routed", joined_path(F.col("module_prefix"), F.col("path")))
    own = versions.select("route", F.lit(True).alias("has_own"), F.col("version").alias("own_version"))
    app = defaults.select("app", F.lit(True).alias("has_default"), F.col("version").alias("default_version"))
    rows = rows.join(own, (rows["route"] == own["route"]) & rows["versioned"], "left").drop(own["route"])
    rows = rows.join(app, (rows["app"] == app["app"]) & rows["versioned"] & F.col("has_own").isNull(), "left").drop(app["app"])
    version = F.when(F.col("has_own"), F.col("own_version")).otherwise(F.col("default_version"))
    barred = exclusions.select("app", joined_path(F.col("path")).alias("routed"), F.coalesce("method", F.lit("ALL")).alias("but"))
    barred = barred.groupBy("app", "routed").agg(F.max((F.col("but") == "ALL").cast("int")).alias("all"), F.collect_set("but").alias("buts"))
    rows = rows.join(barred, ["app", "routed"], "left")
    bare, with_it = F.array(F.lit("")), F.array("prefix")
    prefixes = F.when(F.col("all") == 1, bare).when(F.col("buts").isNull(), with_it).when(F.col("method") == "ALL", F.array(F.lit(""), F.col("prefix"))).when(F.array_contains("buts", F.col("method")), bare).otherwise(with_it)
    rows = rows.withColumn("before", F.explode(prefixes))
    stated = F.when(version.isNull(), F.lit("")).otherwise(F.concat("version_prefix", version))
    return rows.select("route", "method", joined_path(F.col("before"), stated, F.col("routed")).alias("path")).distinct()
