"""The asset graph of a project: what it contains, exposes, uses, ships and calls, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.sources import tree

#: Asset kind, label, relation to the project, and the dependencies and paths that show it.
SHOWN_BY = (
    ("client", "Web client", "contains", ("react", "next"), None),
    ("server", "Application server", "contains", ("next", "express", "@nestjs/core"), None),
    ("database", "Supabase", "uses", ("@supabase/supabase-js",), r"supabase/(?:migrations|config\.toml)"),
    ("database", "Firebase", "uses", ("firebase",), r"firebase\.json$|(?:firestore|storage)\.rules$"),
    ("mobile_app", "Android", "ships", (), r"AndroidManifest\.xml$"),
    ("mobile_app", "iOS", "ships", (), r"Info\.plist$|Podfile(?:\.lock)?$"),
    ("mobile_app", "Flutter", "ships", (), r"pubspec\.yaml$"),
    ("mobile_app", "React Native", "ships", ("react-native",), None),
    ("llm", "OpenAI", "calls", ("openai",), None),
    ("llm", "LangChain", "calls", ("langchain", "@langchain/core"), None),
    ("llm", "Vercel AI SDK", "calls", ("ai",), None),
    ("llm", "MCP", "calls", ("@modelcontextprotocol/sdk",), None),
)
#: Kinds whose labels are one asset together.
TOGETHER = ("mobile_app", "llm")


def facts(files: DataFrame, routes: DataFrame) -> DataFrame:
    """kind, label and relation of what files and routes (route string) show. One pass over paths, one over manifests."""
    names = F.coalesce("name", F.lit(""))
    path = F.coalesce("relative_path", F.lit(""))

    def shown(deps: tuple[str, ...], pattern: str | None) -> Column:
        by_name = names.isin(*deps) if deps else F.lit(False)
        return by_name | path.rlike(pattern) if pattern else by_name

    seen = tree.dependencies(files).select("name", F.lit(None).cast("string").alias("relative_path")).unionByName(files.select(F.lit(None).cast("string").alias("name"), "relative_path"))
    each = F.array(*(F.when(shown(d, p), F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.lit(label).alias("label"), F.lit(r).alias("relation"))) for i, (k, label, r, d, p) in enumerate(SHOWN_BY)))
    rows = seen.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.*").distinct()
    joined = rows.where(F.col("kind").isin(*TOGETHER)).groupBy("kind", "relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), " + ").alias("label"))  # of SHOWN_BY
    alone = rows.where(~F.col("kind").isin(*TOGETHER)).select("kind", "label", "relation")
    auth = alone.where("kind = 'database'").select(F.lit("auth").alias("kind"), F.concat("label", F.lit(" Auth")).alias("label"), "relation")
    exposed = routes.select(F.lit("api_route").alias("kind"), F.col("route").alias("label"), F.lit("exposes").alias("relation")).distinct()
    return alone.unionByName(auth).unionByName(joined.select("kind", "label", "relation")).unionByName(exposed)


def graph(found: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label), each once, and edges (from_id, to_id, relation)."""
    root = T.stable_id("asset", F.lit("project"), F.lit(project))
    rows = found.select(T.stable_id("asset", F.col("kind"), F.col("label")).alias("id"), "kind", "label", "relation")
    nodes = rows.select("id", "kind", "label").distinct()
    nodes = nodes.unionByName(found.sparkSession.range(1).select(root.alias("id"), F.lit("project").alias("kind"), F.lit(project).alias("label")))
    edges = rows.select(root.alias("from_id"), F.col("id").alias("to_id"), "relation")
    data = rows.where("kind = 'database'").select(F.col("id").alias("to_id"), F.concat("label", F.lit(" Auth")).alias("auth"))
    guards = data.select(T.stable_id("asset", F.lit("auth"), F.col("auth")).alias("from_id"), "to_id", F.lit("authorizes").alias("relation"))
    return nodes, edges.unionByName(guards)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row for each key, as routes that are declared twice have it."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("_last")).select(*keys, "_last.*")
