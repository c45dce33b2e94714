"""Project trees as files: which paths are text, which folders are left out, and the budgets of a walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.durable import kept

#: Folders that hold no source of the project.
EXCLUDED = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", ".tox", ".nox", "site-packages", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "vendor", "Pods", ".dart_tool", ".gradle", ".next", ".nuxt", "dist", "build", "coverage", ".cache", ".idea", ".vscode")
#: Extensions and names of text files.
EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".env", ".sql", ".dart", ".java", ".kt", ".kts", ".swift", ".m", ".mm", ".xml", ".plist", ".gradle", ".properties", ".html", ".css", ".scss", ".md", ".py", ".go", ".rb", ".php", ".cs", ".rs", ".sh", ".graphql", ".rules")
MANIFESTS = ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pubspec.yaml", "pubspec.lock", "Podfile", "Podfile.lock", "Gemfile", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "AndroidManifest.xml", "Info.plist", "firebase.json", ".firebaserc", "app.json", "app.config.js", "app.config.ts")
LIMITS = {"max_files": 20_000, "max_file_bytes": 2 << 20, "max_total_bytes": 64 << 20, "max_depth": 64}
#: Reasons that make an inventory partial.
PARTIAL = ("entry_limit", "depth_limit", "file_limit", "total_byte_limit", "oversized_file", "unreadable")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_text(path: Column) -> Column:
    name = basename(path)
    ext = F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))
    return name.isin(*MANIFESTS) | name.startswith(".env") | name.startswith("Dockerfile") | ext.isin(*EXTENSIONS)


def is_excluded(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, excluded)))


def walked(path: Column) -> Column:
    """What paths are sorted by in a walk that sorts each folder's names and goes down at once: their parts, by Unicode collation."""
    return F.split(path, "/").cast("array<string collate UNICODE>")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size, content and walk_pos of the text files below a folder. Paths alone are sorted and numbered, contents are not."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1)
    rows = listed.select(path.alias("relative_path"), F.col("length").alias("size"), "content").where(is_text(F.col("relative_path")))
    placed = kept(rows.select("relative_path").orderBy(walked(F.col("relative_path"))).withColumn("walk_pos", F.monotonically_increasing_id()), "walk")  # written, so that places stay as they are
    return kept(rows.withColumn("content", F.decode("content", "UTF-8")).join(placed, "relative_path"), "tree")


def running_before(rows: DataFrame, value: Column, width: int = 100_000) -> DataFrame:
    """rows with before, the sum of value over smaller walk_pos. First by block of walk_pos, then over the blocks, so no task sorts everything."""
    blocked = rows.withColumn("_v", value.cast("long")).withColumn("_block", F.floor(F.col("walk_pos") / width))
    sums = blocked.groupBy("_block").agg(F.sum("_v").alias("_s"))
    base = sums.select("_block", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_block").orderBy("walk_pos").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(base, "_block").withColumn("before", F.col("_base") + F.coalesce(F.sum("_v").over(own), F.lit(0))).drop("_v", "_block", "_base")


def judged(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """files with skip: null if a file is taken, else why not. Budgets cut the walk at the first file beyond them.

    Entries are counted by files, five for each that may be taken: folders of their own are not listed. Where budgets cut
    is found on places and sizes alone, so that no content is shuffled.
    """
    path, entries = F.col("relative_path"), min(100_000, 5 * limits["max_files"])
    plain = (
        F.when(is_excluded(path), "excluded_directory")
        .when(F.size(F.split(path, "/")) > limits["max_depth"], "depth_limit")
        .when(~is_text(path), "not_text")
        .when(F.col("size") > limits["max_file_bytes"], "oversized_file")
    )
    slim = files.select("walk_pos", "size", plain.isNull().alias("_read"), (F.instr("content", "\0") > 0).alias("_nul"))
    slim = running_before(slim, F.lit(1)).withColumnRenamed("before", "_seen")
    slim = running_before(slim, F.when(F.col("_read"), F.col("size")).otherwise(0)).withColumnRenamed("before", "_bytes")
    slim = running_before(slim, F.when(F.col("_read") & ~F.col("_nul"), 1).otherwise(0)).withColumnRenamed("before", "_files")
    at = lambda beyond: F.min(F.when(beyond, F.col("walk_pos")))
    first = slim.agg(at(F.col("_seen") >= entries).alias("_last"), at(F.col("_read") & (F.col("_bytes") + F.col("size") > limits["max_total_bytes"])).alias("_cut"), at(F.col("_read") & (F.col("_files") >= limits["max_files"])).alias("_full"))
    rows = files.crossJoin(F.broadcast(first))  # one row
    late = F.when(F.col("walk_pos") >= F.col("_last"), "entry_limit").when(F.col("walk_pos") >= F.col("_full"), "file_limit").when(F.col("walk_pos") >= F.col("_cut"), "total_byte_limit")
    skip = F.when(plain.isNull(), F.coalesce(late, F.when(F.instr("content", "\0") > 0, "binary"))).otherwise(plain)
    return rows.withColumn("skip", skip).drop("_last", "_cut", "_full")


def skip_counts(files: DataFrame) -> DataFrame:
    return files.where("skip IS NOT NULL").groupBy(F.col("skip").alias("reason")).agg(F.count("*").cast("long").alias("n"))


def inventory_coverage(skips: DataFrame) -> DataFrame:
    """One row: partial if something was cut off, and the reasons."""
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isin(*PARTIAL), F.concat_ws(": ", "reason", F.col("n").cast("string"))))), ", ")
    got = skips.agg(said.alias("reason"))
    return got.select(F.lit("project-inventory").alias("domain"), F.lit("native").alias("engine"), F.when(F.col("reason") == "", "complete").otherwise("partial").alias("status"), F.lit(True).alias("required"), F.nullif("reason", F.lit("")).alias("reason"))


def dependencies(files: DataFrame) -> DataFrame:
    """relative_path and name of each dependency of a package manifest; bad JSON has none."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>"
    parsed = files.where(basename(F.col("relative_path")) == "package.json").withColumn("p", F.from_json("content", kind))
    keys = lambda c: F.coalesce(F.map_keys(F.col(f"p.{c}")), F.array().cast("array<string>"))
    return parsed.select("relative_path", F.explode(F.array_union(keys("dependencies"), keys("devDependencies"))).alias("name")).distinct()


#: What an extension, a dependency or a path says about a project.
LANGUAGES = {"javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx", ".mts", ".cts"), "python": (".py",), "dart": (".dart",), "kotlin": (".kt", ".kts"), "java": (".java",), "swift": (".swift",), "go": (".go",), "ruby": (".rb",), "php": (".php",), "rust": (".rs",), "csharp": (".cs",)}
FRAMEWORKS = {"next": "nextjs", "express": "express", "@nestjs/core": "nestjs", "react-native": "react-native", "expo": "expo", "vue": "vue", "react": "react", "firebase": "firebase", "@supabase/supabase-js": "supabase"}
LOCKS = ("pnpm-lock.yaml", "yarn.lock", "package-lock.json")


def profile(files: DataFrame) -> DataFrame:
    """One row: sorted languages, frameworks and package managers, and the number of files."""
    ext = F.lower(F.regexp_extract("relative_path", r"[^/](\.[^./]*)$", 1))
    language = F.when(F.lit(False), "")
    for name, exts in LANGUAGES.items():
        language = language.when(ext.isin(*exts), name)
    name = basename(F.col("relative_path"))
    got = files.agg(F.sort_array(F.collect_set(language)).alias("languages"), F.sort_array(F.collect_set(F.when(name.isin(*LOCKS), name))).alias("locks"), F.count("*").cast("long").alias("file_count"))
    known = F.create_map(*(F.lit(x) for kv in FRAMEWORKS.items() for x in kv))
    frameworks = dependencies(files).select(F.try_element_at(known, F.col("name")).alias("f")).agg(F.sort_array(F.collect_set("f")).alias("frameworks"))
    manager = F.when(F.array_contains("locks", "pnpm-lock.yaml"), "pnpm").when(F.array_contains("locks", "yarn.lock"), "yarn").when(F.size("locks") > 0, "npm")
    return got.crossJoin(frameworks).select("languages", "frameworks", manager.alias("package_manager"), "file_count")  # one row each
