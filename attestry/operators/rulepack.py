"""Declarative rule packs: user rules of literals, joined to files by a selector and to lines by what they contain.

Rules are at most 256 (MAX_RULES is checked), so they are broadcast; files and lines are never shuffled for matching.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T

MAX_PACKS, MAX_RULES = 8, 256
#: Files of a walk whose costs one task adds up; shown pairs of all rules together.
WALK_BLOCK, MAX_SHOWN = 100_000, 2000
#: Shared budgets of a scan: rule and file pairs, bytes, bytes times literals, lines.
BUDGETS = {"pairs": 1_000_000, "bytes": 256 << 20, "literal_bytes": 256 << 20, "lines": 2_000_000}


def checked(rules: DataFrame) -> DataFrame:
    """rules, or an error if there are too many packs or rules, or one id twice."""
    n = rules.agg(F.count("*").alias("rules"), F.count_distinct("pack_id").alias("packs"), F.count_distinct("rule_id").alias("ids")).first()
    if n["packs"] > MAX_PACKS or n["rules"] > MAX_RULES or n["ids"] < n["rules"]:
        raise ValueError(f"{n['packs']} packs and {n['rules']} rules with {n['ids']} ids: at most {MAX_PACKS} and {MAX_RULES}, each id once")
    return rules


def numbered(rules: DataFrame) -> DataFrame:
    """rules with rule_no, their place in the order of packs and rules."""
    return rules.withColumn("rule_no", F.row_number().over(Window.orderBy("pack_id", "rule_id")) - 1)  # at most MAX_RULES rows


def extension(path: Column) -> Column:
    """The last extension of a path's last part, lower case; a leading dot starts none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def selected(path: Column) -> Column:
    starts = lambda p: path.startswith(p)
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    return (
        F.array_contains("extensions", extension(path))
        & (none("path_prefixes") | F.exists("path_prefixes", starts))
        & (none("path_suffixes") | F.exists("path_suffixes", lambda s: path.endswith(s)))
        & (none("exclude_prefixes") | ~F.exists("exclude_prefixes", starts))
    )


def line_matches(line: Column) -> Column:
    fold = lambda x: F.when(F.coalesce("case_sensitive", F.lit(True)), x).otherwise(F.lower(x))
    of = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    has = lambda x: F.contains(fold(line), fold(x))
    return ~F.exists(of("excludes"), has) & F.exists(of("contains_any"), has) & F.forall(of("contains_all"), has)


def pairs(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with the files that they select."""
    return files.join(F.broadcast(checked(rules)), selected(F.col("relative_path")))


def with_lines(selected_pairs: DataFrame) -> DataFrame:
    lines = selected_pairs.select("*", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).drop("content")
    return lines.withColumn("line", F.regexp_replace("line", r"\r$", "")).withColumn("line_no", F.col("line_no") + 1)


def present(files: DataFrame, rules: DataFrame) -> DataFrame:
    """A signal for each line that a present rule matches."""
    hits = with_lines(pairs(files, rules.where("coalesce(emit_when, 'present') = 'present'"))).where(line_matches(F.col("line")))
    return _signals(hits.withColumn("snippet", T.snippet(F.col("line"))))


def absent(files: DataFrame, rules: DataFrame) -> DataFrame:
    """A signal for each file that an absent rule selects and that has no matching line."""
    due = pairs(files, rules.where("emit_when = 'absent'"))
    matching = F.exists(F.transform(F.split("content", "\n", -1), lambda x: F.regexp_replace(x, r"\r$", "")), line_matches)
    return _signals(due.where(~matching).drop("content").withColumn("line_no", F.lit(None).cast("int")).withColumn("snippet", F.lit(None).cast("string")))


def _signals(hits: DataFrame) -> DataFrame:
    fp = T.fingerprint(F.lit("rule-pack"), F.col("rule_id"), F.col("relative_path"), F.col("snippet"))
    return hits.withColumn("fingerprint", fp).select(T.signal_id(F.col("fingerprint"), F.col("line_no")).alias("id"), "fingerprint", F.lit("rule-pack").alias("engine"), "rule_id", "title", "severity", "evidence_level", F.col("relative_path").alias("path"), F.col("line_no").alias("line"), "snippet", "pack_id", F.coalesce("emit_when", F.lit("present")).alias("emit_when"), *(["walk_pos", "rule_no", "confidence"] if "rule_no" in hits.columns else []))


def coverage(files: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each pack: partial if an absent rule of its selects no file."""
    counts = rules.select("pack_id", "rule_id", F.coalesce("emit_when", F.lit("present")).alias("emit_when")).join(pairs(files.drop("content"), rules).groupBy("rule_id").agg(F.count("*").alias("n_files")), "rule_id", "left")
    idle = F.array_sort(F.collect_list(F.when((F.col("emit_when") == "absent") & F.col("n_files").isNull(), F.col("rule_id"))))
    got = counts.groupBy("pack_id").agg(idle.alias("idle"))
    more = F.when(F.size("idle") > 1, F.concat(F.lit("; "), (F.size("idle") - 1).cast("string"), F.lit(" additional absent rule(s) also selected no files"))).otherwise("")
    reason = F.when(F.size("idle") > 0, F.concat(F.lit("custom absent rule "), F.try_element_at("idle", F.lit(1)), F.lit(" selected no files"), more))
    return got.select(F.concat(F.lit("rule-pack:"), "pack_id").alias("domain"), F.lit("rule-pack").alias("engine"), F.when(F.size("idle") > 0, "partial").otherwise("complete").alias("status"), F.lit(True).alias("required"), reason.alias("reason"))


def preview(files: DataFrame, rules: DataFrame, per_rule: int = 100, total: int = MAX_SHOWN) -> DataFrame:
    """Which files each rule selects, without reading their text: how many, the first ones in the order of the walk (per_rule of a rule and total of all), how many more."""
    chosen = pairs(files.drop("content"), rules).select("pack_id", "rule_id", "relative_path", "walk_pos")
    n = chosen.groupBy("pack_id", "rule_id").agg(F.count("*").cast("long").alias("n_files"))
    out = rules.select("pack_id", "rule_id").join(n, ["pack_id", "rule_id"], "left").select("pack_id", "rule_id", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    before = Window.orderBy("pack_id", "rule_id").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_RULES rows
    left = F.greatest(F.lit(total) - F.coalesce(F.sum(F.least("n_files", F.lit(per_rule))).over(before), F.lit(0)), F.lit(0))
    room = out.withColumn("room", F.least(left, F.lit(per_rule)))
    first = chosen.withColumn("_rn", F.row_number().over(Window.partitionBy("pack_id", "rule_id").orderBy("walk_pos"))).where(F.col("_rn") <= per_rule)
    first = first.groupBy("pack_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "relative_path"))), lambda x: x["relative_path"]).alias("paths"))  # at most per_rule of each
    got = room.join(first, ["pack_id", "rule_id"], "left").withColumn("paths", F.slice(F.coalesce("paths", F.array().cast("array<string>")), F.lit(1), F.col("room").cast("int")))
    return got.select("pack_id", "rule_id", "n_files", "paths", (F.col("n_files") - F.size("paths")).alias("omitted"))


def within_budgets(selected_pairs: DataFrame, budgets: dict[str, int] = BUDGETS) -> DataFrame:
    """relative_path, size, walk_pos, pack_id and rule_id of the pairs before the first that exceeds a budget, in the order of packs, rules and files.

    Running sums go in two steps, by blocks of a rule's walk and then over the blocks, so that no task holds a rule's
    pairs; texts are measured where they are and not shuffled.
    """
    literals = F.greatest(sum((F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("contains_any", "contains_all", "excludes")), F.lit(0)), F.lit(1))
    lines = (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("long")
    cost = selected_pairs.select("relative_path", "size", "walk_pos", "pack_id", "rule_id", F.lit(1).cast("long").alias("pairs"), F.col("size").alias("bytes"), (F.col("size") * literals).alias("literal_bytes"), lines.alias("lines"), F.floor(F.col("walk_pos") / WALK_BLOCK).alias("_block"))
    limits = {k: v for k, v in (BUDGETS | budgets).items()}
    by_block = cost.groupBy("pack_id", "rule_id", "_block").agg(*(F.sum(c).alias(f"_t_{c}") for c in limits))
    before = Window.orderBy("pack_id", "rule_id", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for WALK_BLOCK files of a rule
    base = by_block.select("pack_id", "rule_id", "_block", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in limits))
    own = Window.partitionBy("pack_id", "rule_id", "_block").orderBy("walk_pos").rowsBetween(Window.unboundedPreceding, 0)
    run = cost.join(base, ["pack_id", "rule_id", "_block"])
    over = reduce(lambda a, b: a | b, (F.sum(c).over(own) + F.col(f"_b_{c}") > limits[c] for c in limits))
    return run.withColumn("over", over).where("NOT over").select("relative_path", "size", "walk_pos", "pack_id", "rule_id")
