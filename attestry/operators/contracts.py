"""Constraints as counts of what violates them, scores of a rule corpus, and contracts for a fix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checks(*each: tuple[str, DataFrame]) -> DataFrame:
    """check_id and violations: one count for each query of violating rows."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").cast("long").alias("violations")).select(F.lit(name).alias("check_id"), "violations") for name, rows in each])


def report_checks(signals: DataFrame, findings: DataFrame, coverage: DataFrame) -> DataFrame:
    ids = signals.select(F.col("id").alias("signal_id"))
    used = findings.select("id", F.explode("signal_ids").alias("signal_id"))
    twice = lambda df, c: df.groupBy(c).count().where("count > 1")
    return _checks(
        ("signal_id_unique", twice(signals, "id")),
        ("finding_fingerprint_unique", twice(findings, "fingerprint")),
        ("finding_signals_exist", used.join(ids, "signal_id", "left_anti")),
        ("finding_has_signals", findings.where("size(signal_ids) = 0")),
        ("finding_id_of_fingerprint", findings.where("id <> concat('finding_', substr(fingerprint, 1, 16))")),
        ("suppressed_has_reason", findings.where("status = 'suppressed' AND reason IS NULL")),
        ("gap_has_reason", coverage.where("status <> 'complete' AND coalesce(reason, '') = ''")),
    )


def rule_checks(rules: DataFrame) -> DataFrame:
    """What a pack must hold to: ids under the pack's, literals within 16 KiB, no literal both wanted and excluded."""
    size = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.octet_length(x))
    return _checks(
        ("rule_id_unique", rules.groupBy("rule_id").count().where("count > 1")),
        ("rule_id_prefix", rules.where("NOT startswith(rule_id, concat(pack_id, '.'))")),
        ("absent_is_inferred", rules.where("emit_when = 'absent' AND evidence_level <> 'inferred'")),
        ("has_literals", rules.where("size(contains_any) = 0")),
        ("wanted_and_excluded", rules.where("arrays_overlap(coalesce(contains_all, array()), coalesce(excludes, array()))")),
        ("literal_bytes", rules.where(size("contains_any") + size("contains_all") + size("excludes") > 16384)),
        ("safe_selector", rules.where("exists(coalesce(path_prefixes, array()), p -> startswith(p, '/') OR contains(p, '..'))")),
    )


def preview_checks(packs: DataFrame, rules: DataFrame) -> DataFrame:
    """What a preview of rule packs must hold to; safe paths are checked where they are made.

    packs: pack_id, rule_count, status, reasons, inventory_status, file_count; rules: pack_id, rule_id, emit_when, evaluated,
    selected, shown (paths), omitted, status, reasons.
    """
    partial = lambda df: f"({df}status = 'partial')"
    of_packs = rules.groupBy("pack_id").agg(F.count("*").alias("n"), F.bool_or(F.expr(partial(""))).alias("any_partial"))
    whole = packs.join(of_packs, "pack_id", "left").fillna({"n": 0, "any_partial": False})
    sized = rules.join(packs.select("pack_id", "file_count").distinct(), "pack_id")
    return _checks(
        ("pack_unique", packs.groupBy("pack_id").count().where("count > 1")),
        ("rule_unique", rules.groupBy("rule_id").count().where("count > 1")),
        ("rule_count", whole.where("rule_count <> n")),
        ("rule_prefix", rules.where("NOT startswith(rule_id, concat('custom.', pack_id, '.'))")),
        ("file_counts", sized.where("evaluated > file_count OR selected > evaluated")),
        ("selected_counts", rules.where("size(shown) + omitted <> selected")),
        ("rule_status", rules.where(f"{partial('')} <> (size(reasons) > 0)")),
        ("absent_partial", rules.where("emit_when = 'absent' AND selected = 0 AND status <> 'partial'")),
        ("pack_status", whole.where(f"{partial('')} <> ({partial('inventory_')} OR any_partial) OR {partial('')} <> (size(reasons) > 0)")),
    )


def policy_checks(required: DataFrame, blocking: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables of rule_id: what a policy names must be known, and what blocks must be required."""
    return _checks(
        ("required_known", required.join(catalog, "rule_id", "left_anti")),
        ("blocking_known", blocking.join(catalog, "rule_id", "left_anti")),
        ("blocking_required", blocking.join(required, "rule_id", "left_anti")),
    )


def catalog_checks(catalog: DataFrame, profiles: DataFrame) -> DataFrame:
    """catalog: rule_id, profiles (ids); profiles: profile_id."""
    used = catalog.select("rule_id", F.explode("profiles").alias("profile_id"))
    return _checks(("rule_id_unique", catalog.groupBy("rule_id").count().where("count > 1")), ("profile_known", used.join(profiles, "profile_id", "left_anti")), ("has_profile", catalog.where("size(profiles) = 0")))


def scored(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """True and false positives and negatives of (case_id, rule_id) pairs by category and in all, in one rollup.

    expected: category, case_id, rule_id (null where a case expects none); actual: case_id, rule_id.
    """
    cases = expected.select("category", "case_id").distinct()
    e = expected.where("rule_id IS NOT NULL").distinct().withColumn("e", F.lit(1))
    a = actual.join(cases, "case_id").select("category", "case_id", "rule_id").distinct().withColumn("a", F.lit(1))
    both = e.join(a, ["category", "case_id", "rule_id"], "full_outer")
    n = both.rollup("category").agg(F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    ratio = lambda x, y: F.when(y == 0, 1.0).otherwise(x / y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    n = n.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return n.select(F.coalesce("category", F.lit("all")).alias("category"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def fix_contract(findings: DataFrame, signals: DataFrame, paths: DataFrame) -> DataFrame:
    """For each finding its signals in order, their places and advice, and the path's summary."""
    each = findings.select(F.col("id").alias("finding_id"), "attack_path_id", "title", "severity", F.posexplode("signal_ids").alias("pos", "signal_id"))
    own = signals.select(F.col("id").alias("signal_id"), "path", "line", "rule_id")
    place = F.concat_ws(":", F.coalesce("path", F.lit("?")), F.col("line").cast("string"))
    got = each.join(own, "signal_id").groupBy("finding_id", "title", "severity", "attack_path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("place"), "rule_id"))), lambda x: F.concat_ws(" ", x["rule_id"], F.lit("at"), x["place"])).alias("evidence"))
    return got.join(paths.select(F.col("id").alias("attack_path_id"), "summary"), "attack_path_id", "left").select("finding_id", "title", "severity", "evidence", F.coalesce("summary", F.lit("")).alias("summary"))
