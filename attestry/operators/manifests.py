"""Rules that authorization manifests, scan options, baselines, CI reports and corpus manifests must hold to: a row for each break.

All of them are predicates over rows and anti joins, so any number of manifests is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators.web import MUTATING, READING

TARGETS = "manifest_id string, target string, environment string, allowed_hosts array<string>"
PLANS = (
    "manifest_id string, data_prefix string, max_requests int, username_field string, password_field string, token_path string, identity_path string, login_path string"
)
ACCOUNTS = "manifest_id string, label string, username_env string, password_env string"
CASES = (
    "manifest_id string, case_id string, owner string, other string, method string, path string, body string, data_label string, match string, expected string, json_path string"
)
OPTIONS = (
    "scan_id string, profile string, max_files long, max_file_bytes long, max_total_bytes long, timeout_ms long, artifacts array<string>, rule_packs array<string>, policy_path string"
)
CI = "report_id string, decision string, exit_code int, n_open int, by_severity array<int>, total int, complete int, gaps int, omitted_coverage int, omitted_findings int, compared boolean, n_new int, n_remaining int"
ANNOTATIONS = (
    "report_id string, kind string, level string, title string, message string, path string, start_line int, end_line int, start_column int, end_column int, "
    "fingerprint string, status string, blocks boolean, baseline_state string"
)
CORPUS = "case_id string, category string, framework string, variant string, path string, artifact string, expected array<string>, near array<string>"

#: Hosts that are never a target, networks that no request may reach and those that a local target may use.
METADATA_HOSTS = ("169.254.169.254", "100.100.100.200", "168.63.129.16", "metadata.google.internal")
UNSAFE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
LOCAL_NETWORKS = (("10.0.0.0", 8), ("127.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16))
#: The largest of each bound that a scan may ask for.
HARD_LIMITS = {"max_files": 100_000, "max_file_bytes": 16 << 20, "max_total_bytes": 512 << 20, "timeout_ms": 1_800_000}
MOST_ARTIFACTS, MOST_PACKS = 10, 8
MOST_GAPS_SHOWN, MOST_FINDINGS_SHOWN = 20, 50

#: Scheme, user, host, rest and fragment of an absolute URL.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/:?#]*)(?::[0-9]+)?([^#]*)(#.*)?$"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
#: A JSON string, with the colon that makes it a name.
JSON_STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'
PLAIN_TEXT = r"^[^\x00-\x1f\x7f]*$"


def _faults(rows: DataFrame, keys: list[str], each: dict[str, Column]) -> DataFrame:
    named = F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in each.items()))
    return rows.select(*keys, F.explode(F.array_compact(named)).alias("fault"))


def network_bounds(networks: tuple[tuple[str, int], ...]) -> list[tuple[int, int]]:
    """First and last address of each network as numbers."""
    out = []
    for address, bits in networks:
        low = sum(int(p) << s for p, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
        out.append((low, low + (1 << 32 - bits) - 1))
    return out


def within(address: Column, networks: tuple[tuple[str, int], ...]) -> Column:
    """Whether an IPv4 address lies in one of a few networks; false for what is none."""
    parts = F.split(F.when(address.rlike(IPV4), address), r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))
    hit = F.lit(False)
    for low, high in network_bounds(networks):
        hit = hit | number.between(low, high)
    return F.coalesce(hit, F.lit(False))


def target_faults(targets: DataFrame) -> DataFrame:
    """Targets that no verification may reach: unlisted, cloud metadata, internal names, private where not local."""
    part = lambda k: F.regexp_extract("target", URL, k)
    host = F.lower(F.regexp_replace(part(3), r"^\[|\]$", ""))
    scheme, local = F.lower(part(1)), F.col("environment") == "local"
    private = within(host, LOCAL_NETWORKS)
    return _faults(targets, ["manifest_id"], {
        "scheme": ~scheme.isin("http", "https"),
        "host_not_listed": ~F.coalesce(F.array_contains(F.transform("allowed_hosts", F.lower), host), F.lit(False)),
        "forbidden_host": host.isin(*METADATA_HOSTS) | host.rlike(r"\.(?:internal|local|localhost)$"),
        "local_elsewhere": local & ~(host.isin("localhost", "::1") | private),
        "without_https": ~local & (scheme != "https"),
        "private_address": ~local & (private | (host == "::1")),
        "credentials": part(2) != "",
        "fragment": part(5) != "",
        "ipv6": host.contains(":") & (host != "::1"),
    })


def _has(words: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, of)))


def _decoded(path: Column) -> Column:
    """A path with its percent signs read once; null where they are malformed or nested."""
    out = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(~out.contains("%"), out)


def plan_faults(plans: DataFrame, accounts: DataFrame, cases: DataFrame) -> DataFrame:
    """Manifests of object-access checks: two distinct accounts, an authentication endpoint, room for two logins and two requests a case."""
    variables = accounts.select("manifest_id", F.explode(F.array("username_env", "password_env")).alias("v"))
    labels = accounts.groupBy("manifest_id").agg(F.count_distinct("label").alias("labels"))
    named = variables.groupBy("manifest_id").agg((F.count_distinct("v") < F.count("v")).alias("shared"))
    sized = cases.groupBy("manifest_id").agg(F.count("*").alias("n_cases"))
    whole = plans.join(labels, "manifest_id", "left").join(named, "manifest_id", "left").join(sized, "manifest_id", "left")
    words = T.marker_words(_decoded(F.col("login_path")))
    unsafe = tuple(w for w in MUTATING if w not in ("create", "start"))
    return _faults(whole, ["manifest_id"], {
        "two_accounts": F.coalesce("labels", F.lit(0)) != 2,
        "credentials_shared": F.col("shared"),
        "login_fields": F.col("username_field") == F.col("password_field"),
        "login_paths": F.col("token_path") == F.col("identity_path"),
        "login_endpoint": ~_has(F.coalesce(words, F.array().cast("array<string>")), ("login", "signin", "session", "token")),
        "login_marker": _has(words, unsafe),
        "request_budget": F.col("max_requests") < 2 + 2 * F.coalesce("n_cases", F.lit(0)),
    })


def case_faults(plans: DataFrame, accounts: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that aren't read-only, name other accounts, or hold in the request what only the response may show."""
    labels = accounts.groupBy("manifest_id").agg(F.collect_set("label").alias("labels"))  # two of a manifest
    twice = cases.groupBy("manifest_id", "case_id").agg(F.count("*").alias("n"))
    whole = cases.join(plans.select("manifest_id", "data_prefix"), "manifest_id").join(labels, "manifest_id", "left").join(twice, ["manifest_id", "case_id"])
    plain = F.coalesce(F.to_json(F.try_parse_json("body")), F.col("body"), F.lit(""))  # with its escapes read
    strings = F.regexp_extract_all(plain, F.lit(JSON_STRING), 0)
    bare = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r'^"|"\s*:?$', ""))
    names, texts = bare(F.filter(strings, lambda x: x.endswith(":"))), bare(F.filter(strings, lambda x: ~x.endswith(":")))
    path, marker = _decoded(F.col("path")), F.lower("expected")
    words, body_words = T.marker_words(path), T.marker_words(F.array_join(bare(strings), " "))
    owned, owner = F.col("match") == "ownerIdentity", F.lower(F.substring_index("json_path", ".", -1))
    asked = F.transform(F.regexp_extract_all("path", F.lit("[?&]([^=&#]+)"), 1), F.lower)
    known = lambda c: F.coalesce(F.array_contains("labels", F.col(c)), F.lit(False))
    post = F.col("method") == "POST"
    return _faults(whole, ["manifest_id", "case_id"], {
        "case_twice": F.col("n") > 1,
        "accounts": ~(known("owner") & known("other")) | (F.col("owner") == F.col("other")),
        "label_prefix": ~F.col("data_label").startswith(F.concat("data_prefix", F.lit("-"))) & ~F.col("data_label").startswith(F.concat("data_prefix", F.lit("_"))),
        "expected_label": ~owned & (F.col("expected") != F.col("data_label")),
        "path": ~F.col("path").rlike(r"^/(?:[^/\\#][^\\#]*)?$") | path.isNull(),
        "path_marker": _has(words, MUTATING),
        "post_reads_nothing": post & ~_has(words, READING),
        "post_without_body": post & F.col("body").isNull(),
        "get_with_body": (F.col("method") == "GET") & F.col("body").isNotNull(),
        "body_marker": _has(body_words, MUTATING),
        "marker_sent": ~owned & (F.lower(path).contains(marker) | F.exists(texts, lambda x: F.lower(x).contains(marker))),
        "owner_sent": owned & (F.array_contains(asked, owner) | F.array_contains(F.transform(names, F.lower), owner)),
    })


def option_faults(options: DataFrame) -> DataFrame:
    """Options beyond a scan's hard limits; a null takes its default, which is within them."""
    blank = lambda c: F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))
    bounds = {f"{name}_bound": (F.col(name) <= 0) | (F.col(name) > most) for name, most in HARD_LIMITS.items()}
    return _faults(options, ["scan_id"], {
        "profile": ~F.col("profile").isin("predeploy", "native"),
        **bounds,
        "artifacts": blank("artifacts"),
        "artifacts_count": F.size("artifacts") > MOST_ARTIFACTS,
        "rule_packs": blank("rule_packs"),
        "rule_packs_count": F.size("rule_packs") > MOST_PACKS,
        "policy_path": F.trim("policy_path") == "",
    })


def baseline_faults(policies: DataFrame, packs: DataFrame) -> DataFrame:
    """Scans whose policy or rule packs aren't their baseline's.

    policies: scan_id, source, digest, base_source, base_digest; packs: scan_id, side (now or base), pack_id, digest, rule_count.
    Sets of packs are equal when each pack is on both sides with the same digest and number of rules.
    """
    was, is_now = F.col("base_source") == "operator", F.col("source") == "operator"
    of_policy = _faults(policies, ["scan_id"], {
        "policy_missing": was & ~F.coalesce(is_now, F.lit(False)),
        "policy_changed": was & is_now & ~F.col("digest").eqNullSafe(F.col("base_digest")),
        "policy_added": is_now & ~F.coalesce(was, F.lit(False)),
    })
    sides = packs.groupBy("scan_id", "pack_id", "digest", "rule_count").agg(F.count_if(F.expr("side = 'now'")).alias("a"), F.count_if(F.expr("side = 'base'")).alias("b"))
    return of_policy.unionByName(sides.where("a <> b").select("scan_id", F.lit("rule_packs").alias("fault")).distinct())


def ci_faults(reports: DataFrame, annotations: DataFrame) -> DataFrame:
    """Breaks of a CI report by its totals, its one decision, and each kind's levels, places and states."""
    kind = lambda k: F.col("kind") == k
    n = lambda cond: F.count_if(cond)
    of = annotations.groupBy("report_id").agg(
        n(kind("decision")).alias("decisions"), F.max(F.when(kind("decision"), F.col("level"))).alias("decision_level"),
        n(kind("coverage")).alias("coverages"), n(kind("coverage") & (F.col("level") != "error")).alias("mild_coverages"),
        n(kind("finding")).alias("findings"), n(kind("finding") & F.col("blocks")).alias("blocking"),
        n(kind("finding") & (F.col("baseline_state") == "new")).alias("as_new"), n(kind("finding") & (F.col("baseline_state") == "unchanged")).alias("as_old"),
    )
    whole = reports.join(of, "report_id", "left").fillna(0, ["decisions", "coverages", "mild_coverages", "findings", "blocking", "as_new", "as_old"])
    gap, decision = F.col("gaps") > 0, F.col("decision")
    stops = decision.isin("block", "incomplete")
    level = F.when(stops, "error").when(decision == "review", "warning").otherwise("notice")
    of_reports = _faults(whole, ["report_id"], {
        "exit_code": F.col("exit_code") != F.when(decision == "block", 1).when(decision == "incomplete", 2).otherwise(0),
        "open_total": F.col("n_open") != F.aggregate("by_severity", F.lit(0), lambda a, x: a + x),
        "coverage_total": F.col("total") != F.col("complete") + F.col("gaps"),
        "incomplete_without_gap": (decision == "incomplete") & ~gap,
        "accepted_with_gap": gap & ~stops,
        "one_decision": F.col("decisions") != 1,
        "decision_level": F.col("decision_level") != level,
        "coverage_shown": (F.col("coverages") != F.least("gaps", F.lit(MOST_GAPS_SHOWN))) | (F.col("mild_coverages") > 0),
        "coverage_omitted": F.col("omitted_coverage") != F.greatest(F.col("gaps") - MOST_GAPS_SHOWN, F.lit(0)),
        "findings_shown": F.col("findings") > MOST_FINDINGS_SHOWN,
        "findings_omitted": (F.col("omitted_findings") > 0) & (F.col("findings") != MOST_FINDINGS_SHOWN),
        "block_without_finding": (decision == "block") & (F.col("blocking") == 0),
        "states_exceed": F.col("compared") & ((F.col("as_new") > F.col("n_new")) | (F.col("as_old") > F.col("n_remaining"))),
    })
    line = lambda c: ~F.col(c).rlike(PLAIN_TEXT) | (F.trim(c) != F.col(c))
    place = F.coalesce("path", "fingerprint", "status", "baseline_state", *(F.col(c).cast("string") for c in ("start_line", "end_line", "start_column", "end_column", "blocks")))
    twice = annotations.where(kind("finding")).groupBy("report_id", "fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    each = annotations.join(reports.select("report_id", "compared"), "report_id")
    of_rows = _faults(each, ["report_id"], {
        "single_line": line("title") | line("message"),
        "path": (F.col("path") != "") & T.safe_relative_path(F.col("path")).isNull(),
        "line_order": F.col("end_line") < F.col("start_line"),
        "column_order": (F.col("end_line") == F.col("start_line")) & (F.col("end_column") < F.col("start_column")),
        "place_without_finding": ~kind("finding") & place.isNotNull(),
        "state_without_baseline": kind("finding") & ~F.col("compared") & F.col("baseline_state").isNotNull(),
        "finding_level": kind("finding") & ((F.col("level") == "error") != F.coalesce("blocks", F.lit(False))),
        "suppressed_shown": kind("finding") & (F.col("status") == "suppressed") & ~F.coalesce("blocks", F.lit(False)),
    })
    return of_reports.unionByName(of_rows).unionByName(twice.select("report_id", F.lit("finding_twice").alias("fault"))).distinct()


def corpus_faults(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """subject (a case or a rule) and fault: cases that are incomplete, and rules of catalog (rule_id, category) that no case covers."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    near_miss = F.col("variant") == "near_miss"
    of_cases = _faults(cases, ["case_id"], {
        "metadata": empty("category") | empty("framework") | ~F.col("variant").isin("positive", "near_miss"),
        "one_source": empty("path") == empty("artifact"),
        "positive_expects_none": (F.col("variant") == "positive") & none("expected"),
        "near_miss_incomplete": near_miss & (~none("expected") | none("near")),
    }).unionByName(cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("case_twice").alias("fault")))
    used = lambda c: cases.select("case_id", "category", F.explode(c).alias("rule_id"))
    unknown = used("expected").union(used("near")).join(catalog, ["rule_id", "category"], "left_anti").select("case_id", F.lit("rule_of_category").alias("fault"))
    lacks = [catalog.join(used(c), "rule_id", "left_anti").select(F.col("rule_id").alias("case_id"), F.lit(f"no_{name}").alias("fault")) for c, name in (("expected", "positive"), ("near", "near_miss"))]
    return of_cases.unionByName(unknown).unionByName(lacks[0]).unionByName(lacks[1]).withColumnRenamed("case_id", "subject").distinct()
