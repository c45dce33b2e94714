"""Column functions: identities, redaction, safe text for reports, routes, severities and times. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
#: Severities by rank.
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: What tools call a severity, by what it means here.
TOOL_SEVERITIES = {"critical": ("critical",), "high": ("error", "high"), "medium": ("warning", "warn", "medium", "moderate"), "low": ("low", "note"), "info": ("info", "informational")}
#: Names whose assigned value is a secret, in capitals and in any case, and those of shell defaults.
TELLING = "[A-Z][A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PRIVATE_KEY|SERVICE_ROLE_KEY|API_KEY)[A-Z0-9_]*"
LOOSE = "password|passwd|secret|token|api[_-]?key"
DEFAULTED = "[A-Z][A-Z0-9_]*(?:ACCESS_KEY|API_KEY|AUTH_KEY|CREDENTIAL|PASSWORD|PASSWD|PRIVATE_KEY|SECRET|TOKEN)[A-Z0-9_]*"
#: What redaction replaces by what, in this order; the forms are those that RE2 knows too. The first four are fixed values; their groups are the three characters that stay on either side.
REDACTIONS = (
    (r"\b(sk_)(?:live|test)_[A-Za-z0-9_-]{5,}([A-Za-z0-9_-]{3})\b", "$1…$2"),
    (r"\b(AKI)A[0-9A-Z]{9,}([0-9A-Z]{3})\b", "$1…$2"),
    (r"\b(gh[pousr])_[A-Za-z0-9]{9,}([A-Za-z0-9]{3})\b", "$1…$2"),
    (r"\b(sk-)[A-Za-z0-9_-]{9,}([A-Za-z0-9_-]{3})\b", "$1…$2"),
    (rf"\b({TELLING}\s*=\s*)['\"]?([^\s#'\"]{{3}})[^\s#'\"…]{{3,}}([^\s#'\"]{{3}})['\"]?", "$1$2…$3"),
    (rf"\b({TELLING}\s*=\s*)['\"]?[^\s#'\"…]{{1,8}}['\"]?(\s|#|$)", "$1[REDACTED]$2"),
    (rf"(?i)((?:{LOOSE})\s*[:=]\s*)[\"']?([^\s\"']{{3}})[^\s\"'…]{{3,}}([^\s\"']{{3}})", "$1$2…$3"),
    (rf"(?i)((?:{LOOSE})\s*[:=]\s*)[\"']?[^\s\"'…\[]{{6,8}}", "$1[REDACTED]"),
    (rf"\$\{{\s*({DEFAULTED})\s*(:?-)\s*[^}}\r\n]+\}}", r"\$\{$1$2[REDACTED]\}"),
)
#: Hosts whose cleartext address is no endpoint.
PLAIN_HOSTS = ("schemas.android.com", "www.w3.org", "www.apache.org", "www.gnu.org", "opensource.org", "xml.org", "purl.org", "ns.adobe.com", "www.apple.com", "crl.apple.com", "ocsp.apple.com")
EXAMPLE_HOSTS = ("example.com", "example.org", "example.net")


def joined(*parts: Column) -> Column:
    """Parts with a NUL between, a null as the empty string."""
    return F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A short id of the parts that aren't empty."""
    return F.concat(F.lit(f"{prefix}_"), sha256(F.concat_ws(NUL, *(F.nullif(p.cast("string"), F.lit("")) for p in parts))).substr(1, 16))


def line_number(text: Column, offset: Column) -> Column:
    return F.length(text.substr(F.lit(1), offset)) - F.length(F.replace(text.substr(F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def redact(value: Column) -> Column:
    return F.when(F.length(value) <= 8, "[REDACTED]").otherwise(F.concat(value.substr(1, 3), F.lit("…"), value.substr(-3, 3)))


def redact_snippet(text: Column) -> Column:
    """Credential shapes, assignments to telling names and shell defaults lose their values."""
    return reduce(lambda c, r: F.regexp_replace(c, *r), REDACTIONS, text)


def snippet(text: Column) -> Column:
    """What a location shows of the matched text."""
    return redact_snippet(F.regexp_replace(text, r"^\s+|\s+$", "").substr(1, 300))


def semantic(text: Column) -> Column:
    """A snippet as identities see it: white space, numbers and case don't matter."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\b\d+\b", "#"), r"^ +| +$", ""))


def fingerprint(engine: Column, rule_id: Column, path: Column, shown: Column) -> Column:
    return sha256(joined(engine, rule_id, path, semantic(F.coalesce(shown, F.lit("")))))


def signal_id(fp: Column, line: Column, column: Column | None = None) -> Column:
    return F.concat(F.lit("sig_"), sha256(joined(fp, line, F.lit("") if column is None else column)).substr(1, 16))


def severity_rank(severity: Column) -> Column:
    return reduce(lambda c, x: c.when(severity == x[1], x[0]), enumerate(SEVERITIES), F.when(severity.isNull(), None))


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def normalize_severity(value: Column, fallback: str = "medium") -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return reduce(lambda c, x: c.when(low.isin(*x[1]), x[0]), TOOL_SEVERITIES.items(), F.when(F.lit(False), None)).otherwise(fallback)


def expiry(value: Column) -> Column:
    """A date means the end of its day."""
    return F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T23:59:59.999Z"))).otherwise(value))


def single_line(value: Column, most: int, fallback: str | Column = "not recorded") -> Column:
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    source = F.when(flat == "", fallback).otherwise(flat)
    return F.when(F.length(source) <= most, source).otherwise(F.concat(source.substr(1, most - 1), F.lit("…")))


def safe_relative_path(value: Column) -> Column:
    """A path within the project, without empty and dot segments; null for any other."""
    slashed = F.replace(value, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    path = F.array_join(parts, "/")
    bad = value.rlike(r"[\x00-\x1f\x7f]") | slashed.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)") | F.exists(parts, lambda p: (p == "..") | p.rlike("(?i)%(?:2e|2f|5c)"))
    return F.when(~bad & (F.size(parts) > 0) & (F.length(path) <= 1024), path)


def sarif_uri(value: Column) -> Column:
    return F.array_join(F.transform(F.split(safe_relative_path(value), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def markdown_text(value: Column, most: int) -> Column:
    """One line in which no address is a link and no character is markup."""
    out = single_line(value, most)
    for pattern, with_ in ((r"(?i)\bhttps:", "hxxps:"), (r"(?i)\bhttp:", "hxxp:"), (r"(?i)\bmailto:", "mailto[:]"), (r"(?i)\bwww\.", "www[.]"), ("@", "[at]")):
        out = F.regexp_replace(out, pattern, with_)
    return F.regexp_replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), r"([`*_\[\]{}()<>#!|])", r"\\$1")


def _replaced(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, value)


def github_data(value: Column) -> Column:
    return _replaced(single_line(value, 2000), (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")))


def github_property(value: Column) -> Column:
    return _replaced(github_data(value), ((":", "%3A"), (",", "%2C")))


def html_text(value: Column) -> Column:
    return _replaced(F.coalesce(value, F.lit("")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def table_cell(value: Column) -> Column:
    return F.regexp_replace(_replaced(value, (("|", "\\|"),)), r"\r?\n", " ")


def non_blank(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def normalized_route(value: Column) -> Column:
    """METHOD /path, or null."""
    verb = r"^(CONNECT|DELETE|GET|HEAD|OPTIONS|PATCH|POST|PUT|TRACE|ALL) +(/[^\s\x7f]{0,480})$"
    trimmed = F.trim(value)
    return F.when(~value.rlike(r"[\x00-\x1f\x7f]") & (F.length(value) <= 512) & trimmed.rlike(verb), F.concat_ws(" ", F.regexp_extract(trimmed, verb, 1), F.regexp_extract(trimmed, verb, 2)))


def joined_route(*parts: Column) -> Column:
    """Path pieces under one slash each, without one at the end."""
    path = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", *(F.coalesce(p, F.lit("")) for p in parts))), "/{2,}", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


def next_route(path: Column) -> Column:
    """The address of a file-routed handler: its folders below app, with [name] as :name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^.*?app(/.*)/route\.[jt]sx?$", "$1"), r"/\([^/]+\)", ""), r"\[(?:\.\.\.)?([^\]]+)\]", ":$1")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[0-9A-Fa-f:.]+\]|[^:/?#\s]*)", 1))


def ignored_endpoint(url: Column) -> Column:
    host = url_host(url)
    example = reduce(lambda a, b: a | b, ((host == d) | host.endswith(f".{d}") for d in EXAMPLE_HOSTS))
    return ~(host.contains(".") | host.contains(":")) | host.startswith("127.") | (host == "10.0.2.2") | example | host.isin(*PLAIN_HOSTS)


def hidden_cookie(cookie: Column) -> Column:
    return F.regexp_replace(cookie, r"^([^=]+)=[^;]*", "$1=[REDACTED]")


def has_name(expression: Column, name: Column) -> Column:
    """Whether name stands in an expression as a whole identifier."""
    return F.concat(F.lit(" "), expression, F.lit(" ")).rlike(F.concat(F.lit("[^A-Za-z0-9_]"), name, F.lit("[^A-Za-z0-9_]")))


def marker_words(value: Column) -> Column:
    """camelCase, kebab-case and paths as lower-case words."""
    return F.filter(F.split(F.lower(F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda w: w != "")


def first_reasons(reasons: Column, most: int = 50) -> Column:
    """Distinct reasons, the first ones, and how many more there are."""
    each = F.array_distinct(reasons)
    more = F.when(F.size(each) > most, F.concat(F.lit("; "), (F.size(each) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(each, 1, most), "; "), more)
