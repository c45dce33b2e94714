"""Rules that a pattern over a file decides: each match is a signal with its place.

The table of rules is data. Files are filtered by path before their text is searched; which rules a file is due for is
told by one test of each pattern, and only what is due is taken apart, with the pattern as a value of the row. No shuffle,
no Python, and one expression whatever the number of rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import arrays as A
from attestry.functions import text as T


class Rule(NamedTuple):
    rule_id: str
    severity: str
    evidence_level: str
    title: str
    paths: str  # which relative paths
    pattern: str  # what in their text
    cwe: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    unless: str = ""  # no signal if the match (or, with whole_file, the text) has this
    whole_file: bool = False  # one signal for a file, at its first matching line
    confidence: str = "high"
    owasp: tuple[str, ...] = ()
    detector: int = 0  # its place among the detectors of a scan


_MOBILE = r"\.(?:js|jsx|ts|tsx|dart|java|kt|swift|m|mm)$"
_SECRET_NAME = "(?:token|accessToken|refreshToken|password|secret|privateKey)"
#: Detectors of a scan in their order.
DETECTORS = ("secrets", "baas-authorization", "mobile-source-config", "application-config", "js-ts-dataflow", "node-api-security", "fastapi-authentication", "fastapi-object-authorization", "python-dataflow", "python-api-configuration")
#: Confidence where it isn't high, and OWASP classes, by rule.
_MEDIUM = ("auth.sensitive-route-without-visible-guard", "privacy.sensitive-logging", "android.backup-enabled", "mobile.webview-javascript-bridge", "flutter.webview-unrestricted-javascript")
_OWASP = {
    "auth.sensitive-route-without-visible-guard": ("A01:2021", "A07:2021"),
    "ci.github-expression-command-injection": ("A03:2021", "A08:2021"),
    "privacy.sensitive-logging": ("A09:2021",),
    "android.cleartext-enabled": ("M5",),
    "android.backup-enabled": ("M9",),
    "ios.ats-disabled": ("M5",),
    "mobile.webview-javascript-bridge": ("M1",),
    "mobile.insecure-http-endpoint": ("M5",),
    "react-native.sensitive-async-storage": ("M9",),
    "flutter.sensitive-shared-preferences": ("M9",),
    "flutter.webview-unrestricted-javascript": ("M1",),
    "flutter.accept-all-certificates": ("M5",),
    "jwt.config.committed-signing-secret": ("A02:2021", "A07:2021"),
    "jwt.config.long-lived-access-token": ("A07:2021", "API2:2023"),
}
_DETECTOR_OF = {"secret": 0, "android": 2, "ios": 2, "mobile": 2, "react-native": 2, "flutter": 2, "auth": 3, "ci": 3, "privacy": 3, "jwt": 9, "sast": 3}


def _completed(rule: Rule) -> Rule:
    confidence = "medium" if rule.rule_id in _MEDIUM else "high"
    return rule._replace(confidence=confidence, owasp=_OWASP.get(rule.rule_id, ()), detector=_DETECTOR_OF.get(rule.rule_id.split(".")[0], 0))


#: What the rules look for. Of secret.*, the four token patterns (stripe-live, openai, aws-access-key,
#: github-token) are those that packaged applications are searched with too; the others follow the catalogue's descriptions.
_TABLE = (
    Rule("secret.stripe-live", "critical", "static_confirmed", "Stripe live secret key in source", ".", r"\bsk_live_[A-Za-z0-9]{12,}\b", ("CWE-798",), ("secret",)),
    Rule("secret.openai", "critical", "static_confirmed", "OpenAI API key in source", ".", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", ("CWE-798",), ("secret",)),
    Rule("secret.aws-access-key", "critical", "static_confirmed", "AWS access key in source", ".", r"\bAKIA[0-9A-Z]{16}\b", ("CWE-798",), ("secret",)),
    Rule("secret.github-token", "critical", "static_confirmed", "GitHub token in source", ".", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", ("CWE-798",), ("secret",)),
    Rule("secret.private-key", "critical", "static_confirmed", "Private key material committed to the project", ".", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", ("CWE-798",), ("secret",)),
    Rule("secret.concrete-interpolation-fallback", "high", "static_confirmed", "Concrete credential used as an environment fallback", ".", r"\$\{\s*[A-Z][A-Z0-9_]*(?:ACCESS_KEY|API_KEY|AUTH_KEY|CREDENTIAL|PASSWORD|PASSWD|PRIVATE_KEY|SECRET|TOKEN)[A-Z0-9_]*\s*:?-\s*[^}\r\n/]{8,}\}", ("CWE-798",), ("secret",), unless=r"(?i)replace-me|changeme|example"),
    Rule("secret.client-public-privileged-variable", "critical", "static_confirmed", "Privileged value exposed through a client-public environment variable", r"(?:^|/)\.env[^/]*$", r"(?m)^\s*(?:NEXT_PUBLIC|VITE|EXPO_PUBLIC|REACT_APP|PUBLIC)_[A-Z0-9_]*(?:SERVICE_ROLE|SECRET|PRIVATE_KEY|ADMIN)[A-Z0-9_]*\s*=\s*\S+", ("CWE-200", "CWE-798"), ("secret", "client")),
    Rule("secret.client-public-privileged-reference", "critical", "static_confirmed", "Client code references a public-prefixed privileged variable", r"\.(?:js|jsx|ts|tsx|mjs|cjs)$", r"(?:process\.env|import\.meta\.env)\.(?:NEXT_PUBLIC|VITE|EXPO_PUBLIC|REACT_APP|PUBLIC)_[A-Z0-9_]*(?:SERVICE_ROLE|SECRET|PRIVATE_KEY|ADMIN)[A-Z0-9_]*", ("CWE-200", "CWE-798"), ("secret", "client")),
    Rule("auth.sensitive-route-without-visible-guard", "high", "inferred", "Sensitive API route has no visible authentication guard", r"app/api/(?:admin|internal|manage|users|billing|payments)(?:/|.*/)?route\.(?:js|jsx|ts|tsx)$", r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|PATCH|DELETE)|export\s+const\s+(?:GET|POST|PUT|PATCH|DELETE)", ("CWE-306",), ("auth", "api", "nextjs"), unless=r"(?i)(?:auth\s*\(|getServerSession|getSession|getUser\s*\(|currentUser|requireAuth|withAuth|verifyToken|verifySession|authorization|auth\.uid|clerkClient)", whole_file=True),
    Rule("ci.github-expression-command-injection", "critical", "static_confirmed", "Untrusted GitHub event data is interpolated into a shell step", r"\.github/workflows/.*\.ya?ml$", r"(?i)run:\s*(?:\||>)?[\s\S]{0,500}?\$\{\{\s*github\.event\.(?:issue|pull_request|comment|discussion|head_commit)[^}]*\}\}", ("CWE-78",), ("ci", "github-actions", "injection", "supply-chain")),
    Rule("privacy.sensitive-logging", "medium", "inferred", "Potential credential or session data written to logs", ".", r"(?i)console\.(?:log|info|debug|warn|error)\s*\([^\n;]*(?:password|accessToken|refreshToken|authorization|cookie|secret|apiKey)", ("CWE-532",), ("privacy", "logging", "secret")),
    Rule("android.cleartext-enabled", "high", "static_confirmed", "Android application permits cleartext network traffic", r"AndroidManifest\.xml$", r"android:usesCleartextTraffic\s*=\s*[\"']true[\"']", ("CWE-319",), ("android", "network")),
    Rule("android.backup-enabled", "medium", "static_confirmed", "Android application data backup is enabled", r"AndroidManifest\.xml$", r"android:allowBackup\s*=\s*[\"']true[\"']", ("CWE-200",), ("android", "storage")),
    Rule("ios.ats-disabled", "high", "static_confirmed", "iOS App Transport Security is globally disabled", r"Info\.plist$", r"<key>NSAllowsArbitraryLoads</key>\s*<true\s*/>", ("CWE-319",), ("ios", "network")),
    Rule("mobile.webview-javascript-bridge", "medium", "inferred", "Mobile WebView enables an elevated JavaScript capability", _MOBILE, r"(?:addJavascriptInterface\s*\(|javaScriptEnabled\s*=\s*true|setJavaScriptEnabled\s*\(\s*true\s*\))", ("CWE-749",), ("mobile", "webview")),
    Rule("mobile.insecure-http-endpoint", "high", "static_confirmed", "Mobile source references a cleartext HTTP endpoint", _MOBILE, r"[\"'`]http://[^\"'`\s]+", ("CWE-319",), ("mobile", "network"), unless=r"^.http://(?:localhost|127\.0\.0\.1|10\.0\.2\.2|example\.(?:com|org))(?:[^A-Za-z0-9_]|$)|^.http://$"),
    Rule("react-native.sensitive-async-storage", "high", "static_confirmed", "Sensitive value stored in React Native AsyncStorage", _MOBILE, rf"(?i)AsyncStorage\.setItem\s*\(\s*[\"'`]{_SECRET_NAME}[\"'`]", ("CWE-922",), ("react-native", "storage", "credential")),
    Rule("flutter.sensitive-shared-preferences", "high", "static_confirmed", "Sensitive value stored in Flutter SharedPreferences", _MOBILE, rf"(?i)(?:SharedPreferences|prefs?|preferences)\.setString\s*\(\s*[\"']{_SECRET_NAME}[\"']", ("CWE-922",), ("flutter", "storage", "credential")),
    Rule("flutter.webview-unrestricted-javascript", "medium", "inferred", "Flutter WebView enables unrestricted JavaScript", _MOBILE, r"(?:javaScriptMode\s*:|setJavaScriptMode\s*\()\s*JavaScriptMode\.unrestricted", ("CWE-749",), ("flutter", "webview")),
    Rule("flutter.accept-all-certificates", "critical", "static_confirmed", "Flutter networking accepts invalid TLS certificates", _MOBILE, r"badCertificateCallback\s*=\s*(?:\([^)]*\)|[^=;]+)=>\s*true|badCertificateCallback[\s\S]{0,160}?return\s+true\s*;", ("CWE-295",), ("flutter", "tls", "network")),
    Rule("jwt.config.committed-signing-secret", "critical", "static_confirmed", "JWT signing secret is committed in a production configuration", r"(?i)(?:^|/)(?:\.env\.prod[^/]*|[^/]*prod[^/]*\.(?:json|ya?ml|toml|env))$", r"(?im)^\s*[\"']?(?:JWT_SECRET(?:_KEY)?|SECRET_KEY)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{8,}[\"']?", ("CWE-321", "CWE-798"), ("auth", "jwt"), unless=r"(?i)replace-me|changeme|\$\{"),
    Rule("jwt.config.long-lived-access-token", "medium", "static_confirmed", "JWT access token lifetime exceeds one day", r"(?i)(?:^|/)(?:\.env\.prod[^/]*|[^/]*prod[^/]*\.(?:json|ya?ml|toml|env))$", r"(?im)^\s*[\"']?(?:JWT_)?ACCESS_TOKEN_EXPIRE_MINUTES[\"']?\s*[:=]\s*[\"']?0*(?:14(?:4[1-9]|[5-9][0-9])|1[5-9][0-9]{2}|[2-9][0-9]{3}|[1-9][0-9]{4,})\b", ("CWE-613",), ("auth", "jwt")),
    Rule("sast.javascript.dynamic-code-execution", "high", "static_confirmed", "JavaScript or TypeScript uses eval or the Function constructor", r"\.(?:js|jsx|ts|tsx|mjs|cjs)$", r"(?:^|[^.\w])eval\s*\(\s*[^)\s]|new\s+Function\s*\(", ("CWE-95",), ("sast",)),
    Rule("sast.python.unsafe-pickle-load", "high", "static_confirmed", "Python loads pickled data", r"\.py$", r"\bpickle\.loads?\s*\(", ("CWE-502",), ("sast",)),
    Rule("sast.generic.weak-hash", "medium", "static_confirmed", "A weak hash is used", r"\.(?:js|jsx|ts|tsx|mjs|cjs|py)$", r"(?:createHash\s*\(\s*[\"'](?:md5|sha1)[\"']|hashlib\.(?:md5|sha1)\s*\()", ("CWE-328",), ("sast",)),
)
RULES = tuple(map(_completed, _TABLE))
#: Rules over the text of a packaged application, under any entry's name.
ARTIFACT_RULES = (
    *(Rule("artifact.embedded-secret", "critical", "static_confirmed", "Credential embedded in a distributed mobile artifact", ".", p, ("CWE-798",), ("mobile", "artifact", "secret")) for p in (r"\bsk_live_[A-Za-z0-9]{12,}\b", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", r"(?i)(?:service_role|SUPABASE_SERVICE_ROLE_KEY)[\"'=:,\s]+[A-Za-z0-9._-]{20,}")),
    Rule("artifact.cleartext-endpoint", "high", "static_confirmed", "Cleartext endpoint embedded in a mobile artifact", ".", r"http://(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::\d{1,5})?(?:/[^\s\"'`<>\x00]*)?", ("CWE-319",), ("mobile", "artifact", "network")),
    Rule("artifact.ios-ats-disabled", "high", "static_confirmed", "Packaged iOS app disables App Transport Security", ".", r"(?m)(?:<key>\s*NSAllowsArbitraryLoads\s*</key>|^NSAllowsArbitraryLoads$)[\s\S]{0,40}<true\s*/>", ("CWE-319",), ("ios", "artifact", "network")),
)


def _remediation(rule: Rule) -> str:
    """What to do about a class of weakness, in a sentence."""
    by_cwe = {
        "CWE-798": "Revoke the value, load it from a secret store and remove it from the history.",
        "CWE-200": "Keep privileged values and private data out of what clients can read.",
        "CWE-306": "Verify the caller on the server, in the handler or in middleware that provably applies, and test calls without a session.",
        "CWE-78": "Pass the value as data in a quoted environment variable, and never run it.",
        "CWE-532": "Leave the field out of logs or hide it, and test that.",
        "CWE-319": "Use encrypted transport, with narrow exceptions for development alone.",
        "CWE-749": "Restrict what the view may load and which of its calls reach native code.",
        "CWE-922": "Keep credentials in the platform's key store.",
        "CWE-295": "Let the platform verify certificates, and pin them where that is needed.",
        "CWE-321": "Make a new signing secret and inject it when the service starts.",
        "CWE-613": "Give access tokens minutes, and renew them with refresh tokens that can be revoked.",
        "CWE-95": "Parse the data instead of evaluating it.",
        "CWE-502": "Read untrusted data with a format that carries no code.",
        "CWE-328": "Use a current hash, and a password hash for passwords.",
    }
    return next((by_cwe[c] for c in rule.cwe if c in by_cwe), "")


def _table(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    ddl = "rule int, rule_id string, severity string, evidence_level string, title string, pattern string, unless string, whole_file boolean, cwe array<string>, tags array<string>, confidence string, owasp array<string>, detector int, remediation string"
    rows = [(i, r.rule_id, r.severity, r.evidence_level, r.title, r.pattern, r.unless, r.whole_file, list(r.cwe), list(r.tags), r.confidence, list(r.owasp), r.detector, _remediation(r)) for i, r in enumerate(rules)]
    return files.sparkSession.createDataFrame(rows, ddl)


def _due(rule: Rule) -> Column:
    text, path = F.col("content"), F.col("relative_path")
    due = path.rlike(rule.paths) & text.rlike(rule.pattern)
    return due & ~text.rlike(rule.unless) if rule.whole_file else due


def matches(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules' columns with relative_path, walk_pos, offset (code points before), match and line of each match."""
    due = F.filter(F.array(*(F.when(_due(r), F.lit(i)) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    hit = files.select("relative_path", "content", "walk_pos", F.explode(due).alias("rule")).join(F.broadcast(_table(files, rules)), "rule")
    text, pattern = F.col("content"), F.col("pattern")
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, pattern)), F.lit(0))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(first, F.col("relative_path")).alias("value"), F.lit(1).alias("line")))
    wanted = lambda m: ((F.col("unless") == "") | ~F.rlike(m["value"], F.col("unless"))) & ~((F.col("rule_id") == "artifact.cleartext-endpoint") & T.ignored_endpoint(m["value"]))
    each = F.when(F.col("whole_file"), whole).otherwise(F.filter(A.found(text, pattern, lines=True), wanted))
    got = hit.select("*", F.explode(each).alias("m")).drop("content")
    return got.select("*", F.col("m.start").alias("offset"), F.col("m.value").alias("match"), F.col("m.line").alias("line")).drop("m")


def signals(files: DataFrame, rules: tuple[Rule, ...] = RULES, engine: str = "native") -> DataFrame:
    """Signals of all matches, in the order (ord) of detectors, files, rules and places."""
    found = matches(files, rules).withColumn("snippet", T.snippet(F.col("match")))
    found = found.withColumn("fingerprint", T.fingerprint(F.lit(engine), F.col("rule_id"), F.col("relative_path"), F.col("snippet")))
    return found.select(
        T.signal_id(F.col("fingerprint"), F.col("line")).alias("id"), "fingerprint", F.lit(engine).alias("engine"), "rule_id", "title", F.concat(F.col("title"), F.lit(" ("), F.col("relative_path"), F.lit(")")).alias("description"),
        "severity", "evidence_level", "confidence", F.col("relative_path").alias("path"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(None).cast("int").alias("end_line"), "snippet", "cwe", "owasp", "tags", "remediation",
        F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("array<string>").alias("routes"), order(F.col("detector"), F.col("walk_pos"), F.col("rule"), F.col("offset")).alias("ord"),
    )


def order(detector: Column, walk_pos: Column, rule: Column, place: Column) -> Column:
    """What signals of a scan are sorted by: first wins, caps and budgets all go by it."""
    return F.struct(detector.cast("int").alias("detector"), walk_pos.cast("long").alias("walk_pos"), rule.cast("int").alias("rule"), place.cast("long").alias("place"))
