"""Rule-based scanning, reports over findings, redaction, and taint tracking.

Rules are regular expressions over whole texts, in the common subset of the engines, so a match may go over line ends; each
finding has the line and the column where it begins. A bad pattern of a rule that the caller loads raises at once. Empty
and null texts have no findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.fixed import SANITIZERS, SINKS, SOURCES

SEVERITIES = ["info", "low", "medium", "high", "critical"]
# Rules as (id, name, severity, cwe, owasp, languages, pattern, message, fix, category).
RULES = [
    ("INJ-001", "Dynamic evaluation", "critical", "CWE-95", "A03", "", r"\beval\s*\(", "Evaluates text as code", "Parse the value instead", "injection"),
    ("INJ-002", "Query built from text", "critical", "CWE-89", "A03", "", r"(?:query|execute|raw)\s*\(\s*[\"'`][^\"'`]*[\"'`]\s*\+", "Builds a query by joining text", "Bind parameters", "injection"),
    ("INJ-003", "Shell call with input", "critical", "CWE-78", "A03", "", r"\b(?:exec|system|popen|spawn|shell_exec)\s*\(\s*[`\"'].*(?:\$\{|\+)", "Runs a shell with joined text", "Pass a list of arguments", "injection"),
    ("INJ-004", "Markup from input", "high", "CWE-79", "A03", "javascript,typescript", r"\.innerHTML\s*=|document\.write\s*\(", "Writes markup from a value", "Write text nodes", "injection"),
    ("INJ-005", "Template from input", "high", "CWE-1336", "A03", "python", r"render_template_string\s*\(", "Renders a template from a value", "Use a fixed template", "injection"),
    ("CRY-001", "Weak digest", "medium", "CWE-328", "A02", "", r"\b(?:md5|sha1)\s*\(", "Uses a weak digest", "Use SHA-256 or better", "cryptography"),
    ("CRY-002", "Weak cipher", "high", "CWE-327", "A02", "", r"\b(?:DES|RC4|ECB)\b", "Uses a weak cipher or mode", "Use AES-GCM", "cryptography"),
    ("CRY-003", "Fixed seed", "low", "CWE-335", "A02", "", r"(?:seed|srand)\s*\(\s*\d+\s*\)", "Seeds a generator with a constant", "Seed from the system", "cryptography"),
    ("CRY-004", "Plain random for secrets", "medium", "CWE-338", "A02", "", r"Math\.random\s*\(|\brandom\.random\s*\(", "Uses a plain generator", "Use a secure generator", "cryptography"),
    ("CRY-005", "Certificate check off", "high", "CWE-295", "A02", "", r"verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true", "Skips the check of certificates", "Check certificates", "cryptography"),
    ("CON-001", "Plain transport", "low", "CWE-319", "A05", "", r"http://[A-Za-z0-9.\-]+", "Uses plain HTTP", "Use HTTPS", "configuration"),
    ("CON-002", "Debug switch on", "low", "CWE-489", "A05", "", r"(?i:debug)\s*[:=]\s*(?:True|true)", "Leaves debugging on", "Switch it off outside development", "configuration"),
    ("CON-003", "Any origin allowed", "medium", "CWE-942", "A05", "", r"Access-Control-Allow-Origin[\"']?\s*[,:]\s*[\"']\*", "Lets any origin in", "Name the origins", "configuration"),
    ("CON-004", "Bound to all interfaces", "low", "CWE-668", "A05", "", r"[\"']0\.0\.0\.0[\"']", "Listens on all interfaces", "Bind one address", "configuration"),
    ("VAL-001", "Path from input", "high", "CWE-22", "A01", "", r"\b(?:open|readFile|readFileSync)\s*\(\s*\w+\s*\+", "Opens a joined path", "Resolve and check the path", "validation"),
    ("VAL-002", "Open redirect", "medium", "CWE-601", "A01", "", r"\bredirect\s*\(\s*[A-Za-z_]\w*", "Redirects to a value", "Check the target", "validation"),
    ("VAL-003", "Unsafe deserialisation", "critical", "CWE-502", "A08", "", r"\b(?:pickle\.loads?|yaml\.load|unserialize|readObject)\s*\(", "Restores objects from data", "Use a data format", "validation"),
    ("VAL-004", "Mass assignment", "medium", "CWE-915", "A08", "", r"Object\.assign\s*\(\s*\w+\s*,\s*req\.body", "Copies a request into an object", "Name the fields", "validation"),
    ("SEC-001", "Cloud access key", "critical", "CWE-798", "A07", "", r"\bAKIA[0-9A-Z]{16}\b", "Holds an access key", "Move it to a secret store", "secrets"),
    ("SEC-002", "Private key", "critical", "CWE-798", "A07", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "Holds a private key", "Move it to a secret store", "secrets"),
    ("SEC-003", "Password assignment", "high", "CWE-798", "A07", "", r"(?i:password|passwd|pwd)\s*[:=]+\s*[\"'][^\"']{4,}[\"']", "Assigns a literal password", "Read it from the environment", "secrets"),
    ("SEC-004", "Literal token", "high", "CWE-798", "A07", "", r"(?i:secret|token|api_?key)\s*[:=]+\s*[\"'][A-Za-z0-9_\-]{16,}[\"']", "Assigns a literal token", "Read it from the environment", "secrets"),
    ("SEC-005", "Personal access token", "critical", "CWE-798", "A07", "", r"\bgh[pousr]_[A-Za-z0-9]{20,}", "Holds an access token", "Revoke and move it", "secrets"),
    ("OTH-001", "Swallowed error", "low", "CWE-390", "A09", "", r"except\s*:\s*pass|catch\s*\([^)]*\)\s*\{\s*\}", "Ignores an error", "Handle or log it", "other"),
    ("OTH-002", "Open work mark", "info", None, None, "", r"\b(?:TODO|FIXME|XXX)\b", "Leaves work open", None, "other"),
    ("OTH-003", "Assertion as check", "low", "CWE-617", "A04", "python", r"^\s*assert\s+\w+\s*(?:==|!=|is|in)\s", "Checks by an assertion", "Raise an error", "other"),
]
RULE_SCHEMA = "rule_id string, rule_name string, severity string, cwe string, owasp string, languages string, pattern string, message string, fix string, category string"
# Weaknesses by number.
WEAKNESSES = {
    "CWE-22": "Path traversal", "CWE-78": "OS command injection", "CWE-79": "Cross-site scripting", "CWE-89": "SQL injection", "CWE-95": "Evaluation of dynamic code", "CWE-295": "Improper certificate validation", "CWE-319": "Cleartext transmission",
    "CWE-327": "Broken cryptographic algorithm", "CWE-328": "Weak hash", "CWE-335": "Incorrect use of seeds", "CWE-338": "Weak random numbers", "CWE-390": "Error without action", "CWE-489": "Active debug code", "CWE-502": "Deserialization of untrusted data",
    "CWE-601": "Open redirect", "CWE-617": "Reachable assertion", "CWE-668": "Exposure to the wrong sphere", "CWE-798": "Hard-coded credentials", "CWE-915": "Mass assignment", "CWE-942": "Permissive cross-domain policy", "CWE-1336": "Template injection",
}
# Advice by category, for findings whose rule has none.
ADVICE = {"injection": "Keep data and commands apart", "cryptography": "Use current algorithms", "configuration": "Harden the settings", "validation": "Validate what comes in", "secrets": "Move secrets out of the source", "other": "Review the place"}
# Parts of paths that tell of tests.
TEST_PATHS = r"(?:^|/)(?:tests?|__tests__|spec|fixtures?|testdata|mocks?)/|(?:^|/)test_[^/]*$|[._-](?:test|spec|tests)\.[^/]*$"


def load_rules(path: str) -> list[tuple]:
    """Rules of a YAML file: a list under `rules` of mappings with the names of RULE_SCHEMA (languages as a list)."""
    import yaml

    with open(path) as f:
        out = [(r["id"], r["name"], r["severity"].lower(), r.get("cwe"), r.get("owasp"), ",".join(r.get("languages") or []), r["pattern"], r["message"], r.get("fix"), r.get("category", "other")) for r in yaml.safe_load(f)["rules"]]
    for r in out:
        re.compile(r[6])
    return out


def is_test_path(path):
    return F.lower(path).rlike(TEST_PATHS)


def owasp_rules(rules: list[tuple] | None = None) -> list[tuple]:
    """The rules with a place in the OWASP list."""
    return [r for r in RULES if r[4]] if rules is None else [r for r in rules if r[4]]


def cwe_rules(rules: list[tuple] | None = None) -> list[tuple]:
    """The rules with a weakness number."""
    return [r for r in RULES if r[3]] if rules is None else [r for r in rules if r[3]]


def line_and_column(text: str, at: int) -> tuple[int, int]:
    """1-based line and column of an offset."""
    return text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)


_FINDING = "key string, line_no int, column_no int, rule_id string, severity string, cwe string, owasp string, category string, matched_text string"


def scan(texts: DataFrame, key: str, text: str, language: str | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """(key, line_no, column_no, rule_id, severity, cwe, owasp, category, matched_text): all matches of all rules.

    One expression of all patterns leaves the texts without any behind; only the others are searched for places.
    """
    rules = RULES if rules is None else rules
    if not rules:
        return texts.sparkSession.createDataFrame([], _FINDING)
    compiled = [(re.compile(r[6], re.ASCII), set(r[5].split(",")) if language and r[5] else None, (r[0], r[2], r[3], r[4], r[9])) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FINDING.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6]
        for b in batches:
            out = []
            for k, t, lang in zip(*(b.column(c).to_pylist() for c in ("key", "text", "language"))):
                for pattern, languages, fixed in compiled:
                    if languages is None or lang in languages:
                        for m in pattern.finditer(t):
                            out.append((k, *line_and_column(t, m.start()), *fixed, m.group()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    some = F.lit(False)
    for r in rules:
        some = some | F.col("text").rlike(r[6])
    lang = F.lower(F.coalesce(F.col(language), F.lit(""))) if language else F.lit("")
    src = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), lang.alias("language"))
    return src.where(some).mapInArrow(run, _FINDING)


def scan_files(files: DataFrame, rules: list[tuple] | None = None, exclude_tests: bool = False) -> DataFrame:
    """Findings of files (file_path, language, content), the worst first, with the path as key."""
    if exclude_tests:
        files = files.where(~is_test_path(F.col("file_path")))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return scan(files, "file_path", "content", "language", rules).orderBy(F.desc(rank), "key", "line_no", "column_no", "rule_id")


def ci_report(findings: DataFrame, least: str = "medium", most: int = 50) -> tuple[str, int]:
    """(Markdown of the findings from a severity on, exit code): 1 if any is critical. At most `most` rows are listed."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower("severity"))
    bad = findings.where(rank > SEVERITIES.index(least))
    counts = {r.severity: r.n for r in bad.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = bad.orderBy(F.desc(rank), "key", "line_no", "column_no", "rule_id").limit(most).collect()
    out = ["## Security findings", "", *(f"- {s}: {counts[s]}" for s in reversed(SEVERITIES) if s in counts)]
    if not counts:
        return "## Security findings\n\nNone.", 0
    out += ["", "| severity | rule | place |", "|---|---|---|", *(f"| {r.severity} | {r.rule_id} | {r.key}:{r.line_no}:{r.column_no} |" for r in rows)]
    return "\n".join(out), int("critical" in counts)


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: counts per severity, and the risk level they make."""
    n = [F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES]
    out = findings.agg(F.count(F.lit(1)).alias("total"), *n)
    return out.withColumn("risk", F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").when(F.col("medium") > 0, "MEDIUM").when(F.col("low") > 0, "LOW").otherwise("NONE"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def explain_weakness(cwe: str) -> str:
    return WEAKNESSES.get(cwe.upper(), "Unknown weakness")


def suggest_fix(rule_id: str) -> str:
    for r in RULES:
        if r[0] == rule_id:
            return r[8] or ADVICE[r[9]]
    return ADVICE["other"]


# What is masked in logs, in this order.
REDACTIONS = [
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_KEY]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_TOKEN]"),
    (r"(bearer|basic)(\s+)[A-Za-z0-9+/=._\-]{12,}", "$1$2[REDACTED]"),
    (r"(password|passwd|pwd)(\s*[:=]\s*)[\"']?[^\s\"',;]{4,}[\"']?", "$1$2[REDACTED]"),
    (r"(api_?key|secret|token)(\s*[:=]\s*)[\"']?[A-Za-z0-9_\-]{8,}[\"']?", "$1$2[REDACTED]"),
    (r"(://[^\s:/@]+:)[^\s@/]+@", "$1[REDACTED]@"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
]


def redact(text):
    """The text with secrets masked; masked text stays as it is when masked again."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, "(?i)" + pattern, by)
    return text


_COLLECT = ("append", "push", "add", "extend", "insert", "set")


def _pattern_hits(texts: DataFrame, key: str, text: str, language: str, table: list[tuple]) -> DataFrame:
    src = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(language)).alias("language"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("p", "line"))
    out = None
    hits = [F.when((F.col("language") == lang) & F.contains("line", F.lit(p)), F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("pattern"))) for lang, kind, ps in table for p in ps]
    out = src.select("key", "language", (F.col("p") + 1).alias("line_no"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return out.select("key", "language", "line_no", "h.kind", "h.pattern")


def taint_sources(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(key, language, line_no, kind, pattern): lines with a source of input."""
    return _pattern_hits(texts, key, text, language, SOURCES)


def taint_sinks(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    return _pattern_hits(texts, key, text, language, SINKS)


_ASSIGN = re.compile(r"^\s*(?:(?:let|const|var|final|mut|auto|String|int)\s+)*([A-Za-z_$][\w$]*)\s*(?::[^=]+)?(?::=|=)(?![=>])\s*(.*)$")
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\.(?:" + "|".join(_COLLECT) + r")\((.*)\)")


def walk(text: str, language: str, from_line: int | None = None, keep_sanitized: bool = False) -> list[tuple]:
    """Flows (source line, source kind, sink line, sink kind, variables, sanitized) of one text.

    From each source the assigned variable is tainted; later assignments and collections take it over; a sink that holds
    a tainted variable ends a flow. A sanitizer of the sink's kind on any line from the source up to the sink clears it.
    """
    rows = text.replace("\r\n", "\n").split("\n")
    language = language.lower()
    sources = [(k, p) for lang, k, ps in SOURCES if lang == language for p in ps]
    sinks = [(k, p) for lang, k, ps in SINKS if lang == language for p in ps]
    out = []
    for i, line in enumerate(rows, 1):
        if from_line is not None and i != from_line:
            continue
        kind = next((k for k, p in sources if p in line), None if from_line is None else "user_input")
        if kind is None:
            continue
        m = _ASSIGN.match(line)
        tainted = [m[1]] if m else []
        for j in range(i, len(rows) + 1):
            now = rows[j - 1]
            if j > i:
                a, c = _ASSIGN.match(now), _CALL.search(now)
                if a and a[1] not in tainted and any(v in a[2] for v in tainted):
                    tainted.append(a[1])
                elif c and c[1] not in tainted and any(v in c[2] for v in tainted):
                    tainted.append(c[1])
            for sink, p in sinks:
                if p in now and (any(v in now for v in tainted) if j > i else any(q in now.split(p, 1)[1] for k, q in sources)):
                    clean = any(x in rows[n - 1] for n in range(i, j) for x in SANITIZERS.get(sink, ()))
                    if keep_sanitized or not clean:
                        out.append((i, kind, j, sink, ",".join(tainted), clean))
                    break
    return out


def find_injections(texts: DataFrame, key: str, text: str, language: str, from_line: int | None = None, keep_sanitized: bool = False) -> DataFrame:
    """(key, source_line, source_kind, sink_line, sink_kind, variables, sanitized): one text at a time, each in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "source_line", "source_kind", "sink_line", "sink_kind", "variables", "sanitized"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [(k, *f) for k, t, lang in zip(*(b.column(c).to_pylist() for c in ("key", "text", "language"))) for f in walk(t, lang or "", from_line, keep_sanitized)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    src = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(language).alias("language"))
    return src.mapInArrow(run, "key string, source_line int, source_kind string, sink_line int, sink_kind string, variables string, sanitized boolean")
