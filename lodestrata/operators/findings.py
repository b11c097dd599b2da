"""Rule engines: security, technical debt, performance, and the scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import any_of, is_code, lines_of, severity_weight
from lodestrata.plans import rules

FINDING = ["file_path", "line_no", "family", "title", "severity"]


# ------------------------------------------------------------------ security


def _comment(line: Column) -> Column:
    return F.trim(line).startswith("#")


#: Texts of which a pattern's match holds one, in lower case; by the rule's title.
TRIGGERS = {
    "Hardcoded API key": ["api_key", "api-key", "apikey"],
    "Hardcoded password": ["password", "passwd", "pwd"],
    "Hardcoded secret/token": ["secret", "token", "auth"],
    "AWS Access Key": ["aws_access_key_id"],
    "Hardcoded private key": ["private"],
    "Private key in source": ["private key"],
    "Hardcoded database connection string": ["database_url", "db_url", "connection_string"],
    "f-string in SQL query (SQL injection risk)": ["execute", "query", "raw"],
    "String formatting in SQL query": ["execute", "query", "raw"],
    "String concatenation in SQL query": ["execute", "query", "raw"],
    ".format() in SQL statement": [".format"],
    "MD5 hash — cryptographically weak": ["md5"],
    "SHA-1 hash — cryptographically weak": ["sha1"],
    "DES encryption — weak cipher": ["des"],
    "RC4 encryption — weak cipher": ["rc4"],
    "SSL verification disabled": ["verify"],
    "HTTPS verification disabled": ["https"],
    "Debug mode enabled": ["debug"],
    "CORS allows all origins": ["cors"],
    "CORS wildcard origin": ["allow_origins"],
}


def _known() -> list[tuple[str, str, str, list[str], Callable[[Column, Column], Column]]]:
    """Each rule: family, title, severity, texts of which a line that breaks it holds one (in
    lower case), and whether a line, given also in lower case, breaks it.  A pattern is tried only
    on lines with one of those texts, which a plain search finds much faster."""

    def matches(pattern: str, title: str) -> Callable[[Column, Column], Column]:
        return lambda line, low: any_of(low, TRIGGERS[title]) & line.rlike(pattern)

    def secret(pattern: str, title: str) -> Callable[[Column, Column], Column]:
        return lambda line, low: matches(pattern, title)(line, low) & ~any_of(low, rules.PLACEHOLDERS)

    def holds(text: str) -> Callable[[Column, Column], Column]:
        return lambda line, low: line.contains(text) & ~_comment(line)

    def weak(pattern: str, title: str) -> Callable[[Column, Column], Column]:
        # word bounds as for any letters, whatever the Java version's default
        return lambda line, low: matches("(?U)" + pattern, title)(line, low) & ~_comment(line)

    return [
        *[("secret-detection", t, s, TRIGGERS[t], secret(p, t)) for p, t, s in rules.SECRETS],
        *[("sql-injection", t, "high", TRIGGERS[t], matches(p, t)) for p, t in rules.SQL_INJECTION],
        *[("dangerous-function", t, s, [p.lower()], holds(p)) for p, t, s in rules.DANGEROUS],
        *[("weak-crypto", t, "medium", TRIGGERS[t], weak(p, t)) for p, t in rules.WEAK_CRYPTO],
        *[("misconfiguration", t, s, TRIGGERS[t], matches(p, t)) for p, t, s in rules.MISCONFIGURED],
    ]


def scannable(files: DataFrame) -> DataFrame:
    """Files of a known language that the security scan reads."""
    return files.filter(F.col("language").isNotNull() & ~F.col("language").isin("", *rules.UNSCANNED) & F.col("size_bytes").between(1, rules.MAX_SCANNED_BYTES))


def security_findings(lines: DataFrame, families: list[str] | None = None) -> DataFrame:
    """One finding for each rule of a file, at its first line, from (file_path, line_no, line).

    All rules are tried in one pass over the lines; only hits leave the scan, and the first
    line of each is a minimum, which combines before the shuffle."""
    line, low = F.col("line"), F.col("__low")
    hits = [F.when(broken(line, low), F.struct(F.lit(family).alias("family"), F.lit(title).alias("title"), F.lit(severity).alias("severity"))) for family, title, severity, _, broken in _known() if families is None or family in families]
    lines = lines.select("file_path", "line_no", "line", F.lower("line").alias("__low"))
    rows = lines.select("file_path", "line_no", F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return rows.groupBy("file_path", "r.family", "r.title", "r.severity").agg(F.min("line_no").alias("line_no")).select(*FINDING)


def risk_within(text: Column) -> Column:
    """(findings, risk_score) of one text, in place: how many rules its lines break, and the
    severities' weights, up to 100.  A rule is tried on the lines of texts with its texts only."""

    def on_line(rule: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        return lambda x: rule(x, F.lower(x))

    def judged(said: Column) -> Column:
        lines, low = said["lines"], said["low"]
        broken = [(F.when(any_of(low, triggers), F.exists(lines, on_line(rule))).otherwise(False), severity) for _, _, severity, triggers, rule in _known()]
        count = reduce(lambda a, b: a + b, [F.when(b, 1).otherwise(0) for b, _ in broken])
        weight = reduce(lambda a, b: a + b, [F.when(b, rules.RISK_WEIGHTS[s]).otherwise(0) for b, s in broken])
        return F.struct(count.cast("long").alias("findings"), F.least(weight, F.lit(100)).cast("double").alias("risk_score"))

    # one struct, so that the text is cut and lower-cased once
    return F.transform(F.array(F.struct(lines_of(text).alias("lines"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))), judged)[0]


def with_recommendation(findings: DataFrame) -> DataFrame:
    said = F.concat(F.lit("Review and remediate this "), F.col("severity"), F.lit("-severity finding."))
    return findings.withColumn("recommendation", said).withColumn("finding_id", F.substring(F.sha2(F.concat_ws(":", "file_path", "family", "title", "line_no"), 256), 1, 32))


# ---------------------------------------------------------------------- debt

DEBT = ["type", "severity", "name", "file_path", "effort_hours", "priority"]


def _debt(rows: DataFrame, kind: str, severity: Column | str, effort: Column | float, priority: Column | int) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(kind).alias("type"), column(severity).alias("severity"), F.col("name"), "file_path", column(effort).cast("double").alias("effort_hours"), column(priority).cast("int").alias("priority"))


def god_classes(symbols: DataFrame, least: int = rules.GOD_CLASS_METHODS) -> DataFrame:
    """Classes with many methods, by the name that the methods give as their parent."""
    methods = symbols.filter(F.col("type").isin("function", "method")).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return _debt(symbols.filter("type = 'class'").join(methods, "name"), "god_class", "high", F.bround(F.col("n") * 0.25, 1), 1)


def long_methods(symbols: DataFrame, most: int = rules.LONG_METHOD_LINES) -> DataFrame:
    span = F.col("line_end") - F.col("line_start")
    return _debt(symbols.filter(F.col("type").isin("function", "method") & (span > most)), "long_method", "medium", F.bround((span - most) * 0.05, 1), 2)


def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Public functions that nothing calls and that aren't entry points."""
    public = symbols.filter(F.col("type").isin("function", "method") & ~F.col("name").startswith("_") & ~F.col("name").rlike(rules.ENTRY_POINT))
    callees = calls.filter(F.coalesce("callee", F.lit("")) != "").select(F.col("callee").alias("name")).distinct()
    return _debt(public.join(callees, "name", "left_anti"), "dead_code", "low", 0.5, 3)


def todo_comments(lines: DataFrame) -> DataFrame:
    tag = F.upper(F.regexp_extract("line", r"(?i)#\s*(TODO|FIXME|HACK|XXX)\b", 1))
    known = F.create_map(*[F.lit(x) for pair in rules.TODO_SEVERITY.items() for x in pair])
    rows = lines.filter(is_code(F.col("file_path"))).withColumn("name", tag).filter("name <> ''").withColumn("severity", F.try_element_at(known, F.col("name")))
    return _debt(rows, "todo_comment", F.col("severity"), 0.25, F.when(F.col("severity") == "low", 4).otherwise(2))


def missing_docstrings(symbols: DataFrame) -> DataFrame:
    rows = symbols.filter(F.col("type").isin("class", "function", "method") & (F.coalesce("docstring", F.lit("")) == ""))
    return _debt(rows, "missing_docstring", "info", 0.1, 5)


def debt_items(symbols: DataFrame, calls: DataFrame, lines: DataFrame) -> DataFrame:
    parts = [god_classes(symbols), long_methods(symbols), dead_code(symbols, calls), todo_comments(lines), missing_docstrings(symbols)]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------- performance

SLOW = ["type", "severity", "name", "file_path", "line_no"]


def _slow(rows: DataFrame, kind: str, severity: str, line: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "name", "file_path", line.cast("int").alias("line_no"))


def n_plus_one(symbols: DataFrame, calls: DataFrame, least: int = 2) -> DataFrame:
    """Functions that call several distinct query-like callees."""
    some = calls.filter(any_of(F.lower("callee"), rules.QUERY_WORDS) & (F.coalesce("caller", F.lit("")) != ""))
    many = some.groupBy(F.col("caller").alias("name")).agg(F.countDistinct("callee").alias("n")).filter(F.col("n") >= least)
    return _slow(symbols.filter(F.col("type").isin("function", "method")).join(many, "name"), "n_plus_one", "high", F.col("line_start"))


def large_objects(files: DataFrame, most: int = rules.LARGE_FILE_BYTES) -> DataFrame:
    rows = files.filter((F.col("size_bytes") > most) & is_code(F.col("path"))).select(F.col("path").alias("name"), F.col("path").alias("file_path"))
    return _slow(rows, "large_object", "medium", F.lit(0))


def missing_pagination(symbols: DataFrame) -> DataFrame:
    """Route handlers without a paging parameter."""
    routed = any_of(F.array_join(F.transform("decorators", lambda d: F.concat(F.when(d.startswith("@"), F.lit("")).otherwise(F.lit("@")), d)), " "), rules.ROUTE_MARKS)
    paged = F.exists("parameters", lambda p: F.lower(p["name"]).isin(*rules.PAGING_PARAMETERS))
    return _slow(symbols.filter(F.col("type").isin("function", "method") & routed & ~F.coalesce(paged, F.lit(False))), "missing_pagination", "low", F.col("line_start"))


def circular_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One finding for each module whose imports name the module itself."""
    module = F.split("module", r"\.")[0]
    names = imports.filter((F.coalesce("module", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")).select(module.alias("owner"), F.col("name").alias("imported")).distinct()
    owner = F.coalesce(F.when(F.col("parent") != "", F.col("parent")), F.col("name"))
    rows = symbols.filter(F.col("type").isin("function", "method")).withColumn("owner", owner).join(names, "owner").filter(F.lower("imported").contains(F.lower("owner")))
    first = rows.groupBy("owner").agg(F.min(F.struct("file_path", "line_start")).alias("at"))
    return _slow(first.select(F.col("owner").alias("name"), "at.file_path", "at.line_start"), "circular_dep", "medium", F.col("line_start"))


def performance_findings(files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [n_plus_one(symbols, calls), large_objects(files), missing_pagination(symbols), circular_imports(symbols, imports)])


# -------------------------------------------------------------------- scores


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def score(findings: DataFrame, weights: dict[str, int], name: str) -> DataFrame:
    """One row: the sum of the findings' weights, 100 at most."""
    total = F.coalesce(F.sum(severity_weight(F.col("severity"), weights)), F.lit(0))
    return findings.agg(F.least(total, F.lit(100)).cast("double").alias(name))


def risk_score(findings: DataFrame) -> DataFrame:
    return score(findings, rules.RISK_WEIGHTS, "risk_score")


def debt_score(items: DataFrame) -> DataFrame:
    hours = items.agg(F.bround(F.coalesce(F.sum("effort_hours"), F.lit(0.0)), 1).alias("effort_hours"))
    return score(items, rules.DEBT_WEIGHTS, "debt_score").join(F.broadcast(hours))  # one row each


def health_score(risk: DataFrame, debt: DataFrame, slow: DataFrame) -> DataFrame:
    """One row from the two scores and the number of performance findings."""
    parts = risk.select("risk_score").join(F.broadcast(debt.select("debt_score"))).join(F.broadcast(slow.agg(F.count(F.lit(1)).alias("n_slow"))))  # one row each
    left = 100 - F.least("risk_score", F.lit(50)) - F.least("debt_score", F.lit(30)) - F.least(2 * F.col("n_slow"), F.lit(20))
    return parts.select("*", F.bround(F.greatest(F.least(left, F.lit(100.0)), F.lit(0.0)), 1).alias("health_score"))
