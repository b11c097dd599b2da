"""Filters and views that people explore results with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Node types by their spelling in lower case without separators (fixed values).
NODE_TYPES = {
    "class": "Class", "interface": "Interface", "function": "Function", "method": "Method", "typealias": "TypeAlias", "type": "TypeAlias", "file": "File", "module": "Module",
    "repository": "Repository", "repo": "Repository", "variable": "Variable", "var": "Variable", "service": "Service", "api": "API", "endpoint": "API", "table": "Table",
    "commit": "Commit", "developer": "Developer", "author": "Developer",
}
#: Edges that stand between tiers if none was found (fixed values).
TIER_FLOW = [
    ("presentation", "api", "HTTP / REST & WS"),
    ("api", "service", "Dispatches & Invokes"),
    ("service", "data", "Queries & Persists"),
    ("service", "infrastructure", "Config & Telemetry"),
    ("api", "infrastructure", "Config & Auth"),
]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
RUN_WORDS = ["npm ", "python ", "pip ", "yarn ", "docker", "manage.py"]
NOT_FEATURES = ["http", "license", "badge", "npm install"]


def node_type(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in NODE_TYPES.items() for x in p])
    plain = F.regexp_replace(F.lower(raw), r"[\s_-]+", "")
    return F.when(F.coalesce(raw, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(known, plain), F.concat(F.upper(F.substring(raw, 1, 1)), F.substr(raw, F.lit(2)))))


def find_endpoints(endpoints: DataFrame, text: str = "", method: str | None = None) -> DataFrame:
    """Endpoints whose path, handler or file holds a text, of one method."""
    low = text.lower()
    rows = endpoints.filter(F.lower("path").contains(low) | F.lower("handler").contains(low) | F.lower("file_path").contains(low))
    return rows if method is None else rows.filter(F.col("method") == method)


def find_findings(findings: DataFrame, severity: str | None = None, limit: int | None = None) -> DataFrame:
    rows = findings if severity is None else findings.filter(F.lower("severity") == severity.lower())
    return rows if limit is None else rows.orderBy("file_path", "line_no").limit(limit)


def find_tables(tables: DataFrame, text: str) -> DataFrame:
    """Tables with a text in their name or a column's."""
    low = text.lower()
    return tables.filter(F.lower("name").contains(low) | F.exists("columns", lambda c: F.lower(c["name"]).contains(low)))


def by_severity(findings: DataFrame, key: str) -> DataFrame:
    """Counts of severities, side by side."""
    return findings.groupBy(key).pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).fillna(0, SEVERITIES)


def with_share(rows: DataFrame, value: str) -> DataFrame:
    """A value in percent of the largest, from one total."""
    most = rows.agg(F.max(value).alias("__most"))  # one row
    return rows.join(F.broadcast(most)).withColumn("share", F.round(F.least(F.col(value) * 100.0 / F.col("__most"), F.lit(100.0)), 2)).drop("__most")


def recent(rows: DataFrame, day: str, n: int = 8) -> DataFrame:
    return rows.orderBy(F.desc(day)).limit(n)


def around(edges: DataFrame, node) -> DataFrame:
    """(id, side) of what a module depends on, and what depends on it."""
    into = edges.filter(F.col("dst") == node).select(F.col("src").alias("id"), F.lit("dependent").alias("side"))
    return into.unionByName(edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.lit("dependency").alias("side"))).distinct()


def flow_edges(edges: DataFrame, subsystems: DataFrame) -> DataFrame:
    """Subsystem edges (src, dst, label) and, between tiers without any, the flow's edge from
    their first subsystems.  ``subsystems`` is (tier, subsystem, ord)."""
    tier = subsystems.select("tier", "subsystem")
    pairs = edges.join(tier.toDF("a", "src"), "src").join(tier.toDF("b", "dst"), "dst").select("a", "b").distinct()
    first = subsystems.groupBy("tier").agg(F.min_by("subsystem", "ord").alias("first"))
    flow = edges.sparkSession.createDataFrame(TIER_FLOW, "a string, b string, label string").join(pairs, ["a", "b"], "left_anti")
    added = flow.join(first.toDF("a", "src"), "a").join(first.toDF("b", "dst"), "b").select("src", "dst", "label")
    return edges.select("src", "dst", F.lit("imports").alias("label")).unionByName(added)


def progress(rows: DataFrame, partition: str, order: str, start: float = 20.0, span: float = 15.0, every: int = 40) -> DataFrame:
    """Points of a phase's progress, every few rows."""
    w = Window.partitionBy(partition)
    i = F.row_number().over(w.orderBy(order)) - 1
    out = rows.withColumn("i", i).withColumn("progress", F.round(start + F.col("i") / F.count(F.lit(1)).over(w) * span, 3))
    return out.filter(F.col("i") % every == 0)


def readme(lines: DataFrame) -> DataFrame:
    """(file_path, description, features, commands) of documentation lines (file_path, line_no,
    line): its first long paragraphs, its bullets, and its blocks of commands.  The state over
    the lines is a running sum within the file."""
    w = Window.partitionBy("file_path").orderBy("line_no")
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.withColumn("t", text).withColumn("fence", F.col("t").startswith("```").cast("int"))
    rows = rows.withColumn("fences", F.sum("fence").over(w)).withColumn("gap", F.sum((F.col("t") == "").cast("int")).over(w))
    mark = F.col("t").rlike(r"^(#|---|```|!\[|\[!)")
    prose = rows.filter((F.col("t") != "") & ~mark).groupBy("file_path", "gap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("p"))
    prose = prose.filter((F.char_length("p") > 60) & ~F.col("p").rlike(r"^(\||http|Copyright)"))
    said = prose.groupBy("file_path").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("gap", "p"))), lambda x: x["p"]), 1, 3), "\n\n").alias("description"))
    bullet = F.regexp_replace("t", "^[-* ]+", "")
    other = F.lit(False)
    for word in NOT_FEATURES:
        other = other | F.col("b").contains(word)
    bullets = rows.filter(F.col("t").rlike("^[-*] ") & (F.char_length("t") > 15)).withColumn("b", bullet).filter(~other)
    features = bullets.groupBy("file_path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "b"))), lambda x: x["b"]), 1, 8).alias("features"))
    inside = rows.filter((F.col("fences") % 2 == 1) & (F.col("fence") == 0)).groupBy("file_path", "fences").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("c"))
    run = F.lit(False)
    for word in RUN_WORDS:
        run = run | F.col("c").contains(word)
    commands = inside.filter(run).groupBy("file_path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("fences", "c"))), lambda x: x["c"]), 1, 3).alias("commands"))
    none = F.array().cast("array<string>")
    out = lines.select("file_path").distinct().join(said, "file_path", "left").join(features, "file_path", "left").join(commands, "file_path", "left")
    return out.select("file_path", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("features", none).alias("features"), F.coalesce("commands", none).alias("commands"))


def package_context(files: DataFrame) -> DataFrame:
    """(file_path, title, description, features, commands) of package.json files (path, content):
    what stands in for documentation; the commands are the first six scripts."""
    some = files.filter((F.element_at(F.split("path", "/"), -1) == "package.json") & F.get_json_object("content", "$").isNotNull())
    read = some.select(F.col("path").alias("file_path"), F.from_json("content", "name string, description string, scripts map<string,string>").alias("j"))
    run = F.transform(F.slice(F.map_entries("j.scripts"), 1, 6), lambda e: F.concat(F.lit("npm run "), e["key"], F.lit(": "), e["value"]))
    none = F.array().cast("array<string>")
    return read.select("file_path", F.coalesce("j.name", F.lit("")).alias("title"), F.coalesce("j.description", F.lit("")).alias("description"), none.alias("features"), F.coalesce(run, none).alias("commands"))


def context(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, description, features, commands): what documentation says, or where there is
    none, what the package files say."""
    said = readme(lines)
    known = said.agg((F.count(F.lit(1)) > 0).alias("__said"))  # one row
    return said.unionByName(package_context(files).drop("title").join(F.broadcast(known)).filter("not __said").drop("__said"))


def reached(**sources: Callable[[], DataFrame]) -> DataFrame:
    """One row with the number of rows of each source; null for one that fails."""
    out = {}
    for name, rows in sources.items():
        try:
            out[name] = rows().count()
        except Exception:  # noqa: BLE001  a source that fails doesn't stop the others
            out[name] = None
    spark = SparkSession.active()
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{n} long" for n in out))


def summary(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out
