"""Answers to questions about a repository, one builder for each intent.

A builder takes the results (tables by name) and gives one row: intent, answer and
citations.  An answer is made of numbered lines: facts, which are one-row tables, and
lists, which are the first few rows of a result; what is collected is bounded by those
few.  A result that is missing counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import findings, graph

Tables = dict[str, DataFrame]
CITATION = "array<struct<type:string,reference:string,snippet:string,relevance:double>>"
#: How many rows an answer lists, and how many it cites.
LISTED = {"security": 8, "performance": 8, "apis": 15, "database": 10, "dependencies": 10, "cycles": 5, "debt": 8, "git": 6, "entry_points": 8, "symbols": 6, "features": 6, "layers": 20}
CITED = {"security": 6, "performance": 6, "apis": 5, "database": 5, "debt": 4, "git": 4, "architecture": 8, "symbols": 6, "entry_points": 8}
#: File names that a program starts from (fixed values).
ENTRY_FILES = ["main.py", "manage.py", "app.py", "server.py", "wsgi.py", "asgi.py", "index.ts", "index.tsx", "index.js", "app.tsx", "main.ts", "vite.config.ts"]


class Answer:
    """The lines and citations of one answer."""

    def __init__(self, spark: SparkSession, tables: Tables, intent: str, title: str):
        self.spark, self.tables, self.intent = spark, tables, intent
        self.parts: list[DataFrame] = []
        self.cited: list[DataFrame] = []
        self.say(title)

    def rows(self, name: str, schema: str) -> DataFrame:
        """A result, or an empty table of the columns that the answer needs."""
        found = self.tables.get(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def say(self, text: str) -> None:
        self.fact(self.spark.range(1), F.lit(text))

    def fact(self, one: DataFrame, text: Column) -> None:
        self.parts.append(one.select(F.lit(len(self.parts)).alias("part"), F.lit(0).alias("n"), text.alias("line")).filter("line is not null"))

    def count(self, label: str, rows: DataFrame) -> None:
        self.fact(rows.agg(F.count(F.lit(1)).alias("n")), F.concat(F.lit(f"- {label}: "), F.col("n").cast("string")))

    def listed(self, title: str, rows: DataFrame, order: list, text: Column, top: int, none: str | None = None) -> None:
        """A title and the first rows, if there are any; ``none`` otherwise."""
        first = self._first(rows, order, top)
        self.fact(first.filter("__n = 1"), F.lit(title))
        self.parts.append(first.select(F.lit(len(self.parts)).alias("part"), F.col("__n").alias("n"), text.alias("line")))
        if none:
            self.fact(rows.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), F.lit(none))

    def cite(self, rows: DataFrame, order: list, reference: Column, snippet: Column, relevance: float, kind: str = "file", top: int | None = None) -> None:
        first = self._first(rows, order, top or CITED[self.intent])
        self.cited.append(first.select(F.lit(len(self.cited)).alias("part"), F.col("__n").alias("n"), F.struct(F.lit(kind).alias("type"), reference.alias("reference"), snippet.alias("snippet"), F.lit(relevance).alias("relevance")).alias("c")))

    def _first(self, rows: DataFrame, order: list, top: int) -> DataFrame:
        return rows.orderBy(*order).limit(top).withColumn("__n", F.row_number().over(Window.orderBy(*order)))

    def row(self) -> DataFrame:
        """(intent, answer, citations)."""
        lines = reduce(DataFrame.unionByName, self.parts).agg(F.array_sort(F.collect_list(F.struct("part", "n", "line"))).alias("l"))
        answer = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
        out = lines.select(F.lit(self.intent).alias("intent"), answer.alias("answer"))
        if not self.cited:
            return out.withColumn("citations", F.array().cast(CITATION))
        cited = reduce(DataFrame.unionByName, self.cited).agg(F.array_sort(F.collect_list(F.struct("part", "n", "c"))).alias("c"))
        return out.join(F.broadcast(cited.select(F.transform("c", lambda x: x["c"]).cast(CITATION).alias("citations"))))  # one row each


def _place(path: str = "file_path", line: str = "line_no") -> Column:
    return F.concat_ws(":", F.col(path), F.when(F.col(line) > 0, F.col(line)).cast("string"))


def _severity() -> Column:
    return F.array_position(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), F.lower("severity"))


def security(a: Answer) -> None:
    rows = a.rows("security", "file_path string, line_no int, title string, severity string, recommendation string")
    a.fact(findings.risk_score(rows), F.concat(F.lit("- Risk score: "), F.col("risk_score").cast("string"), F.lit("/100")))
    a.count("Findings", rows)
    sums = rows.agg(*[F.count(F.when(F.lower("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low", "info")])
    a.fact(sums, F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in ("critical", "high", "medium", "low", "info")]))
    order = [_severity(), "file_path", "line_no", "title"]
    advice = F.coalesce(F.concat(F.lit("; "), "recommendation"), F.lit("")) if "recommendation" in rows.columns else F.lit("")
    a.listed("Most severe:", rows, order, F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), "title", F.lit(" at "), _place(), advice), LISTED["security"], "The rules found nothing.")
    a.cite(rows, order, _place(), F.col("title"), 0.95)


def performance(a: Answer) -> None:
    rows = a.rows("performance", "type string, severity string, name string, file_path string, line_no int")
    a.count("Performance findings", rows)
    order = [_severity(), "file_path", "line_no", "name"]
    a.listed("Found:", rows, order, F.concat(F.lit("- ["), F.upper("type"), F.lit("] "), "name", F.lit(" at "), _place()), LISTED["performance"], "No antipattern was found.")
    a.cite(rows, order, _place(), F.concat_ws(" ", "type", "name"), 0.92)


def architecture(a: Answer) -> None:
    pattern = a.rows("pattern", "pattern string, confidence double")
    a.fact(pattern, F.concat(F.lit("- Pattern: "), "pattern", F.lit(", confidence "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")))
    tiers = a.rows("layers", "tier string, files long, components array<string>")
    a.listed("Layers:", tiers, ["tier"], F.concat(F.lit("- "), "tier", F.lit(": "), F.col("files").cast("string"), F.lit(" files; "), F.array_join("components", ", ")), LISTED["layers"], "No layer was recognised.")
    parts = tiers.select("tier", F.explode(F.slice("components", 1, 2)).alias("component"))
    a.cite(parts, ["tier", "component"], F.col("component"), F.concat("tier", F.lit(" layer")), 0.9)


def dependencies(a: Answer) -> None:
    packages, cycles = a.rows("packages", "name string, type string"), a.rows("cycles", "cycle array<string>, length int")
    a.count("Packages", packages)
    a.count("Circular dependencies", cycles)
    chain = F.array_join(F.col("cycle").cast("array<string>"), " -> ")
    a.listed("Cycles:", cycles, ["length", "cycle"], F.concat(F.lit("- "), chain), LISTED["cycles"], "The modules form no cycle.")
    a.listed("Packages:", packages, ["name", "type"], F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")")), LISTED["dependencies"])
    a.cite(cycles, ["length", "cycle"], F.array_join(F.slice(F.col("cycle").cast("array<string>"), 1, 3), " -> "), F.lit("Circular dependency"), 0.95, "graph", 1)


def apis(a: Answer) -> None:
    rows, used = a.rows("endpoints", "method string, path string, handler string, file_path string, line_no int"), a.rows("frameworks", "framework string")
    a.count("Endpoints", rows)
    a.fact(used.agg(F.array_join(F.array_sort(F.collect_set("framework")), ", ").alias("f")).filter("f <> ''"), F.concat(F.lit("- Frameworks: "), "f"))
    order = ["file_path", "line_no", "path", "method"]
    a.listed("Found:", rows, order, F.concat(F.lit("- "), F.upper("method"), F.lit(" "), "path", F.lit(" -> "), "handler", F.lit("() in "), "file_path"), LISTED["apis"], "No endpoint was found.")
    a.cite(rows, order, _place(), F.concat_ws(" ", "method", "path"), 0.9)


def database(a: Answer) -> None:
    rows, links = a.rows("tables", "name string, columns array<struct<name:string>>, file_path string"), a.rows("relationships", "from_table string")
    a.count("Tables", rows)
    a.count("Relationships", links)
    named = F.array_join(F.transform(F.slice("columns", 1, 5), lambda c: c["name"]), ", ")
    a.listed("Tables:", rows, ["name", "file_path"], F.concat(F.lit("- "), "name", F.lit(": "), named, F.lit(" in "), "file_path"), LISTED["database"], "No model was found.")
    a.cite(rows, ["name", "file_path"], F.col("file_path"), F.concat(F.lit("Table "), "name"), 0.9)


def debt(a: Answer) -> None:
    rows = a.rows("debt", "type string, severity string, name string, file_path string, effort_hours double, priority int")
    a.fact(findings.debt_score(rows), F.concat(F.lit("- Debt score: "), F.col("debt_score").cast("string"), F.lit("/100, "), F.col("effort_hours").cast("string"), F.lit(" hours")))
    a.count("Items", rows)
    order = ["priority", "file_path", "name", "type"]
    a.listed("First to mend:", rows, order, F.concat(F.lit("- "), "type", F.lit(" "), "name", F.lit(" in "), "file_path"), LISTED["debt"], "Nothing was found.")
    a.cite(rows, order, F.col("file_path"), F.concat_ws(" ", "type", "name"), 0.85)


def git(a: Answer) -> None:
    people, rows = a.rows("contributors", "author string, commits long"), a.rows("hotspots", "path string, changes long")
    a.fact(people.agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("p")), F.concat(F.lit("- Commits: "), F.col("n").cast("string"), F.lit(" by "), F.col("p").cast("string"), F.lit(" contributors")))
    order = [F.desc("changes"), "path"]
    a.listed("Changed most:", rows, order, F.concat(F.lit("- "), "path", F.lit(": "), F.col("changes").cast("string"), F.lit(" changes")), LISTED["git"], "No history was read.")
    a.cite(rows, order, F.col("path"), F.concat(F.col("changes").cast("string"), F.lit(" changes")), 0.9)


def health(a: Answer) -> None:
    one = a.rows("health", "risk_score double, debt_score double, n_slow long, health_score double")
    a.fact(one, F.concat(F.lit("- Health score: "), F.col("health_score").cast("string"), F.lit("/100, from 100.0")))
    for column, most, label in (("risk_score", 50.0, "security risk"), ("debt_score", 30.0, "technical debt")):
        a.fact(one, F.concat(F.lit("- less "), F.round(F.least(column, F.lit(most)), 1).cast("string"), F.lit(f" for {label}")))
    a.fact(one, F.concat(F.lit("- less "), F.least(2 * F.col("n_slow"), F.lit(20)).cast("string"), F.lit(" for "), F.col("n_slow").cast("string"), F.lit(" performance findings")))


def _languages(a: Answer) -> None:
    rows = a.rows("languages", "language string, files long, lines long")
    said = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "language"))), 1, 8), lambda x: x["language"]), ", ")
    a.fact(rows.agg(said.alias("s"), F.sum("files").alias("files"), F.sum("lines").alias("lines")).filter("files > 0"), F.concat(F.lit("- Languages: "), "s", F.lit("; "), F.col("files").cast("string"), F.lit(" files, "), F.col("lines").cast("string"), F.lit(" lines")))


def tech_stack(a: Answer) -> None:
    _languages(a)
    one = a.rows("facts", "frameworks array<string>, package_managers array<string>")
    for column, label in (("frameworks", "Frameworks"), ("package_managers", "Package managers")):
        a.fact(one.filter(F.size(column) > 0), F.concat(F.lit(f"- {label}: "), F.array_join(column, ", ")))
    a.count("Endpoints", a.rows("endpoints", "path string"))
    a.count("Tables", a.rows("tables", "name string"))


def _readme(a: Answer) -> DataFrame:
    """What the first documentation file says."""
    return a.rows("readme", "file_path string, description string, features array<string>, commands array<string>").orderBy("file_path").limit(1)


def explain(a: Answer) -> None:
    one = _readme(a)
    a.fact(one.filter("description <> ''"), F.col("description"))
    said = one.select("file_path", F.posexplode("features").alias("i", "feature"))
    a.listed("Features:", said, ["i"], F.concat(F.lit("- "), "feature"), LISTED["features"])
    a.fact(a.rows("pattern", "pattern string"), F.concat(F.lit("- Pattern: "), "pattern"))
    _languages(a)
    a.fact(a.rows("health", "health_score double"), F.concat(F.lit("- Health score: "), F.round("health_score").cast("int").cast("string"), F.lit("/100")))
    a.cite(one, ["file_path"], F.col("file_path"), F.lit("Documentation"), 0.99, top=1)


def setup(a: Answer) -> None:
    one = _readme(a)
    said = one.select("file_path", F.posexplode("commands").alias("i", "command"))
    a.listed("Commands:", said, ["i"], F.col("command"), 3, "The documentation names no command.")
    packages = a.rows("packages", "name string, source string").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    a.listed("Manifests:", packages, ["source"], F.concat(F.lit("- "), "source", F.lit(": "), F.col("n").cast("string"), F.lit(" packages")), 8)
    a.cite(one, ["file_path"], F.col("file_path"), F.lit("Documentation"), 0.99, top=1)


def entry_points(a: Answer) -> None:
    starts = reduce(lambda c, name: c | F.lower("path").endswith(name), ENTRY_FILES, F.lit(False))
    rows = a.rows("files", "path string").filter(starts)
    a.listed("Files:", rows, ["path"], F.concat(F.lit("- "), "path"), LISTED["entry_points"], "No file has a name that programs start from.")
    a.cite(rows, ["path"], F.col("path"), F.lit("Entry point"), 0.95)


def symbols(a: Answer, question: str = "") -> None:
    """What the question's words name in the graph."""
    nodes = a.rows("nodes", "id string, labels array<string>, name string, file_path string, docstring string")
    asked = a.spark.range(1).select("id", F.lit(question).alias("said")).withColumnRenamed("id", "q")
    named = graph.named_in(nodes.filter(F.char_length("name") >= 3), F.col("said"), asked, "q")
    rows = nodes.join(named.select("id"), "id", "left_semi").withColumn("label", F.coalesce(F.get("labels", F.lit(0)), F.lit("Symbol")))
    order = ["label", "name", "file_path", "id"]
    doc = F.coalesce(F.concat(F.lit(": "), F.substring("docstring", 1, 200)), F.lit(""))
    a.listed("Named:", rows, order, F.concat(F.lit("- "), "label", F.lit(" "), "name", F.lit(" in "), F.coalesce("file_path", F.lit("?")), doc), LISTED["symbols"], "The question names nothing that the graph holds.")
    a.cite(rows, order, F.coalesce("file_path", "name"), F.concat_ws(" ", "label", "name"), 0.98)


def overview(a: Answer) -> None:
    one = _readme(a)
    a.fact(one.filter("description <> ''"), F.col("description"))
    a.fact(a.rows("pattern", "pattern string"), F.concat(F.lit("- Pattern: "), "pattern"))
    _languages(a)
    a.count("Security findings", a.rows("security", "title string"))
    a.say("Ask about its purpose, set-up, architecture, security, dependencies, endpoints, tables, debt, history or health.")


BUILDERS: dict[str, tuple[str, Callable[[Answer], None]]] = {
    "explain": ("What it is", explain), "setup": ("How to run it", setup), "entry_points": ("Where it starts", entry_points), "tech_stack": ("What it is made with", tech_stack),
    "health": ("How healthy it is", health), "security": ("Security", security), "architecture": ("Architecture", architecture), "performance": ("Performance", performance),
    "dependencies": ("Dependencies", dependencies), "apis": ("Endpoints", apis), "database": ("Database", database), "debt": ("Technical debt", debt), "git": ("History", git),
    "symbols": ("Symbols", symbols), "overview": ("Overview", overview),
}


def answer(spark: SparkSession, tables: Tables, intent: str, question: str = "") -> DataFrame:
    """(intent, answer, citations) of one intent."""
    title, build = BUILDERS[intent]
    a = Answer(spark, tables, intent, title)
    if intent == "symbols":
        symbols(a, question)
    else:
        build(a)
    return a.row()
