"""The whole analysis of a repository: from files to stored results, and views of them.

``analyze`` builds all modules; one that fails is an error in the report and doesn't
stop the others.  With a ``store.Job``, each module is a stage of it: a run that was
cut short goes on after its last whole stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import discovery, explore, findings, graph, history, retrieval
from lodestrata.plans import answers, store
from lodestrata.session import cut, ship
from lodestrata.sources import files as sources
from lodestrata.sources import gitlog, manifests, parsers
from lodestrata.streaming.progress import PHASES


@dataclass
class Report:
    """Results by name, and what failed."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    job: store.Job | None = None

    def made(self, name: str, build: Callable[[], DataFrame], *after: str, progress: float | None = None) -> DataFrame:
        """Written, as a stage of the job if there is one."""
        return cut(build(), name) if self.job is None else self.job.stage(name, build, after, progress)

    def add(self, name: str, build: Callable[[], DataFrame]) -> None:
        try:
            self.tables[name] = self.made(name, build, "files", "parsed", progress=PHASES["analyzing"])  # made here, so that what fails when it runs is reported
        except Exception as error:  # noqa: BLE001  one module's failure is reported, not raised
            self.errors[name] = f"{type(error).__name__}: {error}"

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def module_links(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst) of relative imports between modules."""
    local = imports.filter(scalars.is_relative(F.col("module"), F.col("is_relative")))
    return local.select(scalars.file_module(F.col("file_path")).alias("src"), scalars.import_module(F.col("module")).alias("dst")).filter("src <> dst and dst <> ''")


def analyze(spark: SparkSession, root: str, repo_id: str = "repo", git: bool = False, job: str | None = None) -> Report:
    """All results of a source tree; ``job`` is a folder that keeps the stages, for a rerun."""
    ship(spark)
    report = Report(job=store.Job(spark, job, json.dumps([repo_id, store.fingerprint(spark, root)])) if job else None)
    files = report.made("files", lambda: sources.scan(spark, root, repo_id), progress=PHASES["cloned"])
    parsed = report.made("parsed", lambda: parsers.parse(files), "files", progress=PHASES["parsed"])
    symbols, imports, calls = (parsers.records(parsed, k) for k in ("symbols", "imports", "calls"))
    lines = sources.lines(files)
    t = report.tables
    t |= {"files": files, "symbols": symbols, "imports": imports, "calls": calls, "parse_errors": parsed.filter(F.size("errors") > 0).select("file_path", "errors")}
    scanned = findings.scannable(files).select(F.col("path").alias("file_path"))
    report.add("security", lambda: findings.with_recommendation(findings.security_findings(lines.join(scanned, "file_path", "left_semi"))))
    report.add("risk", lambda: findings.risk_score(t["security"]))
    report.add("debt", lambda: findings.debt_items(symbols, calls, lines))
    report.add("debt_score", lambda: findings.debt_score(t["debt"]))
    report.add("performance", lambda: findings.performance_findings(files, symbols, calls, imports))
    report.add("health", lambda: findings.health_score(t["risk"], t["debt_score"], t["performance"]))
    report.add("endpoints", lambda: discovery.endpoints(symbols))
    report.add("frameworks", lambda: discovery.frameworks(symbols, imports))
    report.add("tables", lambda: discovery.tables(symbols, imports))
    report.add("relationships", lambda: discovery.relationships(t["tables"]))
    report.add("diagram", lambda: discovery.diagram(t["tables"]))
    report.add("migrations", lambda: discovery.migrations(files))
    report.add("readme", lambda: explore.context(lines.filter(F.lower(F.element_at(F.split("file_path", "/"), -1)).startswith("readme")), files))
    report.add("packages", lambda: manifests.packages(files))
    report.add("facts", lambda: discovery.repository_facts(files, t["packages"]))
    report.add("pattern", lambda: discovery.pattern(files))
    report.add("subsystems", lambda: discovery.subsystems(files, symbols))
    report.add("layers", lambda: discovery.layers(t["subsystems"]))
    report.add("languages", lambda: files.filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines")).orderBy(F.desc("files"), "language"))
    report.add("service_edges", lambda: graph.service_edges(module_links(files, imports)))
    report.add("components", lambda: graph.strong_components(t["service_edges"]))
    report.add("cycles", lambda: graph.cycles(t["service_edges"], limit=25, components=t["components"]))
    report.add("service_nodes", lambda: graph.service_nodes(t["service_edges"], t["components"]))
    try:
        nodes, edges = graph.build(repo_id, files, symbols, imports, calls)
        for name, rows in (("nodes", nodes), ("edges", edges)):
            t[name] = report.made(name, lambda: rows, "files", "parsed", progress=PHASES["graph_built"])  # noqa: B023
    except Exception as error:  # noqa: BLE001
        report.errors["graph"] = f"{type(error).__name__}: {error}"
    report.add("chunks", lambda: retrieval.embedded(retrieval.chunks(files.filter(scalars.is_code(F.col("path")) & F.col("content").isNotNull()).select("path", "language", "content"), "content"), repo_id, "path"))
    if git:
        try:
            commits, touched = gitlog.commits(spark, root)
            t |= {"contributors": history.contributors(commits), "hotspots": history.hotspots(commits, touched, 300), "coupling": history.coupling(touched.filter("seq < 200").select("commit_id", "path")), "frequency": history.frequency(commits)}
        except Exception as error:  # noqa: BLE001
            report.errors["git"] = f"{type(error).__name__}: {error}"
    return report


def save(report: Report, where: str, job: str = "job", repo_id: str = "repo") -> None:
    """Store all results of a repository, in the place of its earlier ones and beside those of
    others (see ``store.ResultStore``), and a row on the job: its state, what failed, and the
    small results as one JSON text."""
    spark = next(iter(report.tables.values())).sparkSession
    scores = {name: report[name].first().asDict(recursive=True) for name in ("risk", "debt_score", "health", "pattern", "facts") if name in report.tables}
    row = (job, "failed" if report.errors else "completed", 100.0, json.dumps(report.errors, sort_keys=True), json.dumps(scores, sort_keys=True, default=str))
    store.ResultStore(spark, where).save(repo_id, report.tables, row)


def views(report: Report, prefix: str = "") -> list[str]:
    """Register all results as views, so that SQL over them answers any question."""
    for name, rows in report.tables.items():
        rows.createOrReplaceTempView(prefix + name)
    return sorted(prefix + n for n in report.tables)


def ask(report: Report, question: str) -> DataFrame:
    """(intent, reasoning, answer, citations) of a question, from the results.  A question of no
    particular intent that names something in the graph is answered by what it names."""
    spark = next(iter(report.tables.values())).sparkSession
    q = spark.createDataFrame([(question,)], "question string").select(scalars.intent(F.col("question")).alias("i"), scalars.reasoning_type(F.col("question")).alias("reasoning"))
    found = q.first()
    intent = found["i"]
    if intent == "overview" and "nodes" in report.tables:
        asked = q.select(F.lit(0).alias("q"), F.lit(question).alias("said"))
        if not graph.named_in(report["nodes"].filter(F.char_length("name") >= 3), F.col("said"), asked, "q").isEmpty():
            intent = "symbols"
    out = answers.answer(spark, report.tables, intent, question)
    return out.select("intent", F.lit(found["reasoning"]).alias("reasoning"), "answer", "citations")
