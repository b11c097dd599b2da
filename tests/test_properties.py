"""Properties that hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import discovery, findings, graph, history, retrieval
from lodestrata.plans import fixtures as fx
from lodestrata.plans import rules


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(4)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(26)}
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs] + [(0, 99, "x"), (0, 99, "y")], "src int, dst int, type string")
    nodes = spark.createDataFrame([(i,) for i in [*range(12), 99]], "id int")
    return pairs | {(0, 99)}, nodes, edges


def test_pagerank(random_graph):
    pairs, nodes, edges = random_graph
    got = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges, tolerance=1e-9, rounds=60).collect()}
    ids = [*range(12), 99]
    out = {i: [b for a, b in pairs if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / 13)
    for _ in range(60):
        loose = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / 13 + 0.85 * (sum(rank[a] / len(out[a]) for a in ids if i in out[a]) + loose / 13) for i in ids}
    assert sum(got.values()) == pytest.approx(1)
    assert got == pytest.approx(rank, abs=1e-6)


def test_cycles(random_graph):
    pairs, _, edges = random_graph
    got = [tuple(r["cycle"]) for r in graph.cycles(edges, 5).collect()]

    def walk(path):
        for b in [b for a, b in pairs if a == path[-1] and a != b]:
            if b == path[0]:
                yield tuple(path)
            elif b > path[0] and b not in path and len(path) < 5:
                yield from walk([*path, b])

    assert sorted(got) == sorted(c for i in range(12) for c in walk([i]) if len(c) > 1)


def test_paths_and_components(random_graph):
    pairs, _, edges = random_graph
    got = sorted(tuple(r["path"]) for r in graph.paths(edges, 0, 5, 4).collect())

    def walk(path):
        if path[-1] == 5:
            yield tuple(path)
        elif len(path) < 5:
            for b in [b for a, b in pairs if a == path[-1] and b not in path]:
                yield from walk([*path, b])

    assert got == sorted(walk([0]))
    found = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert all(found[a] == found[b] for a, b in pairs)


def test_subgraph_is_induced(spark):
    nodes, edges = graph.subgraph(fx.frame(spark, fx.NODES), fx.frame(spark, fx.EDGES), ["File", "Class"])
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in edges.collect()) and ids == {"f1", "f2", "c1"}


def test_three_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "I"), ("b", "c", "I"), ("c", "a", "I")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r["cycle"] for r in graph.cycles(edges).collect()] == [["a", "b", "c"]]
    assert {round(r["score"], 9) for r in graph.pagerank(nodes, edges).collect()} == {round(1 / 3, 9)}
    assert graph.hubs(nodes, edges).count() == 3


def test_chunks_rebuild_the_text(spark):
    texts = ["", "short", "x" * 450, "y" * 451, "".join(map(str, range(700)))]
    rows = retrieval.chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").collect()
    for i, text in enumerate(texts):
        own = sorted((r["chunk_index"], r["chunk"]) for r in rows if r["id"] == i)
        assert "".join(c if k == 0 else c[50:] for k, c in own) == text


def test_scores_are_capped(spark):
    many = spark.createDataFrame([("critical",)] * 9, "severity string")
    assert findings.risk_score(many).first()[0] == 100 and findings.risk_score(many.limit(0)).first()[0] == 0
    assert findings.risk_score(many.limit(2)).first()[0] == 50


def test_lines_as_python_splits_them(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\n\nd", "x\x0by\x0cz\x85w v u\x1ct"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.lines_of(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in rows] == [t.splitlines() for t in texts]


def test_coupling_distance(spark):
    files = spark.createDataFrame([("c", p) for p in "abcdefg"], "commit_id string, path string")
    got = {(r["a"], r["b"]) for r in history.co_changes(files).collect()}
    assert got == {(a, b) for a in "abcdefg" for b in "abcdefg" if 0 < ord(b) - ord(a) <= 4}


def test_contributors_without_email(spark):
    commits = spark.createDataFrame([("1", 0, None, "N", "2024-01-02", 1, 2), ("2", 1, "e", "Old", "2024-01-01", 3, 4), ("3", 2, "e", "New", "2024-01-03", 5, 6)], "commit_id string, seq int, author string, name string, at string, insertions int, deletions int")
    got = {r["author"]: r for r in history.contributors(commits, gate=1).collect()}
    assert got["unknown"]["commits"] == 1 and got["e"]["insertions"] == 3 and got["e"]["name"] == "Old"


@pytest.mark.parametrize("question,kind", [("how do i greet users", "code"), ("what's the architecture pattern", "architecture"), ("are there security vulnerabilities", "security"), ("why is this slow and the latency high", "performance"), ("tell me about the project", "general")])
def test_reasoning(spark, question, kind):
    assert spark.range(1).select(scalars.reasoning_type(F.lit(question))).first()[0] == kind


def test_every_rule_has_a_case(spark):
    found = {r["title"] for r in findings.security_findings(fx.frame(spark, fx.CODE_LINES)).collect()}
    every = {t for _, t, _ in [*rules.SECRETS, *rules.DANGEROUS, *rules.MISCONFIGURED]} | {t for _, t in [*rules.SQL_INJECTION, *rules.WEAK_CRYPTO]}
    assert found == every


def test_empty_architecture(spark):
    files = spark.createDataFrame([("x.py",), ("y.py",)], "path string")
    symbols = spark.createDataFrame([], "file_path string")
    rows = discovery.subsystems(files.filter("path = 'x.py'").union(files.filter("path = 'y.py'")), symbols).collect()
    assert [(r["subsystem"], r["files"]) for r in rows] == [("core_module", 2)]
    assert discovery.pattern(files).first()["pattern"] == "Undetermined"


def test_plans_prune_and_push(spark, tmp_path):
    """Scans read the columns that a query needs, and filters reach them."""
    spark.range(10).selectExpr("id doc_id", "'t' text", "'en' lang", "'s' source", "1L n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    from lodestrata.plans import queries

    plan = queries.QUERIES["language_counts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in plan
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).filter("n_chars > 5").select("doc_id")
    assert "GreaterThan(n_chars,5)" in docs._jdf.queryExecution().executedPlan().toString()
