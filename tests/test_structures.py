"""Strong components, stored indexes, substring joins, keyed streams, stores and jobs against
plain versions."""

import math
import random
import re
import time
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import discovery, explore, graph, ranking, substrings, textindex, vectorindex
from lodestrata.plans import lifecycle, store
from lodestrata.sources import files, parsers
from lodestrata.sources.published import Conflict, Published
from lodestrata.streaming import state


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------- strong components


def plain_components(edges):
    ids = sorted({x for e in edges for x in e})
    reach = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[i] = seen
    return sorted(((i, min(j for j in reach[i] if i in reach[j])) for i in ids), key=str)


def some_graphs():
    rng = random.Random(5)
    yield [(1, 2)]
    yield [(1, 1)]
    yield [(i, i + 1) for i in range(40)] + [(40, 0)]  # one long cycle
    yield [(i + 1, i) for i in range(30)] + [(0, 12), (20, 25)]
    yield [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    yield [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(3, 3), (1, 2), (1, 2)]


@pytest.mark.parametrize("edges", [*some_graphs()])
def test_strong_components(spark, edges):
    found = graph.strong_components(spark.createDataFrame(edges, "src int, dst int"))
    assert rows_of(found) == plain_components(edges)


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("mixed", [False, True])
def test_long_chains_take_few_rounds(spark, monkeypatch, turned, mixed):
    """A chain of small cycles, closed or not, with numbers in, against and out of order."""
    n, written = 200, []
    name = random.Random(3).sample(range(n), n) if mixed else range(n)
    chain = [(i, i + 1) for i in range(n - 1)] + [(i, i - 3) for i in range(4, n, 5)]
    monkeypatch.setattr(graph, "cut", lambda rows, tag="table", cut=graph.cut: written.append(tag) or cut(rows, tag))
    for edges, want in ((chain + [(n - 1, 0)], [0] * n), (chain, [i if i % 5 == 0 else i // 5 * 5 + 1 for i in range(n)])):
        least = {w: min(name[i] for i in range(n) if want[i] == w) for w in want}
        frame = spark.createDataFrame([(name[b], name[a]) if turned else (name[a], name[b]) for a, b in edges], "src int, dst int")
        assert rows_of(graph.strong_components(frame)) == sorted(((name[i], least[want[i]]) for i in range(n)), key=str)
    assert len(written) < 200


def test_no_edges_have_no_components(spark):
    assert graph.strong_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_long_cycles_are_circular_and_bridges_are_not(spark):
    edges = [(f"m{i:02}", f"m{(i + 1) % 12:02}", 1) for i in range(12)] + [("m00", "x", 2), ("x", "y", 1), ("y", "z", 1), ("z", "y", 1)]
    frame = spark.createDataFrame(edges, "src string, dst string, call_count long")
    found = {r["id"]: r["is_circular"] for r in graph.service_nodes(frame).collect()}
    assert found == {f"m{i:02}": True for i in range(12)} | {"x": False, "y": True, "z": True}
    parts = graph.strong_components(frame)
    assert rows_of(graph.cycles(frame, 12, components=parts).select("length")) == [(12,), (2,)]


def test_symbols_exploded_from_few_rows_are_not_broadcast(spark, tmp_path):
    """Rows look as few as those that they are exploded from."""
    spark.range(50).write.parquet(f"{tmp_path}/k")
    n = spark.read.parquet(f"{tmp_path}/k").select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"))
    path, none = F.concat(F.lit("f"), "id"), F.lit(None).cast("string")
    symbols = n.select(F.concat(F.lit("x"), "n").alias("name"), F.when(F.col("n") == 0, "class").otherwise("method").alias("type"), F.when(F.col("n") > 0, F.lit("x0")).alias("parent"), path.alias("file_path"), F.col("n").cast("int").alias("line_start"), none.alias("docstring"))
    calls = n.filter("n > 0").select(F.concat(F.lit("x"), "n").alias("caller"), F.concat(F.lit("x"), F.col("n") - 1).alias("callee"), path.alias("file_path"))
    imports = n.select(F.lit("m").alias("module"), path.alias("file_path"))
    edges = graph.build("r", imports.select(F.col("file_path").alias("path"), F.lit("Python").alias("language")), symbols, imports, calls)[1]
    assert "BroadcastHashJoin" not in plan(edges)
    assert {r["type"]: r["count"] for r in edges.groupBy("type").count().collect()} == {"CONTAINS": 50, "DEFINES": 500, "IMPORTS": 50, "HAS_METHOD": 450, "CALLS": 450}


# ----------------------------------------------------------------- text index

TEXTS = ["The quick brown fox", "quick! quick? 9 lives", None, "", "brownie browns " + "x" * 40 + " a", "licensed under MIT", "foxes and " + "x" * 20 + "y" + "x" * 19, "x" * 39, "ab ac b é", "quic quack"]


def plain_search(docs, match, words, fields=("text",), k=10):
    held = {}
    for key, row in docs:
        c = held.setdefault(key, Counter())
        for f in fields:
            c.update(re.findall("[a-z0-9]+", (row[f] or "").lower()))
    hits = {w: {key: sum(n for t, n in c.items() if match(t, w)) for key, c in held.items()} for w in words}
    score, matched = Counter(), Counter()
    for w, by in hits.items():
        df = sum(n > 0 for n in by.values())
        for key, n in by.items():
            if n:
                score[key] += n * math.log(1 + len(held) / df)
                matched[key] += 1
    return [(key, round(s, 4), matched[key]) for key, s in sorted(score.items(), key=lambda x: (-round(x[1], 4), x[0]))][:k]


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


MATCHES = {"exact": (dict(), lambda t, w: t == w), "prefix": (dict(prefix=True), str.startswith), "fuzzy": (dict(fuzzy=True), one_edit)}
ASKED = ["quick", "brown", "b", "x" * 40, "x" * 39, "mit", "nothing"]


@pytest.fixture(scope="module", params=[1, 2])
def index(spark, tmp_path_factory, request):
    docs = spark.createDataFrame([(i, t, f"t{i}") for i, t in enumerate(TEXTS)], "id long, text string, title string")
    found = textindex.TextIndex(spark, str(tmp_path_factory.mktemp("text")), width=request.param)
    found.update(docs, "id", ["text", "title"])
    return found


@pytest.mark.parametrize("how", MATCHES)
def test_text_search(index, how):
    options, match = MATCHES[how]
    docs = [(i, {"text": t, "title": f"t{i}"}) for i, t in enumerate(TEXTS)]
    assert [tuple(r) for r in index.search(ASKED, fields=["text"], **options).collect()] == plain_search(docs, match, ASKED)
    assert [tuple(r) for r in index.search(["t3"], **options).collect()] == plain_search(docs, match, ["t3"], ("text", "title"))


def test_search_reads_only_the_asked_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    index = textindex.built(spark, str(tmp_path), docs, "id", ["text"])
    want = rows_of(index.postings(["quick", "MIT"]))
    for file in tmp_path.glob("segment-*/postings/range=*/*.parquet"):
        if file.parent.name not in ("range=q", "range=m"):
            file.write_bytes(b"not to be read")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    found = index.postings(["quick", "MIT"])
    assert rows_of(found) == want != []
    assert re.search(r"PartitionFilters: \[.*range", plan(found)) and "PushedFilters: [In(term" in plan(found)


def test_search_among(index, spark):
    among = spark.createDataFrame([(1,), (9,)], "key long")
    assert [r["key"] for r in index.search(["quick"], among=among).collect()] == [1]


def test_text_updates(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "a second row of the key, quick")], "id long, text string")
    index = textindex.TextIndex(spark, str(tmp_path))
    index.update(docs, "id", ["text"])
    index.update(spark.createDataFrame([(1, "fox"), (20, "quick fox")], "id long, text string"), "id", ["text"], removed=spark.createDataFrame([(4,), (99,)], "key long"))
    index.remove(spark.createDataFrame([(9,)], "key long"))
    index.update(spark.createDataFrame([(9, "quack")], "id long, text string"), "id", ["text"])
    now = [(i, {"text": t}) for i, t in enumerate(TEXTS) if i not in (1, 4, 9)] + [(0, {"text": "a second row of the key, quick"}), (1, {"text": "fox"}), (20, {"text": "quick fox"}), (9, {"text": "quack"})]
    want = {how: plain_search(now, match, ["quick", "fox", "quack"]) for how, (_, match) in MATCHES.items()}
    terms = Counter(t for _, row in now for t in re.findall("[a-z0-9]+", (row["text"] or "").lower()))
    for _ in range(2):
        for how, (options, _) in MATCHES.items():
            assert [tuple(r) for r in index.search(["quick", "fox", "quack"], **options).collect()] == want[how]
        assert {r["term"]: r["n"] for r in index.terms().collect()} == terms and index.total() == 10
        index.merge()
    assert len(index.segments()) == 1 and index.vacuum() >= 4 and index.search(["fox"]).count() == 3


def test_an_index_of_nothing(spark, tmp_path):
    index = textindex.TextIndex(spark, str(tmp_path))
    assert index.search(["x"]).count() == 0
    index.update(spark.createDataFrame([], "id long, text string"), "id", ["text"])
    assert index.search(["x"], prefix=True).count() == 0


# --------------------------------------------------------------- vector index


def vectors(n):
    rng = np.random.default_rng(1)
    near = rng.normal(size=(12, 16))
    return near[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, 16))


def plain_nearest(rows, queries, k):
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    out = []
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(w)), 6), key) for key, w in rows)[:k]
        out += [(q, n, key, -s) for n, (s, key) in enumerate(scored, 1)]
    return sorted(out, key=str)


def rounded(found):
    return sorted(((q, n, key, round(s, 6) + 0.0) for q, n, key, s in (tuple(r) for r in found.collect())), key=str)


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 50)
    all_of = vectors(940)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(all_of[:900])]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (5, data[7][1], 0)]
    index = vectorindex.built(spark, str(tmp_path), spark.createDataFrame(data + odd, "id long, v array<double>, kind int"), "id", "v")
    asked = [(i, v.tolist()) for i, v in enumerate(all_of[900:])] + [(100, data[7][1])]
    queries = spark.createDataFrame([*asked, (101, None), (102, [0.0] * 16)], "query long, vector array<double>")
    rows = [(i, v) for i, v, _ in data] + [(5, data[7][1])]
    want = plain_nearest(rows, asked, 6)
    assert rounded(index.search(queries, 6, probes=1, exact=True)) == want
    found = {(q, key) for q, _, key, _ in rounded(index.search(queries, 6))}
    assert len(found & {(q, key) for q, _, key, _ in want}) >= 0.9 * len(want)
    some = index.search(queries, 4, exact=True, where=F.col("kind") == 1)
    assert rounded(some) == plain_nearest([(i, v) for i, v, kind in data if kind == 1], asked, 4)
    assert {r["kind"] for r in index.payload(some).collect()} == {1}


def test_vector_updates(spark, tmp_path):
    data = [(i, v.tolist()) for i, v in enumerate(vectors(300))]
    index = vectorindex.built(spark, str(tmp_path), spark.createDataFrame(data[:200], "id long, v array<double>"), "id", "v", lists=7)
    turned = [(i, [-x for x in v]) for i, v in data[100:220]]
    index.update(spark.createDataFrame(turned, "id long, v array<double>"), "id", "v", removed=spark.createDataFrame([(3,), (4,)], "key long"))
    index.remove(spark.createDataFrame([(5,)], "key long"))
    rows = [(i, v) for i, v in data[:100] if i not in (3, 4, 5)] + turned
    asked = [(i, v) for i, v in data[::25]]
    for _ in range(2):
        assert rounded(index.search(spark.createDataFrame(asked, "query long, vector array<double>"), 5, probes=1, exact=True)) == plain_nearest(rows, asked, 5)
        index.merge()
    assert index.total() == len(rows) and len(index.segments()) == 1


def test_vector_search_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 60)
    monkeypatch.setattr(vectorindex, "ASKING", 40)
    monkeypatch.setattr(vectorindex, "HELD", 1000)
    data = [(f"k{i}", v.tolist(), i % 3) for i, v in enumerate(vectors(400))]
    index = vectorindex.built(spark, str(tmp_path), spark.createDataFrame(data, "id string, v array<double>, kind int"), "id", "v", lists=25)
    asked = [(f"q{i}", v) for i, (_, v, _) in enumerate(data[::3])]
    found = index.search(spark.createDataFrame(asked, "query string, vector array<double>"), 4, probes=2, exact=True, where=F.col("kind") == 1)
    assert rounded(found) == plain_nearest([(i, v) for i, v, kind in data if kind == 1], asked, 4)


def test_vector_tasks_hold_bounded_matrices():
    rng = np.random.default_rng(4)
    centers = vectorindex.unit(rng.normal(size=(1024, 8)))
    flat = pa.array(rng.normal(size=8 * 10_000))
    rows = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 8, dtype=np.int32)), flat)], ["key", "vector"])
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(vectorindex._assigned(SimpleNamespace(value=centers))(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.argmax(vectorindex.unit(np.asarray(flat).reshape(-1, 8)) @ centers.T, axis=1)
    assert out["key"].to_pylist() == list(range(10_000)) and (out["list"].to_numpy() == want).all()
    assert peak < 64 << 20  # all 10,000 rows by 1,024 lists at once: over 200 MB


def test_cells_of_lists():
    lists, first, cells = vectorindex.cells_of({3: 10, 0: 5, 7: 250, 8: 90, 9: 4, 12: 4}, 100)
    assert lists.tolist() == [0, 3, 7, 8, 9, 12] and cells.tolist() == [1, 1, 3, 1, 1, 1]
    assert first.tolist() == [0, 0, 1, 4, 4, 4]
    assert [len(x) for x in vectorindex.cells_of({}, 100)] == [0, 0, 0]


# ------------------------------------------------------------- substring join


def test_held_substrings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé", k=rng.randrange(9))) for _ in range(150)] + [None, "", "日本語"]
    words = ["".join(rng.choices("abé", k=rng.randrange(6))) for _ in range(60)] + [None, "", "本", "日本語x", "zzzz"]
    found = substrings.held("w", spark.createDataFrame([(w,) for w in words], "w string"), "t", spark.createDataFrame([(t,) for t in texts], "t string"))
    assert rows_of(found) == sorted({(w, t) for w in words for t in texts if w and t and w in t}, key=str)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_cross_edges(spark):
    rng = random.Random(4)
    places = [(i, p, f"s{i % 5}") for i, p in enumerate(["app.core", "app", "lib.util.io", "", "io", "core", None])]
    imports = [(f"s{rng.randrange(6)}", rng.choice(["core", "app.core.x", "", "util", "q", None, "io"])) for _ in range(80)]
    want = Counter()
    for (src, module), n in Counter(imports).items():
        near = [(o, s) for o, p, s in places if None not in (p, module) and s != src and (module in p or p in module)]
        if near:
            want[src, min(near)[1]] += n
    found = discovery.cross_edges(spark.createDataFrame(imports, "subsystem string, module string"), spark.createDataFrame(places, "ord int, dotted string, subsystem string"))
    assert rows_of(found) == sorted(((*k, n) for k, n in want.items()), key=str)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


# -------------------------------------------------------------- keyed streams


def test_states_expire_restart_and_replay(spark, tmp_path):
    where, told, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id string, at timestamp, n long"

    def follow(rows, initial=None, checkpoint=checkpoint, where=where, told=told):
        frame = spark.createDataFrame(rows, "id string, at string, n long").withColumn("at", F.to_timestamp("at"))
        frame.coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(schema).parquet(where)
        changes = state.changes(stream, F.col("id"), F.col("at"), F.col("n"), 60_000, "10 seconds", keep=3, initial=initial)
        state.follow(changes, told, checkpoint).awaitTermination(120)

    follow([("a", "2024-01-01 00:00:01", 1), ("a", "2024-01-01 00:00:01", 3), ("a", "2024-01-01 00:00:00", 9), ("b", "2024-01-01 00:00:05", 1), (None, "2024-01-01 00:00:05", 1)])
    assert {(r["key"], r["tie"]) for r in state.states(spark, checkpoint).collect()} == {("a", 3), ("b", 1)}
    follow([("a", "2024-01-01 00:00:50", 4), ("a", "2024-01-01 00:00:02", 5), ("c", "2024-01-01 00:01:30", 1)])  # after a restart
    assert {(r["key"], r["tie"]) for r in state.states(spark, checkpoint).collect()} == {("a", 4), ("c", 1)}  # b has expired
    assert [r["tie"] for r in state.history(spark, checkpoint).filter("key = 'a'").orderBy("time_us", "tie").collect()] == [3, 5, 4]
    kinds = Counter((r["key"], r["kind"]) for r in spark.read.parquet(told).collect())
    assert kinds == {("a", "changed"): 2, ("b", "changed"): 1, ("c", "changed"): 1, ("b", "expired"): 1}
    other = str(tmp_path / "other")
    follow([("a", "2024-01-01 00:00:40", 7), ("d", "2024-01-01 00:01:31", 1)], state.states(spark, checkpoint), other, str(tmp_path / "in2"), str(tmp_path / "out2"))
    assert {(r["key"], r["tie"]) for r in state.states(spark, other).collect()} == {("a", 4), ("c", 1), ("d", 1)}


# ------------------------------------------------------------ stores and jobs


def test_versions_are_taken_once(spark, tmp_path):
    one, two = Published(spark, str(tmp_path)), Published(spark, str(tmp_path))
    assert one.publish({"a": 1}, 0) == 1 and two.state() == {"a": 1}
    with pytest.raises(Conflict):
        two.publish({"a": 2}, 0)
    assert one.state() == {"a": 1}
    tried = []

    def edit(found):
        if not tried:
            one.publish({"a": 5}, one.version())
        tried.append(found["a"])
        return {"a": found["a"] + 1}

    two.change(edit)
    assert tried == [1, 5] and one.state() == {"a": 6} and one.state(1) == {"a": 1}


def test_repositories_in_one_store(spark, tmp_path):
    kept = store.ResultStore(spark, str(tmp_path))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id int, name string")
    one, two = "org/one", "007"
    kept.save(one, {"files": frame((1, "a"), (2, "b")), "empty": frame()}, ("j1", "completed", 100.0, "{}", "{}"))
    kept.save(two, {"files": frame((3, "c")).withColumn("repo_id", F.lit("x"))}, ("j2", "failed", 100.0, "{}", "{}"))
    both = kept.version()
    kept.save(one, {"files": frame((4, "d")).withColumn("size", F.lit(7))}, ("j3", "completed", 100.0, "{}", "{}"))
    kept.append(two, "files", frame((5, "e")))
    files = lambda **k: sorted((r["repo_id"], r["id"], r["name"]) for r in kept.read("files", **k).collect())
    assert files() == [(two, 3, "c"), (two, 5, "e"), (one, 4, "d")] and files(version=both) == [(two, 3, "c"), (one, 1, "a"), (one, 2, "b")]
    assert sorted((r["repo_id"], r["size"]) for r in kept.read("files").select("repo_id", "size").distinct().collect()) == [(two, None), (one, 7)]
    assert {(r["repo_id"], r["scan_job_id"]) for r in kept.read("jobs").collect()} == {(one, "j1"), (one, "j3"), (two, "j2")}
    assert [r["id"] for r in kept.read("files", one).collect()] == [4]
    kept.delete(one)
    assert kept.repositories() == [two] and {r["repo_id"] for r in kept.read("files").collect()} == {two}
    assert kept.vacuum() > 0 and files() == [(two, 3, "c"), (two, 5, "e")]


def test_unique_columns_are_enforced(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "id int, name string")
    with pytest.raises(ValueError, match="not unique"):
        files.write_table(rows, str(tmp_path / "t"), unique=["id"])
    assert not (tmp_path / "t").exists()
    files.write_table(rows, str(tmp_path / "t"), unique=["id", "name"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_documentation_or_package_files(spark):
    lines = spark.createDataFrame([("README.md", 1, "A paragraph that is long enough to be taken for the description of it all.")], "file_path string, line_no int, line string")
    packages = spark.createDataFrame([("package.json", '{"description": "D", "scripts": {"x": "y"}}')], "path string, content string")
    assert [r["file_path"] for r in explore.context(lines, packages).collect()] == ["README.md"]
    assert [(r["description"], r["commands"]) for r in explore.context(lines.limit(0), packages).collect()] == [("D", ["npm run x: y"])]


def test_numbers_over_ranges(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("v"))
    assert [r["n"] for r in ranking.numbered(rows, "v").orderBy("v").collect()] == [*range(1, 5_001)]
    assert ranking.numbered(rows.limit(0), "v").count() == 0


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "app").mkdir(parents=True)
    (root / "app/a.py").write_text("import os\n\nclass A:\n    def m(self):\n        return os.getcwd()\n")
    (root / "app/b.py").write_text("password = 'hunter2hunter2'\n")
    return root


def test_a_job_goes_on_after_its_last_whole_stage(spark, tree, tmp_path, monkeypatch):
    job = str(tmp_path / "job")
    whole = lifecycle.analyze(spark, str(tree), "r")

    def cut_short(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(lifecycle.findings, "performance_findings", cut_short)
        with pytest.raises(KeyboardInterrupt):
            lifecycle.analyze(spark, str(tree), "r", job=job)
    done = [n for n, _ in store.Job(spark, job, "").phases()]
    assert {"files", "parsed", "security"} <= set(done) and "performance" not in done

    def again(*_):
        raise AssertionError("a whole stage ran again")

    with monkeypatch.context() as m:
        m.setattr(parsers, "parse", again)
        m.setattr(lifecycle.findings, "security_findings", again)
        resumed = lifecycle.analyze(spark, str(tree), "r", job=job)
    assert not resumed.errors and set(resumed.tables) == set(whole.tables)
    for name in ("security", "symbols", "edges", "health", "performance"):
        assert rows_of(resumed[name]) == rows_of(whole[name])
    time.sleep(0.01)
    (tree / "app/c.py").write_text("class New:\n    pass\n")
    changed = lifecycle.analyze(spark, str(tree), "r", job=job)
    assert "New" in {r["name"] for r in changed["symbols"].collect()}
