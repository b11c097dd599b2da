"""Parsers, file scans, manifests, commit logs and streams."""

import json
import os
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.plans import further_queries, lifecycle, queries
from lodestrata.sources import files, gitlog, manifests, parsers
from lodestrata.streaming import progress

JAVA = """import java.util.List;
import java.util.*;
public class Hello extends Base implements Iface {
    private int count = 0;
    public void greet(String name) {
        System.out.println("hi " + name); // not(a call)
        List<String> x = new ArrayList<>();
    }
}
"""
PYTHON = '''import os, sys
from a.b import c, d as e
@deco
class Sub(Base):
    """Said."""
    def meth(self, x: int = 5) -> str:
        return str(x)
'''
SCRIPT = """import { Foo } from 'mod';
import * as n from 'n';
import d from 'default';
export interface I { a: string }
enum E { A, B }
type T = string | number;
export class C extends B implements I {
  s: string = "x";
  private foo(a: string): number { return bar(a); }
  hello() { const b = new Bar(); }
}
"""
GO = """package main

import (
	"fmt"
	"net/http"
)

type Config struct {
	Host string
}

type Runner interface {
	Run() error
}

func (c *Config) Address() string {
	return fmt.Sprintf("%s", c.Host)
}

func StartServer(cfg *Config) error {
	return http.ListenAndServe(cfg.Address(), nil)
}
"""
RUST = """use std::collections::HashMap;

pub struct Engine { name: String }

pub trait Worker {
    fn run(&self);
}

impl Engine {
    pub fn new(name: &str) -> Self {
        println!("x {}", name);
        Engine { name: name.to_string() }
    }
}

pub fn execute<'a>(x: &'a str) {
    let e = Engine::new(x);
}
"""


def parsed(path, text):
    out = parsers.parse_text(path, text)
    assert not out.errors
    return out, {(s.name, s.type, s.parent) for s in out.symbols}, {(c.caller, c.callee) for c in out.calls}


def test_java():
    out, symbols, calls = parsed("Hello.java", JAVA)
    assert symbols == {("Hello", "class", None), ("count", "variable", "Hello"), ("greet", "method", "Hello")}
    by_name = {s.name: s for s in out.symbols}
    assert by_name["Hello"].annotations == ["extends Base", "implements Iface"] and by_name["Hello"].visibility == "public"
    assert by_name["count"].visibility == "private" and by_name["greet"].signature == "void greet(String name)"
    assert by_name["greet"].parameters == [{"name": "name", "type": "String"}]
    assert [(i.module, i.name) for i in out.imports] == [("java.util", "List"), ("java.util", "*")]
    assert calls == {("greet", "System.out.println"), ("greet", "new ArrayList")}


def test_python():
    out, symbols, calls = parsed("mod.py", PYTHON)
    assert symbols == {("Sub", "class", None), ("meth", "method", "Sub")}
    assert out.symbols[0].decorators == ["deco"] and out.symbols[0].docstring == "Said."
    assert out.symbols[1].signature == "meth(self, x: int = 5) -> str" and out.symbols[1].return_type == "str"
    assert [(i.module, i.name, i.alias) for i in out.imports] == [("os", None, None), ("sys", None, None), ("a.b", "c", None), ("a.b", "d", "e")]
    assert calls == {("meth", "str")} and out.loc == 7
    assert parsers.parse_text("bad.py", "def (").errors


def test_script():
    out, symbols, calls = parsed("f.ts", SCRIPT)
    assert symbols == {("I", "interface", None), ("E", "enum", None), ("T", "type_alias", None), ("C", "class", None), ("s", "variable", "C"), ("foo", "method", "C"), ("hello", "method", "C")}
    foo = next(s for s in out.symbols if s.name == "foo")
    assert foo.visibility == "private" and foo.signature == "foo(a: string): number"
    assert {(i.module, i.name, i.alias) for i in out.imports} == {("mod", "Foo", None), ("n", "*", "n"), ("default", "d", None)}
    assert calls == {("foo", "bar"), ("hello", "new Bar")}


def test_go():
    out, symbols, calls = parsed("main.go", GO)
    assert symbols == {("Config", "class", None), ("Runner", "interface", None), ("Address", "method", "Config"), ("StartServer", "function", None)}
    assert next(s for s in out.symbols if s.name == "Address").return_type == "string"
    assert {i.module for i in out.imports} == {"fmt", "net/http"}
    assert ("Config.Address", "fmt.Sprintf") in calls


def test_rust():
    out, symbols, calls = parsed("lib.rs", RUST)
    assert {("Engine", "class", None), ("Worker", "interface", None), ("new", "method", "Engine"), ("execute", "function", None)} <= symbols
    assert any("HashMap" in i.module for i in out.imports)
    assert ("execute", "Engine::new") in calls and ("Engine::new", "println!") in calls


@pytest.mark.parametrize("path,end", [("a.py", ".py"), ("a.ts", ".ts"), ("a.tsx", ".tsx"), ("a.js", ".js"), ("a.jsx", ".jsx"), ("a.java", ".java"), ("a.go", ".go"), ("a.rs", ".rs"), ("a.txt", None)])
def test_dispatch(path, end):
    assert parsers.dispatch(path) == end


@pytest.mark.parametrize("url", ["", "  ", "-upload-pack=x", "https://h/\x00", None])
def test_bad_addresses(url):
    with pytest.raises(ValueError):
        files.checked_url(url)


@pytest.mark.parametrize("root", ["/", "/etc", "/proc/1", "", "/no/such/folder"])
def test_bad_roots(root):
    with pytest.raises(ValueError):
        files.checked_root(root)


def test_names():
    assert files.checked_url(" https://h/o/r.git ") == "https://h/o/r.git"
    assert files.repository_name("https://h/o/r.git") == "o/r"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put = lambda p, t: ((root / p).parent.mkdir(parents=True, exist_ok=True), (root / p).write_bytes(t if isinstance(t, bytes) else t.encode()))
    put("app/api/web.py", 'from app.core.db import get\nfrom fastapi import APIRouter\n\n@router.get("/users")\ndef users():\n    # TODO page\n    password = "hunter22"\n    return helper()\n\ndef helper():\n    return 1\n')
    put("app/core/db.py", "from app.api.web import users\n\nclass User(Base):\n    owner_id = Column(Integer, nullable=False)\n    name = Column(String)\n\ndef get():\n    return query.all(session.get(1))\n")
    put("app/models/bad.py", b"x = '\xff'\r\ny = 2")
    put("node_modules/x/index.js", "skip()")
    put("requirements.txt", "fastapi==1.0\n# c\nflask[x]>=2,<3\n")
    put("package.json", json.dumps({"dependencies": {"react": "^1"}, "devDependencies": {"jest": "2"}}))
    put("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "numpy>=1",\n  "plain",\n]\n[tool.dev]\n"pytest==8"\n[other]\nz = 1\n')
    put("pom.xml", "<dependency>\n<groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId></dependency>")
    outside = tmp_path_factory.mktemp("outside") / "secret.py"
    outside.write_text("x")
    os.symlink(outside, root / "link.py")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "app")
    git("commit", "-qm", "one")
    put("app/api/web.py", (root / "app/api/web.py").read_text() + "\n")
    git("add", "app")
    git("commit", "-qm", "two")
    return str(root)


def test_scan(spark, tree):
    rows = {r["path"]: r for r in files.scan(spark, tree).collect()}
    assert "link.py" not in rows and not any("node_modules" in p for p in rows)
    assert rows["app/models/bad.py"]["lines"] == 2 and "�" in rows["app/models/bad.py"]["content"]
    assert rows["app/api/web.py"]["language"] == "Python"


def test_manifests(spark, tree):
    rows = {(r["name"], r["version"], r["type"], r["source"]) for r in manifests.packages(files.scan(spark, tree)).collect()}
    assert rows == {
        ("fastapi", "1.0", "runtime", "requirements.txt"), ("flask[x]", "2", "runtime", "requirements.txt"), ("react", "^1", "runtime", "package.json"), ("jest", "2", "dev", "package.json"),
        ("numpy", "1", "runtime", "pyproject.toml"), ("plain", None, "runtime", "pyproject.toml"), ("pytest", "8", "dev", "pyproject.toml"), ("g:a", "1", "runtime", "pom.xml"), ("g:b", None, "runtime", "pom.xml"),
    }


def test_git_log(spark, tree):
    commits, touched = gitlog.commits(spark, tree)
    rows = commits.orderBy("seq").collect()
    assert len(rows) == 2 and rows[0]["author"] == "a@b" and rows[0]["insertions"] == 1 and rows[0]["at"] is not None
    assert touched.filter("seq = 1").count() == 3


def test_lifecycle(spark, tree, tmp_path):
    report = lifecycle.analyze(spark, tree, "r", git=True)
    assert not report.errors
    t = {k: v.collect() for k, v in report.tables.items()}
    assert [f["title"] for f in t["security"]] == ["Hardcoded password"] and t["risk"][0]["risk_score"] == 25
    assert [(e["method"], e["path"], e["handler"]) for e in t["endpoints"]] == [("GET", "/users", "users")]
    assert {x["name"] for x in t["tables"]} == {"users"} and [c["name"] for c in t["tables"][0]["columns"]] == ["owner_id", "name"]
    assert [(r["from_table"], r["to_table"]) for r in t["relationships"]] == [("users", "owner")]
    assert [c["cycle"] for c in t["cycles"]] == [["app/api", "app/core"]]
    assert {n["labels"][0] for n in t["nodes"]} >= {"Repository", "File", "Class", "Function", "Module"}
    assert {e["type"] for e in t["edges"]} >= {"CONTAINS", "DEFINES", "IMPORTS", "CALLS"}
    assert 0 <= t["health"][0]["health_score"] <= 100 and t["pattern"][0]["pattern"]
    assert "FastAPI" in t["facts"][0]["frameworks"] and "npm" in t["facts"][0]["package_managers"]
    assert t["contributors"][0]["commits"] == 2 and t["hotspots"][0]["path"] == "app/api/web.py"
    assert len(t["chunks"][0]["vector"]) == 32
    answer = lifecycle.ask(report, "are there security vulnerabilities").first()
    assert answer["intent"] == "security" and "Hardcoded password" in answer["answer"] and answer["citations"]
    lifecycle.save(report, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/security")).count() == 1
    assert "security" in lifecycle.views(report)


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_progress_stream(spark, tmp_path):
    said = [("r1", "j", "running", "parsing", 20.0, "", "2024-01-01T00:00:02"), ("r1", "j", "completed", "completed", 100.0, "", "2024-01-01T00:00:09"), ("r2", "k", "failed", "failed", 0.0, "x", "2024-01-01T00:00:05"), ("r1", "j", "running", "cloning", 5.0, "", "2024-01-01T00:00:01")]
    names = ["repo_id", "scan_job_id", "status", "phase", "progress", "message", "timestamp"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in said))
    got = {}

    def keep(batch):
        got.update({r["repo_id"]: r["status"] for r in batch.collect()})

    def dead(batch):
        raise RuntimeError("gone")

    stream = progress.events(spark, str(tmp_path / "in"))
    progress.publish(stream, "progress", str(tmp_path / "state"), dead, keep).awaitTermination(120)
    assert got == {"r1": "completed", "r2": "failed"}
    table = spark.read.schema(progress.SCHEMA).json(str(tmp_path / "in"))
    assert {r["repo_id"]: r["status"] for r in progress.latest_state(table, "repo_id", ["timestamp"]).collect()} == got
    assert progress.windowed(table).agg(F.sum("n")).first()[0] == 4
    assert progress.sessions(table).count() == 2


def test_roots_with_any_number_of_slashes(spark, tmp_path):
    names = {f"d{i % 7}/f{i}.py" for i in range(40)}
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    for root in (f"file:{tmp_path}", f"file://{tmp_path}", f"//{tmp_path}", str(tmp_path)):
        assert {r["path"] for r in files.scan(spark, root, local=False).select("path").collect()} == names


@pytest.mark.parametrize("disk", [True, False])
def test_documents_as_files_with_odd_ids_and_texts(spark, tmp_path, monkeypatch, disk):
    if not disk:
        monkeypatch.setattr(files, "disk_folder", lambda *_: None)
    texts = ["a", "a", "", None, None, "b\r", "c\r\nd\x0b e", "z\n" * 600_000, "é\n\n"]
    ids = [1, 1, 2, 3, None, -4, None, 5, 2**62]
    spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "size_bytes", "language", "lines"]
    got = further_queries.scanned_tree(spark, str(tmp_path)).select(columns).collect()
    want = con.sql(f"select {', '.join(columns)} from ({queries.SQL['scanned_tree']})").fetchall()
    assert len(want) == 9 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_tree_of_small_files_takes_few_tasks(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 3).select(F.concat("id", F.lit(".py")).alias("name"), F.repeat(F.lit("x\n"), F.col("id").cast("int") % 9).alias("text"))
    files.write_tree(rows, f"file:{tmp_path}/tree")
    found = files.scan(spark, f"file:{tmp_path}/tree", local=False).select("path", "size_bytes", "lines", "content").collect()
    assert {(r["path"].split("/")[-1], r["content"], r["size_bytes"]) for r in found} == {(r["name"], r["text"] + "\n", len(r["text"]) + 1) for r in rows.collect()}
    assert len(found) == 3000
    assert files.scan(spark, f"file:{tmp_path}/tree", local=False).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_disk_and_store_find_the_same_files(spark, tmp_path):
    for name in ("a.py", "d/b.py", "d/e/__init__.py", "d/k=1/_c=2/c.go", ".git/x", "_h/y.py", "d/.z", "f[1]/g h.js", "node_modules/i.js", "j._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff\n" * len(name))
    (tmp_path / "empty.py").touch()
    os.symlink(tmp_path / "gone", tmp_path / "broken.py")
    store, disk = (sorted(map(tuple, rows.select("path", "size_bytes", "content").collect())) for rows in (files._from_store(spark, str(tmp_path)), files._from_disk(spark, str(tmp_path), 1 << 30)))
    assert [r for r in store if not r[0].startswith("node_modules/")] == disk and len(disk) == 4
    assert [r[2] for r in files._from_disk(spark, str(tmp_path), 14).select("path", "size_bytes", "content").orderBy("path").collect()] == [b"x\xff\n" * 4, None, None, None]
    assert files.disk_folder(spark, f"file:{tmp_path}/none") is None and files.disk_folder(spark, f"{tmp_path}/a.py") is None


def test_scan_with_a_link_that_comes_back(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_text("x\n")
    os.symlink(tmp_path, tmp_path / "d/back")
    os.symlink("self", tmp_path / "self")
    assert [r["path"] for r in files.scan(spark, str(tmp_path)).select("path").collect()] == ["d/a.py"]
