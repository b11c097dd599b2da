"""The commit source: conditions that reach git, and a stream of commits."""

import datetime
import os
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

from lodestrata.sources import gitlog


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "repository"
    (root / "src").mkdir(parents=True)

    def commit(k, who):
        where = root / ("src" if k % 2 else "") / f"f{k % 3}.py"
        where.write_text(where.read_text() + "x\n" if where.exists() else "x\n")
        at = f"2024-01-{k + 1:02}T00:00:00+0000"
        env = os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at}
        for a in (("add", "."), ("commit", "-qm", f"commit {k}")):
            subprocess.run(["git", "-C", root, "-c", f"user.name=N {who}", "-c", f"user.email={who}@x.y", *a], check=True, env=env)

    subprocess.run(["git", "init", "-q", root], check=True)
    for k in range(9):
        commit(k, "ab"[k % 2])
    return str(root), commit


def test_conditions_reach_git(spark, repository):
    path, _ = repository
    rows = gitlog.log(spark, path)
    every = {r["seq"]: r for r in rows.collect()}
    assert sorted(every) == [*range(9)] and {r["author"] for r in every.values()} == {"a@x.y", "b@x.y"}
    day = F.to_timestamp(F.lit("2024-01-04 00:00:00"))
    some = rows.filter((F.col("author") == "b@x.y") & (F.col("at") >= day)).collect()
    assert sorted(r["seq"] for r in some) == [1, 3, 5] and all(r == every[r["seq"]] for r in some)
    one = every[4]["commit_id"]
    assert [r["seq"] for r in rows.filter(F.col("commit_id").isin(one, "none")).collect()] == [4]
    assert rows.filter(F.col("author") == "nobody").count() == 0
    assert sorted(r["seq"] for r in gitlog.log(spark, path, below="src").collect()) == [1, 3, 5, 7]
    assert sorted(r["seq"] for r in gitlog.log(spark, path, 4).filter("author = 'a@x.y'").collect()) == [0, 2]


def test_the_command_has_the_conditions(repository):
    path, _ = repository
    day = datetime.datetime(2024, 1, 4)
    asked = gitlog.arguments([EqualTo(("author",), "b@x.y"), GreaterThan(("at",), day), LessThan(("at",), day), EqualTo(("name",), "x")])
    assert asked == ["--fixed-strings", "--author=<b@x.y>", f"--since-as-filter=@{int(day.timestamp()) - 1}", f"--until=@{int(day.timestamp()) + 1}"]
    reader = gitlog.LogReader({"path": path})
    reader.pushFilters([EqualTo(("author",), "b@x.y")])
    assert [seq for part in reader.partitions() for seq, _ in part.ids] == [1, 3, 5, 7]


def test_new_commits_arrive_once(spark, repository, tmp_path):
    path, commit = repository
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def follow():
        stream = gitlog.new_commits(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query = stream.trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return [r["commit_id"] for r in spark.read.parquet(out).select("commit_id").collect()]

    first = follow()
    assert len(first) == len(set(first)) == 9
    commit(9, "c")
    commit(10, "c")
    then = follow()  # from the checkpoint
    assert len(then) == len(set(then)) == 11 and set(first) < set(then)
