"""Commit history as a Spark data source named ``gitlog``, for tables and for streams.

Options: ``path`` of a repository, ``limit`` of commits (0: all), ``below`` (a
folder or file: only commits that touch it), and for streams ``after`` (a commit
that has been read).  Rows are (commit_id, seq, name, author, at, iso, insertions,
deletions, paths); seq counts the commits from the newest, 0 first, whatever is
asked for.

Conditions on author, commit_id and at reach the git command, so that only the
commits that meet them are read with their changes (where
``spark.sql.python.filterPushdown.enabled`` is set); Spark checks them again.
The log is read in slices, as of the commit that HEAD was when the query was
planned, so several tasks, and a task's second try, see one history.

A stream's offset is a commit.  A batch has the commits that lead to the new
HEAD and didn't lead to the old one, each once; its seq counts within the batch.
"""

from __future__ import annotations

import datetime
import subprocess
import sys
from collections.abc import Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "commit_id string, seq int, name string, author string, at timestamp, iso string, insertions int, deletions int, paths array<string>"
SLICE = 1_000
FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%cI%x1f%ct"


class Slice(InputPartition):
    """Commits of a history: the ``count`` from place ``skip`` on, or those with some ids."""

    def __init__(self, head: str, skip: int = 0, count: int = 0, ids: tuple[tuple[int, str], ...] = ()):
        self.head, self.skip, self.count, self.ids = head, skip, count, ids


def _git(path: str, *arguments: str, given: str | None = None) -> str:
    return subprocess.run(["git", "-C", path, "-c", "core.quotePath=false", *arguments], check=True, capture_output=True, input=None if given is None else given.encode()).stdout.decode("utf-8", "replace")


def _commits(text: str) -> Iterator[tuple]:
    """(commit_id, name, author, at, iso, insertions, deletions, paths) of a log."""
    for block in text.split("\x1e")[1:]:
        head, *rest = block.strip("\n").split("\n")
        commit, name, author, iso, seconds = head.split("\x1f")
        changes = [x.split("\t", 2) for x in rest if x.count("\t") >= 2]
        added, gone = (sum(int(c[k]) for c in changes if c[k].isdigit()) for k in (0, 1))
        yield commit, name, author or None, datetime.datetime.fromtimestamp(int(seconds)), iso, added, gone, [c[2] for c in changes]


def _read(path: str, part: Slice) -> Iterator[tuple]:
    if part.ids:
        found = {c[0]: c for c in _commits(_git(path, "log", "--numstat", "--no-renames", "--no-walk=unsorted", "--stdin", f"--format={FORMAT}", given="\n".join(i for _, i in part.ids) + "\n"))}
        rows = [(seq, found[i]) for seq, i in part.ids]
    else:
        rows = enumerate(_commits(_git(path, "log", "--numstat", "--no-renames", f"--skip={part.skip}", f"--max-count={part.count}", f"--format={FORMAT}", part.head)), part.skip)
    for seq, (commit, *rest) in rows:
        yield commit, seq, *rest


def arguments(filters: Iterable[Filter]) -> list[str]:
    """What conditions say to ``git rev-list``: never less than the rows that meet them all."""
    out = []
    for f in filters:
        column = f.attribute if hasattr(f, "attribute") else ()
        if column == ("author",) and isinstance(f, EqualTo):
            out += ["--fixed-strings", f"--author=<{f.value}>"]
        elif column == ("at",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            out.append(f"--since-as-filter=@{int(f.value.timestamp()) - 1}")
        if column == ("at",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            out.append(f"--until=@{int(f.value.timestamp()) + 1}")
    return out


def _sliced(head: str, ids: list[tuple[int, str]]) -> list[Slice]:
    return [Slice(head, ids=tuple(ids[k : k + SLICE])) for k in range(0, len(ids), SLICE)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit, self.below = options["path"], int(options.get("limit", "0")), options.get("below")
        self.asked: list[str] = []
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.asked = arguments(filters)
        for f in filters:
            if getattr(f, "attribute", ()) == ("commit_id",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
        return filters  # git's answer may hold more

    def partitions(self) -> list[Slice]:
        head = _git(self.path, "rev-parse", "HEAD").strip()
        most = [f"--max-count={self.limit}"] if self.limit else []
        if not self.asked and self.only is None and not self.below:
            total = int(_git(self.path, "rev-list", "--count", *most, head))
            return [Slice(head, at, min(SLICE, total - at)) for at in range(0, total, SLICE)] or [Slice(head)]
        wanted = self.only
        if self.asked or self.below:
            found = set(_git(self.path, "rev-list", *self.asked, head, *(["--", self.below] if self.below else [])).split())
            wanted = found if wanted is None else wanted & found
        places = [(seq, i) for seq, i in enumerate(_git(self.path, "rev-list", *most, head).split()) if i in wanted]
        return _sliced(head, places) or [Slice(head)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.count or partition.ids:
            yield from _read(self.path, partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.after = options["path"], options.get("after", "")

    def initialOffset(self) -> dict:
        return {"commit": self.after}

    def latestOffset(self) -> dict:
        return {"commit": _git(self.path, "rev-parse", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        new = [f"^{start['commit']}"] if start["commit"] else []
        return _sliced(end["commit"], [*enumerate(_git(self.path, "rev-list", end["commit"], *new).split())])

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known, and let conditions reach it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # it is also planned where the package isn't shipped to
    spark.dataSource.register(GitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def log(spark: SparkSession, path: str, limit: int = 0, below: str | None = None) -> DataFrame:
    """The rows of a repository's history."""
    register(spark)
    reader = spark.read.format("gitlog").option("path", path).option("limit", str(limit))
    return (reader if below is None else reader.option("below", below)).load()


def commits(spark: SparkSession, path: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a repository, newest first."""
    rows = log(spark, path, limit)
    return rows.select("commit_id", "seq", "author", "name", "at", F.col("iso").alias("committed_iso"), "insertions", "deletions"), rows.select("commit_id", "seq", F.explode("paths").alias("path"))


def new_commits(spark: SparkSession, path: str, after: str = "") -> DataFrame:
    """A stream of the commits that come."""
    register(spark)
    return spark.readStream.format("gitlog").option("path", path).option("after", after).load()
