"""Commit history: contributors, ownership, hotspots, coupling, frequency.

commits: (commit_id, seq from the newest, author, name, at, insertions,
deletions); commit_files: (commit_id, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributors(commits: DataFrame, gate: int = 200) -> DataFrame:
    """By author: commits, changed lines of their newest ``gate`` commits, first and last time,
    and the name first seen in the log."""
    own = commits.withColumn("author", F.coalesce("author", F.lit("unknown")))
    # these combine before the shuffle, however many commits an author has
    whole = own.groupBy("author").agg(F.count(F.lit(1)).alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("name", "seq").alias("name"))
    # of the newest commits, Spark keeps only ``gate`` for each author and task before the shuffle
    n = F.row_number().over(Window.partitionBy("author").orderBy("seq"))
    newest = own.select("author", "seq", "insertions", "deletions").withColumn("n", n).filter(F.col("n") <= gate)
    lines = newest.groupBy("author").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return whole.join(lines, "author").select("author", "commits", "insertions", "deletions", "first_at", "last_at", "name")


def leading(contributors: DataFrame, top: int | None = None) -> DataFrame:
    """Contributors by their commits, the most first."""
    rows = contributors.orderBy(F.desc("commits"), "author")
    return rows if top is None else rows.limit(top)


def owned_files(commits: DataFrame, files: DataFrame, top: int = 10) -> DataFrame:
    """Each author's most touched files."""
    touches = commits.join(files, "commit_id").groupBy("author", "path").agg(F.count(F.lit(1)).alias("touches"))
    order = Window.partitionBy("author").orderBy(F.desc("touches"), "path")
    return touches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def hotspots(commits: DataFrame, files: DataFrame, newest: int | None = None, top: int = 30) -> DataFrame:
    """Files by changes, with their distinct authors; of the ``newest`` commits only, if given."""
    some = commits if newest is None else commits.orderBy("seq").limit(newest)
    rows = some.join(files, "commit_id").groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("author").alias("authors"))
    return rows.orderBy(F.desc("changes"), "path").limit(top)


def co_changes(files: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b, n): files of a commit that stand up to ``distance`` apart in its sorted list.
    Each row looks at the next few of its commit, so no pairs of a whole commit are made."""
    order = Window.partitionBy("commit_id").orderBy("path")
    ahead = files.select("commit_id", "path").distinct().select("path", F.array(*[F.lead("path", k).over(order) for k in range(1, distance + 1)]).alias("next"))
    ahead = ahead.select("path", F.explode("next").alias("b")).filter("b is not null")
    return ahead.groupBy(F.col("path").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


def coupling(files: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    return co_changes(files).filter(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(top)


def frequency(commits: DataFrame, pattern: str = "yyyy-MM-dd") -> DataFrame:
    return commits.groupBy(F.date_format("at", pattern).alias("day")).agg(F.count(F.lit(1)).alias("commits"))


def latest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key by the order's columns."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")
