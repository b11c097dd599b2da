"""Source trees: files with their text, and what must be checked before they are read."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.scalars import language_of, line_count, lines_of
from lodestrata.plans import rules
from lodestrata.session import cut, ship

#: Folders that are never scanned (fixed values), and size limits.
FORBIDDEN = ["/", "/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/root/.ssh", "/sbin", "/sys", "/usr", "/var"]
MAX_COUNTED_BYTES, MAX_PARSED_BYTES = 2_000_000, 1_000_000

#: Bytes that a Python worker is given or gives back at once, about, and a file at least.
BATCH_BYTES = 1 << 20


def checked_url(url: str) -> str:
    """A clone address without the forms that git takes for options; raises ValueError."""
    if not isinstance(url, str) or not url.strip():
        raise ValueError("a repository address must be a text that isn't empty")
    url = url.strip()
    if url.startswith("-") or "\x00" in url:
        raise ValueError("a repository address may not start with a hyphen or hold a null byte")
    return url


def checked_root(path: str) -> str:
    """A local folder that may be scanned; raises ValueError."""
    if not path or "\x00" in path or path.strip().startswith("-"):
        raise ValueError("not a folder that can be scanned")
    real = os.path.realpath(path)
    if real in FORBIDDEN or any(real.startswith(f + "/") for f in FORBIDDEN if f not in ("/", "/usr", "/var", "/lib")):
        raise ValueError(f"{real} may not be scanned")
    if not os.path.isdir(real):
        raise ValueError(f"{real} is no folder")
    return real


def clone(url: str, into: str, depth: int = 500) -> str:
    """Clone a repository once; an existing folder is used as it is."""
    if not Path(into).exists():
        subprocess.run(["git", "clone", "--depth", str(depth), "--", checked_url(url), into], check=True, capture_output=True)
    return into


def repository_name(url: str) -> str:
    """owner/name of an address, or its last part."""
    found = re.search(r"[:/]([^/:]+/[^/]+?)(?:\.git)?/?$", url)
    return found[1] if found else url.rstrip("/").split("/")[-1].removesuffix(".git")


def escaping_links(root: str) -> list[str]:
    """Paths under the root whose real place is outside it."""
    root, out = os.path.realpath(root), []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in rules.SKIPPED_DIRS]
        for name in [*dirs, *names]:
            path = os.path.join(folder, name)
            if os.path.islink(path) and not os.path.realpath(path).startswith(root + os.sep):
                out.append(os.path.relpath(path, root))
    return out


def disk_folder(spark: SparkSession, root: str) -> str | None:
    """The path of a folder in the machines' own file system, a shared disk; null for a folder of
    another store, and for what is no folder."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file" or not store.exists(path) or not store.getFileStatus(path).isDirectory():
        return None
    return store.makeQualified(path).toUri().getPath()


def _listed(folder: bytes) -> Iterator[os.DirEntry]:
    """What Spark's readers see of a folder, without what is never scanned."""
    with os.scandir(folder) as entries:
        for entry in entries:
            name = os.fsdecode(entry.name)
            hidden = name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.endswith("._COPYING_")
            if not hidden and name not in rules.SKIPPED_DIRS:
                yield entry


def _lister(root: bytes, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (path, size), where a folder has no size, to what is in it; files are handed on."""
    start = len(root.rstrip(b"/")) + 1

    def found(folder: bytes) -> Iterator[tuple[bytes, int | None]]:
        for entry in _listed(folder):
            try:
                inside, size = entry.is_dir(), entry.stat().st_size if entry.is_file() else 0
            except OSError:  # removed since the folder was listed, or a link that comes back to itself
                continue
            if inside and deep:
                yield from found(entry.path)
            elif inside or size:
                yield entry.path[start:], None if inside else size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int | None]] = []
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                for row in [(path, size)] if size is not None else found(os.path.join(root, path)):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple[bytes, int | None]]) -> pa.RecordBatch:
    paths, sizes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(sizes, pa.int64())], ["path", "size_bytes"])


def _reader(root: bytes, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (path, size) to (path, size_bytes, content); a file that can't be read is left out."""

    def batch(rows: list[tuple[str, int, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "size_bytes", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for given in batches:
            for path, size in zip(*(c.to_pylist() for c in given.columns)):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        content = file.read() if size <= most else None
                except FileNotFoundError:  # removed, or a disk that isn't shared
                    raise
                except OSError:
                    continue
                rows.append((path.decode("utf-8", "replace"), size if content is None else len(content), content))
                held += len(content or b"") + len(path)
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def _from_disk(spark: SparkSession, folder: str, most: int) -> DataFrame:
    """(path, size_bytes, content) of a folder's files, listed and read by the executors: the
    driver holds no list of them, and a task reads any number of small files."""
    ship(spark)
    root, tasks, row = os.fsencode(folder), 4 * spark.sparkContext.defaultParallelism, "path binary, size_bytes long"
    top = spark.range(0, 1, 1, 1).select(F.lit(b"").alias("path"), F.lit(None).cast("long").alias("size_bytes"))
    names = top.mapInArrow(_lister(root, False), row).repartition(tasks).mapInArrow(_lister(root, True), row)
    return names.repartition(tasks).mapInArrow(_reader(root, most), "path string, size_bytes long, content binary")


def _from_store(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, content) of the files under a root of any store, by Spark's reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    where = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = re.sub(r"^([a-z]+:)?/+", "/", root)
    path = F.substr(where, F.instr(where, base) + F.lit(len(base) + 1))
    return raw.select(path.alias("path"), F.col("length").alias("size_bytes"), "content")


def scan(spark: SparkSession, root: str, repo_id: str = "repo", local: bool = True, most: int = MAX_PARSED_BYTES) -> DataFrame:
    """(repo_id, path, language, size_bytes, lines, content) of a tree's files.

    The scan is distributed; bytes that aren't UTF-8 become replacement characters, and
    content is null above ``most`` bytes.  Links out of a local root are left out."""
    root = checked_root(root) if local else root.rstrip("/")
    folder = disk_folder(spark, root)
    raw = _from_disk(spark, folder, max(most, MAX_COUNTED_BYTES)) if folder else _from_store(spark, root)
    rows = raw.select(F.lit(repo_id).alias("repo_id"), "path", "size_bytes", "content")
    rows = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, rules.SKIPPED_DIRS))))
    if local and (links := escaping_links(root)):
        outside = F.lit(False)
        for link in links:
            outside = outside | (F.col("path") == link) | F.col("path").startswith(link + "/")
        rows = rows.filter(~outside)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    counted = F.when(language_of(F.col("path")).isNotNull() & (F.col("size_bytes") < MAX_COUNTED_BYTES), line_count(text)).otherwise(0)
    return rows.select("repo_id", "path", language_of(F.col("path")).alias("language"), "size_bytes", counted.alias("lines"), F.when(F.col("size_bytes") <= most, text).alias("content"))


def _putter(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        mine, place = f"{folder}/.{task.partitionId()}-{task.taskAttemptId()}", f"{folder}/{task.partitionId()}"
        os.makedirs(mine)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(f"{mine}/{name}", "xb") as file:
                    file.write(content)
            n += batch.num_rows
        try:
            os.rename(mine, place)
        except OSError:
            if not os.path.isdir(place):
                raise
            shutil.rmtree(mine)  # another attempt of this task has put its folder in place
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def write_tree(rows: DataFrame, where: str) -> None:
    """Every row of (name, text) as a file of a new folder, with a line end after its text; no two
    names are the same.

    On a disk, tasks make their files themselves: Hadoop's local file system starts a process for
    the mode of each file and folder.  In another store they are written by Spark's writer, each
    in a folder of its name.  A task's files come into place together, in its folder."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    if not (folder := disk_folder(spark, where)):
        rows.withColumn("task", F.spark_partition_id()).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "1").partitionBy("task", "name").text(where)
        return
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    spark.conf.set(bound, str(BATCH_BYTES))
    try:
        content = F.concat(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(b"\n")).alias("content")
        rows.select("name", content).mapInArrow(_putter(folder), "n long").agg(F.sum("n")).collect()
    finally:
        spark.conf.set(bound, before)


def lines(files: DataFrame) -> DataFrame:
    """(file_path, line_no, line) of files with content."""
    cut = files.filter("content is not null").select(F.col("path").alias("file_path"), F.posexplode(lines_of(F.col("content"))).alias("at", "line"))
    return cut.select("file_path", (F.col("at") + 1).alias("line_no"), "line")


def read_table(spark: SparkSession, where: str, kind: str = "parquet") -> DataFrame:
    """A stored table: nodes, edges, findings and the like."""
    return spark.read.format(kind).load(where)


def write_table(rows: DataFrame, where: str, key: str | None = None, mode: str = "overwrite", unique: list[str] | None = None) -> None:
    """Store a table; with a key, its values are partitions and only those present are replaced.
    ``unique`` names columns that no two rows may share; rows that do are refused before any is
    stored (ValueError)."""
    if unique:
        rows = cut(rows, "unique")
        if twice := rows.groupBy(*unique).count().filter("count > 1").limit(3).collect():
            raise ValueError(f"{', '.join(unique)} not unique: {[tuple(r)[:-1] for r in twice]}")
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(key) if key else writer).parquet(where)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows in the place of old ones with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
