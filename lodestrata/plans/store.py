"""Results of many repositories in one store, and jobs that go on where they stopped.

A table's files lie below ``<table>/repo_id=<id>/run-<new>``, so a repository's
rows are a partition.  Which runs count is what the last published version says
(see ``sources.published``): a reader sees a save, an append or a delete whole or
not at all, and those of other repositories don't touch it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.published import Published

JOBS = "scan_job_id string, status string, progress double, errors string, result string"


class ResultStore(Published):
    """Tables by repository."""

    def save(self, repo_id: str, tables: dict[str, DataFrame], job: tuple | None = None) -> int:
        """The tables take the place of all that the repository had; its jobs stay, and ``job``
        (as in ``JOBS``) is added."""
        written = {name: [self._write(name, repo_id, rows)] for name, rows in tables.items()}
        jobs = [self._write("jobs", repo_id, self.spark.createDataFrame([job], JOBS))] if job else []

        def edit(state: dict) -> dict:
            before = state.get("repositories", {}).get(repo_id, {})
            return self._edited(state, repo_id, written | {"jobs": before.get("jobs", []) + jobs})

        return self.change(edit)

    def append(self, repo_id: str, name: str, rows: DataFrame) -> int:
        """Rows in addition to what the repository has in a table."""
        one = self._write(name, repo_id, rows)

        def edit(state: dict) -> dict:
            before = state.get("repositories", {}).get(repo_id, {})
            return self._edited(state, repo_id, before | {name: before.get(name, []) + [one]})

        return self.change(edit)

    def delete(self, repo_id: str) -> int:
        """All of a repository goes."""
        return self.change(lambda state: self._edited(state, repo_id, {}))

    def _edited(self, state: dict, repo_id: str, tables: dict[str, list]) -> dict:
        known = {k: v for k, v in state.get("repositories", {}).items() if k != repo_id}
        return state | {"repositories": known | ({repo_id: tables} if any(tables.values()) else {})}

    def _write(self, name: str, repo_id: str, rows: DataFrame) -> dict:
        rows = rows.drop("repo_id")
        where = f"{name}/repo_id={quote(repo_id, safe='')}/run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{where}")
        return {"path": where, "schema": rows.schema.jsonValue()}

    def repositories(self, version: int | None = None) -> list[str]:
        return sorted(self.state(version).get("repositories", {}))

    def read(self, name: str, *repo_ids: str, version: int | None = None) -> DataFrame:
        """A table's rows with their repo_id: of some repositories (all unless given), as of a
        version (the last unless given).  Columns that only some runs have are null elsewhere."""
        known = self.state(version).get("repositories", {})
        runs = [run for r, tables in sorted(known.items()) if not repo_ids or r in repo_ids for run in tables.get(name, [])]
        every = [run for tables in known.values() for run in tables.get(name, [])]
        if not every:
            raise KeyError(f"no table {name} in {self.root}")
        fields: dict[str, T.StructField] = {}
        for run in every:
            fields |= {f.name: T.StructField(f.name, f.dataType) for f in T.StructType.fromJson(run["schema"])}
        schema = T.StructType([*fields.values(), T.StructField("repo_id", T.StringType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{run['path']}" for run in runs])

    def vacuum(self) -> int:
        """Remove runs that the last version doesn't name; readers of older ones must be done."""
        used = {run["path"] for tables in self.state().get("repositories", {}).values() for runs in tables.values() for run in runs}
        found = [str(s.getPath()) for s in self._fs.globStatus(self._path(f"{self.root}/*/repo_id=*/run-*")) or []]
        old = [p for p in found if "/".join(p.split("/")[-3:]) not in used]
        for p in old:
            self.remove(p)
        return len(old)


class Job(Published):
    """A job's stages: each is written once for its inputs, and read again when the job is rerun.

    The log is the folder's versions; ``phases`` says how far it came.  A stage that was cut
    short left no version and runs again."""

    def __init__(self, spark: SparkSession, root: str, inputs: str):
        super().__init__(spark, root)
        self.inputs = inputs

    def stage(self, name: str, build: Callable[[], DataFrame], after: tuple[str, ...] = (), progress: float | None = None) -> DataFrame:
        """The stage's rows; ``after`` names the stages that it reads."""
        done = self.state().get("stages", {})
        key = hashlib.sha256(json.dumps([self.inputs, name, [done[a]["key"] for a in after]]).encode()).hexdigest()
        if done.get(name, {}).get("key") != key:
            rows, where = build(), self.new(name)
            rows.write.parquet(where)
            one = {"key": key, "path": where, "schema": rows.schema.jsonValue(), "progress": progress}
            self.change(lambda state: state | {"stages": state.get("stages", {}) | {name: one}})
            done = self.state()["stages"]
        return self.spark.read.schema(T.StructType.fromJson(done[name]["schema"])).parquet(done[name]["path"])

    def phases(self) -> list[tuple[str, float | None]]:
        """The stages that are done, by progress."""
        return sorted(((n, s["progress"]) for n, s in self.state().get("stages", {}).items()), key=lambda x: (x[1] is None, x[1] or 0.0, x[0]))


def fingerprint(spark: SparkSession, root: str) -> str:
    """Changes when a file below a folder is added, removed, or written anew."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    one = files.select(F.xxhash64("path", "length", "modificationTime").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("s")).first()
    return f"{one['n']}-{one['x']}-{one['s']}"
