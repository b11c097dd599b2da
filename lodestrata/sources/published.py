"""Folders of tables that change as a whole: writers add files beside those in use, and then
publish a new version that names them, in one rename; readers see the last whole version.

``versions/`` holds one small JSON file for each version; nothing is overwritten.  A writer
that finds its version taken by another (``Conflict``) reads again and retries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published first."""


class Published:
    """The versions of a folder, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(conf)
        self._jvm, self._conf = jvm, conf

    def version(self) -> int:
        """The last version's number; 0 if there is none."""
        where = self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return max((int(n[:12]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        """What a version (the last one unless given) says; empty if there is none."""
        version = self.version() if version is None else version
        if not version:
            return {}
        found = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(found.readAllBytes()).decode())
        finally:
            found.close()

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def publish(self, state: dict, after: int) -> int:
        """Make ``state`` the version that follows ``after``."""
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        draft, final = f"{self.root}/versions/.{uuid.uuid4().hex}", self._name(after + 1)
        out = self._fs.create(self._path(draft), False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(final)), none)
        except Exception as error:
            self._fs.delete(self._path(draft), False)
            if self._fs.exists(self._path(final)):
                raise Conflict(f"version {after + 1} of {self.root} is taken") from error
            raise
        return after + 1

    def change(self, edit: Callable[[dict], dict], tries: int = 20) -> int:
        """Publish ``edit`` of the last state, again from the new one where another came first."""
        for k in range(tries):
            before = self.version()
            try:
                return self.publish(edit(self.state(before)), before)
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError

    def new(self, name: str) -> str:
        """A path below the folder that nothing uses yet."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Segmented(Published):
    """A stored index in segments.  An update is a segment of its own: the rows of the keys that
    it adds or replaces, and the list of all its keys, with those that it removes.  What an
    older segment holds of a key is dead once a later one lists the key."""

    def segments(self) -> list[dict]:
        return self.state().get("segments", [])

    def total(self) -> int:
        """How many keys are live."""
        return self.state().get("total", 0)

    def listed(self, segments: list[dict] | None = None) -> DataFrame | None:
        """(key, segment, live) of what the segments list, the last one of each key."""
        parts = [self.spark.read.parquet(f"{s['path']}/keys").withColumn("segment", F.lit(s["id"])) for s in (self.segments() if segments is None else segments)]
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max(F.struct("segment", "live")).alias("last")).select("key", "last.segment", "last.live")

    def rows(self, name: str, pick: Callable[[DataFrame], DataFrame], schema: str | None = None) -> DataFrame | None:
        """The live rows of a table of all segments, picked before they are put together; the
        rows' key is the column ``key``."""
        found = self.segments()
        if not found:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        out = reduce(DataFrame.unionByName, [pick(reader.parquet(f"{s['path']}/{name}")).withColumn("segment", F.lit(s["id"])) for s in found])
        if len(found) > 1:
            later = self.listed(found[1:]).select("key", F.col("segment").alias("later"))
            out = out.join(later, "key", "left").filter("later is null or segment >= later").drop("later")
        return out.drop("segment")

    def add(self, write: Callable[[str], None], keys: DataFrame, removed: DataFrame | None = None, merged: bool = False, **more) -> int:
        """Write a segment by ``write(path)`` and publish it.  ``keys`` and ``removed`` have the
        column ``key``; with ``merged``, the segment takes the place of those before it."""
        path, before = self.new("segment"), self.segments()
        write(path)
        listed = keys.select("key").distinct().withColumn("live", F.lit(True))
        if removed is not None:
            listed = listed.unionByName(removed.select("key").distinct().join(listed, "key", "left_anti").withColumn("live", F.lit(False)))
        listed.write.parquet(f"{path}/keys")
        own = self.spark.read.parquet(f"{path}/keys")
        added = own.filter("live").count()

        def edit(state: dict) -> dict:
            segments = state.get("segments", [])
            if merged and [s["id"] for s in segments] != [s["id"] for s in before]:
                raise RuntimeError("another update came while segments were merged")
            old = self.listed(segments)
            gone = 0 if old is None or merged else old.filter("live").join(own, "key", "left_semi").count()
            one = {"id": 1 + max((s["id"] for s in segments), default=0), "path": path}
            return state | more | {"segments": [one] if merged else [*segments, one], "total": added if merged else state.get("total", 0) - gone + added}

        return self.change(edit)

    def vacuum(self) -> int:
        """Remove segments that the last version doesn't name; readers of older ones must be done."""
        used = {s["path"].rsplit("/", 1)[1] for s in self.segments()}
        found = [s.getPath() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("segment-")]
        old = [p for p in found if p.getName() not in used]
        for p in old:
            self._fs.delete(p, True)
        return len(old)
