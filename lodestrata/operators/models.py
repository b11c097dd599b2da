"""Calls of a language-model server from a table of prompts.

Each distinct prompt is called once: prompts are keyed by a hash of the model, the
kind of call, its options and the text, and those with a stored answer aren't
called.  The rest is called in waves, whose answers are published when a wave is
whole (see ``sources.published``); a job that is cut short, or run again, goes on
with what has no answer.  A call carries its key, so that a server may answer a
lost task's second try from the first.

A task calls one prompt at a time and at most ``rate`` a second; a call that can't
connect, times out, or is answered 408, 429 or 5xx is tried again after growing
pauses.  What still fails is an error in the prompt's row, and isn't stored.

Null prompts have neither answer nor error.  Repeated prompts share an answer.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.published import Published

#: Paths of the calls, and where their answers are (fixed values).
KINDS = {"generate": ("/api/generate", ("response",)), "chat": ("/api/chat", ("message", "content")), "embed": ("/api/embeddings", ("embedding",))}
LIST = "/api/tags"
AGAIN = {408, 429}


@dataclass(frozen=True)
class Server:
    """Where a model is, and how it may be called."""

    address: str
    model: str
    kind: str = "generate"
    options: dict = field(default_factory=dict)
    system: str = ""
    rate: float = 5.0
    timeout: float = 120.0
    tries: int = 4
    pause: float = 0.5

    def body(self, prompt: str) -> dict:
        said = {"model": self.model, "options": self.options, "stream": False}
        if self.kind == "chat":
            turns = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": prompt}]
            return said | {"messages": turns}
        return said | {"prompt": prompt} | ({"system": self.system} if self.system and self.kind == "generate" else {})

    def key(self, prompt: Column) -> Column:
        """Of a call: equal calls have equal keys."""
        call = json.dumps([self.kind, self.model, self.system, self.options], sort_keys=True)
        return F.sha2(F.concat(F.lit(call + "\n"), prompt), 256)

    def call(self, prompt: str, key: str = "") -> tuple[str | None, str | None, int]:
        """(answer, error, tries) of a prompt; an answer that isn't a text is JSON."""
        path, where = KINDS[self.kind]
        request = urllib.request.Request(self.address.rstrip("/") + path, json.dumps(self.body(prompt)).encode(), {"Content-Type": "application/json", "Idempotency-Key": key})
        for n in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as said:
                    found = json.load(said)
                for name in where:
                    found = found[name]
                return (found if isinstance(found, str) else json.dumps(found)), None, n
            except urllib.error.HTTPError as error:
                why, again = f"HTTP {error.code}", error.code >= 500 or error.code in AGAIN
            except (OSError, ValueError, KeyError, TypeError) as error:
                why, again = f"{type(error).__name__}: {error}", isinstance(error, OSError)
            if not again or n == self.tries:
                return None, why, n
            time.sleep(self.pause * 2 ** (n - 1))
        raise AssertionError

    def models(self) -> list[str]:
        """What the server has."""
        with urllib.request.urlopen(self.address.rstrip("/") + LIST, timeout=self.timeout) as said:
            return [m["name"] for m in json.load(said)["models"]]


def _called(server: Server):
    """Batches (key, prompt) to (key, answer, error, tries), at most ``rate`` a second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = 0.0
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["key"].to_pylist(), batch["prompt"].to_pylist()):
                time.sleep(max(0.0, free - time.monotonic()))
                free = max(free, time.monotonic()) + 1 / server.rate
                rows.append((key, *server.call(prompt, key)))
            columns = [[r[i] for r in rows] for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["key", "answer", "error", "tries"])

    return run


class Answers(Published):
    """Stored answers below a folder."""

    def __init__(self, spark: SparkSession, root: str, tasks: int = 8, waves: int = 4):
        super().__init__(spark, root)
        self.tasks, self.waves = tasks, waves

    def stored(self) -> DataFrame:
        """(key, answer) of all calls that were answered."""
        parts = self.state().get("parts", [])
        schema = "key string, answer string, error string, tries int"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.filter("error is null").select("key", "answer").dropDuplicates(["key"])

    def answer(self, rows: DataFrame, prompt: str, server: Server) -> DataFrame:
        """The rows with ``answer`` and ``error`` of their prompts."""
        keyed = rows.withColumn("__key", server.key(F.col(prompt)))
        asked = keyed.filter("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.first(prompt).alias("prompt"))
        failed = []
        for wave in range(self.waves):
            some = asked.filter(F.pmod(F.xxhash64("key"), F.lit(self.waves)) == wave).join(self.stored(), "key", "left_anti")
            where = self.new("answers")
            some.repartition(self.tasks, "key").mapInArrow(_called(server), "key string, answer string, error string, tries int").write.parquet(where)
            self.change(lambda state: state | {"parts": [*state.get("parts", []), where]})  # noqa: B023
            failed.append(where)
        errors = self.spark.read.schema("key string, answer string, error string, tries int").parquet(*failed).filter("error is not null").select("key", "error")
        out = keyed.join(self.stored().withColumnRenamed("key", "__key"), "__key", "left").join(errors.withColumnRenamed("key", "__key"), "__key", "left")
        return out.drop("__key")
