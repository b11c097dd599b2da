"""Progress events as a stream: the latest state of each key, and windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "repo_id string, scan_job_id string, status string, phase string, progress double, message string, timestamp timestamp"
#: Phases and where they stand in percent (fixed values).
PHASES = {"queued": 0.0, "cloning": 5.0, "cloned": 10.0, "parsing": 15.0, "parsed": 20.0, "building_graph": 40.0, "graph_built": 55.0, "analyzing": 60.0, "saving": 85.0, "completed": 100.0}


def events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of JSON event files, read with some options."""
    return spark.readStream.schema(SCHEMA).options(**options).json(folder)


def latest_state(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: works on a stream (update mode) and on a table alike, and
    combines before the shuffle."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def publish(stream: DataFrame, name: str, checkpoint: str, *subscribers: Callable[[DataFrame], None]) -> StreamingQuery:
    """Send each batch of changed states to all subscribers; one that fails is dropped."""
    alive = list(subscribers)

    def send(batch: DataFrame, _: int) -> None:
        batch.persist()
        for one in list(alive):
            try:
                one(batch)
            except Exception:  # noqa: BLE001  a dead subscriber doesn't stop the others
                alive.remove(one)
        batch.unpersist()

    latest = latest_state(stream, "repo_id", ["timestamp", "progress"])
    return latest.writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(send).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str = "timestamp", length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by window and status; those later than ``late`` are left out, and so is their state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "status", "n")


def sessions(stream: DataFrame, key: str = "repo_id", time: str = "timestamp", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")
