"""Quality scores: kernel ridge regression by random Fourier features.

Each text becomes a short vector of statistics (``STATISTICS``).  Random
Fourier features ``cos(x W + b)`` of the standardised vectors approximate a
Gaussian kernel; every partition sums its part of the normal equations
``Z'Z`` and ``Z'y``, the driver adds these fixed-size sums and solves the
ridge system, and isotonic regression over binned raw scores turns the result
into probabilities.

Defined results: a null text counts as empty; empty texts get the score of
their (zero) statistics; repeated rows get equal scores; without any learnable
label every score is 0; an empty table gives an empty result.  A very long text
is read whole.  Ill-formed UTF-8 counts as U+FFFD.  Labels other than 0 and 1,
and rows with a null id, teach nothing.  Only doc_id and text are read, whatever
other columns are named.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import fold_of, materialize

STATISTICS = ("size", "word_length", "long_words", "lower", "upper", "digits", "spaces", "stops", "commas", "bars", "symbols", "exclaims", "high_bytes", "new_words", "new_lines", "line_length", "top_word", "lone_bytes")
FEATURES, BINS, RIDGE = 256, 512, 1e-3
#: The part of a score that is the raw value, which keeps the order within an isotonic step.
RANK = 0.02

_B = np.arange(256)
_IN = lambda s: np.isin(_B, np.frombuffer(s, np.uint8))
_CLASSES = np.stack([(_B >= 97) & (_B <= 122), (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), _IN(b" \t\n\r"), _IN(b"."), _IN(b",;:"), _IN(b"|"), _IN(b"#$%&*@^~=+<>{}[]\\_"), _IN(b"!?"), _B >= 128], axis=1).astype(float)


def statistics_of(text: str | None) -> np.ndarray:
    """The statistics of a whole text, each of a bounded range."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    data = text.encode("utf-8", "replace")
    n, words, lines = len(data), data.split(), data.split(b"\n")
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES / n
    out[0] = np.log1p(n) / 10
    out[3:13] = share
    if words:
        count = Counter(words)
        letters = sum(map(len, words))
        out[1] = min(letters / len(words), 40) / 10
        out[2] = sum(c for w, c in count.items() if len(w) > 12) / len(words)
        out[13] = len(count) / len(words)
        out[16] = max(count.values()) / len(words)
        out[17] = sum(c for w, c in count.items() if len(w) == 1) / len(words)
    full = [x for x in lines if x]
    if full:
        out[14] = len(set(full)) / len(full)
        out[15] = np.log1p(n / len(full)) / 10
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        values = np.stack([statistics_of(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, len(STATISTICS)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))

    return docs.select("doc_id", stats(F.make_valid_utf8("text")).alias("stats"))


class QualityModel:
    """Standardisation, projection, ridge weights and the isotonic steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        width = np.sqrt(len(STATISTICS))
        self.project = rng.normal(size=(len(STATISTICS), FEATURES)) / width
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.edges, self.steps = weights, np.zeros(1), np.zeros(1)

    def z(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(x @ self.project + self.phase), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.z(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.zeros(len(stats))
        raw = self.raw(stats)
        return np.clip((1 - RANK) * np.interp(raw, self.edges, self.steps) + RANK * (raw + 0.5) / 2, 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, k2 = pools.pop()
            v1, w1, k1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATISTICS)))


def fit(stats: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> QualityModel:
    """Learn from all labelled rows outside the held-out fold.  ``stats`` is read
    three times, so pass a written one.  Only fixed-size sums reach the driver."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out)).distinct()
    train = stats.join(rows, "doc_id")
    sums = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATISTICS))], *[F.sum(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}") for i in range(len(STATISTICS))]).first()
    k, n = len(STATISTICS), sums["n"]
    if not n:
        return QualityModel(np.zeros(k), np.ones(k))
    mean = np.array([sums[f"s{i}"] for i in range(k)]) / n
    scale = np.sqrt(np.maximum(np.array([sums[f"q{i}"] for i in range(k)]) / n - mean**2, 0))
    model = QualityModel(mean, np.maximum(scale, 1e-3))

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 1
        zz, zy = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.z(_matrix(batch["stats"]))
            zz += z.T @ z
            zy += z.T @ batch["label"].to_numpy(float)
        yield pd.DataFrame({"part": [np.concatenate([zz.ravel(), zy]).tobytes()]})

    @F.pandas_udf("binary")
    def added(parts: pd.Series) -> bytes:
        return sum(np.frombuffer(p, np.float64) for p in parts).tobytes()

    # partitions meet in groups, and these in fewer, before the last sum
    parts = train.select("stats", "label").mapInPandas(equations, "part binary").select(F.pmod(F.spark_partition_id(), F.lit(4096)).alias("g"), "part")
    parts = parts.groupBy("g").agg(added("part").alias("part")).groupBy(F.pmod("g", F.lit(32)).alias("g")).agg(added("part").alias("part"))
    total = sum(np.frombuffer(r["part"], np.float64) for r in parts.collect())
    size = FEATURES + 1
    zz, zy = total[: size * size].reshape(size, size), total[size * size :]
    model.weights = np.linalg.solve(zz + RIDGE * n * np.eye(size) / size, zy)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            slot = np.clip(((model.raw(_matrix(batch["stats"])) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(slot, minlength=BINS)
            y += np.bincount(slot, batch["label"].to_numpy(float), minlength=BINS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bin": at, "n": n[at], "y": y[at]})

    found = train.select("stats", "label").mapInPandas(bins, "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("bin")
    model.edges = (found["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.steps = isotonic((found["y"] / found["n"]).to_numpy(), found["n"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, quality) of every row of ``docs``."""
    stats = materialize(statistics(docs), "quality-stats")
    model = fit(stats, labels, folds, held_out)

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column)))

    return stats.select("doc_id", scored("stats").alias("quality"))
