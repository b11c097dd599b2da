"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import cut

#: Bytes of the rows that an executor hands a Python worker at once, about, and a row at least.
ARROW_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage,
    and a lost executor costs no recomputation."""
    return cut(df, tag)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers batches by their bytes: what an executor and
    its workers hold for a batch doesn't grow with the length of texts.  Spark's 10,000 rows are
    some 20 MB of common texts, of which there are copies in the executor and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def is_fold(doc_id: Column, folds: int, which: int) -> Column:
    """Whether a row is held out; a null id isn't, but isn't learned from either."""
    return F.coalesce(fold_of(doc_id, folds) == F.lit(which), F.lit(False))


def bounded_share(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` of the rows at most, chosen by a hash of ``key``; all of
    them when there are no more than that.  Expects narrow rows: it counts them."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1_000_003)) < F.lit(int(1_000_003 * bound / n)))


def ascii_lower(text: Column) -> Column:
    """A text with A-Z lower-cased and all else as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def bounded(df: DataFrame, size: Column, most: int = 64 << 20) -> DataFrame:
    """A hint to broadcast a written table whose rows' sizes sum to ``most`` bytes at most; as
    it is, otherwise, so that adaptive execution joins it by a shuffle and splits hot keys."""
    return F.broadcast(df) if (df.agg(F.sum(size + F.lit(64))).first()[0] or 0) <= most else df
