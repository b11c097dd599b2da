"""A stored vector index: inverted lists around centroids, searched by cosine.

Centroids come from spherical k-means over a sample of ``SAMPLE`` rows at most, on
the driver; every row is in the list of its nearest centroid, in a folder of its
own, with its payload.  A list's radius is the largest angle from its centroid.

A search takes many queries at once.  Each looks through its ``probes`` nearest
lists (as many, unless given, as gave ``RECALL`` of the sample's neighbours; queries that
are unlike the rows may find fewer), whose rows are scored with their whole vectors in cells of some ``BLOCK``
rows: neighbouring small lists share a cell, to which a query goes once, and large lists are cut
into several.  A cell's queries come some ``ASKING`` at a time, so that neither a large list nor
a popular one meets in one task at once, however many rows and queries there are.
With ``exact``, every further list follows that may hold a better row: by the
triangle inequality no row of a list is nearer to the query than the centroid's
angle less the radius, and a list whose bound is below the query's k-th score
can't.  So the exact mode's results are those of a full scan.

Payload filters apply before rows are scored.  Updates are segments (see
``sources.published``); centroids stay those of the first one.  Rows with equal
scores (to six digits) are ordered by key.  Vectors that are null, empty, hold
null or non-finite components, or are zero have no direction and take no part.
Rows with equal keys are each found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrata.session import cut
from lodestrata.sources.published import Segmented

SAMPLE, ROUNDS, MOST_LISTS, BLOCK, ASKING = 16_384, 10, 1_024, 8_192, 16_384
#: Numbers of a task's matrices of angles or scores.
HELD = 1 << 20
#: Rows of a batch that is handed on.
ROWS = 8_192
#: Share of true neighbours that the default probes find of a new index's sample, and how many are sought of how many rows.
RECALL, SOUGHT, TRIED = 0.95, 10, 256
#: What rounding may hide: scores have six digits.
SLACK = 2e-6


def directed(vector: str) -> Column:
    """Whether a vector has a direction."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list | np.ndarray) -> np.ndarray:
    a = np.asarray(rows, float)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from rows that are far apart; empty lists keep their centroid."""
    rng = np.random.default_rng(7)
    chosen = [int(rng.integers(len(sample)))]
    near = sample @ sample[chosen[0]]
    while len(chosen) < lists:
        away = np.clip(1 - near, 0, None)
        at = int(rng.choice(len(sample), p=away / away.sum())) if away.sum() > 1e-9 else int(rng.integers(len(sample)))
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    centers = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def probes_of(sample: np.ndarray, centers: np.ndarray) -> int:
    """The least number of probes by which ``RECALL`` of the neighbours in a sample are found."""
    tried = sample[:: max(1, len(sample) // TRIED)]
    near = np.argsort(-(tried @ sample.T), axis=1)[:, 1 : SOUGHT + 1]  # without the row itself
    if not near.size:
        return 1
    place = _angles(tried, centers).argsort(axis=1, kind="stable").argsort(axis=1)
    own = np.argmax(sample @ centers.T, axis=1)
    return 1 + int(np.quantile(np.take_along_axis(place, own[near], axis=1), RECALL, method="higher"))


def _angles(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centers.T, -1, 1))


def _vectors(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch[name].combine_chunks() if isinstance(batch, pa.Table) else batch[name]
    return unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1))


def _assigned(known):
    """Batches with a column ``vector`` get their list and the angle from its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(known.value)):
                angles = _angles(_vectors(part, "vector"), known.value)
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], [*part.schema.names, "list", "angle"])

    return run


def _parts(rows: pa.RecordBatch | pa.Table, width: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Rows in parts whose matrices of ``width`` columns have ``HELD`` numbers at most."""
    step = max(1, HELD // max(1, width))
    for at in range(0, len(rows), step):
        yield rows.slice(at, step)


def cells_of(sizes: dict[int, int], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, first cell, cells) of lists with numbers of rows: a cell holds some ``block`` rows,
    of one large list, or of small ones that follow each other."""
    lists, first, cells, cell, held = sorted(sizes), [], [], 0, 0
    for i in lists:
        n = 1 + sizes[i] // block
        if held and (n > 1 or held + sizes[i] > block):
            cell, held = cell + 1, 0
        first.append(cell)
        cells.append(n)
        cell, held = (cell + n, 0) if n > 1 else (cell, held + sizes[i] + 1)
    return np.array(lists, int), np.array(first, int), np.array(cells, int)


def _probed(known, probes: int, rest: bool):
    """Batches (query, vector, kth) to (query, vector, cell, lists): the nearest lists, or with
    ``rest`` all others that may hold a row as good as the query's k-th, by their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radius, (lists, first, cells) = known.value
        listed = np.repeat(lists, cells)  # the lists of all cells, one cell after the other
        placed = np.repeat(first, cells) + np.concatenate([np.arange(n) for n in cells]) if len(cells) else first
        for batch in batches:
            for part in _parts(batch, max(len(centers), len(listed))):
                angles = np.where(np.isnan(radius), np.inf, _angles(_vectors(part, "vector"), centers))
                place = angles.argsort(axis=1, kind="stable").argsort(axis=1)
                take = (place < probes) & ~np.isnan(radius)
                if rest:
                    best = np.cos(np.clip(angles - np.nan_to_num(radius), 0, np.pi))
                    take = ~take & ~np.isnan(radius) & (best >= part["kth"].to_numpy(zero_copy_only=False)[:, None] - SLACK)
                at, entry = take[:, listed].nonzero()
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (placed[entry[1:]] != placed[entry[:-1]])])) if len(at) else at
                found = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(listed[entry].astype(np.int32)))
                for some in range(0, len(new), ROWS):
                    of = slice(some, some + ROWS)
                    columns = part.select(["query", "vector"]).take(pa.array(at[new[of]])).columns
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(placed[entry[new[of]]].astype(np.int32)), found[of]], ["query", "vector", "cell", "lists"])

    return run


def _scored(k: int, schema: pa.Schema):
    """A cell's rows, and the queries that look through some of its lists: the best k of each."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(queries):
            keys, vectors = rows["key"].combine_chunks(), _vectors(rows, "vector").T
            order = np.empty(len(rows), int)  # the keys' places in their order
            order[pc.sort_indices(keys).to_numpy()] = np.arange(len(rows))
            lists, own = np.unique(rows["list"].to_numpy(), return_inverse=True)
            for part in _parts(queries, len(rows)):
                scores = np.round(_vectors(part, "vector") @ vectors, 6)
                asked = part["lists"].combine_chunks()
                wanted, of = asked.flatten().to_numpy(), np.repeat(np.arange(len(part)), pc.list_value_length(asked).to_numpy())
                at = np.minimum(np.searchsorted(lists, wanted), len(lists) - 1)
                there = lists[at] == wanted  # a list may have no row that meets the condition
                taken = np.zeros((len(part), len(lists)), bool)
                taken[of[there], at[there]] = True
                scores[~taken[:, own]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(part), -2.0)
                q, row = np.nonzero(scores >= np.maximum(least, -2.0)[:, None])
                value = scores[q, row]
                by = np.lexsort((order[row], -value, q))
                q, row, value = q[by], row[by], value[by]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, row, value = q[nth < k], row[nth < k], value[nth < k]
                out.append(pa.table([part["query"].take(pa.array(q)), keys.take(pa.array(row)), pa.array(value)], ["query", "key", "score"]).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


class VectorIndex(Segmented):
    """An index below a folder; ``lists`` is how many a new one has (the square root of its first
    rows' number unless given)."""

    def __init__(self, spark: SparkSession, root: str, lists: int | None = None):
        super().__init__(spark, root)
        self.lists = lists

    def update(self, rows: DataFrame, key: str, vector: str, removed: DataFrame | None = None) -> int:
        """Index rows, other columns as payload, in the place of what is known of their keys;
        leave out the keys of ``removed`` (a table with the column ``key``)."""
        named = {key: "key", vector: "vector"}
        rows = rows.select(*[F.col(c).alias(named.get(c, c)) for c in rows.columns])
        whole = rows.filter(directed("vector")).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
        state = self.state()
        where, probes = (state["centroids"], state["probes"]) if "centroids" in state else self._fit(whole)
        known = self.spark.sparkContext.broadcast(self._centers(where))
        schema = T.StructType([*whole.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        placed = whole.mapInArrow(_assigned(known), schema)
        return self.add(lambda path: self._write(path, placed), rows.select("key"), removed, centroids=where, probes=probes, schema=schema.jsonValue())

    def remove(self, keys: DataFrame) -> int:
        """Take out the rows of some keys (a table with the column ``key``)."""
        none = self.spark.createDataFrame([], self._schema())
        return self.add(lambda path: self._write(path, none), keys.limit(0), keys)

    def merge(self) -> int:
        """One segment of all, without what is dead."""
        live = self.listed().filter("live")
        return self.add(lambda path: self._write(path, self.rows("rows", lambda r: r, self._schema())), live, merged=True)

    def _fit(self, rows: DataFrame) -> tuple[str, int]:
        n = rows.count()
        share = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * SAMPLE / n))
        sample = share.select("vector").limit(2 * SAMPLE).toArrow()["vector"].to_pylist()
        lists = max(1, min(self.lists or int(n**0.5), MOST_LISTS, len(sample)))
        sample = unit(sample) if sample else np.ones((1, 1))
        centers = centroids_of(sample, lists)
        where = self.new("centroids")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").coalesce(1).write.parquet(where)
        return where, probes_of(sample, centers)

    def _centers(self, where: str) -> np.ndarray:
        return np.array([r["center"] for r in self.spark.read.parquet(where).orderBy("list").collect()])  # MOST_LISTS rows at most

    def _write(self, path: str, placed: DataFrame) -> None:
        placed.hint("rebalance", F.col("list")).sortWithinPartitions("list", "angle").write.partitionBy("list").parquet(f"{path}/rows")
        held = self.spark.read.schema(placed.schema).parquet(f"{path}/rows")
        held.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/radii")

    def _radii(self) -> dict[int, tuple[float, int]]:
        """Each list's radius and rows, over all segments; dead rows can only widen it."""
        found: dict[int, tuple[float, int]] = {}
        for s in self.segments():
            for r in self.spark.read.parquet(f"{s['path']}/radii").collect():  # a row for each list
                radius, n = found.get(r["list"], (0.0, 0))
                found[r["list"]] = max(radius, r["radius"]), n + r["n"]
        return found

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
        """(query, rank, key, score) of each query's k best rows; ``queries`` is (query, vector),
        ``where`` a condition on the payload."""
        radii, schema = self._radii(), self._schema()
        probes = probes or self.state()["probes"]
        centers = self._centers(self.state()["centroids"])
        radius = np.array([radii[i][0] if i in radii else np.nan for i in range(len(centers))])
        cells = cells_of({i: n for i, (_, n) in radii.items()}, BLOCK)
        known = self.spark.sparkContext.broadcast((centers, radius + 1e-9, cells))
        rows = self.rows("rows", lambda r: r if where is None else r.filter(where), schema).select("list", "key", "vector")
        sizes = self.spark.createDataFrame([tuple(map(int, c)) for c in zip(*cells)], "list int, first int, cells int")
        rows = rows.join(F.broadcast(sizes), "list").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("cells"))).cast("int"))  # a row for each list
        asked = queries.filter(directed("vector")).select("query", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        asked = cut(asked.withColumn("kth", F.lit(None).cast("double")), "queries")
        parts = 1 + asked.count() // ASKING
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        kind = T.StructType([asked.schema["query"], rows.schema["key"], T.StructField("score", T.DoubleType())])
        pair = T.StructType([*asked.schema.fields[:2], *T.StructType.fromDDL("cell int, lists array<int>").fields])

        def looked(asking: DataFrame, rest: bool) -> DataFrame:
            pairs = asking.mapInArrow(_probed(known, probes, rest), pair).withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
            cell = rows.select("cell", "part", "list", "key", "vector").groupBy("cell", "part")
            return cell.cogroup(pairs.groupBy("cell", "part")).applyInArrow(_scored(k, to_arrow_schema(kind)), kind)

        best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = top(looked(asked, False))
        if exact:
            found = cut(found, "probed")
            kth = found.filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
            asking = asked.drop("kth").join(kth, "query", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
            found = top(found.drop("rank").unionByName(looked(asking, True)))
        return found.select("query", "rank", "key", "score")

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state()["schema"])

    def payload(self, found: DataFrame) -> DataFrame:
        """Found rows with all columns that are stored of them."""
        rows = self.rows("rows", lambda r: r, self._schema()).drop("list", "angle")
        return found.join(rows, "key")


def built(spark: SparkSession, root: str, rows: DataFrame, key: str, vector: str, lists: int | None = None) -> VectorIndex:
    """An index with the rows in it."""
    index = VectorIndex(spark, root, lists)
    index.update(rows, key, vector)
    return index
