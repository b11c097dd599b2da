"""Near-duplicates by SimHash, found with vantage-point trees.

A fingerprint has 64 bits; bit i is set where more than half of the hashes of
the text's word shingles (repeats included) have bit i set.  Fingerprints
with at most ``RADIUS`` differing bits are linked, exactly; a document's
component is named by the smallest doc_id that links reach.

How the links are found.  Random 64-bit fingerprints lie about 32 bits apart
from any vantage point, so one tree over all of them can prune little at
radius 4.  The first level therefore partitions by the Hamming distance
within parts of the fingerprint: if two fingerprints differ in at most 4
bits, they agree (distance 0) on at least two of 6 parts.  Each of the shards
that two parts make, of some 21 bits, is searched by a vantage-point tree over
whole fingerprints: a node splits by the distance to its vantage point, and the
triangle inequality prunes all pairs whose distances to it differ by over 4;
leaves of up to ``LEAF`` fingerprints are compared directly, and most shards
are no larger.  A shard with more than ``SHARD_ROWS`` fingerprints is split
further in the same way: by rings of equal distance to a vantage point, each of
which meets only the rings within 4 of it (the boundary), in cells of bounded
size.

Only distinct fingerprints are compared, and a cell returns a spanning forest
of its links, never all pairs, so groups of copies cost no more than their
size.  Components are joined from the forests by alternating star operations
on (node, smaller neighbour) rows; nothing is collected by the driver.

The pipeline's stage (``distinct_documents``) uses wider SimHash fingerprints, of some
thousand bits.  At a shingle similarity of 0.8 a bit differs with a probability of
0.15, so that 64 bits don't tell such pairs from random ones, and no tree prunes.
Candidates agree on one of many bands of bits and differ in at most ``WIDE_RADIUS``
of ``WIDE`` words apart from those; an exact check follows.  See ``similar_documents``.

Defined results: null and empty texts have fingerprint zero and link like any
other; a row with a null doc_id gets a fingerprint, but takes part in no link
and has a null component; repeated rows get equal results; rows that share a
doc_id are one document, of which ``distinct_documents`` keeps the row whose
columns' hash is the least; an empty table gives an empty result.  A very long
text is hashed whole.  Ill-formed UTF-8 counts as U+FFFD.  Only doc_id and text
are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded, materialize

WORDS, RADIUS, SEED = 4, 4, 42
#: The pipeline's stage: words of a shingle, and the similarity of sets that links documents.
SHINGLE, SIMILARITY = 5, 0.8
#: The stage's fingerprints: words that are compared whole, and differing bits of candidates (29 and 5
#: around it of a pair at the similarity, 96 and 7 around it of a random one); the probability that a
#: pair at the similarity agrees on no band of further bits, and the bits of a band at least and at most.
WIDE, WIDE_RADIUS, MISSED, BAND_BITS = 3, 62, 5e-8, (10, 20)
#: Rows of a shard whose pairs are compared together with those of other shards.
FEW = 512
#: Rows of a shard that one task searches; larger shards are split exactly.
SHARD_ROWS = 4_096
#: Shingles of a group of candidates whose texts meet in one task; larger groups are cut exactly.
GROUP_SHINGLES = 1 << 20
#: Fingerprints of a tree's leaf, whose pairs are compared directly.
LEAF = 16


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """The SimHash of a whole text; words are separated by ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _text() -> Column:
    return F.make_valid_utf8(F.col("text"))


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", simhash(_text()).alias("fp"))


# ---------------------------------------------------------------- one shard


class Forest:
    """Union-find over the rows of one shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:  # shorten all paths
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _near(x: np.ndarray, y: np.ndarray, ix: np.ndarray, iy: np.ndarray, forest: Forest, radius: int) -> None:
    """Compare all of ix with all of iy, a bounded block at a time."""
    step = max(1, 2_000_000 // max(1, len(iy)))
    for at in range(0, len(ix), step):
        part = ix[at : at + step]
        p, q = np.nonzero(np.bitwise_count(x[part][:, None] ^ y[iy][None, :]) <= radius)
        forest.link(part[p], iy[q])


def search(fp: np.ndarray, forest: Forest, radius: int = RADIUS) -> None:
    """Link all pairs within the radius, by a vantage-point tree."""
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(fp)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= LEAF:
                _near(fp, fp, a, a, forest, radius)
                continue
            d = np.bitwise_count(fp[a] ^ fp[a[0]]).astype(np.int64)
            close = a[d <= radius]
            forest.link(np.full(len(close), a[0]), close)
            middle = int(np.median(d))
            inside = d <= middle
            if inside.all():
                inside = d < middle
            if not inside.any():  # all at one distance from the vantage point
                _near(fp, fp, a, a, forest, radius)
                continue
            edge = d[inside].max()
            todo += [(a[inside], None), (a[~inside], None), (a[inside & (d > edge - radius)], a[~inside & (d <= edge + radius)])]
            continue
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= LEAF * LEAF:
            _near(fp, fp, a, b, forest, radius)
            continue
        da, db = (np.bitwise_count(fp[x] ^ fp[a[0]]).astype(np.int64) for x in (a, b))
        middle = int(np.median(np.concatenate([da, db])))
        ia, ib = da <= middle, db <= middle
        if (ia.all() and ib.all()) or not (ia.any() or ib.any()) or len(a) * len(b) <= 65_536:
            _near(fp, fp, a, b, forest, radius)
            continue
        low, high = da > middle - radius, da <= middle + radius
        low_b, high_b = db > middle - radius, db <= middle + radius
        parts = [(a[ia], b[ib]), (a[~ia], b[~ib]), (a[ia & low], b[~ib & high_b]), (a[~ia & high], b[ib & low_b])]
        if sum(len(p) * len(q) for p, q in parts) > 0.9 * len(a) * len(b):  # nothing to prune here
            _near(fp, fp, a, b, forest, radius)
            continue
        todo += parts


def _small(fp: np.ndarray, start: np.ndarray, end: np.ndarray, forest: Forest, radius: int) -> None:
    """The pairs within many leaf-sized shards at once: rows i and i + k for each k."""
    if not len(start):
        return
    rows = np.concatenate([np.arange(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    last = np.repeat(end, end - start)
    for k in range(1, int((end - start).max())):
        keep = rows + k < last
        rows, last = rows[keep], last[keep]
        hit = np.bitwise_count(fp[rows] ^ fp[rows + k]) <= radius
        forest.link(rows[hit], rows[hit] + k)


def _edges(shard: np.ndarray, fp: np.ndarray, node: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of whole shards (sorted): (node, smaller node) of linked rows.  Rows of
    sides 1 and 2 of a cell are compared across sides only; side 0 is compared within."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]])
    forest = Forest(len(shard))
    plain = side[start] == 0
    small = plain & (end - start <= LEAF)
    _small(fp, start[small], end[small], forest, radius)
    for s, e, within in zip(start[~small].tolist(), end[~small].tolist(), plain[~small].tolist(), strict=True):
        own = Forest(e - s)
        if within:
            search(fp[s:e], own, radius)
        else:
            _near(fp[s:e], fp[s:e], np.flatnonzero(side[s:e] == 1), np.flatnonzero(side[s:e] == 2), own, radius)
        forest.root[s:e] = own.root + s
    first = node.copy()
    np.minimum.at(first, forest.root, node)
    low = first[forest.root]
    linked = low != node
    return node[linked], low[linked]


def _shards(find):
    """A mapInArrow function over rows (shard, side, fingerprint words, node), sorted by shard within
    the partition; it holds one shard and the batch that ends it.  ``find`` gives a shard's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate([h, n]) for h, n in zip(held, new, strict=True)] if held else new
            if not len(held[0]):
                continue
            done = int(np.searchsorted(held[0], held[0][-1], side="left"))
            if done:
                yield from emit([h[:done] for h in held])
                held = [h[done:] for h in held]
        if held and len(held[0]):
            yield from emit(held)

    def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard, side, *fp, node = rows
        a, b = find(shard, [x.view(np.uint64) for x in fp], node, side)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _wide_near(fp: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether wide fingerprints of rows a and b are near; the shapes broadcast."""
    return sum(np.bitwise_count(x[a] ^ x[b]) for x in fp) <= WIDE_RADIUS  # at most 192: it fits 8 bits


def _wide_edges(shard: np.ndarray, fp: list[np.ndarray], node: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_edges``, of wide fingerprints, whose pairs are all compared."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]])
    forest = Forest(len(shard))
    few = (side[start] == 0) & (end - start <= FEW)
    if few.any():
        last = np.repeat(np.where(few, end, 0), end - start)
        rows = np.flatnonzero(last)
        for k in range(1, int((end - start)[few].max())):
            rows = rows[rows + k < last[rows]]
            hit = rows[_wide_near(fp, rows, rows + k)]
            forest.link(hit, hit + k)
    for s, e in zip(start[~few].tolist(), end[~few].tolist(), strict=True):
        whole = np.arange(s, e)
        x, y = (whole, whole) if side[s] == 0 else (whole[side[s:e] == 1], whole[side[s:e] == 2])
        step = max(1, 1_000_000 // max(1, len(y)))
        for at in range(0, len(x), step):
            p, q = np.nonzero(_wide_near(fp, x[at : at + step, None], y[None, :]))
            forest.link(x[at + p], y[q])
    first = node.copy()
    np.minimum.at(first, forest.root, node)
    low = first[forest.root]
    linked = low != node
    return node[linked], low[linked]


# ------------------------------------------------------------- all shards


def _keys(bits: Column, radius: int) -> Column:
    """The keys of a fingerprint: each two of its ``radius + 2`` parts with their values.  Two
    fingerprints within the radius agree on at least two parts, so they share a key."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    size = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]
    part = [F.shiftrightunsigned(bits, edges[i]).bitwiseAND(F.lit((1 << size[i]) - 1)) for i in range(n)]
    pairs = [(i, j) for j in range(n) for i in range(j)]
    return F.array(*[(F.shiftleft(part[i], size[j]) + part[j]) * F.lit(len(pairs)) + F.lit(k) for k, (i, j) in enumerate(pairs)])


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b), b < a: enough links to connect what is linked, from distinct (fp, node) rows."""
    rows = nodes.select(F.explode(_keys(F.col("fp"), radius)).alias("bucket"), "fp", "node")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("vantage"))
    large = materialize(sizes.filter(F.col("n") > shard_rows), "large-shards")
    whole = rows.join(large, "bucket", "left_anti").select(F.col("bucket").alias("shard"), F.lit(0).alias("side"), "fp", "node")
    found = _searched(whole, radius)
    if not large.isEmpty():
        ring = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("int")
        ringed = materialize(rows.join(large, "bucket").select("bucket", ring.alias("ring"), "fp", "node"), "rings")
        found = found.unionByName(_searched(_cells(ringed, F.lit(1), shard_rows, radius), radius))
    return materialize(found.distinct(), "links")


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    placed = rows.repartition("shard").sortWithinPartitions("shard")
    find = lambda shard, fp, node, side: _edges(shard, fp[0], node, side, radius)
    return placed.select("shard", "side", "fp", "node").mapInArrow(_shards(find), "a long, b long")


def _cells(ringed: DataFrame, weight: Column, bound: int, reach: int) -> DataFrame:
    """(shard, side, and the other columns) of rows (bucket, ring, node, ...): buckets cut into
    cells of bounded weight.  Rings of a bucket are cut into pieces by a hash of the node; a piece
    meets itself (side 0), and each piece of the rings up to ``reach`` away (sides 1 and 2)."""
    others_of = [c for c in ringed.columns if c not in ("bucket", "ring")]
    rings = ringed.groupBy("bucket", "ring").agg(F.ceil(F.sum(weight) / F.lit(bound)).cast("int").alias("pieces"))
    near = rings.alias("x").join(rings.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.abs(F.col("x.ring") - F.col("y.ring")) <= reach))
    # for each ring: the rings around it with their numbers of pieces, at most 2 * reach + 1
    near = near.groupBy("x.bucket", "x.ring", F.col("x.pieces")).agg(F.collect_list(F.struct(F.col("y.ring").alias("ring"), F.col("y.pieces").alias("pieces"))).alias("around"))
    placed = ringed.join(near, ["bucket", "ring"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    others = F.flatten(F.transform("around", lambda r: F.transform(F.sequence(F.lit(0), r["pieces"] - 1), lambda k: F.struct(r["ring"].alias("ring"), k.cast("int").alias("piece")))))
    own = F.struct(F.col("ring"), F.col("piece"))
    out = placed.select("bucket", *others_of, own.alias("own"), F.explode(others).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cell = F.xxhash64("bucket", low["ring"], low["piece"], high["ring"], high["piece"])
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return out.select(cell.alias("shard"), side.alias("side"), *others_of)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links, the smallest node that it is connected
    with.  Alternating large and small stars; each round is written to the shared folder."""
    now, before = edges.select("a", "b"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        star = joined.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(star.select("e.a", "e.b").filter("a <> b").distinct(), "stars")
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = digest


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    nodes = materialize(prints.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # a document with several texts (a repeated id) links their fingerprints
    several = prints.filter(F.col("doc_id").isNotNull()).join(nodes, "fp").filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    several = several.join(nodes.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    found = components(links(nodes, radius, shard_rows).unionByName(several).distinct())
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ------------------------------------------------------- word shingles, exactly


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles; of all its words if they are fewer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def band_plan(n: int) -> tuple[int, int]:
    """The bits of a band, and how many bands, for n documents: random ones share a band with some
    hundreds of others, and a pair at the similarity misses all with a probability of ``MISSED``."""
    bits = min(max(BAND_BITS[0], int(n).bit_length() - 8), BAND_BITS[1])
    apart = np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
    return bits, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - apart) ** bits))))


def wide_bits(own: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a shingle set, as bits: each is 1 if set in over half of the shingles' hashes,
    of which a shingle has one of 64 bits for each word."""
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), 255):
        x = own[at : at + 255, None] + step
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * ones > len(own)


def wide_fingerprint(own: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``WIDE`` words that are compared, and the bands of further bits."""
    found = wide_bits(own, WIDE + -(-bits * bands // 64))
    head, rest = found[: 64 * WIDE], found[64 * WIDE : 64 * WIDE + bits * bands]
    return np.packbits(head, bitorder="little").view(np.int64), rest.reshape(bands, bits) @ (1 << np.arange(bits, dtype=np.int32))


def wide_links(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b), b < a: enough links to connect the candidates of distinct (node, w0, w1, ..., bands) rows:
    pairs that agree on a band and differ in at most ``WIDE_RADIUS`` of the words' bits."""
    words = [f"w{i}" for i in range(WIDE)]
    rows = nodes.select("node", *words, F.posexplode("bands").alias("band", "value"))
    rows = rows.select((F.col("band").cast("long") * F.lit(1 << BAND_BITS[1]) + F.col("value")).alias("bucket"), *words, "node")
    large = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows).select("bucket"), "large-bands")
    find = lambda dealt, side: dealt.select("shard", side, *words, "node").mapInArrow(_shards(_wide_edges), "a long, b long")
    deal = lambda shards: shards.repartition("shard").sortWithinPartitions("shard")
    if large.isEmpty():
        return find(deal(rows.withColumnRenamed("bucket", "shard")), F.lit(0).alias("side"))
    known = bounded(large, F.lit(8))
    found = find(deal(rows.join(known, "bucket", "left_anti").withColumnRenamed("bucket", "shard")), F.lit(0).alias("side"))
    ringed = materialize(rows.join(known, "bucket", "left_semi").select("bucket", F.lit(0).alias("ring"), *words, "node"), "wide-rings")
    return found.unionByName(find(deal(_cells(ringed, F.lit(1), shard_rows, 0)), F.col("side")))


def linked_sets(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """For each set the first of its component; sets are linked at a Jaccard similarity of
    ``least``, exactly.  Each set in turn meets those after it, in order of size, that aren't
    in its component yet and aren't too large."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, forest = size[order], Forest(len(sets))
    tokens, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(tokens), bool)
    for i in range(len(sets)):
        far = int(np.searchsorted(size * least, size[i] + 1e-9, side="right"))
        others = np.arange(i + 1, far)
        others = others[forest.root[others] != forest.root[i]]
        if not len(others):
            continue
        own = token[start[i] : start[i + 1]]
        mark[own] = True
        step = max(1, 4_000_000 // int(size[others[-1]] or 1))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            if not size[i]:  # empty sets are equal
                both = np.zeros(len(some), np.int64)
                near = size[some] == 0
            else:
                ends = np.cumsum(size[some])
                place = np.arange(ends[-1]) + np.repeat(start[some] - ends + size[some], size[some])
                both = np.add.reduceat(mark[token[place]], ends - size[some], dtype=np.int64)
                near = both >= least * (size[i] + size[some] - both) - 1e-9
            forest.link(np.full(int(near.sum()), i), some[near])
        mark[own] = False
    first = np.full(len(sets), len(sets))
    np.minimum.at(first, forest.root, order)
    out = np.empty(len(sets), np.int64)
    out[order] = first[forest.root]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, text), sorted by shard within the partition: links (a, b) of each shard's
    rows.  It holds the shingles of one shard."""

    def emit(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        node = np.array(nodes, np.int64)
        low = node[linked_sets(sets)]
        apart = node != low
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(node, low)[apart]), pa.array(np.minimum(node, low)[apart])], ["a", "b"])

    now, nodes, sets = None, [], []
    for batch in batches:
        for root, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if root != now and nodes:
                yield emit(nodes, sets)
                nodes, sets = [], []
            now = root
            nodes.append(node)
            sets.append(shingles(text.as_py()))
    if nodes:
        yield emit(nodes, sets)


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, key, component_id) of every row of ``docs``: documents are linked where the
    Jaccard similarity of their shingle sets is ``SIMILARITY`` or more.

    Equal sets are one node.  Nodes whose SimHash fingerprints agree on a band and are near are
    candidates (``wide_links``), and connected candidates are one group, whose texts meet in one place, where all links are exact.  A group of more
    shingles than ``GROUP_SHINGLES`` is cut into cells: rings of sizes within a factor of the
    similarity, which link only to the rings beside them, and pieces of rings."""

    bits, bands = band_plan(docs.count())
    words = [f"w{i}" for i in range(WIDE)]

    @F.arrow_udf(f"struct<key:long,size:int,{','.join(f'{w}:long' for w in words)},bands:array<int>>")
    def sketch(texts: pa.Array) -> pa.Array:
        keys, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32)
        heads, values = np.zeros((WIDE, len(texts)), np.int64), np.zeros((len(texts), bands), np.int32)
        for i, text in enumerate(texts):
            own = shingles(text.as_py())
            keys[i], sizes[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)
            heads[:, i], values[i] = wide_fingerprint(own, bits, bands)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands, dtype=np.int32)), pa.array(values.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array(sizes), *map(pa.array, heads), lists], ["key", "size", *words, "bands"])

    prints = materialize(docs.select("doc_id", sketch(_text()).alias("s")).select("doc_id", "s.*"), "sketches")
    known = prints.filter(F.col("doc_id").isNotNull())
    same = [F.first(c).alias(c) for c in ("size", *words, "bands")]
    nodes = materialize(known.groupBy("key").agg(F.min("doc_id").alias("node"), *same), "set-nodes")
    near = materialize(wide_links(nodes).distinct(), "candidates")
    grouped = components(near)
    members = grouped.unionByName(grouped.select(F.col("root").alias("node"), "root")).distinct()
    members = materialize(members.join(nodes.groupBy("node").agg(F.max("size").alias("size")), "node").select(F.col("root").alias("bucket"), "node", "size"), "candidate-groups")
    large = materialize(members.groupBy("bucket").agg(F.sum("size").alias("total")).filter(F.col("total") > GROUP_SHINGLES).select("bucket"), "large-groups")
    cells = members.join(large, "bucket", "left_anti").select(F.col("bucket").alias("shard"), "node")
    if not large.isEmpty():
        ring = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-np.log(SIMILARITY))).cast("int")
        ringed = materialize(members.join(large, "bucket", "left_semi").select("bucket", ring.alias("ring"), "node", "size"), "size-rings")
        cells = cells.unionByName(_cells(ringed, F.col("size"), GROUP_SHINGLES, 1).select("shard", "node"))
    texts = docs.select(F.col("doc_id").alias("node"), _text().alias("text")).join(cells, "node").select("shard", "node", "text")
    found = texts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_groups, "a long, b long")
    # a document with several texts (a repeated id) links their sets
    several = known.join(nodes.select("key", "node"), "key").filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    several = several.join(nodes.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    linked = components(materialize(found.unionByName(several).distinct(), "set-links"))
    named = nodes.join(linked, "node", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    joined = prints.select("doc_id", "key").join(named, "key", "left")
    return joined.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: one of each component, that of the smallest
    doc_id; rows without an id stay.  Components are those of ``similar_documents``."""
    found = materialize(similar_documents(docs), "similar-documents")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    # rows repeated under the kept id: the one whose columns' hash is the least
    again = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return kept
    again = materialize(again.select(F.col("doc_id").alias("__again")), "repeated")
    alone = kept.join(again, kept["doc_id"] == again["__again"], "left_anti")
    several = kept.join(again, kept["doc_id"] == again["__again"], "left_semi")
    first = F.min_by(F.struct(*several.columns), F.xxhash64(*several.columns))
    return alone.unionByName(several.groupBy("doc_id").agg(first.alias("__row")).select("__row.*"))
