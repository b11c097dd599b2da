"""Byte-level BPE encoding and decoding.

A text is cut by a pattern into pieces; a piece starts as its single bytes,
and a fold merges, one at a time and leftmost first, the neighbours whose
joined bytes have the lowest rank, until no neighbours join to a known token.
Decoding joins the identifiers' binary pieces.

There are two forms with equal results.  ``Codec`` cuts blocks of texts by numpy
passes, looks all their pieces up at once in a bounded memory, and folds each
new piece in a Python worker; ``encode``, the query and the pipeline use it.
``encode_native`` does the same with Spark's higher-order functions and a
literal rank map (an array of small maps, found by a hash of the joined bytes),
after a literal dictionary of the ``DICTIONARY`` most frequent pieces; it takes
several times the time that the README's limits allow on texts with many rare
words, since such words are folded where they stand.  Neither shuffles texts.

Pieces of over ``LONG_PIECE`` bytes, for which the fold's quadratic cost tells,
are merged by the same rule with a heap.

Defined results: a null text counts as empty, and encodes to no identifiers;
repeated rows get equal results, and an empty table none; a very long text is
encoded in blocks that end before white space, with the same result; text that
looks like a special token is ordinary text; ill-formed UTF-8 counts as U+FFFD.
``encode`` keeps the rows' columns but replaces one that has its ``name``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import pieces
from lodestrata.llm.common import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
DICTIONARY = 131_072
BUCKETS = 65_536
LONG_PIECE = 192

_PIECE = regex.compile(public_tokenizers.PATTERN)


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens; it lies with the library on every machine."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges by a fold over the byte parts of one piece."""
    if (rank := ranks.get(piece)) is not None:
        return [rank]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    known = ranks.get
    pairs = [known(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = known(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = known(parts[at - 1] + parts[at])


def merge_long(piece: bytes, path: str) -> list[int]:
    """The same merges with a heap of neighbours, for long pieces."""
    ranks, n = read_ranks(path), len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:k])) is not None:
            heapq.heappush(heap, (r, h, i, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def cut(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces start that the pattern makes of texts that lie one after another from
    ``begins``; pieces leave nothing out.  ASCII, Latin-1 letters and common punctuation are cut
    by kinds of bytes, a text with any other character by the pattern itself."""
    n, kind = len(data), pieces.kinds(data)
    start, fresh = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    start[begins] = fresh[begins] = True
    fresh[n] = True
    space = kind == pieces.SPACE
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    change = change[~fresh[change]]
    into = change[space[change]]
    out_of = change[space[change - 1]]
    start[change] = True
    start[out_of] = data[out_of - 1] != 32  # one space goes with what follows it
    start[out_of - 1] = True
    start[into] = True
    # 's 't 'm 'd 're 've 'll at the start of a piece
    mark = np.flatnonzero(start[:-1] & np.append(data == 39, False)[:n])
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == pieces.LETTER) & ~fresh[mark + 1]]
    if len(mark):
        a = data[mark + 1]
        b = np.where(fresh[np.minimum(mark + 2, n)], 0, data[np.minimum(mark + 2, n - 1)])
        size = np.where(np.isin(a, (100, 109, 115, 116)), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        start[mark + 1 + size] = True
    foreign = np.flatnonzero(kind == pieces.FOREIGN)
    if len(foreign):
        ends = np.append(begins[1:], n)
        for i in np.unique(np.searchsorted(begins, foreign, side="right") - 1).tolist():
            a, b = int(begins[i]), int(ends[i])
            size = [len(p.encode()) for p in _PIECE.findall(data[a:b].tobytes().decode())]
            start[a:b] = False
            start[a + np.cumsum([0, *size[:-1]])] = True
    return np.flatnonzero(start[:n])


class Codec:
    """Encodes and decodes texts; remembers the pieces that it has folded."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.path, self.memo = path, pieces.PieceMemo(self.learn, [], pieces.MEMO)
        self.tokens = pieces.Arena(tokens)
        self.digits = pieces.Arena([b"%d " % i for i in range(len(tokens))])

    def learn(self, words: list[bytes], _: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        ranks = read_ranks(self.path)
        found = [merge_short(w, ranks) if len(w) <= LONG_PIECE else merge_long(w, self.path) for w in words]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, sizes) of the texts of a string array; null is empty."""
        data, offsets = pieces.columns(texts)
        ids, ends_at, total = [np.zeros(0, "<u4")], [], 0
        for block, begins, stops in pieces.blocks(data, offsets, pieces.BLOCK):
            starts, reach = np.zeros(0, np.int64), np.zeros(1, np.int64)
            if len(block):
                starts = cut(block, begins)
                low = np.zeros(len(block) + 24, np.uint8)
                low[: len(block)] = block
                own, size = self.memo.gather(self.memo.look_up(low, starts, np.append(starts[1:], len(block)), np.zeros(len(starts), bool)))
                ids.append(own)
                reach = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            ends_at += (total + reach[np.searchsorted(starts, stops)]).tolist()
            total += int(reach[-1])
        return np.concatenate(ids), np.diff(np.array(ends_at, np.int64), prepend=0)

    def digested(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """(sizes, hashes of the identifiers as decimals, hashes of the decoded bytes) of texts."""
        ids, sizes = self.encode(texts)
        ends = np.cumsum(sizes)
        out: tuple[list[str], list[str]] = ([], [])
        for arena, hashes, less in ((self.digits, out[0], 1), (self.tokens, out[1], 0)):
            if len(ids) <= pieces.BLOCK * 2:
                all_bytes = arena.gather(ids).data
                reach = np.concatenate([[0], np.cumsum(arena.sizes[ids], dtype=np.int64)])[np.concatenate([[0], ends])].tolist()
                hashes += [hashlib.sha256(all_bytes[a : max(a, b - less)]).hexdigest() for a, b in zip(reach, reach[1:], strict=False)]
                continue
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                digest = hashlib.sha256()
                for at in range(a, b, pieces.BLOCK):
                    some = arena.gather(ids[at : min(b, at + pieces.BLOCK)])
                    digest.update(some[: len(some) - less * (at + pieces.BLOCK >= b)].data)
                hashes.append(digest.hexdigest())
        return sizes, *out


@lru_cache(1)
def _codec(path: str) -> Codec:
    """A worker's own, for all its tasks."""
    return Codec(path)


def _text() -> Column:
    return F.make_valid_utf8(F.col("text"))


def encode(docs: DataFrame, path: str | None = None, name: str = "ids") -> DataFrame:
    """The rows of ``docs`` with a column ``name``, which takes the place of one so named."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        codec, ids, sizes = _codec(path), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for some in pieces.slices(texts):
            own, size = codec.encode(some)
            ids.append(own.astype(np.int32))
            sizes.append(size)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))

    return docs.withColumn(name, ids_of(_text()))


def decoder(path: str | None = None):
    """A column function: a list of identifiers -> bytes; null for null."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        tokens = _codec(path).tokens
        return pa.array([tokens.gather(x.values.to_numpy()).tobytes() if x.is_valid else None for x in lists], pa.binary())

    return decoded


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: identifiers and decoded
    bytes stay in the worker that makes them."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        codec, n, listed, decoded = _codec(path), [], [], []
        for some in pieces.slices(texts):
            sizes, a, b = codec.digested(some)
            n += sizes.tolist()
            listed += a
            decoded += b
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(_text()).alias("d")).select("doc_id", "d.*")


def _bucketed(entries: dict[str, object], buckets: int) -> str:
    """JSON of small maps, each at the place that the engine's hash gives its keys."""
    out: list[dict] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        signed = (xxhash.xxh64_intdigest(key.encode(), 42) ^ 1 << 63) - (1 << 63)
        out[signed % buckets][key] = value
    return json.dumps(out, separators=(",", ":"))


def _found(table: Column, key: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), key)


def rank_map(path: str) -> Column:
    """The literal rank map; a token's bytes stand as Latin-1 characters."""
    return F.from_json(F.lit(_bucketed({t.decode("latin-1"): r for t, r in read_ranks(path).items()}, BUCKETS)), "array<map<string,int>>")


def token_list(path: str) -> Column:
    """The literal list of tokens by rank, as Latin-1 characters."""
    ranks = read_ranks(path)
    tokens = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.decode("latin-1")
    return F.from_json(F.lit(json.dumps(tokens)), "array<string>")


def pieces_of(text: Column) -> Column:
    """The matches of the pattern; (?U) gives white space its Unicode meaning."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))


def fold(piece: Column, ranks: Column) -> Column:
    """Identifiers of one piece, by ranked merges over its bytes."""
    start = F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), "")

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda right, i: _found(ranks, F.concat(F.get(parts, i), right), BUCKETS))

        def merged(pairs: Column) -> Column:
            def joined(at: Column) -> Column:
                new = F.concat(F.get(parts, at - 1), F.get(parts, at))
                return F.concat(F.slice(parts, 1, at - 1), F.array(new), F.slice(parts, at + 2, F.size(parts)))

            return _let(F.array_position(pairs, F.array_min(pairs)).cast("int"), lambda at: F.when(at > 0, joined(at)).otherwise(parts))

        return _let(pairs, merged)

    parts = F.aggregate(F.sequence(F.lit(1), F.size(start)), start, step)
    return F.transform(parts, lambda p: _found(ranks, p, BUCKETS))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dictionary(docs: DataFrame, ranks: Column, size: int = DICTIONARY) -> Column:
    """A literal map from the most frequent pieces of ``docs`` to their identifiers."""
    counts = docs.select(F.explode(pieces_of(F.col("text"))).alias("piece")).filter(F.octet_length("piece") <= LONG_PIECE)
    counts = counts.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = materialize(counts.orderBy(F.desc("n"), "piece").limit(size).select("piece"), "frequent-pieces")
    folded = top.repartition(64).select("piece", fold(F.col("piece"), ranks).alias("ids"))
    held = {r["piece"]: r["ids"] for r in folded.collect()}
    return F.from_json(F.lit(_bucketed(held, BUCKETS)), "array<map<string,array<int>>>")


def encode_native(docs: DataFrame, path: str | None = None, size: int = DICTIONARY) -> DataFrame:
    """The rows of ``docs`` with a column ``ids``."""
    path = path or public_tokenizers.path(VOCABULARY)
    ranks = rank_map(path)
    held = dictionary(docs, ranks, size)

    @F.arrow_udf("array<array<int>>")
    def merge(lists: pa.Array) -> pa.Array:
        return pa.array([[merge_long(p.encode(), path) for p in x] for x in lists.to_pylist()], pa.list_(pa.list_(pa.int32())))

    cut = docs.withColumn("__pieces", pieces_of(F.col("text")))
    cut = cut.withColumn("__long", F.array_distinct(F.filter("__pieces", lambda p: F.octet_length(p) > LONG_PIECE)))
    cut = cut.withColumn("__long", F.map_from_arrays("__long", merge(F.col("__long"))))

    def ids_of(piece: Column) -> Column:
        rest = F.when(F.octet_length(piece) > LONG_PIECE, F.try_element_at(F.col("__long"), piece)).otherwise(fold(piece, ranks))
        return F.coalesce(_found(held, piece, BUCKETS), rest)

    return cut.withColumn("ids", F.flatten(F.transform("__pieces", ids_of))).drop("__pieces", "__long")


def decode_native(ids: Column, path: str | None = None) -> Column:
    """The bytes of a list of identifiers."""
    tokens = token_list(path or public_tokenizers.path(VOCABULARY))
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""), "ISO-8859-1")
