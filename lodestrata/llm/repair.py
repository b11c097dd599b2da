"""Token output with Re-Pair grammar compression.

Documents are dealt to shards in ascending order of doc_id, tokenised, and
each shard's identifiers are written as one file: Re-Pair repeatedly replaces
frequent neighbouring pairs by new symbols (nonterminals) until no pair pays
for its rule, that is, until the symbols that it would save take no more bytes
than the rule.  A file holds the rules, each rule's expansion length, the
remaining symbols and, for each document, its place, so that one document can
be decoded without the others.  Pairs never reach across documents, since the
end identifier takes no part in any.

A round replaces many pairs at once, and where occurrences overlap the more
frequent pair.  Rounds are numpy passes over the places that can still matter.

File format, little-endian.  Header: magic ``LSRP``, version, number of
terminals, rules, symbols and documents as unsigned 32-bit integers.  Then the
terminals' identifiers as unsigned 32-bit integers (symbols count the
identifiers that the shard uses, then its rules), the rules (left, right), the
expansion lengths as unsigned 32-bit integers, the documents' first symbols
and first identifiers as unsigned 64-bit integers (one more than documents),
and the symbols.  Rules and symbols are unsigned integers of 16 bits, or of 32
where terminals and rules are more than 65,536.

Defined results: a null text counts as empty; an empty text has the end
identifier alone, and an empty table no rows; a very long text is encoded in
blocks that end at white space, and is one document of its shard; strings that
look like special tokens are what the library makes of them; ill-formed UTF-8
counts as U+FFFD.  Null doc_ids come first; rows of one doc_id are ordered by
a hash of the text, and repeated rows stay repeated.  Other columns than
doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import pieces
from lodestrata.session import shared_path

VOCABULARY, END = "word_bpe_49k.json", 1
MAGIC, VERSION = b"LSRP", 2
#: Identifiers of a shard, at least, unless the partition ends.
SHARD_TOKENS = 1 << 20
#: A round takes pairs of at least this part of the greatest count.
FALL = 64
#: Distinct pieces of text that a worker remembers.
MEMO = 1 << 21
#: A private character, and how many chunks go to the library with it between them.
MARK, MARKED = "\ue000", 1_000


# ---------------------------------------------------------------- tokenising


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _model(path: str):
    """The library's tokenizer without its normaliser and pattern, for pieces that are already
    normalised and cut (one to a line), and which of its identifiers end a piece."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.normalizer = normalizers.Sequence([])
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(found.get_vocab_size(), bool)
    ends[[i for token, i in found.get_vocab().items() if token.endswith("</w>")]] = True
    return found, ends


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARKS = np.zeros(256, bool)
_MARKS[[*range(9), *range(14, 32), 127]] = True


def cut(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, raw): the pieces that the tokenizer's normaliser and pattern make of
    texts that lie one after another from ``begins``.  Chunks between white space that hold ASCII,
    Latin-1 letters and dashes, quotes and dots from U+2010 to U+2027 are lower-cased and cut
    here; a chunk with any other character, a control character or the beginning of a special
    token stays whole, with its case, and is marked raw.  24 zero bytes follow the bytes."""
    n, kind = len(data), pieces.kinds(data)
    kind[_MARKS[data]] = pieces.FOREIGN
    low = np.zeros(n + 24, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[:-1] == 0xC3) & (kind[1:] == pieces.LETTER)) + 1
    low[accented] += np.where(data[accented] <= 0x9E, 0x20, 0).astype(np.uint8)
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == pieces.DIGIT)
    first[begins] = True
    starts = np.flatnonzero(first)
    ends, own = np.append(starts[1:], n), kind[starts]
    keep = own != pieces.SPACE
    starts, ends, own = starts[keep], ends[keep], own[keep]
    if not len(starts):
        return low, starts, ends, np.zeros(0, bool)
    fresh = np.empty(len(starts), bool)  # the piece begins a chunk
    fresh[0] = True
    fresh[1:] = starts[1:] != ends[:-1]
    at = np.searchsorted(starts, begins)
    at = at[at < len(starts)]
    fresh[at[np.isin(starts[at], begins)]] = True
    odd = own == pieces.FOREIGN
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(special):
        odd[np.searchsorted(starts, special, side="right") - 1] = True
    raw = np.zeros(len(starts), bool)
    if odd.any():
        chunk = np.cumsum(fresh) - 1
        bad = np.zeros(chunk[-1] + 1, bool)
        bad[chunk[odd]] = True
        head = np.flatnonzero(fresh)
        last = np.append(head[1:], len(starts)) - 1
        stop = ends[last]
        whole = bad[chunk]
        keep = ~whole | fresh
        ends = np.where(whole, stop[chunk], ends)[keep]
        starts, raw, own = starts[keep], whole[keep], own[keep]
        at = pieces.ragged(starts[raw], (ends - starts)[raw])
        low[at] = data[at]
        fresh = fresh[keep]
    # 's 't 'm 'd 're 've 'll take their letters from the piece after
    mark = np.flatnonzero((ends - starts == 1) & (low[starts] == 39) & ~raw)
    mark = mark[mark + 1 < len(starts)]
    mark = mark[~fresh[mark + 1] & (own[mark + 1] == pieces.LETTER)]
    if len(mark):
        size = contracted(low, ends[mark], ends[mark + 1] - starts[mark + 1])
        ends[mark] += size
        starts[mark + 1] += size
        keep = ends > starts
        starts, ends, raw = starts[keep], ends[keep], raw[keep]
    return low, starts, ends, raw


def contracted(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of the letters at ``at`` belong to an apostrophe before them: s t m d re ve ll."""
    a, b = data[at], np.where(length > 1, data[np.minimum(at + 1, len(data) - 1)], 0)
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    return np.where(np.isin(a, (100, 109, 115, 116)), 1, np.where(two, 2, 0))


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once while it is remembered."""

    def __init__(self, path: str):
        self.path = path
        self.mark = self.library([MARK])[0]
        self.memo = pieces.PieceMemo(self.learn, [END], MEMO)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes], raw: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of pieces, one after another, and how many each has.  Normalised ones
        need the library's model only, raw chunks all of it."""
        if any(raw):
            found = self.raw_chunks(words)
            return np.concatenate(found), np.array([len(x) for x in found])
        model, is_end = _model(self.path)
        parts, sizes = [], []
        for at in range(0, len(words), MARKED):
            some = words[at : at + MARKED]
            ids = np.array(model.encode_batch_fast([b"\n".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            size = np.diff(np.flatnonzero(is_end[ids]), prepend=-1)
            if len(size) != len(some) or size.sum() != len(ids):
                each = self.library([w.decode() for w in some])
                ids, size = np.concatenate(each), np.array([len(x) for x in each])
            parts.append(ids)
            sizes.append(size)
        return np.concatenate(parts), np.concatenate(sizes)

    def raw_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Identifiers of whole chunks; many go to the library at a time, a mark between them."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        parts: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, c in enumerate(texts) if MARK not in c]
        for at in range(0, len(plain), MARKED):
            some = plain[at : at + MARKED]
            ids, k = self.library([f" {MARK} ".join(texts[i] for i in some)])[0], len(self.mark)
            hit = np.ones(max(0, len(ids) - k + 1), bool)
            for i, x in enumerate(self.mark.tolist()):
                hit &= ids[i : len(hit) + i] == x
            cuts = np.flatnonzero(hit)
            if len(cuts) == len(some) - 1:
                for i, a, b in zip(some, [0, *(cuts + k).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    parts[i] = ids[a:b]
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, x in zip(rest, self.library([texts[i] for i in rest]), strict=True):
            parts[i] = x
        return parts

    def numbers(self, block: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a block's pieces, and where they start."""
        low, starts, ends, raw = cut(block, begins)
        out = np.empty(len(starts), np.int64)
        while True:
            before = self.memo.cleared
            for chosen in (~raw, raw):
                if chosen.any():
                    out[chosen] = self.memo.look_up(low, starts[chosen], ends[chosen], raw[chosen])
            if self.memo.cleared == before:  # else the first numbers are of before
                return out, starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, sizes) of the texts of a string array, each with the end identifier;
        null is empty."""
        data, offsets = pieces.columns(texts)
        ids, ends_at, total = [np.zeros(0, "<u4")], [], 0
        for block, begins, stops in pieces.blocks(data, offsets, pieces.BLOCK):
            if len(block):
                numbers, starts = self.numbers(block, begins)
                places = np.searchsorted(starts, stops)
            else:
                numbers, places = np.zeros(0, np.int64), np.zeros(len(stops), np.int64)
            own, size = self.memo.gather(np.insert(numbers, places, 0))
            ids.append(own)
            reach = total + np.cumsum(size, dtype=np.int64)
            ends_at += reach[places + np.arange(len(places))].tolist()
            total += len(own)
        return np.concatenate(ids), np.diff(np.array(ends_at, np.int64), prepend=0)


@lru_cache(1)
def _encoder(path: str) -> PieceEncoder:
    """A worker's own, for all its tasks."""
    return PieceEncoder(path)


# ------------------------------------------------------------------- grammar


def _turns(same: np.ndarray) -> np.ndarray:
    """For rows that are marked where they overlap the row before: whether it is one to take,
    every other one of a run from the left."""
    turn = np.arange(len(same), dtype=np.int32)
    return (turn - np.maximum.accumulate(np.where(same, 0, turn))) % 2 == 0


def _grouped(left: np.ndarray, right: np.ndarray, place: np.ndarray, after: np.ndarray, pays: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): the places of pairs that occur ``pays`` times or more, pair after pair,
    and how many there are of each.  Of a symbol beside itself, occurrences that overlap count
    as the number of them that can be replaced."""
    symbol, where = int(max(left.max(), right.max())).bit_length(), int(place[-1]).bit_length()
    if 2 * symbol + where <= 64:
        packed = left.astype(np.uint64) << np.uint64(symbol + where) | right.astype(np.uint64) << np.uint64(where) | place.astype(np.uint64)
        packed.sort()
        place = (packed & np.uint64((1 << where) - 1)).astype(np.int32)
        code = packed >> np.uint64(where)
        twin = code >> np.uint64(symbol) == code & np.uint64((1 << symbol) - 1)
    else:  # a shard of one very long text
        code = left.astype(np.uint64) << np.uint64(32) | right
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order]
        twin = code >> np.uint64(32) == code & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    count = np.diff(np.append(first, len(code)))
    real = count.copy()
    if twin.any():
        at = np.flatnonzero(twin)
        same = np.concatenate([[False], (code[at[1:]] == code[at[:-1]]) & (after[place[at[:-1]]] == place[at[1:]])])
        group = np.searchsorted(first, at[_turns(same)], side="right") - 1
        real = np.where(twin[first], np.bincount(group, minlength=len(first)), count)
    often = real >= pays
    return place[np.repeat(often, count)], count[often]


def compress(ids: np.ndarray, terminals: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): rule i is the pair that symbol ``terminals + i`` stands for.

    Each round replaces the pairs of at least a ``FALL``-th of the greatest count, the more
    frequent one where occurrences overlap, until no pair pays for its rule.  Symbols are a
    linked list; after the first, a round looks only at places whose pair was frequent and
    stayed, or has changed, since no other pair can have become frequent.  The round with the
    smallest file is returned, since symbols double where they outgrow 16 bits."""
    n = len(ids)
    sym = ids.astype(np.uint32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive, mark = np.ones(n, bool), np.zeros(n, bool)
    rules: list[np.ndarray] = []
    n_rules, n_symbols, best = 0, n, None
    place = np.arange(n, dtype=np.int32)
    while True:
        width = 2 if terminals + n_rules <= 1 << 16 else 4
        cost = width * n_symbols + (2 * width + 4) * n_rules
        if best is None or cost < best[0]:
            best = cost, n_rules, sym.copy() if width == 4 else None, alive.copy() if width == 4 else None
        elif width == 4 and best[2] is None:
            break  # symbols have doubled, and a file of 16 bits is smaller
        pays = (2 * width + 4) // width + 1
        place = place[(after[place] < n) & (sym[place] != end)]
        right = sym[after[place]]
        place, right = place[right != end], right[right != end]
        if not len(place):
            break
        place, count = _grouped(sym[place], right, place, after, pays)
        if not len(place):
            break
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        chosen = count >= count.max() / FALL
        # places in order, with their pairs; the more frequent a pair, the higher its number
        packed = place[np.repeat(chosen, count)].astype(np.uint64) << np.uint64(32) | np.repeat(rank[chosen], count[chosen]).astype(np.uint64)
        packed.sort()
        at, pair = (packed >> np.uint64(32)).astype(np.int32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int32)
        beside = after[at[:-1]] == at[1:]
        same = np.concatenate([[False], beside & (pair[1:] == pair[:-1])])
        take = same | np.concatenate([[True], ~beside | (pair[1:] > pair[:-1])])
        take &= np.concatenate([~beside | (pair[:-1] >= pair[1:]), [True]])
        if same.any():  # of a run of one pair, every other one
            take &= _turns(same)
        at, pair = at[take], pair[take]
        made = np.bincount(pair, minlength=len(count)) >= pays
        keep = made[pair]
        at, pair = at[keep], pair[keep]
        names = np.flatnonzero(made)
        number, sample = np.zeros(len(count), np.uint32), np.zeros(len(count), np.int32)
        number[names] = terminals + n_rules + np.arange(len(names))
        sample[pair] = at
        gone = after[at]
        rules.append(np.stack([sym[sample[names]], sym[after[sample[names]]]], axis=1))
        sym[at] = number[pair]
        alive[gone] = False
        then = after[gone]
        after[at] = then
        before[then[then < n]] = at[then < n]
        n_rules, n_symbols = n_rules + len(names), n_symbols - len(at)
        mark[:] = False
        mark[place] = True
        mark[at] = True
        mark[before[at][before[at] >= 0]] = True
        place = np.flatnonzero(mark & alive).astype(np.int32)
    if best[2] is None and best[1] < n_rules:  # the rounds in wide symbols are undone
        return _undone(sym[alive], np.concatenate(rules), terminals, best[1])
    made = np.concatenate(rules)[: best[1]] if rules else np.zeros((0, 2), np.uint32)
    symbols = sym[alive] if best[2] is None else best[2][best[3]]
    return symbols, made, lengths(made, terminals)


def _undone(symbols: np.ndarray, rules: np.ndarray, terminals: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A grammar with its first ``n`` rules only."""
    while (symbols >= terminals + n).any():
        late = symbols >= terminals + n
        size = 1 + late
        out = np.repeat(symbols, size)
        at = np.cumsum(size)[late] - 2
        out[at], out[at + 1] = rules[symbols[late].astype(np.int64) - terminals].T
        symbols = out
    return symbols, rules[:n], lengths(rules[:n], terminals)


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Expansion length of each rule; a rule refers to earlier ones only."""
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((1 if a < terminals else size[a - terminals]) + (1 if b < terminals else size[b - terminals]))
    return np.array(size, np.uint32)


def expansions(rules: np.ndarray, terminals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(identifiers, starts, sizes): what each symbol stands for, one after another."""
    whole = terminals.astype("<u4").tobytes()
    out = [whole[i : i + 4] for i in range(0, len(whole), 4)]
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    sizes = np.array([len(x) // 4 for x in out], np.int64)
    return np.frombuffer(b"".join(out), "<u4"), np.cumsum(sizes) - sizes, sizes


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The identifiers that symbols stand for."""
    ids, starts, sizes = table
    return ids[pieces.ragged(starts[symbols], sizes[symbols])]


def pack(ids: np.ndarray, sizes: np.ndarray, end: int = END) -> bytes:
    """A file of one shard: its identifiers, and how many each document has, end included."""
    used = np.zeros(int(ids.max()) + 1, bool)
    used[ids] = True
    terminals = np.flatnonzero(used)
    own = np.cumsum(used, dtype=np.uint32) - 1
    symbols, rules, size = compress(own[ids], len(terminals), int(own[end]) if end < len(used) and used[end] else 0xFFFFFFFF)
    n = np.ones(len(symbols), np.int64)
    is_rule = symbols >= len(terminals)
    n[is_rule] = size[symbols[is_rule].astype(np.int64) - len(terminals)]
    tokens = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    places = np.searchsorted(np.concatenate([[0], np.cumsum(n)]), tokens.astype(np.int64)).astype("<u8")
    kind = "<u2" if len(terminals) + len(rules) <= 1 << 16 else "<u4"
    head = struct.pack("<4s5I", MAGIC, VERSION, len(terminals), len(rules), len(symbols), len(sizes))
    return b"".join([head, terminals.astype("<u4").tobytes(), rules.astype(kind).tobytes(), size.astype("<u4").tobytes(), places.tobytes(), tokens.tobytes(), symbols.astype(kind).tobytes()])


class TokenFile:
    """Reads a file, whole or one document at a time."""

    def __init__(self, data: bytes):
        magic, version, n_terminals, n_rules, n_symbols, self.n_docs = struct.unpack_from("<4s5I", data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = 24

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        kind = "<u2" if n_terminals + n_rules <= 1 << 16 else "<u4"
        self.terminals, self.rules, self.size = read("<u4", n_terminals), read(kind, 2 * n_rules).reshape(-1, 2), read("<u4", n_rules)
        self.places, self.tokens = read("<u8", self.n_docs + 1), read("<u8", self.n_docs + 1)
        self.symbols = read(kind, n_symbols)
        self.table = expansions(self.rules, self.terminals)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.table)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[int(self.places[i]) : int(self.places[i + 1])], self.table)


# ---------------------------------------------------------------- the tables


def write(docs: DataFrame, where: str, path: str | None = None) -> None:
    """Write the files of ``docs`` to ``where``, a folder in a store that all machines share:
    one row for each, with its partition and number therein, its documents' ids and its bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            blob = pack(np.concatenate(held), np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_tokens": pa.array([total], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "file": pa.array([blob], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, size = encoder.encode(some.column(1))
                doc_ids += some.column(0).to_pylist()
                held.append(ids)
                sizes.append(size)
                total += len(ids)
                if total >= SHARD_TOKENS:
                    yield flush()
                    doc_ids, held, sizes, total = [], [], [], 0
                    seq += 1
        if doc_ids:
            yield flush()

    placed.mapInArrow(shards, "part int, seq int, n_tokens long, doc_ids array<long>, file binary").write.parquet(where)


def read(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its decoded identifiers."""
    files = spark.read.parquet(where)
    # where each file starts: one row for each file, without its contents
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    order = Window.partitionBy("part").orderBy("seq")
    starts = files.select("part", "seq", "n_tokens").withColumn("own", F.sum("n_tokens").over(order) - F.col("n_tokens")).join(before, "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("own")).alias("base"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, doc_ids, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "file")), strict=True):
                own = TokenFile(data)
                ids, at = own.ids(), own.tokens.astype(np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "at": pa.array(at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    # few files to a batch, since each is some MB
    docs = files.select("part", "seq", "doc_ids", "file").mapInArrow(decoded, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    where = shared_path(docs.sparkSession, "token-files")
    write(docs, where, path)
    return read(docs.sparkSession, where)
