"""Phrase collocations by Apriori's level-wise passes.

A phrase is a run of words within a piece of a text, counted for each language
with all its occurrences, overlaps included.  A phrase of k words can be
frequent only if both its phrases of k-1 words are, so level k's pass looks only
at neighbouring places that hold a frequent phrase of k-1 words each.

The frequent phrases of a level are broadcast and numbered while they are within
``BROADCAST_BYTES``.  Texts are written once as runs of their frequent words'
numbers; a level pairs neighbouring numbers, counts the pairs, and replaces each
place's number by that of the frequent pair that begins there.  A pair of numbers
is one phrase exactly, and runs without a neighbour left go, so that what is read
shrinks from level to level.  Tasks count in part, Spark adds up.

From the first level whose table is larger than that, phrases are counted as
such, and what tasks get is a bit table of fixed size, in which a phrase that
isn't frequent may pass.  That costs time but no exactness: a passed phrase is
counted like any other, and falls to the threshold.

All cuts of a candidate are then looked up in the level tables, with exact
decimal arithmetic (right while 1000 times a count times the number of words is
below 10^38).

Defined results: a null text is empty, a null language ``und``, together with a
language of that name.  Repeated rows count each.  Ties go to the smaller cut,
and in reports to the more frequent and then the first phrase in byte order.
Very long texts are taken whole, a megabyte of pieces at a time.  Ill-formed
UTF-8 counts as U+FFFD.  An empty table has no phrases.  Only text and lang are
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded, materialize

LONGEST, LEAST, TOP = 5, 100, 2000
BROADCAST_BYTES = 64 << 20
#: Bits of the table that stands for a level of more bytes than that.
BITS = 1 << 27
#: Distinct phrases that a task counts before it hands them on, bytes of text cut at a time,
#: numbers that a row of runs has and that are paired at a time, and texts of a batch made canonical at a time.
HELD, SEGMENT, RUN, PAIRED, TEXTS = 100_000, 1 << 20, 1 << 17, 1 << 20, 128
#: Marks that end a piece become line ends, tabs spaces, A-Z a-z (fixed values).
CANONICAL = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + bytes(range(65, 91)), b"\n" * 9 + b" " + bytes(range(97, 123)))
COUNTED = "lang string, phrase binary, n long"


class Tally:
    """Counts by language and phrase, handed on as batches when there are many."""

    def __init__(self):
        self.by: dict[str, Counter] = {}

    def of(self, lang: str) -> Counter:
        return self.by.setdefault(lang, Counter())

    def full(self) -> bool:
        return sum(map(len, self.by.values())) >= HELD

    def batches(self) -> Iterator[pa.RecordBatch]:
        for lang, counts in self.by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["lang", "phrase", "n"])
        self.by = {}


def _tallied(count: Callable[[Counter, bytes, int, str], None]):
    """Batches (lang, body, n) to batches of ``count``'s counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for lang, body, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for part in segments(body.as_py()):
                    count(tally.of(lang), part, n, lang)
                    if tally.full():
                        yield from tally.batches()
        yield from tally.batches()

    return run


def segments(body: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """A canonical text in parts of about ``size`` bytes, cut between pieces."""
    at = 0
    while at < len(body):
        end = len(body) if len(body) - at <= size else body.find(b"\n", at + size)
        end = len(body) if end < 0 else end
        yield body[at:end]
        at = end + 1


def _add(counts: Counter, phrases, n: int) -> None:
    if n == 1:
        counts.update(phrases)
    else:
        for p in phrases:
            counts[p] += n


def _count_words(counts: Counter, body: bytes, n: int, _: str) -> None:
    """Words; the empty phrase stands for all of them."""
    words = body.split()
    _add(counts, words, n)
    counts[b""] += n * len(words)


class Frequent:
    """Which phrases a level's table holds; ``bits`` instead of ``phrases`` may say yes too often."""

    def __init__(self, phrases: dict[str, frozenset] | None, bits: np.ndarray | None):
        self.phrases, self.bits = phrases, bits

    def test(self, lang: str) -> Callable[[bytes], bool]:
        if self.phrases is not None:
            return self.phrases.get(lang, frozenset()).__contains__
        head, bits = lang.encode() + b"\n", self.bits

        def maybe(phrase: bytes) -> bool:
            at = xxhash.xxh64_intdigest(head + phrase, 42) & (BITS - 1)
            return bool(int(bits[at >> 6]) >> (at & 63) & 1)

        return maybe


def frequent(level: DataFrame, most: int = BROADCAST_BYTES) -> Frequent:
    """A level's table (lang, phrase, f) in the form that tasks get."""
    if _fits(level, most):
        found: dict[str, list[bytes]] = {}
        table = level.select("lang", F.col("phrase").cast("binary").alias("phrase")).toArrow()
        for lang, phrase in zip(table["lang"].to_pylist(), table["phrase"].to_pylist()):
            found.setdefault(lang, []).append(phrase)
        return Frequent({lang: frozenset(p) for lang, p in found.items()}, None)
    at = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase")).bitwiseAND(F.lit(BITS - 1))
    slots = level.select(at.alias("at")).selectExpr("shiftright(at, 6) slot", "shiftleft(1L, cast(at & 63 as int)) bit")
    table = slots.groupBy("slot").agg(F.bit_or("bit").alias("word")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[table["slot"].to_numpy()] = table["word"].to_numpy().view(np.uint64)
    return Frequent(None, bits)


def _cut_runs(known, k: int) -> Callable[[Counter, bytes, int, str], None]:
    """Runs of at least k words of which every k-1 in a row are a frequent phrase."""

    def cut(counts: Counter, body: bytes, n: int, lang: str) -> None:
        test, runs = known.value.test(lang), []
        for piece in body.split(b"\n"):
            words = piece.split()
            if len(words) < k:
                continue
            good = [*map(test, words if k == 2 else map(b" ".join, zip(*(words[i:] for i in range(k - 1)))))]
            if all(good):
                runs.append(b" ".join(words))
                continue
            start = 0
            for i, g in enumerate([*good, False]):
                if not g:
                    if i - start >= 2:  # words start to i + k - 3
                        runs.append(b" ".join(words[start : i + k - 2]))
                    start = i + 1
        _add(counts, runs, n)

    return cut


def _count_phrases(k: int) -> Callable[[Counter, bytes, int, str], None]:
    def count(counts: Counter, run: bytes, n: int, _: str) -> None:
        words = run.split()
        _add(counts, map(b" ".join, zip(*(words[i:] for i in range(k)))), n)

    return count


def _summed(counted: DataFrame, least: int) -> DataFrame:
    """A level's table; the empty phrase stays, as it is the number of words."""
    total = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return total.filter((F.col("f") >= least) | (F.octet_length("phrase") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _numbered(a: np.ndarray) -> np.ndarray:
    """Numbers (0: none) without those that have no neighbour, and with one 0 between runs."""
    there = a != 0
    both = there[:-1] & there[1:]
    keep = np.zeros(len(a), bool)
    keep[:-1] |= both
    keep[1:] |= both
    ends = np.zeros(len(a), bool)
    ends[1:] = keep[:-1] & ~keep[1:]
    return np.where(keep, a, 0)[keep | ends]


def _blobs(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of numbers as rows of some ``RUN`` numbers each; each part ends with a 0."""
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= RUN:
            yield _blob(held)
            held = []
    if held:
        yield _blob(held)


def _blob(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).astype("<i4").tobytes()], pa.binary())], ["runs"])


def _numbers_of(known):
    """Batches (lang, body, n) of canonical texts to runs of their frequent words' numbers."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = known.value.get(lang)
                for part in segments(body.as_py()) if number else ():
                    words = filter(None, part.replace(b"\n", b" \n ").split(b" "))  # a line end has no number
                    a = _numbered(np.fromiter(map(number.get, words, repeat(0)), np.int32))
                    if len(a):
                        yield np.append(a, np.int32(0))

    return lambda batches: _blobs(parts(batches))


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column(0):
            yield np.frombuffer(row.as_py(), "<i4")


def _keys(a: np.ndarray) -> np.ndarray:
    """The pair at each place but the last; 0 where there is none."""
    key = a[:-1].astype(np.int64) << 32 | a[1:]
    return np.where((a[:-1] != 0) & (a[1:] != 0), key, 0)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of numbers to counts (key, n) of their pairs."""
    held, full = np.empty(PAIRED, np.int64), 0

    def counted() -> pa.RecordBatch:
        keys = held[:full]
        keys.sort()
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(keys[start]), pa.array(np.diff(start, append=full))], ["key", "n"])

    for a in _arrays(batches):
        for at in range(0, len(a) - 1, RUN):
            key = _keys(a[at : at + RUN + 1])
            key = key[key != 0]
            while len(key):
                part, key = key[: PAIRED - full], key[PAIRED - full :]
                held[full : full + len(part)] = part
                full += len(part)
                if full == PAIRED:
                    yield counted()
                    full = 0
    if full:
        yield counted()


def _renumbered(known):
    """Runs of numbers to runs of the numbers of frequent pairs (sorted keys) that begin there."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        keys = known.value
        for a in _arrays(batches):
            key = _keys(a)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            b = _numbered(np.where(keys[at] == key, at + 1, 0).astype(np.int32))
            if len(b):
                yield np.append(b, np.int32(0))

    return lambda batches: _blobs(parts(batches))


def _number_words(known):
    """Batches (lang, phrase, f) of words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = [known.value[lang][w.encode()] for lang, w in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int32())], [*batch.schema.names, "number"])

    return run


def _number_keys(known):
    """Batches (lang, phrase, f, key) of phrases with their numbers, by the sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.searchsorted(known.value, batch["key"].to_numpy()) + 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("lang", "phrase", "f")), pa.array(number, pa.int32())], ["lang", "phrase", "f", "number"])

    return run


NUMBERED = "lang string, phrase string, f long, number int"


def _fits(level: DataFrame, most: int) -> bool:
    return (level.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 64)).first()[0] or 0) <= most


def _source(docs: DataFrame) -> DataFrame:
    valid = F.make_valid_utf8(F.coalesce("text", F.lit(""))).cast("binary")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), valid.alias("phrase"), F.lit(1).cast("long").alias("n"))


def _by_numbers(docs: DataFrame, words: DataFrame, longest: int, least: int, most: int) -> list[DataFrame]:
    """The levels after the first, up to the first whose table doesn't fit."""
    context = docs.sparkSession.sparkContext
    table, by = words.filter("phrase <> ''").toArrow().sort_by([("lang", "ascending"), ("phrase", "ascending")]), {}
    for number, (lang, word) in enumerate(zip(table["lang"].to_pylist(), table["phrase"].to_pylist()), 1):
        by.setdefault(lang, {})[word.encode()] = number
    known = context.broadcast(by)
    last = words.filter("phrase <> ''").mapInArrow(_number_words(known), NUMBERED)
    runs = materialize(_source(docs).mapInArrow(_canonical(_numbers_of(known)), "runs binary"), "runs-1")
    found: list[DataFrame] = []
    for k in range(2, longest + 1):
        counted = runs.mapInArrow(_count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        counted = materialize(counted, f"pairs-{k}")
        near = bounded(materialize(last, f"numbers-{k - 1}"), F.octet_length("phrase") + F.octet_length("lang"))
        first, second = near.select(F.col("number").alias("a"), "lang", F.col("phrase").alias("p")), near.select(F.col("number").alias("b"), F.substring_index("phrase", " ", -1).alias("w"))
        split = counted.select("key", "f", F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"))
        level = materialize(split.join(first, "a").join(second, "b").select("lang", F.concat_ws(" ", "p", "w").alias("phrase"), "f", "key"), f"phrases-{k}")
        found.append(level.select("lang", "phrase", "f"))
        if k == longest or not _fits(level, most):
            break
        keys = np.sort(counted.select("key").toArrow()["key"].to_numpy())
        if not len(keys):
            break
        known = context.broadcast(keys)
        last = level.mapInArrow(_number_keys(known), NUMBERED)
        runs = materialize(runs.mapInArrow(_renumbered(known), "runs binary"), f"runs-{k}")
    return found


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Tables (lang, phrase, f) of the frequent phrases of one word, of two, and so on; the
    first has each language's number of words at the empty phrase."""
    found = [materialize(_summed(_source(docs).mapInArrow(_canonical(_tallied(_count_words)), COUNTED), least), "phrases-1")]
    if _fits(found[0], most):
        found += _by_numbers(docs, found[0], longest, least, most)
    source, context, raw = _source(docs), docs.sparkSession.sparkContext, True
    for k in range(len(found) + 1, longest + 1):
        if found[-1].filter("phrase <> ''").isEmpty():
            break
        cut = _tallied(_cut_runs(context.broadcast(frequent(found[-1].filter("phrase <> ''"), most)), k))
        source, raw = materialize(source.mapInArrow(_canonical(cut) if raw else cut, COUNTED), f"runs-{k}"), False
        found.append(materialize(_summed(source.mapInArrow(_tallied(_count_phrases(k)), COUNTED), least), f"phrases-{k}"))
    return found


def _canonical(run):
    """The same, on raw texts."""

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), TEXTS):
                    part = batch.slice(at, TEXTS)
                    bodies = pa.array([b.as_py().translate(CANONICAL) for b in part.column(1)], pa.large_binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), bodies, part.column(2)], ["lang", "phrase", "n"])

        return run(plain())

    return canonical


def _joined(words: Column, at: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(at) if isinstance(at, int) else at, size), " ")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, phrase, size, a, cut, l, r, n, score, inside) of every candidate; inside: some
    longer candidate holds it and is as frequent."""
    tables = levels(docs, longest, least, most)
    known = tables[0]
    for table in tables[1:]:
        known = known.unionByName(table)
    size = F.octet_length("phrase") + F.octet_length("lang") + 8
    near = bounded(known, size)
    words = F.split("phrase", " ")
    cuts = known.filter("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", F.size("w").alias("size"), "cut", _joined(F.col("w"), 1, F.col("cut")).alias("left"), _joined(F.col("w"), F.col("cut") + 1, F.size("w")).alias("right"))
    cuts = cuts.join(near.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(near.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    numbers = tables[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(bounded(numbers, F.octet_length("lang")), "lang")
    score = F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # a phrase within a longer one that is as frequent is also within one of one word more
    within = known.filter("phrase like '% % %'").withColumn("w", words)
    within = within.select("lang", "f", F.explode(F.array(_joined(F.col("w"), 1, F.size("w") - 1), _joined(F.col("w"), 2, F.size("w")))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = best.join(within, ["lang", "phrase"], "left")
    return out.select("lang", "phrase", "size", "a", "b.cut", "b.l", "b.r", "n", "b.score", F.coalesce(F.col("longer") >= F.col("a"), F.lit(False)).alias("inside"))


def report(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first ``top`` candidates that aren't inside a longer one."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = phrases(docs, **options).filter("not inside").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The contract's rows in DuckDB's SQL, over ``documents``."""
    return rf"""
with t as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from t),
total as (select lang, sum(len(w)) n from p group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from (select lang, w, unnest(range(1, len(w) + 1)) i from p), (select unnest(range(1, {LONGEST + 1})) k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, count(*) f from g group by all having count(*) >= {LEAST}),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w, unnest(range(1, k)) j from f where k > 1),
s as (select c.lang, c.k, c.phrase, a, x.f l, y.f r, n, j, (1000 :: hugeint * a * n) // (x.f :: hugeint * y.f) score from c join total using (lang)
  join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(w[j + 1:], ' ')),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
open as (select * from best b where not exists (select 1 from f where f.lang = b.lang and f.k > b.k and f.f >= b.a and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score from open
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}
"""
