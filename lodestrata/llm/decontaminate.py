"""Benchmark decontamination by a prefix-filtered set join.

Every item gives windows of ``WINDOW`` consecutive words (a shorter item is
one window).  A document can hold a window only if it holds the window's
rarest word, so that word, by its count over the whole corpus, is the one
prefix token which exact containment needs.  Document words are joined with
the prefix tokens; the window's place follows from the token's offset, so the
positional bounds (it starts at or after the first word) and the length bound
(it ends at or before the last) prune candidates, then the window's second
rarest word is compared, and then all its words.

Only built-in functions are used.  What is broadcast are the benchmark's
tables, and only while their summed bytes are within ``BROADCAST_BYTES``.
Larger ones are joined by a shuffle, which adaptive execution splits where a
word is frequent: of single words with their places, without the texts, which
meet only the candidates that pass the bounds.  Both ways give equal results.

Defined results: a null text has no words and no hits; so have empty texts
and tables.  Repeated rows get equal results each; windows that tie in rarity
are searched by the word that sorts first.  A null item_id counts as an empty
one; repeated items count once.  A very long text is searched whole.
Ill-formed UTF-8 counts as U+FFFD.  Only doc_id, text, item_id are read, and
``clean`` keeps the rows' columns, whatever they are named.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize

WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: Everything but digits, letters a-z and non-ASCII characters (a fixed pattern), after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; an empty array for null."""
    text = F.make_valid_utf8(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _fits(df: DataFrame, size: Column) -> bool:
    """Whether a written table, whose rows take ``size`` bytes and some more, may be broadcast."""
    return (df.agg(F.sum(size + F.lit(64))).first()[0] or 0) <= BROADCAST_BYTES


def _bounded(df: DataFrame, size: Column) -> DataFrame:
    """A hint to broadcast a written table that is small enough; as it is, otherwise."""
    return F.broadcast(df) if _fits(df, size) else df


def _bytes(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.octet_length(w) + 16)


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, words) of each distinct window, and (win, item) of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1))))
    cut = items.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("words"))
    cut = cut.withColumn("win", F.sha2(F.array_join("words", " "), 256)).distinct()
    cut = materialize(cut, "windows")
    return cut.select("win", "words").distinct(), cut.select("win", "item").distinct()


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Each window with its two rarest words in ``docs`` and their offsets; windows
    with a word that no document has are left out."""
    vocabulary = materialize(wins.select(F.explode("words").alias("word")).distinct(), "window-words")
    held = docs.select(F.explode(words(F.col("text"))).alias("word"))
    number = F.count(F.lit(1)).alias("n")
    if _fits(vocabulary, F.octet_length("word")):
        counts = held.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(number)
    else:  # all words are counted in part before they meet the vocabulary
        counts = held.groupBy("word").agg(number).join(vocabulary, "word", "left_semi")
    counts = materialize(counts, "word-counts")
    placed = wins.select("win", "words", F.posexplode("words").alias("off", "word")).join(_bounded(counts, F.octet_length("word")), "word", "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")))
    rare = placed.groupBy("win", "words").agg(ranked.alias("r")).filter(F.col("r")[0]["n"] > 0)
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    out = rare.select("win", "words", F.col("r")[0]["word"].alias("word"), F.col("r")[0]["off"].alias("off"), second["word"].alias("word2"), second["off"].alias("off2"))
    return materialize(out, "window-prefixes")


def _key(text: Column) -> Column:
    """With the id, tells rows apart unless they are repeated."""
    return F.xxhash64(text)


def occurrences(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, row, start, length, win): every occurrence of a window, start from 0."""
    probe = prefixes(docs, wins).withColumnRenamed("words", "win_words")
    rows = docs.select("doc_id", _key(F.col("text")).alias("row"), words(F.col("text")).alias("w"))
    start, size = F.col("pos") - F.col("off"), F.size("win_words")
    if _fits(probe, _bytes(F.col("win_words"))):
        near = rows.select("doc_id", "row", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(probe), "word")
        near = near.filter((start >= 0) & (start + size <= F.size("w"))).withColumn("start", start)
    else:
        placed = rows.select("doc_id", "row", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        found = placed.join(probe.select("word", "off", "win", size.alias("size")), "word").filter((start >= 0) & (start + F.col("size") <= F.col("n")))
        found = materialize(found.select("doc_id", "row", start.alias("start"), "win").distinct(), "window-candidates")
        texts = rows.dropDuplicates(["doc_id", "row"]).withColumnsRenamed({"doc_id": "__id", "row": "__row"})
        near = found.join(texts, found["doc_id"].eqNullSafe(texts["__id"]) & (found["row"] == texts["__row"]))
        near = near.join(probe.select("win", "win_words", "off2", "word2"), "win")
    near = near.filter(F.get("w", F.col("start") + F.col("off2")) == F.col("word2"))
    held = near.filter(F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), size) == F.col("win_words"))
    return held.select("doc_id", "row", "start", size.alias("length"), "win")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_hit, items) of the distinct rows that hold a window; items sorted as strings."""
    wins, holders = windows(benchmark, size)
    found = occurrences(docs, wins)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    whole = found.groupBy("doc_id", "row").agg(spans.alias("spans"), F.collect_set("win").alias("wins"))
    whole = materialize(whole, "window-hits")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("reach"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")))
    items = whole.select("doc_id", "row", F.explode("wins").alias("win")).join(_bounded(holders, F.octet_length("win") + F.octet_length("item")), "win")
    items = items.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    i, h = items.alias("i"), whole.select("doc_id", "row", covered["n"].alias("n_hit")).alias("h")
    return h.join(i, F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.row") == F.col("i.row"))).select("h.doc_id", "h.row", "n_hit", "items")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of ``docs``."""
    d = docs.select("doc_id", _key(F.col("text")).alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    m = matches(docs, benchmark, size).alias("m")
    joined = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.row") == F.col("m.row")), "left")
    return joined.select("d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    m = matches(docs, benchmark, size).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
    return docs.join(m, docs["doc_id"].eqNullSafe(m["__id"]) & (_key(docs["text"]) == m["__row"]), "left_anti")


def oracle(size: int = WINDOW) -> str:
    """The contract's digest in DuckDB's SQL, over ``documents`` and ``benchmark``."""
    split = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
with d as (select row_number() over () r, doc_id, {split} w from documents),
i as (select distinct coalesce(cast(item_id as varchar), '') item, {split} w from benchmark),
wins as (select distinct item, len(w[s:s + {size - 1}]) n, array_to_string(w[s:s + {size - 1}], ' ') win
  from (select item, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) s from i where len(w) > 0)),
sizes as (select distinct n from wins),
places as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') win
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) p from d, sizes where len(w) >= n)),
hits as (select r, p, x.n, item from places p join wins x on p.win = x.win and p.n = x.n),
pos as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from hits) group by r),
its as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from hits) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (r) left join its using (r)
"""
