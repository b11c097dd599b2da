"""A stored inverted index, for searches that don't read the texts.

Postings (term, field, key, n) lie in one folder for each term range, which is a
term's first ``width`` characters (1; 2 suits more than some hundred million
postings), sorted by term within files; so a search reads the ranges of the
asked words, and of their files the row groups that hold them.  Adaptive
execution sizes the files: small ranges share a task, large ones are split.

A dictionary has each term's documents and occurrences.  A third table has the
deletion neighbourhood: a term of up to ``SHORT`` characters under itself and
under each of its forms without one character.  Two words are one edit apart
only if their neighbourhoods meet, so a word's few forms are looked up and the
found terms checked.  A longer term is under its first and its last ``HALF``
characters: one edit leaves one of them as it is.

Updates are segments (see ``sources.published``).  Words are runs of a-z and
0-9 in lower case.  Rows with equal keys are one document, and their counts add
up; a null text has no words, a null key is a document like another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import tokens
from lodestrata.sources.published import Segmented

SHORT, HALF = 32, 16


def _range(term: Column, width: int) -> Column:
    return F.when(term == "", "_").otherwise(F.substring(term, 1, width))


def near_keys(word: str) -> list[str]:
    """The keys that terms within one edit of a word may be found under."""
    short = [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))] if len(word) <= SHORT + 1 else []
    return sorted({*short, *(["^" + word[:HALF], "$" + word[-HALF:]] if len(word) >= SHORT else [])})


def _neighbourhood(term: Column) -> Column:
    """The keys that a term is found under, of the same kinds."""
    at = F.sequence(F.lit(1), F.char_length(term))
    without = F.transform(at, lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)))
    ends = F.array(F.concat(F.lit("^"), F.substring(term, 1, HALF)), F.concat(F.lit("$"), F.right(term, F.lit(HALF))))
    return F.when(F.char_length(term) <= SHORT, F.array_union(F.array(term), without)).otherwise(ends)


def _stored(rows: DataFrame, path: str, *order: str) -> None:
    """A folder for each range, its rows in order, in files of the size that adaptive execution aims at."""
    rows.hint("rebalance", F.col("range")).sortWithinPartitions("range", *order).write.partitionBy("range").parquet(path)


class TextIndex(Segmented):
    """An index below a folder; ``width`` is that of a new one.

    ``update`` adds and replaces documents, ``remove`` takes them out, ``search`` ranks them;
    ``merge`` makes one segment of all."""

    def __init__(self, spark: SparkSession, root: str, width: int = 1):
        super().__init__(spark, root)
        self.width = self.state().get("width", width)

    def update(self, docs: DataFrame, key: str, fields: list[str], removed: DataFrame | None = None) -> int:
        """Index the fields of ``docs``, in the place of what is known of their keys; leave out
        the keys of ``removed`` (a table with the column ``key``)."""
        said = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields])).alias("t")
        words = docs.select(F.col(key).alias("key"), said).select("key", "t.field", F.explode("t.words").alias("term"))
        counted = words.groupBy("term", "field", "key").agg(F.count(F.lit(1)).alias("n"))
        return self.add(lambda path: self._write(path, counted), docs.select(F.col(key).alias("key")), removed, width=self.width)

    def remove(self, keys: DataFrame) -> int:
        """Take out the documents of some keys (a table with the column ``key``)."""
        none = keys.limit(0)
        empty = none.select(F.lit("").alias("term"), F.lit("").alias("field"), "key", F.lit(0).cast("long").alias("n"))
        return self.add(lambda path: self._write(path, empty), none, keys)

    def merge(self) -> int:
        """One segment of all, without what is dead."""
        found = self.segments()
        live = self.listed(found).filter("live")
        return self.add(lambda path: self._write(path, self._postings(lambda p: p).drop("range")), live, merged=True)

    def _write(self, path: str, counted: DataFrame) -> None:
        rows = counted.withColumn("range", _range(F.col("term"), self.width))
        _stored(rows, f"{path}/postings", "term", "key")
        held = self.spark.read.schema(rows.schema).parquet(f"{path}/postings")
        terms = held.groupBy("range", "term").agg(F.count_distinct("key").alias("documents"), F.sum("n").alias("n"))
        _stored(terms, f"{path}/terms", "term")
        words = self.spark.read.schema("term string").parquet(f"{path}/terms")
        near = words.select("term", F.explode(_neighbourhood(F.col("term"))).alias("form")).withColumn("range", _range(F.col("form"), self.width))
        _stored(near, f"{path}/near", "form")

    def _postings(self, pick) -> DataFrame | None:
        found = self.segments()
        if not found:
            return None
        kind = self.spark.read.parquet(f"{found[0]['path']}/keys").schema["key"].dataType.simpleString()
        return self.rows("postings", pick, f"term string, field string, key {kind}, n long, range string")

    def terms(self) -> DataFrame:
        """(term, documents, n) of all that is live."""
        return self._postings(lambda p: p).groupBy("term").agg(F.count_distinct("key").alias("documents"), F.sum("n").alias("n"))

    def near(self, word: str) -> list[str]:
        """The terms within one edit of a word: as many as there are such strings, at most."""
        forms = near_keys(word)
        places = sorted({f[: self.width] or "_" for f in forms})
        found = set()
        for s in self.segments():
            near = self.spark.read.schema("term string, form string, range string").parquet(f"{s['path']}/near")
            rows = near.filter(F.col("range").isin(places) & F.col("form").isin(forms)).select("term").distinct()
            found |= {r["term"] for r in rows.filter(F.levenshtein("term", F.lit(word)) <= 1).collect()}
        return sorted(found)

    def postings(self, words: list[str], prefix: bool = False, fuzzy: bool = False, fields: list[str] | None = None) -> DataFrame | None:
        """(word, key, n): how often documents hold the asked words, or terms that begin with
        them, or that are within one edit of them.  Reads the words' term ranges only."""
        asked = sorted({w.lower() for w in words})
        of = [(t, w) for w in asked for t in (self.near(w) if fuzzy else [w])]
        term, places = F.col("term"), F.col("range")
        if prefix:
            there, held = F.lit(False), F.lit(False)
            for w in asked:
                there = there | (places == w[: self.width] if len(w) >= self.width else places.startswith(w))
                held = held | term.startswith(w)
        else:
            there, held = places.isin(sorted({t[: self.width] for t, _ in of})), term.isin(sorted({t for t, _ in of}))
        named = F.lit(True) if fields is None else F.col("field").isin(fields)
        hits = self._postings(lambda p: p.filter(there & held & named))
        if hits is None:
            return None
        if prefix:
            begun = F.filter(F.array(*map(F.lit, asked)), lambda w: F.startswith(term, w))
            hits = hits.withColumn("word", F.explode(begun))
        else:
            pairs = self.spark.createDataFrame(of, "term string, word string")
            hits = hits.join(F.broadcast(pairs), "term")  # as many rows as strings are within an edit of the words
        return hits.groupBy("word", "key").agg(F.sum("n").alias("n"))

    def search(self, words: list[str], k: int = 10, among: DataFrame | None = None, **how) -> DataFrame:
        """(key, score, matched) of the k best documents by TF-IDF, of those in ``among`` (a table
        with the column ``key``) if given; ``how`` is that of ``postings``."""
        hits = self.postings(words, **how)
        if hits is None:
            return self.spark.createDataFrame([], "key long, score double, matched long")
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        scored = hits.join(F.broadcast(df), "word")  # as many rows as words are asked for
        if among is not None:
            scored = scored.join(among.select("key").distinct(), "key", "left_semi")
        score = F.sum(F.col("n") * F.ln(1 + F.lit(self.total()) / F.col("df")))
        return scored.groupBy("key").agg(F.round(score, 4).alias("score"), F.count(F.lit(1)).alias("matched")).orderBy(F.desc("score"), "key").limit(k)


def built(spark: SparkSession, root: str, docs: DataFrame, key: str, fields: list[str]) -> TextIndex:
    """An index with the documents in it."""
    index = TextIndex(spark, root)
    index.update(docs, key, fields)
    return index
