"""Which texts hold which words as substrings, by an index of q-grams.

A text holds a word only if it holds the word's rarest gram of ``GRAM``
characters, so words are joined on that one gram with the grams of the texts,
and the pairs are checked.  A word shorter than that is joined whole with the
texts' shorter substrings.  Both sides are made distinct first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """A text's distinct substrings of a size."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))
    return F.when(F.char_length(text) >= size, found).otherwise(F.array().cast("array<string>"))


def held(words: Column | str, of: DataFrame, texts: Column | str, among: DataFrame) -> DataFrame:
    """(word, text): the distinct texts of ``among`` that hold a distinct word of ``of``.  Nulls
    hold nothing and are in nothing; the empty word, which all texts hold, has no pairs."""
    word = of.select((F.col(words) if isinstance(words, str) else words).alias("word")).filter("word <> ''").distinct()
    text = cut(among.select((F.col(texts) if isinstance(texts, str) else texts).alias("text")).filter("text <> ''").distinct(), "held-texts")
    long = F.char_length("word") >= GRAM
    placed = text.select("text", F.explode(grams(F.col("text"), GRAM)).alias("gram"))
    counts = placed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = word.filter(long).select("word", F.explode(grams(F.col("word"), GRAM)).alias("gram")).join(counts, "gram", "left")
    rare = rare.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("word", "r.gram")
    pairs = placed.join(rare, "gram").filter(F.contains("text", "word")).select("word", "text")
    short = F.flatten(F.array(*[grams(F.col("text"), k) for k in range(1, GRAM)]))
    return pairs.unionByName(text.select("text", F.explode(short).alias("word")).join(word.filter(~long), "word").select("word", "text"))
