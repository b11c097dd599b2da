"""Chunks, vectors, full text, fusion and prompts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import cosine, hash_vector, key_of, snippet

CHUNK, OVERLAP = 500, 50


def chunks(docs: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Each text's overlapping pieces: the other columns, chunk_index and chunk."""
    step = size - overlap
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(step)))
    cut = docs.select("*", F.posexplode(starts).alias("chunk_index", "__at"))
    return cut.withColumn("chunk", F.substr(F.col(text), F.col("__at") + 1, F.lit(size))).drop("__at", text)


def embedded(pieces: DataFrame, repo_id: str, path: str, embed=hash_vector) -> DataFrame:
    """Chunks with identifiers and vectors; ``embed`` is a column function and can be replaced."""
    ident = key_of(F.lit(repo_id), F.col(path).cast("string"), F.col("chunk_index").cast("string"), length=32)
    return pieces.withColumn("id", ident).withColumn("vector", embed(F.col("chunk")))


def nearest(vectors: DataFrame, vector: str, query: list[float] | DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """The k best rows by cosine, filtered before scoring; a bounded heap for each task."""
    rows = vectors if where is None else vectors.filter(where)
    if isinstance(query, DataFrame):  # one row
        rows, q = rows.join(F.broadcast(query.select(F.col(vector).alias("__q")).limit(1))), F.col("__q")
    else:
        q = F.array(*map(F.lit, query))
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    scored = rows.withColumn("score", F.round(cosine(as_double(F.col(vector)), as_double(q)), 6)).drop("__q")
    return scored.orderBy(F.desc("score"), scored.columns[0]).limit(k)


def tokens(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def occurrences(text: Column, word: str) -> Column:
    """How many of a text's ``tokens`` are the word; only texts that hold it are searched."""
    if not re.fullmatch("[a-z0-9]+", word):
        return F.lit(0)
    low = F.lower(text)
    return F.when(low.contains(word), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){word}(?![a-z0-9])"))).otherwise(0)


def search(docs: DataFrame, key: str, text: str, words: list[str], k: int = 10) -> DataFrame:
    """The k best documents for some words by TF-IDF.  Only the words asked for leave the
    scan, counted in the row, so what is shuffled doesn't depend on the texts' length."""
    asked = sorted({w.lower() for w in words})
    counted = docs.select(F.col(key), *[occurrences(F.col(text), w).alias(f"__{i}") for i, w in enumerate(asked)])
    rows = counted.select(key, F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"__{i}").alias("tf")) for i, w in enumerate(asked)])).alias("h"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    hits = rows.filter("h.tf > 0").select(key, "h.word", "h.tf")
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total))  # one row
    scored = hits.join(F.broadcast(df), "word")  # as many rows as words are asked for
    score = F.sum(F.col("tf") * F.ln(1 + F.col("total") / F.col("df")))
    return scored.groupBy(key).agg(F.round(score, 4).alias("score"), F.count(F.lit(1)).alias("matched")).orderBy(F.desc("score"), key).limit(k)


def first_places(rows: DataFrame, text: str, order: Column, k: int) -> DataFrame:
    """(text, rank) of the first k distinct texts by their best place among all rows, repeats
    counted; the minimum of each text's hash combines before the shuffle."""
    placed = rows.select(F.col(text).alias("text"), order.alias("o"))
    best = placed.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("o").alias("o"))
    top = best.orderBy("o").limit(k)
    # k rows: how many rows stand before each, and its text
    before = placed.select(F.col("o").alias("p")).join(F.broadcast(top), F.col("p") < F.col("o")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    texts = placed.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).join(F.broadcast(top.select("h", F.col("o").alias("first"))), "h").filter(F.col("o") == F.col("first"))
    return texts.select("h", "text").dropDuplicates(["h"]).join(before, "h", "left").select("text", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"))


def fuse(sources: list[DataFrame], k: int = 12) -> DataFrame:
    """Ranked sources (text, score, rank) joined in order; a text counts once, where it first
    stands."""
    rows = reduce(DataFrame.unionByName, [s.select("text", "score", "rank").withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    best = rows.groupBy("text").agg(F.min(F.struct("source", "rank", "score")).alias("b")).select("text", "b.source", "b.rank", "b.score")
    return best.orderBy("source", "rank", "text").limit(k)


def citations(fused: DataFrame, *keep: str) -> DataFrame:
    """Numbered snippets for a prompt, from the few rows that were fused."""
    n = F.row_number().over(Window.orderBy("source", "rank", "text"))
    return fused.select(n.alias("n"), snippet(F.col("text")).alias("snippet"), "score", *keep)


def prompts(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One prompt for each conversation: its turns in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, role, text)))
    return turns.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: F.concat(r[role], F.lit(": "), r[text])), "\n").alias("prompt"), F.count(F.lit(1)).alias("turns"))


def clean_answer(text: Column) -> Column:
    """An answer without Markdown: headings become labels with a colon, emphasis goes."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^#{1,6}[ \t]+(.+?):?[ \t]*$", "$1:\n")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "[#*]", ""), r"::\s*", ": ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


MODELS = {"code": "code", "security": "code", "performance": "code", "architecture": "code"}


def model_of(reasoning: Column) -> Column:
    """The kind of model that answers a class of questions."""
    return F.when(reasoning.isin(*MODELS), "code").otherwise("general")


def temperature_of(reasoning: Column) -> Column:
    return F.when(reasoning == "general", 0.3).otherwise(0.1)


def messages(system: str, history: Column, cited: Column, question: Column) -> Column:
    """A chat: the system's text, the history (role, content), and the question below its
    numbered context, an array of texts."""
    turn = lambda role, said: F.struct(F.lit(role).alias("role"), said.alias("content"))
    context = F.array_join(F.transform(cited, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    asked = F.when(F.size(cited) > 0, F.concat(context, F.lit("\n\n"), question)).otherwise(question)
    return F.concat(F.array(turn("system", F.lit(system))), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(turn("user", asked)))


def search_documents(files: DataFrame, repo_id: str) -> DataFrame:
    """(id, path, name, content, language) of files, for a full-text index."""
    return files.select(key_of(F.lit(repo_id), F.col("path"), length=32).alias("id"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "language")


#: What each index is searched by (fixed values).
INDEXES = {"files": ["path", "name", "content", "language"], "symbols": ["name", "type", "file_path", "signature"], "docs": ["title", "content", "file_path"]}


def search_index(rows: DataFrame, key: str, attributes: list[str], words: list[str], k: int = 10) -> DataFrame:
    """The k best rows for some words in any of their attributes."""
    return search(rows.select(key, F.concat_ws(" ", *attributes).alias("__said")), key, "__said", words, k)


def symbol_documents(symbols: DataFrame, repo_id: str) -> DataFrame:
    """(id, name, type, file_path, signature) of symbols, for a full-text index."""
    ident = key_of(F.lit(repo_id), F.col("file_path"), F.col("name"), F.col("line_start").cast("string"), length=32)
    return symbols.select(ident.alias("id"), "name", "type", "file_path", F.coalesce("signature", F.lit("")).alias("signature"))


def document_documents(files: DataFrame, repo_id: str, most: int = 10_000) -> DataFrame:
    """(id, title, content, file_path, cut) of documentation files, a row each; the index takes the
    first ``most`` characters of a text, as an index's limit, and ``cut`` says whether there are
    more.  A file without a path has no id."""
    name = F.element_at(F.split("path", "/"), -1)
    ident = F.when(F.col("path").isNotNull(), key_of(F.lit(repo_id), F.col("path"), length=32))
    return files.select(ident.alias("id"), F.regexp_replace(name, r"[.][^.]*$", "").alias("title"), F.substring("content", 1, most).alias("content"), F.col("path").alias("file_path"), (F.char_length("content") > most).alias("cut"))
