"""Line-level deduplication: lines that many documents share stay in one of them.

Each text is exploded into its lines.  A line's key is the line without white
space at its ends and with A-Z lower-cased; keys of at least ``LEAST_LENGTH``
code points are hashed (128 bits of SHA-256), and the distinct documents of each
hash are counted.  That count is of (hash, doc_id) first and of the hash after,
so a line that a third of all documents hold combines before it is shuffled.
Lines whose hash ``LEAST_DOCUMENTS`` or more documents hold are dropped, but for
the document with the largest id; the others are put together by position.

Only hashes, ids and positions are shuffled to find the lines; texts meet the
dropped positions of their own row once, and are shuffled only where those are
more than ``common.bounded`` broadcasts.

Defined results: a null or empty text is one empty line.  Rows with equal doc_id
are one document when documents are counted, and are put together row by row;
all of its rows keep the lines that the largest doc_id keeps.  A row without
doc_id is no document: it counts for nothing and loses every shared line.  A
text whose lines all go becomes empty.  Very long texts and lines are taken
whole.  Ill-formed UTF-8 counts as U+FFFD, also in what is kept.  An empty table
stays empty.  Only doc_id and text are read; ``clean`` keeps all other columns,
whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, bounded, materialize

LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
#: White space that a key hasn't at its ends (fixed values): \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"


def _valid(text: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def _row(text: Column) -> Column:
    """With the id, tells rows apart unless they are repeated."""
    return F.xxhash64(text)


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(_valid(text)), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))


def marks(docs: DataFrame, length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, row, at, hash) of every line with a long enough key, at counted from 0."""
    # hashed before the lines are exploded: beside the generator, it would be for each line
    whole = docs.select("doc_id", _row(F.col("text")).alias("row"), "text")
    lines = whole.select("doc_id", "row", F.posexplode(keys(F.col("text"))).alias("at", "key")).filter(F.char_length("key") >= length)
    return lines.select("doc_id", "row", "at", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("hash"))


def shared(lines: DataFrame, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(hash, n, keeper) of lines that enough documents hold."""
    return lines.groupBy("hash").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= documents)


def dropped(docs: DataFrame, length: int = LEAST_LENGTH, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, row, gone) of the distinct rows that lose lines: their positions."""
    lines = materialize(marks(docs, length), "line-marks")
    common = materialize(shared(lines, documents).select("hash", "keeper"), "shared-lines")
    gone = lines.join(bounded(common, F.lit(24)), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return materialize(gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone")), "dropped-lines")


def _marked(docs: DataFrame, length: int, documents: int) -> DataFrame:
    """(d, gone) of each row: its columns, and the positions of lines to drop (null: none)."""
    gone = dropped(docs, length, documents)
    rows = docs.select(F.struct("*").alias("d")).withColumn("row", _row(F.col("d.text"))).alias("l")
    found = bounded(gone, 4 * F.size("gone") + 16).alias("g")
    return rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("l.row") == F.col("g.row")), "left").select("d", "gone")


def _kept(text: Column, gone: Column) -> Column:
    """A text without the lines at some positions, in time linear in its lines."""
    lines = F.split(text, "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))


def deduplicated(docs: DataFrame, length: int = LEAST_LENGTH, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs``."""
    rows = _marked(docs, length, documents).select("d.doc_id", _valid(F.col("d.text")).alias("text"), "gone").withColumn("lines", F.split("text", "\n"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("doc_id", size("lines").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(size("gone")).alias("n_dropped"), _kept(F.col("text"), F.col("gone")).alias("kept"))


def clean(docs: DataFrame, length: int = LEAST_LENGTH, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of ``docs``, all columns, with the kept lines as their text."""
    rows = _marked(docs, length, documents).withColumn("lines", F.split(_valid(F.col("d.text")), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(_kept(_valid(F.col("d.text")), F.col("gone")))
    return rows.select(F.col("d").withField("text", kept).alias("d")).select("d.*")


def oracle() -> str:
    """The contract's digest in DuckDB's SQL, over ``documents``."""
    key = "trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents),
l as (select r, doc_id, i, line, {key} k from (select r, doc_id, unnest(lines) line, unnest(range(len(lines))) i from d)),
shared as (select k, max(doc_id) keeper from l where length(k) >= {LEAST_LENGTH} group by k having count(distinct doc_id) >= {LEAST_DOCUMENTS}),
f as (select r, l.doc_id, i, line, s.k is not null and l.doc_id is distinct from keeper gone from l left join shared s using (k))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from f group by r, doc_id
"""
