"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: every context of up to
``ORDER`` bytes holds the counts of the bytes that followed it.  With the
statistics frozen, a byte's code length in a context is ``-log2(c / (n + d))``
if it was seen there and otherwise the escape ``-log2(d / (n + d))`` plus the
code length in the next shorter context (n occurrences, d distinct bytes);
below order 0 every byte costs 8 bits.  A text belongs to the language whose
tree codes it in the fewest bits.

All contexts and bytes that the training rows hold are kept.  The model has, for
each order, a sorted table of the strings (context and byte) that any language
has seen, with the code length of each language, and one of the contexts, with
the escapes; so its size is that of the bounded training text's distinct
strings.  Whole blocks of texts are scored by numpy look-ups, order by order
for the bytes that the longer contexts haven't seen.

Defined results: a null text, or one without a letter, gets ``und`` with
score 0; so does every text if nothing could be learned.  Ties go to the
language that sorts first.  Rows are scored one by one, so repeated rows get
equal results and empty tables give empty results; a very long text is scored
whole, in blocks.  Ill-formed UTF-8 counts as U+FFFD.  Rows with a null doc_id
are scored, but not learned from.  ``identify`` keeps the rows' columns but
replaces one that has its ``name``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import fold_of
from lodestrata.llm.pieces import columns

ORDER = 3
#: Bound of what training reads: labelled rows of a language, about.
MAX_ROWS_PER_LANG = 4_000
#: Bytes scored at a time, so that temporaries stay small whatever a batch holds.
BLOCK = 1 << 20


def _grams(data: np.ndarray) -> np.ndarray:
    """Codes of the bytes with their three predecessors; the start counts as spaces."""
    padded = np.concatenate([np.full(ORDER, 32, np.uint32), data.astype(np.uint32)])
    return padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of four-byte strings, summed per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(_grams(np.frombuffer(text.encode(), np.uint8)))
            for lang, arrays in parts.items():
                gram, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Strings:
    """Rows of numbers by byte string: an open-addressing table of codes."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)]).astype(np.float32)
        self.bits = max(4, int(2 * len(codes) + 1).bit_length())
        self.code = np.zeros(1 << self.bits, np.uint32)
        self.row = np.full(1 << self.bits, -1, np.int32)
        left, codes = np.arange(len(codes), dtype=np.int32), codes.astype(np.uint32)
        slot = self._slots(codes)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]
            lost = self.row[slot] != left
            self.code[slot[~lost]] = codes[left[~lost]]
            left, slot = left[lost], (slot[lost] + 1) & (1 << self.bits) - 1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        mixed = (codes ^ codes >> np.uint32(15)) * np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(32 - self.bits)).astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row number of each code; the last row, of zeros, where there is none."""
        slot = self._slots(codes)
        row, none = self.row[slot], len(self.rows) - 1
        rows = np.flatnonzero((self.code[slot] != codes) & (row >= 0))
        row[row < 0] = none
        while len(rows):
            at = (slot[rows] + 1) & (1 << self.bits) - 1
            slot[rows] = at
            found, held = self.row[at], self.code[at]
            row[rows] = np.where(found < 0, none, found)
            rows = rows[(held != codes[rows]) & (found >= 0)]
        return row


class PpmModel:
    """Frozen code lengths of each language's context tree, by order from the longest."""

    def __init__(self, langs: list[str], seen: list[Strings], escapes: list[Strings]):
        self.langs, self.seen, self.escapes = langs, seen, escapes

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> PpmModel:
        """From (lang, gram, n) rows."""
        langs = sorted(counts["lang"].unique())
        lang = np.searchsorted(langs, counts["lang"].to_numpy(str)) if langs else np.zeros(0, int)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(float)
        model = cls(langs, [], [])
        size = len(langs)
        for order in range(ORDER + 1):
            keep = (1 << 8 * (order + 1)) - 1
            codes, at = np.unique(gram & keep, return_inverse=True)
            count = np.zeros((len(codes), size))
            np.add.at(count, (at, lang), n)
            contexts, of = np.unique(codes >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, count)
            np.add.at(distinct, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0)
                own = -np.log2(count / (total + distinct)[of])
            shorter = model.lengths((codes & keep >> 8).astype(np.uint32), order - 1)
            length = np.where(count > 0, own, escape[of] + shorter)
            # a context's leading zero bytes don't count, so its order is part of the table
            model.seen.append(Strings(codes, length))
            model.escapes.append(Strings(contexts, escape))
        return model

    def lengths(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Code lengths, (codes, languages), of last bytes in contexts of ``order`` bytes."""
        if order < 0:
            return np.full((len(codes), len(self.langs)), 8.0)
        table = self.seen[order]
        row = table.find(codes)
        out = table.rows[row]
        new = np.flatnonzero(row == len(table.rows) - 1)
        if len(new):
            some, escapes = codes[new], self.escapes[order]
            rest = self.lengths(some & np.uint32((1 << 8 * order) - 1), order - 1)
            out[new] = rest + escapes.rows[escapes.find(some >> np.uint32(8))]
        return out

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code lengths, (texts, languages), of non-empty texts that lie one after another."""
        codes = _grams(data)
        for j in range(ORDER):  # no context reaches into the text before
            at = starts + j
            at = at[at < np.append(starts[1:], len(data))]
            codes[at] = codes[at] & np.uint32((1 << 8 * (j + 1)) - 1) | np.uint32(0x20202020 << 8 * (j + 1) & 0xFFFFFFFF)
        return np.add.reduceat(self.lengths(codes, ORDER), starts, axis=0, dtype=np.float64)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per byte of each text of a string array."""
        lang, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not len(texts) or not self.langs:
            return lang, score, rate
        data, offsets = columns(texts)
        full = np.flatnonzero(np.diff(offsets) > 0)
        at = 0
        while at < len(full):
            end = max(at + 1, int(np.searchsorted(offsets[full + 1] - offsets[full[at]], BLOCK, side="right")))
            rows = full[at:end]
            lo, hi = offsets[rows[0]], offsets[rows[-1] + 1]
            block, starts = data[lo:hi], offsets[rows] - lo
            # a very long text in parts; its contexts reach back over their borders
            bits = self.bits(block, starts) if len(rows) > 1 or hi - lo <= BLOCK else self._long(block)
            letters = np.add.reduceat(_ASCII_LETTER[block], starts, dtype=np.int64)
            best = bits.argmin(axis=1)
            behind = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
            sure = 1 / np.exp2(-behind).sum(axis=1)
            for i, row in enumerate(rows.tolist()):
                if letters[i] or any(map(str.isalpha, texts[row].as_py())):
                    lang[row], score[row] = self.langs[best[i]], sure[i]
                    rate[row] = bits[i, best[i]] / (offsets[row + 1] - offsets[row])
            at = end
        return lang, score, rate

    def _long(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros((1, len(self.langs)))
        for at in range(0, len(data), BLOCK):
            part = data[max(0, at - ORDER) : at + BLOCK]
            codes = _grams(part)[min(at, ORDER) :]
            total += self.lengths(codes, ORDER).sum(axis=0, dtype=np.float64)
        return total


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)], np.uint8)


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, max_rows_per_lang: int = MAX_ROWS_PER_LANG) -> PpmModel:
    """Learn from rows with a text, a language and an id outside the held-out fold;
    from about ``max_rows_per_lang`` of them for each language at most."""
    known = F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    rows = docs.select("doc_id", "lang", F.make_valid_utf8("text").alias("text")).filter(known & (fold_of(F.col("doc_id"), folds) != held_out))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows_per_lang).collect()
    chosen = rows.filter(F.col("text").isNotNull())
    if sizes:  # only languages of more rows than the bound: not more than rows / bound of them
        share = F.from_json(F.lit(json.dumps({r["lang"]: int(1_000_003 * max_rows_per_lang / r["n"]) for r in sizes})), "map<string,int>")
        place = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1_000_003))
        chosen = chosen.filter(place <= F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1_000_003)))
    return PpmModel.fit(gram_counts(chosen).toPandas())


def predictor(model: PpmModel):
    """A column function: text -> struct(lang_pred, score, bits_per_byte)."""
    kind = "struct<lang_pred:string,score:double,bits_per_byte:double>"

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        lang, score, rate = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])

    return lambda text: predict(F.make_valid_utf8(text))


def identify(docs: DataFrame, model: PpmModel | None = None, name: str = "language") -> DataFrame:
    """The rows of ``docs`` with a struct column ``name`` (lang_pred, score, bits_per_byte)."""
    return docs.withColumn(name, predictor(model or fit(docs))(F.col("text")))


def accepted(language: Column, min_score: float = 0.5) -> Column:
    """Whether a filter keeps a row: a language was found, and rather surely."""
    return (language["lang_pred"] != "und") & (language["score"] >= min_score)
