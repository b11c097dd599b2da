"""Toxicity scores by a counterfactual-regularised linear classifier.

A text's features are its distinct words (lower-cased) and their first four
and five letters, so that unseen inflections of a word still count.  Words
that the labels show to go with toxicity are kept as features, identity terms
(in four languages) always are, and a logistic model is fitted to them with one
more penalty: each labelled text that holds an identity term is paired with a
copy in which the terms are swapped, and the squared difference of the two scores
(in logits) is added to the loss.  A group's mere mention therefore can't move a
score much, whichever group the labelled sentences happened to insult.

Defined results: null and empty texts get the score of a text without
features; repeated rows get equal scores, and are learned from once; without
any learnable label, or any document, the score is 0; an empty table gives an
empty result.  A very long text is scored whole.  Ill-formed UTF-8 counts as
U+FFFD.  Labels other than 0 and 1, and rows with a null id, teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded_share, fold_of, materialize

#: Bound of the labelled rows that training reads, about; all features of theirs that have the
#: evidence are kept.
MAX_ROWS = 16_000
#: A feature must have this log-likelihood ratio against independence of the label.
MIN_EVIDENCE = 15.0
PENALTY, COUNTERFACTUAL = 1e-3, 1.0
#: Words whose weights a task remembers.
MEMO = 200_000

#: Identity terms (fixed values); each swaps with its neighbour on the line.
IDENTITY_SWAPS = """
he she
him her
his hers
man woman
men women
boy girl
boys girls
male female
father mother
son daughter
husband wife
brother sister
gay straight
lesbian heterosexual
homosexual bisexual
transgender cisgender
black white
african european
asian american
latino hispanic
arab persian
muslim christian
muslims christians
jewish catholic
jews catholics
hindu buddhist
immigrant native
immigrants natives
disabled abled
deaf blind
old young
elderly teenage
mann frau
männer frauen
junge mädchen
vater mutter
sohn tochter
bruder schwester
ehemann ehefrau
schwule lesben
schwarze weiße
afrikaner europäer
muslime christen
juden katholiken
türken griechen
ausländer inländer
einwanderer einheimische
behinderte gesunde
homme femme
hommes femmes
garçon fille
garçons filles
père mère
frère sœur
mari épouse
noir blanc
noirs blancs
africains européens
musulman chrétien
musulmans chrétiens
juif catholique
juifs catholiques
immigré natif
immigrés natifs
handicapé valide
homosexuel hétérosexuel
hombre mujer
hombres mujeres
chico chica
niño niña
padre madre
hijo hija
hermano hermana
esposo esposa
negro blanco
negros blancos
africanos europeos
musulmán cristiano
musulmanes cristianos
judío católico
judíos católicos
inmigrante nativo
inmigrantes nativos
discapacitado sano
sordo ciego
viejo joven
"""
SWAP = {a: b for x, y in map(str.split, IDENTITY_SWAPS.split("\n")[1:-1]) for a, b in ((x, y), (y, x))}

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> tuple[str, ...]:
    """The word itself, and marked beginnings of longer ones."""
    if len(word) <= 3:
        return (word,)
    return (word, "4:" + word[:4], "5:" + word[:5]) if len(word) > 4 else (word, "4:" + word)


def swapped(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self._memo = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_memo": {}}

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None) -> float:
        memo, total = self._memo, self.bias
        if self.bias == -np.inf:
            return 0.0
        for word in words_of(text):
            found = memo.get(word)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[word] = self.word_weight(word)
            total += found
        return float(1 / (1 + np.exp(-min(max(total, -60.0), 60.0))))


def _labelled(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(text, toxic) of at most about ``max_rows`` rows outside the held-out fold.  The
    labels are thinned first, so the side that is broadcast is bounded."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out)).distinct()
    rows = bounded_share(rows, F.col("doc_id"), max_rows)
    found = docs.select("doc_id", F.make_valid_utf8("text").alias("text")).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label")
    found = materialize(found.distinct(), "toxicity-sample")  # an id may have many rows
    return bounded_share(found, F.xxhash64("doc_id", "text"), max_rows).select("text", "label")


def _evidence(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Log-likelihood ratios of 2 x 2 tables of texts with and without a feature."""

    def bits(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    p, n = pos.cast("double"), neg.cast("double")
    a, b = F.lit(float(n_pos)), F.lit(float(n_neg))
    cells = bits(p) + bits(n) + bits(a - p) + bits(b - n)
    return 2 * (cells + bits(a + b) - bits(a) - bits(b) - bits(p + n) - bits(a + b - p - n))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled rows outside the held-out fold, with a
    weight of the counterfactual penalty (0: none)."""
    sample = _labelled(docs, labels, folds, held_out, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update({f for w in words_of(text) for f in features_of(w)})
                found[label][""] += 1  # the texts
        keys = list(found[0] | found[1])
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.string()), "neg": pa.array([found[0][k] for k in some], pa.int64()), "pos": pa.array([found[1][k] for k in some], pa.int64())})

    counts = sample.mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # texts of each label; then what could have the evidence at all
    sizes = counts.filter("feature = ''").collect()
    n_neg, n_pos = (int(sizes[0]["neg"]), int(sizes[0]["pos"])) if sizes else (0, 0)
    if not n_pos or not n_neg:
        return ToxicityModel({}, -np.inf if not n_pos else np.log(n_pos))
    rare = counts.filter((F.col("feature") != "") & (F.col("pos") >= 3) & (F.col("pos") * F.lit(n_neg) > F.lit(2.0 * n_pos) * F.col("neg")))
    judged = rare.withColumn("evidence", _evidence(F.col("pos"), F.col("neg"), n_pos, n_neg)).filter(F.col("evidence") >= MIN_EVIDENCE)
    few = judged.select("feature").toPandas()["feature"]
    index = {f: i for i, f in enumerate(sorted({*few, *SWAP}))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            own, other = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                own.append([index[f] for w in words for f in features_of(w) if f in index])
                other.append([index[f] for w in swapped(words) for f in features_of(w) if f in index] if words & SWAP.keys() else own[-1])
            yield pa.RecordBatch.from_pydict({"label": batch.column(1), "own": pa.array(own, ints), "other": pa.array(other, ints)})

    data = sample.mapInArrow(vectors, "label int, own array<int>, other array<int>").toPandas()
    return ToxicityModel(*_logistic(data, list(index), counterfactual))


def _logistic(data: pd.DataFrame, names: list[str], counterfactual: float = COUNTERFACTUAL, steps: int = 400) -> tuple[dict[str, float], float]:
    """Full-batch Adam on the log loss, a ridge and the counterfactual penalty."""
    n, k = len(data), len(names)
    y = data["label"].to_numpy(float)

    def sparse(column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = data[column].tolist()
        return np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])

    (row, col), (row2, col2) = sparse("own"), sparse("other")
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z, z2 = (np.bincount(r, w[c], n) for r, c in ((row, col), (row2, col2)))
        p = 1 / (1 + np.exp(-np.clip(z + b, -60, 60)))
        err, gap = (p - y) / n, 2 * counterfactual * (z - z2) / n
        grad = np.bincount(col, (err + gap)[row], k) - np.bincount(col2, gap[row2], k) + PENALTY / 10 * w
        grad = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(names, w.tolist(), strict=True)), float(b)


def scorer(model: ToxicityModel):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return lambda text: score(F.make_valid_utf8(text))


def score(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, name: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``name``, which takes the place of one so named."""
    return docs.withColumn(name, scorer(model or fit(docs, labels))(F.col("text")))
