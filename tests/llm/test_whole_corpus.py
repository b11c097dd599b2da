"""Manifest, line deduplication and collocations against plain versions, on tables with nulls,
empty and long texts, ties, repeated rows, clashing columns and ill-formed text."""

import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import collocations, entries, linededup, merkle

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
EXTRA = {"order": "1", "branch": "2", "at": "3", "n": "4", "row": "5", "gone": "6", "lines": "7", "phrase": "8", "f": "9"}


def written(spark, where, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5).selectExpr("*", *[f"{v} `{k}`" for k, v in EXTRA.items()])
    docs.write.parquet(f"{where}/documents.parquet")
    return docs


def same(got, want):
    assert sorted((tuple(r) for r in got), key=str) == sorted(map(tuple, want), key=str)


# ------------------------------------------------------------------ manifest


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def leaf(row, text):
    i, source, lang, n, _ = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves):
    """The root, and each leaf's path of (place, run)."""
    level, paths, owners = leaves, [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for k, own in enumerate(owners):
            for o in own:
                paths[o].append((k % 8, runs[k // 8]))
        owners = [sum(owners[k : k + 8], []) for k in range(0, len(owners), 8)]
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops, own = [], []
    for lang in langs:
        ordered = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subroot, paths = tree([leaf(r, r[4]) for r in ordered])
        tops.append(subroot)
        own.append((ordered, paths))
    root, above = tree(tops)
    out = []
    for (ordered, paths), subroot, more in zip(own, tops, above):
        for r, path in zip(ordered, paths):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            h, proof = leaf(r, lower(r[4]) if tampered else r[4]), []
            for place, run in [*path, *more]:
                proof += run[:place] + run[place + 1 :]
                h = sha("".join([*run[:place], h, *run[place + 1 :]]))
            out.append((r[0], leaf(r, r[4]), subroot, root, sha("".join(proof)), h, h == root))
    return out


def manifest_rows(n, spread=1, langs=("en", "de", None)):
    rng = random.Random(n)
    rows = [(i * spread - n // 2, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([1, None, 77]), rng.choice(["Text", "été É", "", None, "lower"]) if i % 3 else f"T {i}") for i in range(n)]
    return [*rows, (None, "s", "en", 1, "X"), (None, "s", "en", 1, "X"), (None, "s", "en", 2, "Y"), (10**18, "s", "en", 1, "Long é " * 50_000), rows[0], rows[0], (5, "s", "alone", 1, "One")]


@pytest.mark.parametrize(("n", "spread"), [(0, 1), (60, 1), (1_300, 1), (700, 10**15 // 7)])
def test_manifest(spark, tmp_path, n, spread):
    rows = manifest_rows(n, spread) if n else [(7, None, None, None, "A")]
    written(spark, tmp_path, rows)
    got = entries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    same(got, plain_manifest(rows))
    assert len({r["root"] for r in got}) == 1


def test_ranks_of_crowded_prefixes(spark, monkeypatch):
    """Prefixes grow until none holds more than a bucket, through the digests beneath equal ids."""
    monkeypatch.setattr(merkle, "BUCKET", 3)
    rows = [("1x", None if i % 3 == 0 else i % 5, hashlib.sha256(str(i // 2).encode()).hexdigest()) for i in range(400)]
    frame = spark.createDataFrame(rows, "branch string, doc_id long, leaf string").select("branch", merkle._order(F.col("doc_id"), F.col("leaf")).alias("order"), "doc_id")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    same(merkle.ranks(frame, "doc_id").select("rank", "doc_id", "leaf", "total").collect(), [(k, r[1], r[2], 400) for k, r in enumerate(want)])


def test_many_languages_and_copies(spark, tmp_path):
    rows = [(i, "s", f"l{i % 90}", i, f"Text {i}") for i in range(400)] + [(3, "s", "l3", 3, "Text 3")] * 5_000
    written(spark, tmp_path, rows)
    same(entries.op11_merkle_manifest(spark, str(tmp_path)).collect(), plain_manifest(rows))


def test_manifest_path_proves_its_leaf(spark):
    docs = spark.createDataFrame(manifest_rows(100), COLUMNS)
    found = merkle.manifest(docs.select("lang", "doc_id", merkle.leaf().alias("leaf")))
    right, wrong = merkle.folded(F.col("path"), F.col("leaf")), merkle.folded(F.col("path"), F.lit("0" * 64))
    for r in found.select("root", right.alias("right"), wrong.alias("wrong")).collect():
        assert r["right"] == r["root"] != r["wrong"]


# --------------------------------------------------------------------- lines


def plain_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))))
    return out


def line_rows():
    rng = random.Random(8)
    pool = ["a line that many documents share", "A LINE that many documents SHARE \t", "short line", "twenty code points é", "nineteen code poin é", "", "   ", "one more shared line, é É", "one more shared line, é é", "� bad bytes in this line, yes"]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randrange(7)), f"an own line of the document {i}"][:: rng.choice([1, -1])])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (None, pool[0] + "\nown line of a row without id"), (None, pool[0]), (5, rows[5][1]), (5, pool[0] + "\n" + pool[0]), (203, "\n".join(f"line number {i % 4000} of a long text" for i in range(60_000)))]
    return rows + [(i, f"held by two only, {i % 2} of them are\n{pool[0]}\n{pool[0]}") for i in range(300, 304)] + [(i, pool[7]) for i in (204, 204, 204)]


def test_line_dedup(spark, tmp_path):
    rows = line_rows()
    written(spark, tmp_path, [(i, "s", "en", 1, t) for i, t in rows])
    same(entries.op12_line_dedup(spark, str(tmp_path)).collect(), plain_lines(rows))


def test_line_dedup_by_shuffle(spark, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr(linededup, "bounded", lambda df, size: df)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(linededup.deduplicated(docs).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept, 256)").collect(), plain_lines(rows))


def test_cleaned_rows_keep_their_columns(spark):
    rows = [(i, "a line that many documents share\nown", "x", "y") for i in range(3)] + [(9, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string, gone string")
    got = linededup.clean(docs)
    assert got.columns == docs.columns
    same(got.collect(), [(0, "own", "x", "y"), (1, "own", "x", "y"), (2, rows[2][1], "x", "y"), (9, None, "x", "y")])


def test_ill_formed_lines(spark):
    docs = spark.sql("select id doc_id, cast(concat(unhex('ff'), ' bytes that are not text') as string) text from range(4)")
    got = linededup.deduplicated(docs).collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["kept"]) for r in got) == [(0, 1, ""), (1, 1, ""), (2, 1, ""), (3, 0, "� bytes that are not text")]


# -------------------------------------------------------------- collocations


def plain_phrases(rows, least=100, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        known = {p: f for p, f in c.items() if f >= least}
        inner = set()
        for p, f in known.items():
            inner |= {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1) if f >= known[p[i : i + k]]}
        best = []
        for p, a in known.items():
            if len(p) > 1 and p not in inner:
                score, k = min((1000 * a * total[lang] // (known[p[:k]] * known[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return out


def phrase_rows():
    rng = random.Random(3)
    words = ["new", "york", "city", "Hall", "of", "the", "É", "é", "x y", "a"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, k=30)) + rng.choice([". ", "\n", ", "]) + "new york\tcity  hall of the world" * (i % 2)) for i in range(900)]
    return [*rows, ("en", None), ("en", ""), (None, "?!"), ("fr", "once"), ("en", "la la " * 70_000), ("en", rows[0][1]), ("en", "tied pair! " * 150 + "pair tied! " * 150 + "one two one two one! " * 60)]


def test_collocations(spark, tmp_path, monkeypatch):
    rows = phrase_rows()
    written(spark, tmp_path, [(i, "s", lang, 1, t) for i, (lang, t) in enumerate(rows)])
    want = plain_phrases(rows)
    assert len(want) > 100 and any(len(r[2].split()) == 5 for r in want)
    same(entries.op13_collocations(spark, str(tmp_path)).collect(), want)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 6])
def test_collocations_by_bit_table(spark, monkeypatch, bits):
    """A level beyond the broadcast bound, and a bit table so small that every phrase passes."""
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    known = collocations.frequent(spark.createDataFrame([("en", "new york", 5)], "lang string, phrase string, f long"), 0)
    assert known.phrases is None and known.test("en")(b"new york")
    if bits > 64:
        assert not known.test("de")(b"new york")
        same(collocations.report(docs, top=5, most=0).collect(), plain_phrases(rows, top=5))


def test_segments_cut_between_pieces():
    body = b"\n".join(b"w" * (i % 13) for i in range(500))
    for size in (1, 7, 100, 10_000):
        assert b"\n".join(collocations.segments(body, size)) in (body, body[:-1])


def test_scores_beyond_64_bits(spark):
    score = spark.sql("select cast((cast(1000 as decimal(4,0)) * cast(9000000000000 as decimal(18,0)) * cast(90000000000000 as decimal(16,0))) div (cast(9000000000001 as decimal(18,0)) * cast(9000000000007 as decimal(18,0))) as long) s").first()["s"]
    assert score == 1000 * 9000000000000 * 90000000000000 // (9000000000001 * 9000000000007)


def test_pairs_are_counted_in_bounded_memory():
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 300, 1 << 19).astype("<i4") for _ in range(9)]
    plain = Counter()
    for a in rows:
        both = (a[:-1] != 0) & (a[1:] != 0)
        keys, n = np.unique((a[:-1].astype(np.int64) << 32 | a[1:])[both], return_counts=True)
        plain.update(dict(zip(keys.tolist(), n.tolist())))
    batches = [pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["runs"]) for a in rows]
    found = Counter()
    tracemalloc.start()
    try:
        for out in collocations._count_pairs(iter(batches)):
            for key, n in zip(out["key"].to_pylist(), out["n"].to_pylist()):
                found[key] += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == plain
    assert peak < 60 << 20  # 4 million pairs at a time took over 100 MB


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_line_dedup", "op13_collocations"])
def test_empty_table(spark, tmp_path, name):
    written(spark, tmp_path, [])
    assert entries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the data tables")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_line_dedup", "op13_collocations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{DATA}/documents.parquet'")
    got, want = entries.QUERIES[name](spark, DATA).toPandas(), con.sql(entries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    same(got[columns].astype(str).to_numpy().tolist(), want[columns].astype(str).to_numpy().tolist())
