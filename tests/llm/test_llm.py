"""The training-data operators against brute force, libraries and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import bytebpe, decontaminate, langid, licences, neardup, pagetext, pieces, quality, repair, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, w int, fp int, ids int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def frame(spark, texts, ids=None, langs=None):
    """Documents with columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 1, 1, 1, 1, 1) for i, t, g in zip(ids, texts, langs)], DOCS)


PIECES = ["it's", "I'LL", "'st", "''s", "x's", "you're'd", "'rest", "<|endoftext|>", "<|", "a<|startoftext|>b", "é", "É", "İ", "ΣΑΣ", "12", "½", "\0", "a\0", "\x01", "漢字", "A" * 20, "É" * 20, "!?", "-'s", "ß", "ẞ", "x\u0085y", "“x”", "’s", "e\u0301", "=\u0338", "×", "ñO"]
EDGE = [None, "", " \n", "one", LONG, "same text here", "same text here", "Été été"]
EDGE_IDS = [1, 2, 3, 4, 5, 6, 6, None]


# ------------------------------------------------------------ decontamination


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_hits(docs, items, size=10):
    out = []
    for i, text in docs:
        w, hit, held = plain_words(text), set(), set()
        for item, said in items:
            v = plain_words(said)
            for s in range(max(1, len(v) - size + 1) if v else 0):
                win = v[s : s + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        held.add(str(item))
        out.append((i, len(w), len(hit), sorted(held)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "d", "Éa", "e1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 10, 12, 15])))) for i in range(12)] + [(12, None), (3, "a b a b a b a b a b a b a b")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=30)) + ". " + (rng.choice(items)[1] or "")) for i in range(40)] + [(90, None), (91, ""), (92, docs_text := "a, b; a-b a b a b a b"), (92, docs_text)]
    found = decontaminate.report(frame(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()], key=str)
    assert got == plain_hits(docs, items)


def test_decontamination_of_edges(spark):
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    docs = frame(spark, EDGE, EDGE_IDS)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == len(EDGE) - 1
    assert decontaminate.clean(docs, items.limit(0)).count() == len(EDGE)
    assert decontaminate.report(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination_runs_no_python(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.report(frame(spark, ["a b c"]), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ------------------------------------------------------------------ byte BPE


def test_bpe_equals_the_library(spark):
    import tiktoken

    path = public_tokenizers.path(bytebpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    texts = [*EDGE, "it's <|endoftext|> 12345 \U0001f600", "a" * 3000, "漢字" * 300, "x   y", "antidisestablishmentarianism" * 30]
    docs = frame(spark, texts, [*EDGE_IDS, 20, 21, 22, 23, 24])
    forms = [(bytebpe.encode(docs), bytebpe.decoder()(F.col("ids")))]
    forms += [(bytebpe.encode_native(docs.drop("ids"), size=size), bytebpe.decode_native(F.col("ids"))) for size in (0, 50)]
    for coded, decoded in forms:
        for text, ids, back in coded.select("text", "ids", decoded.alias("back")).collect():
            assert list(ids) == library.encode_ordinary(text or "")
            assert bytes(back) == (text or "").encode()
    for (text, i), row in zip(zip(texts, [*EDGE_IDS, 20, 21, 22, 23, 24]), bytebpe.digests(docs).collect()):
        assert tuple(row) == plain_digest(library, i, text)
    assert bytebpe.encode(docs.limit(0)).count() == 0
    assert bytebpe.encode(docs).columns == docs.columns and "found" in bytebpe.encode(docs, name="found").columns


def plain_digest(library, i, text):
    ids = library.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


SPACES = ["", " ", "\n", "\t", "  ", "\x0b", "   ", "\n\n", " \n", "\n "]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_bpe_digests_equal_the_library_in_any_blocks(monkeypatch, block):
    import pyarrow as pa
    import tiktoken

    path = public_tokenizers.path(bytebpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    monkeypatch.setattr(pieces, "BLOCK", block)
    rng = random.Random(3)
    words = [*PIECES, "'ll", "'l", "'v", "\u3000", "\xa0", "\x1c"]
    texts = [None, "", "   ", " a", "\n", LONG] + ["".join(rng.choice(words[: rng.choice([8, 99])]) + rng.choice(SPACES) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    sizes, listed, decoded = bytebpe.Codec(path).digested(pa.array(texts, pa.string()))
    assert [(0, *x) for x in zip(sizes.tolist(), listed, decoded)] == [plain_digest(library, 0, t) for t in texts]


def test_bpe_of_ill_formed_text(spark):
    """Ill-formed bytes count as U+FFFD."""
    docs = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text")
    path = public_tokenizers.path(bytebpe.VOCABULARY)
    back = bytebpe.encode(docs).select(bytebpe.decoder(path)(F.col("ids")).alias("b")).first()["b"]
    assert bytes(back).decode() == "a\ufffdb"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abtheé ", min_size=1, max_size=40))
def test_heap_merges_equal_the_library(text):
    import tiktoken

    path = public_tokenizers.path(bytebpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    assert bytebpe.merge_long(text.encode(), path) == library.encode_ordinary(text)
    assert bytebpe.merge_short(text.encode(), bytebpe.read_ranks(path)) == library.encode_ordinary(text)


# --------------------------------------------------------------- language ID


def labelled(spark):
    english, german = "the house and the garden with that thing", "das haus und der garten mit dem ding"
    return frame(spark, [english, german] * 20, langs=["en", "de"] * 20)


def test_language(spark):
    model = langid.fit(labelled(spark))
    assert model.langs == ["de", "en"]
    docs = frame(spark, ["the thing in that house", "der garten und das haus", None, "", "123 ...", LONG, "漢"])
    rows = [(r["lang_pred"], r["score"]) for r in langid.identify(docs, model).select("language.*").collect()]
    assert [r[0] for r in rows[:5]] == ["en", "de", "und", "und", "und"]
    assert rows[6][0] in ("en", "de")
    assert all(0 <= r[1] <= 1 for r in rows)


def test_language_code_lengths_equal_a_plain_walk(spark):
    """Exact code lengths, by a walk over dictionaries of contexts."""
    docs = [("en", "the theme then"), ("de", "der den die")]
    counts = pd.DataFrame(langid.gram_counts(frame(spark, [t for _, t in docs], langs=[g for g, _ in docs])).collect(), columns=["lang", "gram", "n"])
    model = langid.PpmModel.fit(counts)
    trees = {}
    for lang, text in docs:
        padded = b"   " + text.encode()
        for i in range(3, len(padded)):
            for k in range(4):
                seen = trees.setdefault((lang, padded[i - k : i]), {})
                seen[padded[i]] = seen.get(padded[i], 0) + 1
    text = "then der d\u00e9"

    def length(lang, context, symbol):
        seen = trees.get((lang, context))
        if seen is not None and symbol in seen:
            return -np.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        shorter = length(lang, context[1:], symbol) if context else 8
        return shorter if seen is None else shorter - np.log2(len(seen) / (sum(seen.values()) + len(seen)))

    padded = b"   " + text.encode()
    for i, lang in enumerate(model.langs):
        want = sum(length(lang, padded[j - 3 : j], padded[j]) for j in range(3, len(padded)))
        two = model.bits(np.frombuffer((text + text).encode(), np.uint8), np.array([0, len(text.encode())]))
        assert two[:, i] == pytest.approx([want, want], rel=1e-4)
        assert model._long(np.frombuffer(text.encode(), np.uint8))[0, i] == pytest.approx(want, rel=1e-4)


def test_language_query_against_a_plain_walk(spark, tmp_path, monkeypatch):
    """The registered query, with ties, repeated rows, nulls and texts longer than a block."""
    from lodestrata.llm import entries

    monkeypatch.setattr(langid, "BLOCK", 256)
    rng = random.Random(5)
    said = {"en": "the house and the garden with that thing of ours", "de": "das haus und der garten mit dem ding von uns", "zh": "漢字 的 書 和 花 園"}
    rows = [(i, " ".join(rng.choices(said[g].split(), k=8)), g) for i, g in enumerate(rng.choices(list(said), k=120))]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 !", "de"), (503, "the haus", None), (503, "the haus", None), (None, "der garten", "de"), (504, "the garden " * 400, None), (505, "ÿ", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    trees, known = {}, sorted({g for i, t, g in rows if t is not None and g and i is not None and zlib.crc32(str(i).encode()) % 4 != 2})
    for i, t, g in rows:
        if t is not None and g and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            padded = b"   " + t.encode()
            for at in range(3, len(padded)):
                for k in range(4):
                    seen = trees.setdefault((g, padded[at - k : at]), {})
                    seen[padded[at]] = seen.get(padded[at], 0) + 1

    def length(g, context, symbol):
        seen = trees.get((g, context))
        if seen and symbol in seen:
            return -np.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        shorter = length(g, context[1:], symbol) if context else 8
        return shorter if seen is None else shorter - np.log2(len(seen) / (sum(seen.values()) + len(seen)))

    want = []
    for i, t, _ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not any(map(str.isalpha, t or "")):
            want.append((i, held, "und", 0.0))
            continue
        padded = b"   " + t.encode()
        bits = [sum(length(g, padded[at - 3 : at], padded[at]) for at in range(3, len(padded))) for g in known]
        want.append((i, held, known[int(np.argmin(bits))], 1 / sum(2.0 ** -min(b - min(bits), 1000) for b in bits)))
    got = entries.QUERIES["op3_language"](spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), str(r[2]))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:3] == b[:3] and a["score"] == pytest.approx(b[3], abs=1e-3)


def test_language_without_labels(spark):
    docs = frame(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs).select("language.*").collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


# --------------------------------------------------------------------- top-k


def plain_top(rows, k, every=20):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(400)]
    rows += [(500 + i, rows[20][1]) for i in range(30)] + [(600, None), (620, []), (640, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (660, [float("nan")] + [0.0] * 5), (680, [float("inf")] + [0.0] * 5), (700, [1.0, 2.0]), (721, [0.5, -1.0]), (None, [0.0] * 6), (722, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (3, 20):
        got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 20 == 0, k=k).collect()))
        assert got == plain_top(rows, k)
    assert topk.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()))
    assert got == plain_top(rows, 20)


# --------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav>
<div class="cookie-notice">We use cookies, which you can accept, or decline.</div>
<div id="sidebar"><p>Other stories, many of them, with long descriptions here.</p></div>
<article><h2>The  title</h2><p>First <b>bold</b> para&shy;graph &amp; more,
wrapped.<p>Second one &lt;tag&gt;.<ul><li>Item one<li>Item two</ul><form><input value="x">Search</form><script>var x = "<p>no</p>";</script></article>
<section class="comments"><p>I disagree, strongly, with all of this.</p></section><footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert pagetext.main_text(PAGE) == "The title\nFirst bold para­graph & more, wrapped.\nSecond one <tag>.\nItem one\nItem two"
    plain = "<html><body><div class=menu>Home About</div><div><p>A long paragraph of text, with some commas, and more.</p><p>Another long paragraph, again with words, here.</p></div><div class='ad'>Buy, now!</div></body></html>"
    assert pagetext.main_text(plain) == "A long paragraph of text, with some commas, and more.\nAnother long paragraph, again with words, here."
    for page in (None, "", "<", "<html><body><nav>x</nav>", "<!-- open", "<script>never closed"):
        assert pagetext.main_text(page) == ""
    assert pagetext.main_text("<article><p>cut off in a t<b") == "cut off in a t"
    assert len(pagetext.main_text("<article>" + "<p>word word, word.</p>" * 20_000).split("\n")) == 20_000


def test_unmarked_text_beside_marked_teasers():
    story = "".join(f"<p>Sentence {i} of the story, which is long, has commas, and goes on for a while, as stories do.</p>" for i in range(9))
    cards = "".join(f'<article class="card"><h3>Teaser {i}</h3></article>' for i in range(4))
    assert pagetext.main_text(f"<html><body><div>{story}</div>{cards}</body></html>").startswith("Sentence 0 of the story")
    lead = "The lead, a paragraph with commas, which stands in a header of the entry, and is text."
    assert lead in pagetext.main_text(f'<article><div class="entry-header"><p>{lead}</p></div>{story}</article>')


def test_page_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, None)], "page_id long, url string, html string, text int")
    rows = pagetext.extract(pages).collect()
    assert sorted(r["n_chars"] for r in rows)[0] == 0 and rows[0]["text"] == rows[1]["text"]
    assert pagetext.extract(pages.limit(0)).count() == 0


# ------------------------------------------------------- toxicity and quality


def judged(spark):
    rng = random.Random(1)
    texts, toxic, good = [], [], []
    for i in range(400):
        words = rng.choices(["house", "tree", "river", "cloud", "stone", "grass", "women", "men"], k=30)
        toxic.append(int(i % 4 == 0))
        good.append(int(i % 5 != 0))
        if toxic[-1]:
            words[rng.randrange(30)] = rng.choice(["idiot", "idiots"])
        texts.append(" ".join(words) + "." if good[-1] else " | ".join(words).upper() + "!!")
    return frame(spark, texts), spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(good, toxic))] + [(999, None, None), (0, good[0], toxic[0])], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = judged(spark)
    model = toxicity.fit(docs, labels)
    probes = frame(spark, ["you idiot", "a tree by the river", None, "", LONG + " idiots", "the women", "the men"])
    got = [r["toxicity"] for r in toxicity.score(probes, labels, model).orderBy("doc_id").collect()]
    assert got[0] > 0.5 and got[4] > 0.5 and got[1] < 0.3 and got[2] == got[3] and got[5] == pytest.approx(got[6], abs=0.05)
    none = toxicity.fit(docs, labels.limit(0))
    assert none.score("you idiot") == 0.0
    assert toxicity.score(docs.limit(0), labels, model).count() == 0


def test_features_are_chosen_by_their_evidence(spark):
    rare = [f"r{c}z" for c in "abcdefghijkl"]
    texts, toxic = [], []
    for i in range(600):
        toxic.append(int(i < 200))
        words = ["bad"] if i < 150 or 200 <= i < 240 else ["fox"]
        texts.append(" ".join([*words, *([rare[i // 12]] if i < 144 else [])]))
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    assert "bad" in toxicity.fit(frame(spark, texts), labels).weights
    got = spark.createDataFrame([(100, 40), (4, 0)], "p long, n long").select(toxicity._evidence(F.col("p"), F.col("n"), 1800, 14200)).collect()
    want = []
    for pos, neg in ((100, 40), (4, 0)):
        cells = [(pos, 1800, pos + neg), (neg, 14200, pos + neg), (1800 - pos, 1800, 16000 - pos - neg), (14200 - neg, 14200, 16000 - pos - neg)]
        want.append(2 * sum(x * np.log(x * 16000 / (r * c)) for x, r, c in cells if x))
    assert np.allclose([r[0] for r in got], want)


def test_counterfactual_penalty_levels_groups():
    """Labels blame one group; the penalty evens its score with the swapped text's."""
    data = pd.DataFrame({"label": [1, 0] * 50, "own": [[0, 1], [2]] * 50, "other": [[0, 2], [1]] * 50})
    weights, _ = toxicity._logistic(data, ["insult", "women", "men"])
    assert abs(weights["women"] - weights["men"]) < 0.7 < weights["insult"]


def test_swaps_are_symmetric():
    assert all(toxicity.SWAP[toxicity.SWAP[w]] == w for w in toxicity.SWAP)


def test_quality(spark):
    docs, labels = judged(spark)
    got = quality.score(frame(spark, EDGE, EDGE_IDS), labels.limit(0)).collect()
    assert len(got) == len(EDGE) and {r["quality"] for r in got} == {0.0}


def test_quality_separates(spark):
    docs, labels = judged(spark)
    found = quality.score(docs, labels).withColumnRenamed("quality", "score").join(labels.dropDuplicates(["doc_id"]), "doc_id").toPandas()
    assert found[found.quality == 1].score.min() > found[found.quality == 0].score.max()


def test_isotonic_is_monotonic():
    out = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1, 1, 1]))
    assert out.tolist() == [0.1, 0.4, 0.4, 0.9]


# ------------------------------------------------------------------ licences


def test_every_known_sentence_passes_the_anchor():
    assert all(re.search(licences.ANCHOR, said) for _, said in licences._rows(licences.SENTENCES))


def test_licences(spark):
    said = {}
    for name, text in licences._rows(licences.SENTENCES):
        said.setdefault(name, text.capitalize() + ".")
    mit = "\n".join([said["mit.grant"].replace(" to deal", "\nto deal"), said["mit.notice"], said["mit.disclaim"]])
    texts = ["Prose.\nReleased under the MIT License.", mit, said["bsd.grant"] + " " + said["bsd.source"] + " " + said["bsd.binary"], "word | word |\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", *EDGE]
    rows = [(r["sentence_ids"], r["licences"]) for r in licences.scan(frame(spark, texts, [*range(100, 104), *EDGE_IDS])).collect()]
    assert rows[0] == (["mit.name"], ["MIT"])
    assert rows[1] == (["mit.grant", "mit.notice", "mit.disclaim"], ["MIT"])
    assert rows[2][1] == ["BSD-2-Clause"]
    assert rows[3] == (["ccbync.name", "mit.name"], ["CC-BY-NC-4.0", "MIT"])
    assert all(r == ([], []) for r in rows[4:])


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://example.org/MPL/2.0/. */"""
BSD = """Copyright (c) 2020, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Some Body Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""


def test_wrapped_notices_and_their_sql(spark, tmp_path):
    import duckdb

    from lodestrata.llm import entries

    texts = ["x = 1\n" + GPL + "y = 2", MPL, BSD, GPL + BSD, "The\nMIT License\nmit license", "we like the mit license", "licensed under the MIT\nLicense", None, "", "all rights reserved, all rights reserved"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in entries.op7_licences(spark, str(tmp_path)).collect()}
    assert [rows[i]["licences"] for i in range(7)] == ["GPL-3.0-or-later", "MPL-2.0", "BSD-3-Clause", "BSD-3-Clause,GPL-3.0-or-later", "MIT", "", "MIT"]
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(entries.ORACLE_SQL["op7_licences"]).fetchall()
    assert sorted(map(tuple, rows.values())) == sorted(want)


def test_every_sentence_over_lines_and_marks(spark, tmp_path):
    """Each known sentence, wrapped in a comment, with a long holder's name in its gap; and SQL."""
    import duckdb

    from lodestrata.llm import entries

    said = licences._rows(licences.SENTENCES)
    texts = []
    for name, text in said:
        words = text.replace("*", "Some Body, Some Other Body and " * 40 + "Company").title().split()
        wrapped = " ".join(words) if name.endswith("title") else "\n".join("// * " + " ".join(words[k : k + 3]) + "," for k in range(0, len(words), 3))
        texts.append(f"x = 1;\n{wrapped}\ny = 2;")
    texts += ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0 */", "# spdx-license-identifier: ISC\n# SPDX-License-Identifier: gpl-2.0+ or foo-1.0\nlicensed under the unlicense",
              "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n", "is licensed under the Apache License, Version 2.0 or the MIT license.", "MIT License\n\nApache License, Version 2.0", "see the MIT License\n", "the name of the rose " * 9 + BSD]
    got = frame(spark, texts)
    got.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in entries.op7_licences(spark, str(tmp_path)).collect()}
    for k, (name, _) in enumerate(said):
        assert rows[k]["sentence_ids"] == name, said[k]
    assert [rows[len(said) + k]["licences"] for k in range(7)] == ["Apache-2.0,GPL-2.0-or-later,MIT", "GPL-2.0-or-later,ISC,Unlicense", "GPL-3.0-only", "Apache-2.0,MIT", "Apache-2.0,MIT", "", "BSD-3-Clause"]
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, rows.values())) == sorted(con.sql(entries.ORACLE_SQL["op7_licences"]).fetchall())


# --------------------------------------------------------------- token files


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(repair.VOCABULARY))
    texts = [*EDGE, "A\tb　c é é <|endoftext|> don't", "the cat sat on the mat " * 50, "hello<|startoftext|>you <|ENDOFTEXT|>"]
    ids = [*EDGE_IDS, -5, 50, 51]
    rows = repair.round_trip(frame(spark, texts, ids)).collect()
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0]))
    assert len(rows) == len(texts)
    start = 0
    for (i, text), row in zip(order, sorted(rows, key=lambda r: r["start"])):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert repair.round_trip(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 6), max_size=60), min_size=1, max_size=30))
def test_grammar_round_trip(lists):
    ids = np.array([x for own in lists for x in [*own, 1]], np.uint32)
    sizes = np.array([len(own) + 1 for own in lists])
    file = repair.TokenFile(repair.pack(ids, sizes))
    assert file.ids().tolist() == ids.tolist()
    assert [file.document(i).tolist() for i in range(len(lists))] == [[*own, 1] for own in lists]


def test_grammar_compresses():
    ids = np.array([*[5, 6, 7, 8] * 1000, 1], np.uint32)
    symbols, rules, size = repair.compress(ids, 10)
    assert len(symbols) < len(ids) / 8 and len(rules) and size.max() >= 8


def test_grammar_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(1)
    passage = rng.integers(2, 30_000, 1_000)
    noise = rng.permutation(np.arange(2, 40_000))
    ids = np.concatenate([np.concatenate([passage, [1]]) for _ in range(60)] + [noise, [1]]).astype(np.uint32)
    symbols, rules, size = repair.compress(ids, 49_152)
    assert size.max() > 64 and len(symbols) < len(noise) + 60 * 20
    assert repair.expand(symbols, repair.expansions(rules, np.arange(49_152))).tolist() == ids.tolist()


def test_grammar_stops_where_no_pair_pays():
    """Nine or more bytes are saved by five occurrences of two bytes each; a rule takes eight."""
    rng = np.random.default_rng(4)
    ids = np.append(rng.integers(2, 40, 20_000), 1).astype(np.uint32)
    symbols, rules, _ = repair.compress(ids, 40)
    plain = {}
    last = None
    for a, b in zip(symbols.tolist(), symbols[1:].tolist()):
        if 1 in (a, b) or (last == (a, b) and a == b):
            last = None
            continue
        last = (a, b)
        plain[last] = plain.get(last, 0) + 1
    assert max(plain.values()) <= 4 and len(rules) > 100
    assert repair.expand(symbols, repair.expansions(rules, np.arange(40))).tolist() == ids.tolist()


def test_grammar_of_wide_symbols():
    rng = np.random.default_rng(9)
    words = rng.integers(2, 70_000, (20_000, 2))
    ids = np.append(words[rng.integers(0, len(words), 300_000)].reshape(-1), 1).astype(np.uint32)
    file = repair.TokenFile(repair.pack(ids, np.array([len(ids)])))
    assert (file.ids() == ids).all() and len(file.symbols) < 0.6 * len(ids)
    symbols, rules, size = repair.compress(ids, 70_000)
    back, kept, _ = repair._undone(symbols, rules, 70_000, 50)
    assert len(kept) == 50 and (repair.expand(back, repair.expansions(kept, np.arange(70_000))) == ids).all()




@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_pieces_equal_the_library(monkeypatch, block):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(pieces, "BLOCK", block)
    library = Tokenizer.from_file(public_tokenizers.path(repair.VOCABULARY))
    rng = random.Random(2)
    texts = [None, "", "   ", "a", LONG] + ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    ids, sizes = repair.PieceEncoder(public_tokenizers.path(repair.VOCABULARY)).encode(pa.array(texts, pa.string()))
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_forgets_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repair, "MEMO", 64)
    monkeypatch.setattr(pieces, "BLOCK", 128)
    encoder = repair.PieceEncoder(public_tokenizers.path(repair.VOCABULARY))
    texts = [" ".join(f"word{i}x{k}" for k in "abcdef") for i in range(300)]
    first, _ = encoder.encode(pa.array(texts))
    assert (first == repair.PieceEncoder(public_tokenizers.path(repair.VOCABULARY)).encode(pa.array(texts))[0]).all()


def test_memory_grows_for_a_long_text_without_spaces():
    import pyarrow as pa
    import tiktoken

    path = public_tokenizers.path(bytebpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    codec = bytebpe.Codec(path)
    codec.memo = pieces.PieceMemo(codec.learn, [], 32)
    text = "".join(f"漢{chr(0x4E00 + i)}{chr(0x5E00 + i % 77)}。x{i}" for i in range(400))
    ids, sizes = codec.encode(pa.array([text, "a b"]))
    assert ids.tolist() == [*library.encode_ordinary(text), *library.encode_ordinary("a b")] and sizes[1] == 2


# ------------------------------------------------------------ near-duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abABÉ \t\n ", max_size=60))
def test_fingerprint(text):
    assert neardup.fingerprint(text) == plain_fingerprint(text)


def plain_components(prints, radius=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shard_rows", [4096, 5])
def test_components_against_brute_force(spark, shard_rows):
    rng = random.Random(8)
    prints, centres = {}, [rng.getrandbits(64) for _ in range(6)]
    for i in range(300):
        base = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            base ^= 1 << rng.randrange(64)
        prints[i] = base
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, doc_id long").groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = {r["node"]: r["root"] for r in neardup.components(neardup.links(nodes, shard_rows=shard_rows)).collect()}
    want = plain_components(prints)
    by_fp = {p: min(i for i in prints if prints[i] == p) for p in prints.values()}
    for i, p in prints.items():
        assert found.get(by_fp[p], by_fp[p]) == want[i]


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    fp[300:600] = fp[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    fp[600:] = fp[0] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))
    forest, plain = neardup.Forest(900), neardup.Forest(900)
    neardup.search(fp, forest)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    plain.link(a, b)
    assert (forest.root == plain.root).all()


def test_near_duplicates_of_edges(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts, ids = [*EDGE, base, base + " extra", base, "  "], [*EDGE_IDS, 30, 20, 40, 50]
    rows = [(r["doc_id"], r["fp"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts, ids)).collect()]
    assert len(rows) == len(texts)
    by_id = {r[0]: r for r in rows}
    assert by_id[30][2] == by_id[20][2] == by_id[40][2] == 20
    assert by_id[1][1] == by_id[2][1] == by_id[50][1] == 0 and by_id[50][2] == 1
    assert by_id[None][2] is None and by_id[6][2] == 6
    kept = neardup.distinct_documents(frame(spark, texts, ids))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 20]
    assert kept.columns == frame(spark, []).columns
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


# ------------------------------------------------------------------- pipeline


def plain_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(words, changes, tag):
    out = list(words)
    for k in range(changes):
        out[20 + 30 * k + 7 * tag] = f"changed{tag}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("shingles", [1 << 20, 500])
def test_edited_copies_are_one_document(spark, monkeypatch, shingles):
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles)
    rng = random.Random(7)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(6)]
    texts = [" ".join(b) for b in bases] + [edited(b, 1 + i % 4, i % 4) for i, b in enumerate(bases)]
    far = [edited(b, 5, 2) for b in bases]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = [plain_shingles(t) for t in texts + far]
    assert all(0.8 <= jaccard(sets[i], sets[6 + i]) < 0.96 and jaccard(sets[i], sets[12 + i]) < 0.8 for i in range(6))
    kept = {r["doc_id"] for r in neardup.distinct_documents(frame(spark, texts + far)).collect()}
    want = list(range(18))
    for a in range(18):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = want[a], want[b]
                want = [min(x, y) if c in (x, y) else c for c in want]
    assert kept == set(want) and not kept & set(range(6, 12))


def test_wide_fingerprint_is_a_simhash():
    rng = np.random.default_rng(6)
    for n in (0, 1, 4, 5, 300):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        bits = [neardup.wide_bits(own[i : i + 1], 3) for i in range(len(own))]  # of one shingle: its hash
        want = 2 * np.sum(bits, axis=0, initial=0) > len(own) if len(own) else np.zeros(192, bool)
        assert (neardup.wide_bits(own, 3) == want).all()
        words, bands = neardup.wide_fingerprint(own, 5, 7)
        whole = neardup.wide_bits(own, neardup.WIDE + 1)
        assert [int(w) >> b & 1 for w in words.view(np.uint64).tolist() for b in range(64)] == whole[:192].tolist()
        assert bands.tolist() == [sum(1 << b for b in range(5) if whole[192 + 5 * k + b]) for k in range(7)]


@pytest.mark.parametrize("n", [10_000, 300_000, 10_000_000])
def test_pairs_at_the_similarity_are_candidates(n):
    rng = np.random.default_rng(9)
    plan = neardup.band_plan(n)
    for both, apart in [(8, 1), (40, 5), (356, 44)] * 20:
        some = rng.integers(0, 1 << 63, both + 2 * apart).astype(np.uint64)
        assert both / len(some) >= 0.8
        (a, v), (b, w) = neardup.wide_fingerprint(some[: both + apart], *plan), neardup.wide_fingerprint(np.concatenate([some[:both], some[both + apart :]]), *plan)
        assert (v == w).any() and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= neardup.WIDE_RADIUS


@pytest.mark.parametrize("shard_rows,few", [(4096, 512), (4096, 4), (20, 8)])
def test_wide_links_against_brute_force(spark, monkeypatch, shard_rows, few):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(neardup, "FEW", few)  # in the driver; workers keep theirs
    centres = rng.integers(0, 2, (30, 192 + 80)).astype(bool)
    bits = np.concatenate([centres[rng.integers(0, 30, 150)] ^ (rng.random((150, 272)) < 0.12), rng.integers(0, 2, (50, 272)).astype(bool)])
    heads = np.packbits(bits[:, :192], axis=1, bitorder="little").view(np.int64)
    bands = bits[:, 192:].reshape(200, 16, 5) @ (1 << np.arange(5))
    nodes = spark.createDataFrame([(i, *heads[i].tolist(), bands[i].tolist()) for i in range(200)], "node long, w0 long, w1 long, w2 long, bands array<int>")
    near = (bits[:, None, :192] ^ bits[None, :, :192]).sum(axis=2) <= neardup.WIDE_RADIUS
    linked = near & (bands[:, None] == bands[None]).any(axis=2)
    want = list(range(200))
    for a in range(200):
        for b in range(a):
            if linked[a, b]:
                x, y = want[a], want[b]
                want = [min(x, y) if c in (x, y) else c for c in want]
    found = {r["node"]: r["root"] for r in neardup.components(neardup.wide_links(nodes, shard_rows).distinct()).collect()}
    assert [found.get(i, i) for i in range(200)] == want
    shard, node, side = np.repeat(np.arange(5), 40), np.arange(200), np.zeros(200, int)
    a, b = neardup._wide_edges(shard, [x.view(np.uint64) for x in heads.T], node, side)
    forest = neardup.Forest(200)
    forest.link(a, b)
    plain = neardup.Forest(200)
    plain.link(*np.nonzero(near & (shard[:, None] == shard[None])))
    assert (forest.root == plain.root).all()


def test_linked_sets_against_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for _ in range(12):
        base = rng.integers(0, 400, 40)
        sets += [np.unique(np.concatenate([base[: 40 - k], rng.integers(0, 400, k)])).astype(np.uint64) for k in range(8)]
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if len(x & y) >= 0.8 * len(x | y):
                p, q = want[a], want[b]
                want = [min(p, q) if c in (p, q) else c for c in want]
    assert neardup.linked_sets(sets).tolist() == want


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    docs, labels = judged(spark)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    more = frame(spark, ["before " + passage + " after", "12 34", "clean words of a house by the river"], [1000, 1001, 1002])
    docs.unionByName(more).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    assert all(r["round_trip"] for r in rows) and 1002 in kept and not kept & {1000, 1001}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    assert not kept & toxic
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "simhash_near_dedup", "decontamination", "byte_bpe"]


def test_pipeline_stages_hand_workers_batches_of_bounded_bytes(spark):
    import corpus_pipeline
    import pyarrow as pa

    from lodestrata.llm.common import ARROW_BYTES

    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('some words of a long text ', 400) as text")
    for name, stage in corpus_pipeline.STAGES[1::3]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(3).withColumn("lang", F.lit("en")), "")

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

        got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r["rows"] for r in got) == 2000, name
        assert max(r["bytes"] for r in got) < 2 * ARROW_BYTES, name
