"""The registered queries, through ``llm.entries``, against plain versions on tables with nulls,
empty and very long texts, ties, repeated rows, clashing columns and ill-formed text."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lodestrata.llm import bytebpe, entries, pagetext, quality, repair, toxicity

LONG = "lorem ipsum dolor sit amet " * 20_000
EXTRA = {"ids": "1", "w": "2", "fp": "3", "toxicity": "4", "language": "5", "stats": "6", "node": "7", "text_": "8"}


def held_out(i, folds, which):
    return i is not None and zlib.crc32(str(i).encode()) % folds == which


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and the documents' rows."""
    rng, where = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    words = ["house", "tree", "river", "cloud", "stone", "grass", "women", "men", "don't", "été"]
    rows, labels = [], []
    for i in range(300):
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        said = rng.choices(words, k=30)
        if toxic:
            said[rng.randrange(30)] = rng.choice(["idiot", "idiots"])
        rows.append((i, " ".join(said) + "." if good else " | ".join(said).upper() + "!!"))
        labels.append((i, good, toxic))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, LONG), (405, rows[7][1]), (406, rows[7][1]), (406, rows[7][1]), (None, "a null id"), (407, "x\0y <|endoftext|> \U0001f600 漢字")]
    labels += [(999, None, None), (0, labels[0][1], labels[0][2]), (None, 1, 1), (5, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.sql("select 408L, cast(unhex('61ff6220') as string)"))
    docs = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars", *[f"{v} {k}" for k, v in EXTRA.items()])
    docs.write.parquet(f"{where}/documents.parquet")
    docs.limit(0).write.parquet(f"{where}/none/documents.parquet")
    for folder in (where, f"{where}/none"):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return where, [*rows, (408, "a�b ")]


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_byte_bpe(spark, corpus):
    import tiktoken

    where, rows = corpus
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path(bytebpe.VOCABULARY)), special_tokens={})
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert by_row(entries.op2_byte_bpe(spark, where).collect()) == by_row(want)


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    where, rows = corpus
    library = Tokenizer.from_file(public_tokenizers.path(repair.VOCABULARY))
    want, start = [], 0
    order = {i: n for n, i in enumerate(sorted({i for i, _ in rows}, key=lambda i: (i is not None, i)))}
    for i, text in sorted(rows, key=lambda r: order[r[0]]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_row(entries.op8_token_files(spark, where).collect()) == by_row(want)


def test_near_duplicates(spark, corpus):
    where, rows = corpus
    prints = []
    for i, text in rows:
        said = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(said[k : k + 4]), 42) for k in range(max(1, len(said) - 3))] if said else []
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    root = {i: i for i, _ in prints if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in prints:
        for j, q in prints:
            if i is not None and j is not None and i < j and (p ^ q).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [(i, f"{p:016x}", None if i is None else find(i)) for i, p in prints]
    assert by_row(entries.op9_near_duplicates(spark, where).collect()) == by_row(want)


def test_toxicity(spark, corpus):
    """The scores are those of a plain sum of weights; folds and predictions follow."""
    where, rows = corpus
    model = toxicity.fit(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet"))
    got = {(r["doc_id"], i): r for i, r in enumerate(entries.op6_toxicity(spark, where).collect())}
    assert len(got) == len(rows)
    plain = {}
    for i, text in rows:
        z = model.bias + sum(model.weights.get(f, 0) for w in toxicity.words_of(text) for f in toxicity.features_of(w))
        plain[i] = 1 / (1 + np.exp(-z))
    for (i, _), r in got.items():
        assert r["score"] == pytest.approx(plain[i]) and r["predicted"] == int(plain[i] >= 0.3) and r["held_out"] == held_out(i, 4, 2)
    assert all(r["predicted"] == int(i % 4 == 0) for (i, _), r in got.items() if i is not None and i < 300)


def plain_toxicity(texts, y, counterfactual):
    """The same objective, written out over dense vectors and solved by Newton's method."""
    import math
    import re

    def named(text, swap=False):
        words = set(re.findall(r"\w+", (text or "").lower()))
        words = {toxicity.SWAP.get(w, w) for w in words} if swap else words
        return {w for w in words} | {f"4:{w[:4]}" for w in words if len(w) > 3} | {f"5:{w[:5]}" for w in words if len(w) > 4}

    own = [named(t) for t in texts]
    n, n_pos = len(y), sum(y)
    log = lambda x: x * math.log(x) if x else 0.0

    def kept(f):
        pos, neg = sum(f in o for o, t in zip(own, y) if t), sum(f in o for o, t in zip(own, y) if not t)
        g = 2 * (sum(map(log, (pos, neg, n_pos - pos, n - n_pos - neg, n))) - log(n_pos) - log(n - n_pos) - log(pos + neg) - log(n - pos - neg))
        return pos >= 3 and pos * (n - n_pos) > 2 * n_pos * neg and g >= toxicity.MIN_EVIDENCE

    names = sorted({f for f in set().union(*own) if kept(f)} | set(toxicity.SWAP))
    dense = lambda rows: np.array([[f in r for f in names] + [True] for r in rows], float)
    x, gap, y = dense(own), dense(own) - dense([named(t, True) for t in texts]), np.array(y, float)
    ridge = np.diag([toxicity.PENALTY / 10] * len(names) + [1e-9])
    w = np.zeros(len(names) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / n + 2 * counterfactual * gap.T @ (gap @ w) / n + ridge @ w
        w = w - 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x / n + 2 * counterfactual * gap.T @ gap / n + ridge, grad)
    return lambda text: float(1 / (1 + np.exp(-(dense([named(text)]) @ w)[0])))


def test_counterfactual_penalty_against_a_plain_fit(spark):
    """Insults that the labels tie to women move women's mere mention without the penalty only."""
    rng = random.Random(9)
    said = ["house", "tree", "river", "cloud", "stone", "grass", "road"]
    texts, y = [], []
    for i in range(240):
        words = rng.choices(said, k=6)
        toxic = i % 3 == 0
        words += ([rng.choice(["idiot", "moron"])] if rng.random() < 0.8 else []) + (["women"] if rng.random() < 0.7 else []) if toxic else rng.choices(["men", "women", "idiot", "tree"], [6, 3, 1, 5])
        texts.append(" ".join(words) + f" {i}")
        y.append(int(toxic))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(y)], "doc_id long, toxic int")
    learned = [k for k in range(240) if not held_out(k, 4, 2)]
    probes = ["the women by the river", "the men by the river", "an idiot by the river", "a tree", "moron men", ""]
    got = {}
    for c in (0.0, toxicity.COUNTERFACTUAL):
        model, plain = toxicity.fit(docs, labels, counterfactual=c), plain_toxicity([texts[k] for k in learned], [y[k] for k in learned], c)
        got[c] = [model.score(p) for p in probes]
        assert got[c] == pytest.approx([plain(p) for p in probes], abs=0.06)
    logit = lambda p: np.log(p / (1 - p))
    spread = {c: abs(logit(s[0]) - logit(s[1])) for c, s in got.items()}
    assert spread[0.0] > 1 and spread[toxicity.COUNTERFACTUAL] < 0.3 * spread[0.0]
    assert got[toxicity.COUNTERFACTUAL][4] > 0.3 > got[toxicity.COUNTERFACTUAL][3]


def test_quality(spark, corpus):
    """Ridge on random features, solved whole, then isotonic steps: equal to the partition sums."""
    where, rows = corpus
    x = np.stack([quality.statistics_of(t) for _, t in rows])
    learned = [k for k, (i, _) in enumerate(rows) if i is not None and i < 300 and not held_out(i, 5, 0)]
    y = np.array([int(rows[k][0] % 5 != 0) for k in learned], float)
    model = quality.QualityModel(x[learned].mean(axis=0), np.maximum(x[learned].std(axis=0), 1e-3))
    z = model.z(x[learned])
    model.weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    slot = np.clip(((model.raw(x[learned]) + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(slot)
    model.edges = (bins + 0.5) / quality.BINS * 2 - 0.5
    model.steps = quality.isotonic(np.array([y[slot == b].mean() for b in bins]), np.array([(slot == b).sum() for b in bins], float))
    want = model.score(x)
    got = entries.op10_quality(spark, where).collect()
    assert len(got) == len(rows)
    plain = {i: s for (i, _), s in zip(rows, want)}
    for r in got:
        assert r["score"] == pytest.approx(plain[r["doc_id"]], abs=1e-3) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == held_out(r["doc_id"], 5, 0)
    assert len({round(s, 9) for s in want[:300]}) > 20  # ranks, not two values


@pytest.mark.parametrize("name", ["op2_byte_bpe", "op3_language", "op6_toxicity", "op7_licences", "op8_token_files", "op9_near_duplicates", "op10_quality"])
def test_empty_tables(spark, corpus, name):
    assert entries.QUERIES[name](spark, corpus[0] + "/none").count() == 0


def page_of(rng, n):
    """A page and its article's text."""
    said = lambda k: " ".join(rng.choice(["stone", "über", "a&amp;b", "<i>river</i>", "x &lt; y"]) for _ in range(k)) + rng.choice([".", ", so.", "!"])
    plain = lambda s: s.replace("<i>", "").replace("</i>", "").replace("&amp;", "&").replace("&lt;", "<")
    parts, text = [], []
    for k in range(n):
        body = said(rng.randrange(1, 60))
        kind = rng.choice(["p", "h2", "li", "br", "blockquote"])
        parts.append({"p": f"<p title=it's>{body}</p>", "h2": f"<h2>{body}</h2>", "li": f"<ul><li>{body}</ul>", "br": f"<p>{body}<br>\n {body}", "blockquote": f'<blockquote class="search-term" a="x>y">{body}</blockquote>'}[kind])
        text += [plain(body)] * (2 if kind == "br" else 1)
        if rng.random() < 0.3:
            parts.append(rng.choice(["<script>if (a < b) { x('</p>') }</script>", "<!-- <p>no</p> -->", '<div class="ad banner">Buy this, now.</div>', "<form><input> <button>Send</button></form>"]))
    menu = "".join(f'<li><a href="/{k}">Part {k}</a>' for k in range(6))
    comments = "".join(f"<p>I disagree, strongly, with all of this, and with {k}.</p>" for k in range(rng.randrange(3)))
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul>{menu}</ul></nav><article>{''.join(parts)}</article><section id=comments>{comments}</section><footer>&copy; us, 2020.</footer></body></html>", "\n".join(text)


def test_page_text(spark, tmp_path):
    rng = random.Random(6)
    made = [page_of(rng, rng.randrange(1, 12)) for _ in range(60)] + [page_of(rng, 3_000)]
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(made)] + [(90, None, None, "x"), (91, "u", "", "x"), (3, "u3", made[3][0], "x"), (None, "u", "<p>no end, of text", "x")]
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(made)] + [(90, None, "", 0), (91, "u", "", 0), (3, "u3", made[3][1], len(made[3][1])), (None, "u", "no end, of text", 15)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    assert by_row(entries.op5_page_text(spark, str(tmp_path)).collect()) == by_row(want)


BETWEEN = [
    ("<p title=it's>odd attribute</p>", ["odd attribute"]), ("<math><mi>x</mi><mo>=</mo></math>", ["x="]), ("<noscript>shown</noscript>", ["shown"]), ("<p class='search-term'>a term</p>", ["a term"]),
    ("<button>press", []), ("<datalist><option>x<option>y</datalist>", []), ("<ul><li>One<li>Two</ul>", ["One", "Two"]), ("<h2>Hi</h2>", ["Hi"]), ("<div class=ad>Buy, now.</div>", []),
    ("<ul><li><a href=x>ref</a></ul>", ["ref"]), ("<svg><text>no</text></svg>", []), ('<p a="x>y">kept</p>', ["kept"]), ("<select><option>a</select>", []), ("<div class='social share'>Share this, now.</div>", []),
]


@pytest.mark.parametrize(("between", "kept"), BETWEEN)
def test_elements_within_an_article(between, kept):
    first, last = "Some text, which is long enough, and has commas. It goes on, and on.", "Another paragraph, with some words in it, and an end."
    assert pagetext.main_text(f"<article><p>{first}</p>{between}<p>{last}</p></article>").split("\n") == [first, *kept, last]


def test_ratios_select_where_names_say_nothing():
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(5)) + "</ul></div>"
    story = ["Head", "A long paragraph of text, with some commas, and more.", "Another long paragraph, again with words, here."]
    page = f"<html><body>{links}<div><h2>{story[0]}</h2><p>{story[1]}</p><p>{story[2]}</p></div></body></html>"
    assert pagetext.main_text(page).split("\n") == story
    value = pagetext.path_values(pagetext.blocks_of(page))
    assert value["/html/body/div/ul/li"] < pagetext.SHARE * value["/html/body/div/p"]


def test_comments_and_notices_of_unmarked_and_short_pages():
    note = "<div><h1>Short note</h1><p>One short paragraph, here.</p></div>"
    comments = "".join(f"<div><p>I disagree, strongly, with everything said above; it is wrong, and here is a long explanation of why, number {i}.</p></div>" for i in range(12))
    for name in ("section id='discussion'", "div class='comment-list'", "div class='user comments'"):
        assert pagetext.main_text(f"<html><body>{note}<{name}>{comments}</{name.split()[0]}></body></html>") == "Short note\nOne short paragraph, here."
    story = "<article><h1>Title of it</h1><p>" + "A story with words, and more. " * 9 + "</p></article>"
    for name in ("disclaimer-box", "x9"):
        notice = f"<div class='{name}'><p>" + "This is for information, without warranty, and so on. " * (20 if name != "x9" else 3) + "</p></div>"
        assert "warranty" not in pagetext.main_text(f"<html><body>{story}{notice}</body></html>")
    main = "<div><h2>Main</h2>" + "<p>The main text goes on, and on, in a plain division, for long.</p>" * 9 + "</div>"
    cards = "".join(f"<article class='card'><h3>Story {i}</h3><p>Read it.</p></article>" for i in range(4))
    assert pagetext.main_text(f"<html><body>{main}{cards}</body></html>").count("goes on") == 9


def test_deep_pages_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    assert pagetext.main_text("<div>" * 100_000 + "Text, here." + "</div>" * 100_000) == "Text, here."
    assert pagetext.main_text("<div>x, y" * 20_000 + "</p></b></li>" * 20_000).count("x, y") == 20_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_pipeline_against_plain_stages(spark, corpus, tmp_path):
    """Every stage's decisions, from plain versions of them, on all that the stage before kept."""
    import re

    import corpus_pipeline

    where, _ = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    copies = ["w1 w2 w3 w4 w5 w6 " * 3 + " ".join(f"v{k}" for k in range(40)) + e for e in ("", " more", " and more")]
    more = [(1000, "before " + passage + " after"), (1001, "12 34"), (1002, "clean words of a house by the river"), *((1010 + i, t) for i, t in enumerate(copies))]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "1L n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.selectExpr("doc_id", "make_valid_utf8(text) text").collect()]
    rows = [(i, t) for i, t in rows if model.score(t) < corpus_pipeline.TOXIC_SCORE]
    rows = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]  # one language is learned, and sure
    sets = []
    for _, t in rows:
        w = re.findall(r"[^ \t\n\r\f\v]+", t.lower())
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and (rows[a][0] == rows[b][0] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    kept = {i: t for k, (i, t) in enumerate(rows) if i is None or least[find(k)] == i}
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    kept = {i: t for i, t in kept.items() if f" {' '.join(plain(passage)[:10])} " not in f" {' '.join(plain(t))} " and f" {' '.join(plain(passage)[1:])} " not in f" {' '.join(plain(t))} "}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted(kept, key=str) and len(kept) > 100
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path(bytebpe.VOCABULARY)), special_tokens={})
    for r in got:
        assert r["round_trip"] and list(r["ids"]) == library.encode_ordinary(kept[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_pipeline_on_empty_tables_and_with_clashing_columns(spark, tmp_path):
    """Empty tables give no rows; further columns, named like the stages' own, change nothing."""
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["house", "tree", "river", "cloud", "idiot"], [9, 9, 9, 9, 1], k=12)), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t, *_ in rows], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string")
    clashing = {k: f"{n} `{k}`" for n, k in enumerate(["score", "language", "ids", "row", "w", "node", "band", "key", "toxicity", "__id", "__row", "n_tokens"])}
    kept = {}
    for name, frame in (("plain", docs), ("clashing", docs.selectExpr("*", *clashing.values())), ("none", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name != "none" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        (items if name != "none" else items.limit(0)).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        kept[name] = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
    assert kept["none"] == [] and len(kept["plain"]) > 10 and kept["clashing"] == kept["plain"]


def test_further_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some item of ten words or more, which is one window")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op1_decontamination", "op4_top_k", "op5_page_text"):
        assert entries.QUERIES[name](spark, str(tmp_path)).count() == 0
