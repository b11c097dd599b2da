"""Queries over structures that are built first: strong components, stored indexes, stores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import language_of, line_count
from lodestrata.operators import explore, findings, graph, motifs, substrings, textindex, vectorindex
from lodestrata.plans import answers
from lodestrata.plans import fixtures as fx
from lodestrata.plans import more_queries as m
from lodestrata.plans import queries as q
from lodestrata.plans import store
from lodestrata.plans.queries import query, table
from lodestrata.session import shared_path
from lodestrata.sources import files, manifests
from lodestrata.streaming import progress, state

# --------------------------------------------------------- strong components

_BACK = "back as (select distinct 's' || l_suppkey as src, 'c' || o_custkey as dst from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and l_linenumber >= 7)"


def _purchases_and_returns(spark, d) -> DataFrame:
    """Who bought from whom, and from whom a seventh line came back."""
    who = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_linenumber >= 7").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("src")).join(who, "l_orderkey")
    return m._purchases(spark, d)[1].union(back.select("src", "dst").distinct())


@query(f"""with recursive {m._PURCHASES}, {_BACK}, hops as (select distinct b.src as a, e.dst as b from back b join bought e on e.src = b.dst),
reach as (select distinct dst as a, dst as b from bought union select r.a, h.b from reach r join hops h on h.a = r.b),
led as (select distinct r.a as s, k.dst as c from reach r join back k on k.src = r.b), away as (select distinct e.src as c, r.b as s from bought e join reach r on r.a = e.dst),
joint as (select s, c from led join away using (s, c)), mutual as (select x.a as s, x.b as o from reach x join reach y on y.a = x.b and y.b = x.a union all select s, c from joint),
least_of as (select s, min(o) as component from mutual group by s)
select s as id, component from least_of union all select e.c, coalesce(min(component), e.c) from (select distinct src as c from bought) e left join joint using (c) left join least_of using (s) group by e.c""")
def strong_components(spark, d):
    """Purchases and returns: a customer and a supplier are together if each leads to the other."""
    return graph.strong_components(_purchases_and_returns(spark, d))


_PLACED = "placed as (select lang, n_chars % 50 as g, doc_id, row_number() over w as rn, count(*) over (partition by lang, n_chars % 50) as n from documents window w as (partition by lang, n_chars % 50 order by doc_id))"


@query(f"""with {_PLACED} select p.doc_id as id, case when p.g % 7 = 0 then (select min(doc_id) from placed x where x.lang = p.lang and x.g = p.g)
when p.rn % 5 <> 1 and p.rn + (5 - p.rn % 5) % 5 <= p.n then (select x.doc_id from placed x where x.lang = p.lang and x.g = p.g and x.rn = p.rn + (5 - p.rn % 5) % 5 - 3) else p.doc_id end as component
from placed p where p.n > 1""")
def chained_strong_components(spark, d):
    """Chains of documents with a way back over three of them at each fifth, and from the last
    to the first of every seventh chain."""
    group = Window.partitionBy("lang", "g")
    chain = group.orderBy("doc_id")
    rows = table(spark, d, "documents").withColumn("g", F.col("n_chars") % 50)
    rows = rows.select("g", "doc_id", F.lag("doc_id").over(chain).alias("before"), F.lag("doc_id", 3).over(chain).alias("third"), F.row_number().over(chain).alias("rn"), F.min("doc_id").over(group).alias("first"), F.max("doc_id").over(group).alias("last"))
    edge = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    edges = F.array(edge("before", "doc_id"), F.when(F.col("rn") % 5 == 0, edge("doc_id", "third")), F.when((F.col("g") % 7 == 0) & (F.col("doc_id") == F.col("last")), edge("doc_id", "first")))
    links = rows.select(F.explode(edges).alias("e")).select("e.*").filter("src is not null and dst is not null and src <> dst")
    return graph.strong_components(links)


# ------------------------------------------------------------- stored indexes

_WORDS = "w as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as term from documents)"


def _text_index(spark, d) -> textindex.TextIndex:
    return textindex.built(spark, shared_path(spark, "text-index"), table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"])


def _scored(hits: str, total: str, key: str = "doc_id") -> str:
    """SQL that ranks (word, key, n) as a search does."""
    return f"""h as ({hits}), df as (select word, count(*) as df from h group by word)
select {key} as key, round(sum(n * ln(1 + ({total}) / df)), 4) as score, count(*) as matched from h join df using (word) group by {key} order by score desc, key limit 10"""


@query(f"with {_WORDS} select term, count(distinct doc_id) as documents, count(*) as n from w group by term")
def index_terms(spark, d):
    """The dictionary of an index of all documents."""
    return _text_index(spark, d).terms()


@query(f"with {_WORDS}, {_scored('select term as word, doc_id, count(*) as n from w where term in (' + repr('licensed') + ', ' + repr('apache') + ', ' + repr('mit') + ') group by all', 'select count(*) from documents')}")
def index_search(spark, d):
    return _text_index(spark, d).search(["licensed", "apache", "MIT"])


@query(f"with {_WORDS}, a as (select word, doc_id, count(*) as n from w, (values ('licen'), ('a'), ('zz')) v(word) where starts_with(term, word) group by all), {_scored('from a', 'select count(*) from documents')}")
def index_prefix_search(spark, d):
    return _text_index(spark, d).search(["licen", "a", "zz"], prefix=True)


@query(f"with {_WORDS}, a as (select word, doc_id, count(*) as n from w, (values ('licensd'), ('apachee'), ('mit')) v(word) where levenshtein(term, word) <= 1 group by all), {_scored('from a', 'select count(*) from documents')}")
def index_fuzzy_search(spark, d):
    return _text_index(spark, d).search(["licensd", "apachee", "mit"], fuzzy=True)


@query(f"with u as (select doc_id, case when doc_id % 7 = 0 then 'mit ' || text else text end as text from documents where doc_id % 11 <> 0), {_WORDS.replace('from documents', 'from u')}, "
       f"{_scored('select term as word, doc_id, count(*) as n from w where term in (' + repr('licensed') + ', ' + repr('mit') + ') group by all', 'select count(*) from u')}")  # fmt: skip
def index_updated_search(spark, d):
    """Four fifths indexed, the rest added, a seventh replaced and an eleventh removed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = textindex.built(spark, shared_path(spark, "text-index"), docs.filter("doc_id % 5 <> 0"), "doc_id", ["text"])
    gone = docs.filter("doc_id % 11 = 0").select(F.col("doc_id").alias("key"))
    index.update(docs.filter("doc_id % 5 = 0"), "doc_id", ["text"])
    index.update(docs.filter("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("mit "), "text")), "doc_id", ["text"])
    index.remove(gone)
    return index.search(["licensed", "mit"])


@query("""with t as (select page_id, unnest(list_filter(string_split_regex(lower(url), '[^a-z0-9]+'), lambda x: x <> '')) as term from pages),
""" + _scored("select term as word, page_id, count(*) as n from t where term in ('example', 'en') group by all", "select count(*) from pages", "page_id"))  # fmt: skip
def index_field_search(spark, d):
    """One field of an index of two."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.regexp_replace("html", "<[^>]*>", " ").alias("content"))
    index = textindex.built(spark, shared_path(spark, "text-index"), pages, "page_id", ["path", "content"])
    return index.search(["example", "en"], fields=["path"])


def _vector_index(spark, d) -> vectorindex.VectorIndex:
    return vectorindex.built(spark, shared_path(spark, "vector-index"), table(spark, d, "embeddings"), "vec_id", "embedding")


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _ranked_vectors(rows: str) -> str:
    return f"""select query, cast(rank as integer) as rank, key, score from (select *, row_number() over (partition by query order by score desc, key) as rank from
(select q.vec_id as query, r.vec_id as key, round(list_cosine_similarity(q.embedding :: double[], r.embedding :: double[]), 6) as score from embeddings q, {rows} r where q.vec_id % 20 = 0)) where rank <= 5"""


@query(_ranked_vectors("embeddings"))
def vector_index_exact(spark, d):
    """Every twentieth vector against all, by bounds of the lists' radii."""
    return _vector_index(spark, d).search(_asked(spark, d), 5, probes=2, exact=True)


@query(_ranked_vectors("(from embeddings where label % 3 = 1)"))
def vector_index_filtered(spark, d):
    return _vector_index(spark, d).search(_asked(spark, d), 5, probes=2, exact=True, where=F.col("label") % 3 == 1)


@query(_ranked_vectors("(select vec_id, case when vec_id % 7 = 0 then list_transform(embedding, lambda x: -x) else embedding end as embedding from embeddings where vec_id % 11 <> 0)"))
def vector_index_updated(spark, d):
    """Four fifths indexed, the rest added, a seventh turned round and an eleventh removed."""
    rows = table(spark, d, "embeddings")
    index = vectorindex.built(spark, shared_path(spark, "vector-index"), rows.filter("vec_id % 5 <> 0"), "vec_id", "embedding")
    index.update(rows.filter("vec_id % 5 = 0"), "vec_id", "embedding")
    index.update(rows.filter("vec_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "vec_id", "embedding")
    index.remove(rows.filter("vec_id % 11 = 0").select(F.col("vec_id").alias("key")))
    return index.search(_asked(spark, d), 5, exact=True)


@query("select count(*) as queries, true as enough from embeddings where vec_id % 20 = 0")
def vector_index_recall(spark, d):
    """Whether the default probes find nine tenths of what a full scan finds."""
    index, asked = _vector_index(spark, d), _asked(spark, d)
    right = index.search(asked, 10, exact=True).select("query", "key")
    share = F.count("found") / F.count(F.lit(1))
    found = index.search(asked, 10).select("query", "key", F.lit(1).alias("found"))
    return right.join(found, ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), (share >= 0.9).alias("enough"))


# ------------------------------------------------------------ substring joins


@query("""with needles as (select substr(lower(n_name), 1, 1 + n_nationkey % 5) as word from nation union select ''), texts as (select distinct unnest(regexp_extract_all(lower(text), '[\\pL]+')) as text from documents)
select distinct word, text from needles join texts on contains(text, word) where word <> ''""")
def substring_pairs(spark, d):
    """Beginnings of nations' names in the distinct words of all documents."""
    words = table(spark, d, "nation").select(F.expr("substr(lower(n_name), 1, 1 + n_nationkey % 5)").alias("word")).union(spark.range(1).select(F.lit("")))
    texts = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("text"))
    return substrings.held("word", words, "text", texts)


# -------------------------------------------------------------- keyed streams

LATE, TTL_MINUTES = "10 minutes", 150


def _followed(spark, d) -> str:
    """The checkpoint of a stream of all events, in four parts by time."""
    events, where = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), shared_path(spark, "events")
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * 4 / (last - first + 1))
    for i in range(4):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(where)
    told = state.changes(stream, F.col("user_id"), F.col("ts"), F.col("event_id"), TTL_MINUTES * 60_000, LATE, keep=5)
    checkpoint = shared_path(spark, "states")
    state.follow(told, shared_path(spark, "changes"), checkpoint).awaitTermination()
    return checkpoint


_LIVE = f"live as (select user_id from events group by user_id having epoch_ms(max(ts)) + {TTL_MINUTES * 60_000} > (select epoch_ms(max(ts)) - 600000 from events))"


@query(f"with {_LIVE} select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) join live using (user_id) where rn = 1")
def stream_states(spark, d):
    """What a late subscriber gets: the last state of each user who hasn't expired."""
    said = F.from_json("said", "user_id long, event_id long, event_type string").alias("e")
    return state.states(spark, _followed(spark, d)).select(said).select("e.*")


@query(f"with {_LIVE} select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) join live using (user_id) where rn <= 5")
def stream_history(spark, d):
    """Each live user's last five events."""
    return state.history(spark, _followed(spark, d)).select(F.from_json("said", "user_id long, event_id long").alias("e")).select("e.*")


# -------------------------------------------------------------- result stores

_STORED = "stored as (select lang as repo_id, doc_id, n_chars from documents where lang <> 'fr' and (lang <> 'de' or doc_id % 2 = 0) union all select 'en', -doc_id, null from documents where lang = 'en' and doc_id % 10 = 3)"


@query(f"with {_STORED} select repo_id, count(*) as files, cast(sum(n_chars) as bigint) as chars, min(doc_id) as first from stored group by repo_id")
def stored_repositories(spark, d):
    """Each language a repository: all are saved, German again with half of its files, English
    is appended to, and French deleted."""
    docs, kept = table(spark, d, "documents").select("lang", "doc_id", "n_chars"), store.ResultStore(spark, shared_path(spark, "results"))
    for lang in [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]:
        kept.save(lang, {"files": docs.filter(F.col("lang") == lang).drop("lang")})
    kept.save("de", {"files": docs.filter("lang = 'de' and doc_id % 2 = 0").drop("lang")})
    kept.append("en", "files", docs.filter("lang = 'en' and doc_id % 10 = 3").select((-F.col("doc_id")).alias("doc_id")))
    kept.delete("fr")
    return kept.read("files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))


# ---------------------------------------------------------------- many paths

_PAIRS = "pairs as (select 'c' || c_custkey as src, 'c' || (c_custkey * 7 + 13) % (select count(*) from customer) as dst from customer where c_custkey <= 100)"


@query(f"""with recursive {m._PURCHASES}, {_PAIRS}, ways as (select src, dst from bought union select dst, src from bought),
reach as (select src, dst, src as id, 0 as hops from pairs union select r.src, r.dst, w.dst, hops + 1 from reach r join ways w on w.src = r.id where hops < 6)
select src, dst, cast(min(hops) as integer) as hops from reach where id = dst group by src, dst""")
def distances_purchases(spark, d):
    """A hundred pairs of customers, by purchases from common suppliers."""
    customers = table(spark, d, "customer")
    other = (F.col("c_custkey") * 7 + 13) % F.lit(customers.count())
    pairs = customers.filter("c_custkey <= 100").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("c"), other).alias("dst"))
    return graph.shortest_paths(m._purchases(spark, d)[1], pairs, 6).select("src", "dst", (F.size("path") - 1).alias("hops"))


@query(f"""with {m._PURCHASES}, {_BACK}, e as (from bought union from back), target as (select min(dst) as t from bought where src = 'c1')
select array_to_string(path, '>') as path, len(path) - 1 as depth from (select [src, dst] as path from e, target where src = 'c2' and dst = t
union all select [a.src, a.dst, b.dst, c.dst] from e a join e b on b.src = a.dst join e c on c.src = b.dst, target where a.src = 'c2' and a.dst <> t and b.dst <> 'c2' and c.dst = t)""")
def paths_purchases(spark, d):
    """Directed ways from one customer to a supplier, over purchases and returns."""
    edges = _purchases_and_returns(spark, d)
    target = m._purchases(spark, d)[1].filter("src = 'c1'").agg(F.min("dst")).first()[0]
    return graph.paths(edges, "c2", target, 4).select(F.array_join("path", ">").alias("path"), F.col("depth").cast("long").alias("depth"))


# -------------------------------------------------------------------- motifs

_MARKET = """market as (select 'c' || o_custkey as src, 'o' || o_orderkey as dst, 'PLACED' as type from orders union select 'o' || l_orderkey, 's' || l_suppkey, 'FROM' from lineitem
union select 'c' || c_custkey, 'n' || c_nationkey, 'LIVES' from customer union select 's' || s_suppkey, 'n' || s_nationkey, 'LIVES' from supplier)"""


def _market(spark, d) -> DataFrame:
    """Who placed which orders, which suppliers they came from, and where all live."""

    def edge(name: str, a: str, src: str, b: str, dst: str, kind: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"), F.lit(kind).alias("type"))

    parts = [edge("orders", "c", "o_custkey", "o", "o_orderkey", "PLACED"), edge("lineitem", "o", "l_orderkey", "s", "l_suppkey", "FROM"), edge("customer", "c", "c_custkey", "n", "c_nationkey", "LIVES"), edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "LIVES")]
    return reduce(DataFrame.union, parts).distinct()


@query(f"with {_MARKET} select a.src as c, a.dst as o, b.dst as s, h.dst as n from market a join market b on b.src = a.dst join market h on h.src = a.src join market g on g.src = b.dst and g.dst = h.dst where a.type = 'PLACED' and b.type = 'FROM' and h.type = 'LIVES' and g.type = 'LIVES'")
def motif_home_orders(spark, d):
    """Orders from a supplier in the customer's own nation: a cycle of four hops."""
    return motifs.match(_market(spark, d), [motifs.Hop("c", "PLACED", "o"), motifs.Hop("o", "FROM", "s"), motifs.Hop("c", "LIVES", "n"), motifs.Hop("s", "LIVES", "n")])


@query(f"""with {_MARKET} select o, x, y, n from (select a.src as o, a.dst as x, b.dst as y, h.dst as n from market a join market b on b.src = a.src and b.dst <> a.dst join market h on h.src = a.dst join market g on g.src = b.dst and g.dst = h.dst
where a.type = 'FROM' and b.type = 'FROM' and h.type = 'LIVES' and g.type = 'LIVES') where n in ('n3', 'n4')""")
def motif_two_suppliers(spark, d):
    """Two suppliers of one order in one of two nations; an edge doesn't serve twice."""
    some = table(spark, d, "nation").filter("n_nationkey in (3, 4)").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return motifs.match(_market(spark, d), [motifs.Hop("o", "FROM", "x"), motifs.Hop("o", "FROM", "y"), motifs.Hop("x", "LIVES", "n"), motifs.Hop("y", "LIVES", "n")], {"n": some})


@query(f"""with {_MARKET}, one as (select src, dst from market), two as (select distinct a.src, b.dst from one a join one b on b.src = a.dst), far as (select * from one union select * from two union select distinct a.src, b.dst from two a join one b on b.src = a.dst)
select f.src as c, f.dst as n from far f join market h on h.src = f.src and h.dst = f.dst and h.type = 'LIVES' join two t on t.src = f.src and t.dst like 's%' group by f.src, f.dst""")
def motif_bounded_hops(spark, d):
    """Customers and the nation that they live in and reach over one to three edges of any kind."""
    found = motifs.match(_market(spark, d), [motifs.Hop("c", None, "n", 1, 3), motifs.Hop("c", "LIVES", "n"), motifs.Hop("c", None, "s", 2, 2)], {"s": table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))})
    return found.select("c", "n").distinct()


# ------------------------------------------------- files, formats, progress


@query("""select doc_id, octet_length(encode(text)) + 1 as size_bytes, 'Python' as language,
len(string_split_regex(replace(text || chr(10), chr(13) || chr(10), chr(10)), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) - 1 as lines from documents""")
def scanned_tree(spark, d):
    """Every document as a file of a tree, found by a scan."""
    where = shared_path(spark, "tree")
    # a number for each row, as ids may be repeated or null; and whether there is no text
    name = F.concat_ws("-", F.monotonically_increasing_id(), "doc_id", F.when(F.col("text").isNull(), F.lit("none")))
    files.write_tree(q.texts(spark, d, "doc_id", "text").select(F.concat(name, F.lit(".py")).alias("name"), "text"), where)
    found = files.scan(spark, where, "r", local=False, most=2**31 - 1)
    part = lambda n: F.regexp_extract("path", r"\d+(?:-(-?\d+))?(-none)?\.py", n)
    known = lambda value: F.when(part(2) == "", value)
    return found.select(
        part(1).try_cast("long").alias("doc_id"), known(F.col("size_bytes")).alias("size_bytes"), language_of(part(0)).alias("language"), known(line_count(F.col("content")).cast("long")).alias("lines")
    )


@query(" union all ".join(f"select '{kind}' as kind, event_type, count(*) as n, cast(sum(user_id) as bigint) as users from events group by event_type" for kind in ("parquet", "orc", "json", "csv", "keyed")))
def stored_formats(spark, d):
    """Events stored and read in each format, and by key with one key replaced."""
    events, parts = table(spark, d, "events").select("event_id", "user_id", "event_type"), []
    for kind in ("parquet", "orc", "json", "csv"):
        where = shared_path(spark, kind)
        events.write.format(kind).save(where)
        parts.append(spark.read.schema(events.schema).format(kind).load(where).withColumn("kind", F.lit(kind)))
    where = shared_path(spark, "keyed")
    files.write_table(events.withColumn("user_id", F.when(F.col("event_type") == "click", F.lit(0)).otherwise(F.col("user_id"))), where, "event_type")
    files.write_table(events.filter("event_type = 'click'"), where, "event_type")
    parts.append(files.read_table(spark, where).select("event_id", "user_id", "event_type").withColumn("kind", F.lit("keyed")))
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("select repo_id, status, progress from (select cast(user_id as varchar) as repo_id, event_type as status, cast(value as double) as progress, row_number() over (partition by user_id order by ts desc, value desc, event_type desc) rn from events) where rn = 1")
def published_progress(spark, d):
    """Events as progress messages, streamed to a subscriber that keeps the last of each user."""
    where, kept = shared_path(spark, "messages"), shared_path(spark, "kept")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("repo_id"), F.lit("j").alias("scan_job_id"), F.col("event_type").alias("status"), F.lit("").alias("phase"), F.col("value").cast("double").alias("progress"), F.lit("").alias("message"), F.col("ts").cast("timestamp").alias("timestamp"))
    rows.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(where)
    stream = progress.events(spark, where, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    progress.publish(stream, f"progress-{uuid.uuid4().hex}", shared_path(spark, "checkpoint"), lambda batch: batch.write.mode("append").parquet(kept)).awaitTermination()
    return progress.latest_state(spark.read.parquet(kept), "repo_id", ["timestamp", "progress", "status"]).select("repo_id", "status", "progress")


@query("select repo_id, scan_job_id, status, n from (values ('completed', 1), ('failed', 2)) v(status, i), (select lang as repo_id, lang || '-job' as scan_job_id, count(*) as n from documents group by lang)")
def stored_jobs(spark, d):
    """Two jobs of each language as a repository; the second save takes the first's results' place, but not its job."""
    docs, kept = table(spark, d, "documents").select("lang", "doc_id"), store.ResultStore(spark, shared_path(spark, "results"))
    for r in docs.groupBy("lang").count().orderBy("lang").collect():
        for status in ("completed", "failed"):
            kept.save(r["lang"], {"files": docs.filter(F.col("lang") == r["lang"])}, (f"{r['lang']}-job", status, 100.0, "{}", "{}"))
    n = kept.read("files").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return kept.read("jobs").join(n, "repo_id").select("repo_id", "scan_job_id", "status", "n")


_PACKAGED = ("path string, content string", [
    ("package.json", '{"name": "web", "description": "A site.", "scripts": {"dev": "vite", "build": "vite build", "a": "1", "b": "2", "c": "3", "d": "4", "e": "5"}}'), ("x/package.json", '{"name": "none"}'), ("y/package.json", "not json"), ("setup.py", "{}"),
], ("supplier", "s_suppkey", {"path": "'r' || k || '/' || path", "content": "replace(content, 'vite', 'vite' || k)"}, "true"))


@query(f"""select path as file_path, coalesce(content ->> '$.name', '') as title, coalesce(content ->> '$.description', '') as description,
coalesce(array_to_string(list_transform(json_keys(content, '$.scripts')[:6], lambda k: 'npm run ' || k || ': ' || json_extract_string(content, '$.scripts.' || k)), ';'), '') as commands
from {fx.woven_sql(_PACKAGED)} where path like '%/package.json' and json_valid(content)""")
def package_context(spark, d):
    """What package files say where there is no documentation."""
    found = explore.package_context(fx.woven(spark, d, _PACKAGED))
    return found.select("file_path", "title", "description", F.array_join("commands", ";").alias("commands"))


@query("select (select count(*) from documents) as documents, null :: bigint as missing, (select count(*) from events) as events")
def partial_summary(spark, d):
    """A source that fails is null, and the others count."""
    return explore.reached(documents=lambda: table(spark, d, "documents"), missing=lambda: table(spark, d, "no_such_table"), events=lambda: table(spark, d, "events"))


# ------------------------------------------------------------------- answers


def _listed(title: str, rows: str, line: str, top: int, none: str | None = None) -> str:
    """SQL of a title and the first rows of a table (with its order as n), or of what is said without any."""
    return f"(select case when count(*) > 0 then '{title}' || chr(10) || string_agg(case when n <= {top} then {line} end, chr(10) order by n) {f'else {q._quote(none)}' if none else ''} end from {rows})"


def _answered(intent: str, tables: str, parts: list[str], cited: str = "''") -> str:
    return f"with {tables} select '{intent}' as intent, concat_ws(chr(10), {q._quote(answers.BUILDERS[intent][0])}, {', '.join(parts)}) as answer, {cited} as cited"


def _cited(rows: str, top: int, reference: str, snippet: str) -> str:
    return f"(select string_agg(case when n <= {top} then {reference} || '=' || {snippet} end, ';' order by n) from {rows})"


@query(_answered("performance", f"o as (select *, row_number() over (order by file_path, line_no, name) as n from ({q.SQL['n_plus_one_functions']}))",
                 ["'- Performance findings: ' || (select count(*) from o)", _listed("Found:", "o", "'- [' || upper(type) || '] ' || name || ' at ' || file_path || ':' || line_no", 8)], _cited("o", 6, "file_path || ':' || line_no", "type || ' ' || name")))
def answer_performance(spark, d):
    return m._said(answers.answer(spark, {"performance": q.QUERIES["n_plus_one_functions"](spark, d)}, "performance"))


@query(_answered("apis", f"o as (select *, row_number() over (order by handler, path, method) as n from ({q.SQL['api_endpoints']})), f as ({q.SQL['frameworks_detected']})",
                 ["'- Endpoints: ' || (select count(*) from o)", "(select '- Frameworks: ' || string_agg(framework, ', ' order by framework) from f)", _listed("Found:", "o", "'- ' || upper(method) || ' ' || path || ' -> ' || handler || '() in ' || handler || '.py'", 15)],
                 _cited("o", 5, "handler || '.py'", "method || ' ' || path")))
def answer_apis(spark, d):
    """Each handler in a file of its own."""
    found = q.QUERIES["api_endpoints"](spark, d).withColumns({"file_path": F.concat("handler", F.lit(".py")), "line_no": F.lit(0)})
    return m._said(answers.answer(spark, {"endpoints": found, "frameworks": q.QUERIES["frameworks_detected"](spark, d)}, "apis"))


@query(_answered("debt", f"{q._DEBT}, o as (select *, row_number() over (order by priority, file_path, name, type) as n from debt), s as (select cast({q._DEBT_SCORE} as double) as score, round_even(sum(effort_hours), 1) as hours from debt)",
                 ["(select '- Debt score: ' || score || '/100, ' || hours || ' hours' from s)", "'- Items: ' || (select count(*) from o)", _listed("First to mend:", "o", "'- ' || type || ' ' || name || ' in ' || file_path", 8)], _cited("o", 4, "file_path", "type || ' ' || name")))
def answer_debt(spark, d):
    return m._said(answers.answer(spark, {"debt": q._debt(spark, d)}, "debt"))


_STARTS = ("path string", [("src/main.py",), ("app/index.ts",), ("lib/util.py",), ("manage.py",), ("domain.py",)], ("supplier", "s_suppkey", {"path": "'r' || k || '/' || path"}, "(k + length(path)) % 3 <> 0"))


@query(_answered("entry_points", f"o as (select *, row_number() over (order by path) as n from {fx.woven_sql(_STARTS)} where {' or '.join(f'lower(path) like {q._quote(chr(37) + x)}' for x in answers.ENTRY_FILES)})",
                 [_listed("Files:", "o", "'- ' || path", 8)], _cited("o", 8, "path", "'Entry point'")))
def answer_entry_points(spark, d):
    return m._said(answers.answer(spark, {"files": fx.woven(spark, d, _STARTS)}, "entry_points"))


@query(_answered("setup", f"r as (select * from ({q.SQL['readme_context']}) order by file_path limit 1), c as (select line, n from (select unnest(string_split(commands, ';')) as line, unnest(range(1, len(string_split(commands, ';')) + 1)) as n from r where commands <> '')), p as (select *, row_number() over (order by source) as n from (select source, count(*) as k from {fx.woven_sql(m._PACKAGES)} group by source))",
                 [_listed("Commands:", "c", "line", 3, "The documentation names no command."), _listed("Manifests:", "p", "'- ' || source || ': ' || k || ' packages'", 8)], "(select file_path || '=Documentation' from r)"))
def answer_setup(spark, d):
    return m._said(answers.answer(spark, {"readme": explore.readme(fx.woven(spark, d, fx.README)), "packages": manifests.packages(m._manifests(spark, d))}, "setup"))


@query(_answered("health", f"{q._DEBT}, r as (select cast({q._RISK} as double) as risk from ({q.SQL['union_findings']})), t as (select cast({q._DEBT_SCORE} as double) as owed from debt), s as (select count(*) as slow from ({q.SQL['n_plus_one_functions']}))",
                 ["(select '- Health score: ' || greatest(least(100 - least(risk, 50) - least(owed, 30) - least(2 * slow, 20), 100), 0) || '/100, from 100.0' from r, t, s)", "(select '- less ' || least(risk, 50.0 :: double) || ' for security risk' from r)",
                  "(select '- less ' || least(owed, 30.0 :: double) || ' for technical debt' from t)", "(select '- less ' || least(2 * slow, 20) || ' for ' || slow || ' performance findings' from s)"]))
def answer_health(spark, d):
    risk, slow = findings.risk_score(q.QUERIES["union_findings"](spark, d)), q.QUERIES["n_plus_one_functions"](spark, d)
    return m._said(answers.answer(spark, {"health": findings.health_score(risk, findings.debt_score(q._debt(spark, d)), slow)}, "health"))


@query(_answered("architecture", f"p as ({q.SQL['pattern_rules']}), o as (select *, row_number() over (order by tier) as n from ({q.SQL['tier_layers']})), c as (select tier, component, row_number() over (order by tier, component) as n from (select tier, unnest(string_split(components, ';')[:2]) as component from o))",
                 ["(select '- Pattern: ' || pattern || ', confidence ' || cast(round(confidence * 100) as integer) || '%' from p)", _listed("Layers:", "o", "'- ' || tier || ': ' || files || ' files; ' || replace(components, ';', ', ')", 20)], _cited("c", 8, "component", "tier || ' layer'")))
def answer_architecture(spark, d):
    tiers = q.QUERIES["tier_layers"](spark, d).withColumn("components", F.split("components", ";"))
    return m._said(answers.answer(spark, {"pattern": q.QUERIES["pattern_rules"](spark, d), "layers": tiers}, "architecture"))


@query(_answered("tech_stack", f"l as ({q.SQL['files_by_language']}), f as ({q.SQL['repository_facts']})",
                 ["(select '- Languages: ' || string_agg(language, ', ' order by files desc, language) || '; ' || sum(files) || ' files, ' || sum(files) || ' lines' from l)", "(select '- Frameworks: ' || replace(frameworks, ';', ', ') from f)", "(select '- Package managers: ' || replace(managers, ';', ', ') from f)",
                  f"'- Endpoints: ' || (select count(*) from ({q.SQL['api_endpoints']}))", f"'- Tables: ' || (select count(*) from ({q.SQL['discovered_tables']}))"]))
def answer_tech_stack(spark, d):
    """Each file counts as one line."""
    facts = q.QUERIES["repository_facts"](spark, d).select(F.split("frameworks", ";").alias("frameworks"), F.split("managers", ";").alias("package_managers"))
    languages = q.QUERIES["files_by_language"](spark, d).select("language", "files", F.col("files").alias("lines"))
    return m._said(answers.answer(spark, {"languages": languages, "facts": facts, "endpoints": q.QUERIES["api_endpoints"](spark, d), "tables": q.QUERIES["discovered_tables"](spark, d)}, "tech_stack"))


@query(_answered("explain", f"r as (select * from ({q.SQL['readme_context']}) order by file_path limit 1), f as (select unnest(string_split(features, ';')) as feature, unnest(range(1, len(string_split(features, ';')) + 1)) as n from r where features <> ''), p as ({q.SQL['pattern_rules']}), h as ({q.SQL['health_score']})",
                 ["(select nullif(description, '') from r)", _listed("Features:", "f", "'- ' || feature", 6), "(select '- Pattern: ' || pattern from p)", "(select '- Health score: ' || cast(round(health_score) as integer) || '/100' from h)"], "(select file_path || '=Documentation' from r)"))
def answer_explain(spark, d):
    said = {"readme": explore.readme(fx.woven(spark, d, fx.README)), "pattern": q.QUERIES["pattern_rules"](spark, d), "health": q.QUERIES["health_score"](spark, d)}
    return m._said(answers.answer(spark, said, "explain"))


@query(_answered("symbols", "o as (select 'Nation ' || n_name || ' in ' || n_name || '.py' as line, n_name as name, row_number() over (order by n_name) as n from nation where regexp_matches('did nation_3 or nation_12 trade with nation_7 and nation_99', '\\b' || lower(n_name) || '\\b') and not contains(n_name, ' '))",
                 [_listed("Named:", "o", "'- ' || line", 6, "The question names nothing that the graph holds.")], "(select coalesce(string_agg(case when n <= 6 then name || '.py=Nation ' || name end, ';' order by n), '') from o)"))
def answer_symbols(spark, d):
    """Nations as symbols that a question names."""
    n = table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(".py")).alias("file_path"), F.lit(None).cast("string").alias("docstring"))
    return m._said(answers.answer(spark, {"nodes": nodes}, "symbols", "did nation_3 or nation_12 trade with nation_7 and nation_99"))
