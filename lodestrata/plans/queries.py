"""The engine's queries over the data tables, each with its SQL.

Operators are generic; here the tables stand in for repositories: orders are
commits, customers authors, parts files, nations modules that trade with each
other, and lines of documents lines of source.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import discovery, explore, findings, graph, history, retrieval
from lodestrata.plans import fixtures as fx
from lodestrata.plans import rules
from lodestrata.session import cut, spread
from lodestrata.sources import manifests
from lodestrata.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the documents, on all cores however few files they are in."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


# ---------------------------------------------------------- counts and lines


@query("select lang as language, count(*) as files from documents group by lang")
def language_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("select count(*) as files, cast(sum(n_chars) as bigint) as chars, cast(sum(len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end) as bigint) as lines from documents")
def totals(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.sum(scalars.line_count(F.col("text"))).alias("lines"))


@query("""select doc_id, cast(len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end as integer) as n_lines,
cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) as integer) as loc from documents""")
def line_counts_loc(spark, d):
    return texts(spark, d, "doc_id", "text").select("doc_id", scalars.line_count(F.col("text")).alias("n_lines"), scalars.lines_of_code(F.col("text")).alias("loc"))


# ------------------------------------------------------------------- history

_COMMITS = "select o_orderkey as commit_id, o_custkey as author, o_orderpriority as name, o_orderdate as t, o_totalprice as price, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders"


def _commits(spark, d) -> DataFrame:
    """Orders as commits; seq orders them from the newest, and needs no global sort."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    seq = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), F.col("o_orderkey").alias("k"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("at"), cents.alias("insertions"), F.lit(1).cast("long").alias("deletions"), seq.alias("seq"))


def _commit_files(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")).distinct()


@query(f"""select author, count(*) as commits, cast(sum(case when n <= 5 then round(price * 100) else 0 end) as bigint) as insertions, cast(sum(case when n <= 5 then 1 else 0 end) as bigint) as deletions,
min(t) as first_at, max(t) as last_at, max(case when n = 1 then name end) as name from ({_COMMITS}) group by author""")
def contributor_stats(spark, d):
    c = _commits(spark, d)
    return history.contributors(c.withColumn("author", F.col("author")), gate=5)


@query("""select author, path, touches, rank from (select o_custkey as author, l_partkey as path, count(*) as touches, cast(row_number() over (partition by o_custkey order by count(*) desc, l_partkey) as integer) as rank
from orders join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey group by 1, 2) where rank <= 10""")
def owned_files_topk(spark, d):
    return history.owned_files(_commits(spark, d), _commit_files(spark, d), 10)


@query("""select l_partkey as path, count(*) as changes, count(distinct o_custkey) as authors from orders join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey
group by 1 order by changes desc, path limit 30""")
def hotspots(spark, d):
    return history.hotspots(_commits(spark, d), _commit_files(spark, d), top=30)


@query("""select a, b, count(*) as n from (select unnest([lead(path, 1) over w, lead(path, 2) over w, lead(path, 3) over w, lead(path, 4) over w]) as b, path as a
from (select distinct l_orderkey, p_brand as path from lineitem join part on p_partkey = l_partkey) window w as (partition by l_orderkey order by path)) where b is not null
group by a, b having count(*) >= 3 order by n desc, a, b limit 20""")
def change_coupling(spark, d):
    files = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("commit_id"), F.col("p_brand").alias("path"))
    return history.coupling(files, 3, 20)


@query("select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as commits from orders group by 1")
def commit_frequency(spark, d):
    return history.frequency(_commits(spark, d))


@query("select strftime(o_orderdate, '%Y-%m') as day, count(*) as commits from orders group by 1")
def commit_frequency_monthly(spark, d):
    return history.frequency(_commits(spark, d), "yyyy-MM")


@query("select o_custkey, o_orderkey, o_orderstatus, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1")
def latest_per_key(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return history.latest(rows, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey offset 40 limit 20")
def page_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


# --------------------------------------------------------------------- graph

_TRADE = """trade as (select s_nationkey as src, c_nationkey as dst, count(*) as call_count from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey
join customer on c_custkey = o_custkey where s_nationkey <> c_nationkey group by 1, 2)"""
_LINKED = f"{_TRADE}, linked as (select src, dst from trade)"


def _trade(spark, d) -> DataFrame:
    """Nations that sell to others: lines are counted by supplier and order's customer first."""
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    buyer = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("dst"))
    return graph.service_edges(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").join(nation, "l_suppkey").join(buyer, "l_orderkey").select("src", "dst"))


def _linked(spark, d) -> DataFrame:
    return _trade(spark, d).select("src", "dst")


@query(f"with {_TRADE} select * from trade")
def service_graph_edges(spark, d):
    return _trade(spark, d)


@query(f"""with recursive {_LINKED}, reach as (select src, dst from linked union select r.src, l.dst from reach r join linked l on l.src = r.dst), members as (select src as id from reach where src = dst)
select id, cast(sum(i) as bigint) as in_count, cast(sum(o) as bigint) as out_count, cast(sum(k) as bigint) as dependents, case when sum(k) >= 5 then 'Critical' when sum(k) >= 2 then 'Moderate' else 'Low' end as impact,
id in (select id from members) as is_circular from (select src as id, 0 as i, call_count as o, 0 as k from trade union all select dst, call_count, 0, 1 from trade) group by id""")
def service_graph_nodes(spark, d):
    return graph.service_nodes(cut(_trade(spark, d), "trade"))


@query(f"with {_LINKED} select n_nationkey as id, count(distinct src) as dependents, case when count(distinct src) >= 5 then 'Critical' when count(distinct src) >= 2 then 'Moderate' else 'Low' end as impact from nation left join linked on dst = n_nationkey group by 1")
def blast_radius(spark, d):
    into = _linked(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id")).join(into, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("dependents"))
    return rows.withColumn("impact", graph.impact(F.col("dependents")))


@query(f"""with recursive {_LINKED}, walk as (select src as start, dst as last, [src, dst] as path from linked where dst > src
union all select start, s.dst, list_append(path, s.dst) from walk join linked s on s.src = last where s.dst > start and not list_contains(path, s.dst) and len(path) < 3)
select array_to_string(path, '>') as cycle, cast(len(path) as integer) as length from walk join linked s on s.src = last and s.dst = start""")
def module_cycles(spark, d):
    found = graph.cycles(_linked(spark, d), 3)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length")


_NODES = "nodes as (select n_nationkey as id from nation union all select 99)"
_LINKS = "links as (select src, dst from linked union all select 0, 99)"
_RANKS = f"""with recursive {_LINKED}, {_NODES}, {_LINKS}, outs as (select src as id, count(*) as o from links group by src),
ranks as (select 0 as k, id, 1.0::double / (select count(*) from nodes) as score from nodes
union all select k + 1, id, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) from (
  select r.k, r.id, (select count(*) from nodes) as n, (select sum(q.score / o.o) from ranks q join links l on l.src = q.id join outs o on o.id = q.id where l.dst = r.id) as got,
  (select coalesce(sum(q.score), 0) from ranks q where q.id not in (select id from outs)) as loose from ranks r where r.k < 20)), final as (select id, score from ranks where k = 20)"""


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The trade graph with one node that has no edge out."""
    one = spark.range(1)
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id")).union(one.select(F.lit(99).alias("id")))
    return nodes, _linked(spark, d).union(one.select(F.lit(0), F.lit(99)))


@query(f"{_RANKS} select id, round(score, 4) as score from final")
def pagerank(spark, d):
    nodes, edges = _ranked(spark, d)
    return graph.pagerank(nodes, edges, rounds=20, tolerance=0).select("id", F.round("score", 4).alias("score"))


@query(f"""{_RANKS}, deg as (select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (select src as id, 0 as i, 1 as o from links union all select dst, 1, 0 from links) group by id)
select id, round(score, 4) as score, coalesce(in_degree, 0) as in_degree, coalesce(out_degree, 0) as out_degree from final left join deg using (id) order by score desc, id limit 10""")
def hubs_topn(spark, d):
    nodes, edges = _ranked(spark, d)
    return graph.hubs(nodes, edges, 10, rounds=20, tolerance=0)


@query(f"with {_LINKED} select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (select src as id, 0 as i, 1 as o from linked union all select dst, 1, 0 from linked) group by id")
def node_degrees(spark, d):
    return graph.degrees(_linked(spark, d))


@query(f"""with recursive {_LINKED}, target as (select max(dst) as t from linked), walk as (select [src, dst] as path, dst as last from linked where src = 0 and dst <> 0
union all select list_append(path, s.dst), s.dst from walk join linked s on s.src = last, target where last <> t and not list_contains(path, s.dst) and len(path) < 4)
select array_to_string(path, '>') as path, cast(len(path) - 1 as integer) as depth from walk, target where last = t""")
def paths_bounded(spark, d):
    edges = _linked(spark, d)
    found = graph.paths(edges, 0, edges.agg(F.max("dst")).first()[0], 3)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


@query(f"""with recursive {_LINKED}, sym as (select src, dst from linked union select dst, src from linked), reach as (select 0 as id, 0 as hops union select b.dst, hops + 1 from reach join sym b on b.src = id where hops < 10)
select id, cast(min(hops) as integer) as hops from reach where id = (select max(dst) from linked) group by id""")
def shortest_path_length(spark, d):
    edges = _linked(spark, d)
    target = edges.agg(F.max("dst")).first()[0]
    return graph.shortest_path(edges, 0, target).select(F.element_at("path", -1).alias("id"), (F.size("path") - 1).alias("hops"))


@query(f"""with recursive {_LINKED}, sym as (select src, dst from linked union select dst, src from linked), reach as (select src as id, src as r from sym union select reach.id, b.dst from reach join sym b on b.src = r)
select id, least(id, min(r)) as component from reach group by id""")
def connected_components(spark, d):
    return graph.components(_linked(spark, d))


@query("""with n as (select 'n' || n_nationkey as id, n_name as name from nation union all select 'r' || r_regionkey, r_name from region), e as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation)
select id, name from n where id in (select 'r1' union select dst from e where src = 'r1' union select src from e where dst = 'r1')""")
def neighbors(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("CONTAINS").alias("type"))
    return graph.neighbors(nodes, edges, "r1", "both")


@query(f"with n as {fx.woven_sql(fx.NODES)}, e as {fx.woven_sql(fx.EDGES)}, s as (select id from n where list_has_any(labels, ['File', 'Class', 'Method']) order by id limit 250) select src, dst, type from e where src in (select id from s) and dst in (select id from s)")
def induced_subgraph(spark, d):
    return graph.subgraph(fx.woven(spark, d, fx.NODES), fx.woven(spark, d, fx.EDGES), ["File", "Class", "Method"], 250)[1].select("src", "dst", "type")


@query("select p_partkey, substr(sha256('part:' || p_partkey || ':' || p_brand), 1, 16) as node_id from part")
def node_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.key_of(F.lit("part"), F.col("p_partkey").cast("string"), F.col("p_brand")).alias("node_id"))


@query(f"""with s as (select *, name || '@' || file_path as id from {fx.woven_sql(fx.SYMBOLS)} s), c as {fx.woven_sql(fx.CALLS)},
a as (select distinct file_path, name, arg_max(id, struct_pack(l := line_start, i := id)) as src from s group by file_path, name),
f as (select name, arg_max(id, struct_pack(p := file_path, l := line_start, i := id)) as far from s group by name)
select distinct a.src, coalesce(n.src, f.far) as dst from c join a on a.file_path = c.file_path and a.name = c.caller left join a n on n.file_path = c.file_path and n.name = c.callee left join f on f.name = c.callee
where coalesce(n.src, f.far) is not null and a.src <> coalesce(n.src, f.far)""")
def call_resolution(spark, d):
    symbols = fx.woven(spark, d, fx.SYMBOLS).withColumn("id", F.concat_ws("@", "name", "file_path"))
    return graph.resolve_calls(symbols, fx.woven(spark, d, fx.CALLS))


# ----------------------------------------------------- debt and performance


@query("select o_orderkey as name from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def dead_code_anti(spark, d):
    """Orders as functions, which their lines call."""
    functions = table(spark, d, "orders").select(F.lit("function").alias("type"), F.col("o_orderkey").cast("string").alias("name"), F.lit("a.py").alias("file_path"))
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("callee"))
    return findings.dead_code(functions, calls).select(F.col("name").cast("long").alias("name"))


@query("select c_custkey, n, n * 0.25::double as effort_hours from (select o_custkey as c_custkey, count(*) as n from orders group by 1 having count(*) >= 15) join customer using (c_custkey)")
def god_class_having(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey").withColumn("effort_hours", F.col("n") * F.lit(0.25))


@query("select doc_id, n_lines, (n_lines - 30) * 5 as effort from (select doc_id, cast(len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end as integer) as n_lines from documents) where n_lines > 30")
def long_method(spark, d):
    rows = table(spark, d, "documents").select("doc_id", scalars.line_count(F.col("text")).alias("n_lines"))
    return rows.filter("n_lines > 30").withColumn("effort", (F.col("n_lines") - 30) * 5)


_S, _C, _L = fx.woven_sql(fx.SYMBOLS), fx.woven_sql(fx.CALLS), fx.woven_sql(fx.TODO_LINES)
_DEBT = f"""debt as (with s as {_S}, c as {_C}, l as {_L}, n as (select parent, count(*) as n from s where type in ('function', 'method') group by parent)
select 'god_class' as type, 'high' as severity, name, file_path, cast(round_even(n * 0.25, 1) as double) as effort_hours, 1 as priority from s join n on n.parent = s.name where type = 'class' and n >= {rules.GOD_CLASS_METHODS}
union all select 'long_method', 'medium', name, file_path, cast(round_even((line_end - line_start - {rules.LONG_METHOD_LINES}) * 0.05::double, 1) as double), 2 from s where type in ('function', 'method') and line_end - line_start > {rules.LONG_METHOD_LINES}
union all select 'dead_code', 'low', name, file_path, 0.5::double, 3 from s where type in ('function', 'method') and not starts_with(name, '_') and not regexp_matches(name, '{rules.ENTRY_POINT}') and name not in (select callee from c where callee <> '')
union all select 'todo_comment', case t when 'TODO' then 'low' when 'HACK' then 'high' else 'medium' end, t, file_path, 0.25::double, case t when 'TODO' then 4 else 2 end from (select *, upper(regexp_extract(line, '(?i)#\\s*(TODO|FIXME|HACK|XXX)\\b', 1)) as t from l) where t <> '' and regexp_matches(file_path, '\\.(py|js|ts|tsx|jsx|java|go|rb|php|cs|rs)$')
union all select 'missing_docstring', 'info', name, file_path, 0.1::double, 5 from s where type in ('class', 'function', 'method') and coalesce(docstring, '') = '')"""


def _symbols(spark, d) -> DataFrame:
    none = F.array().cast("array<string>")
    return fx.woven(spark, d, fx.SYMBOLS).withColumns({"decorators": none, "annotations": none, "parameters": F.array().cast("array<struct<name:string,type:string>>"), "signature": F.lit(None).cast("string")})


def _debt(spark, d) -> DataFrame:
    return findings.debt_items(_symbols(spark, d), fx.woven(spark, d, fx.CALLS), fx.woven(spark, d, fx.TODO_LINES))


_HOURS = "type, severity, name, file_path, cast(round(effort_hours * 100) as bigint) as effort_cents, priority"


def _hours(items: DataFrame) -> DataFrame:
    return items.select("type", "severity", "name", "file_path", F.round(F.col("effort_hours") * 100).cast("long").alias("effort_cents"), "priority")


@query(f"with {_DEBT} select {_HOURS} from debt")
def debt_items(spark, d):
    return _hours(_debt(spark, d))


@query(f"with {_DEBT} select {_HOURS} from debt where type = 'todo_comment'")
def todo_comments(spark, d):
    return _hours(findings.todo_comments(fx.woven(spark, d, fx.TODO_LINES)))


@query(f"with {_DEBT} select severity, count(*) as n from debt group by severity")
def severity_summary(spark, d):
    return findings.severity_counts(_debt(spark, d))


@query("""select o_custkey as name, count(distinct o_orderpriority) as n from orders where contains(lower(o_orderpriority), 'high') or contains(lower(o_orderpriority), 'urgent') group by 1 having count(distinct o_orderpriority) >= 2""")
def n_plus_one_orders(spark, d):
    some = table(spark, d, "orders").filter(scalars.any_of(F.lower("o_orderpriority"), ["high", "urgent"]))
    return some.groupBy(F.col("o_custkey").alias("name")).agg(F.count_distinct("o_orderpriority").alias("n")).filter("n >= 2")


@query("""select user_id as name, count(distinct event_type) as n from events where regexp_matches(lower(event_type), 'view|click|search|get|select|purchase') group by 1 having count(distinct event_type) >= 2""")
def n_plus_one(spark, d):
    some = table(spark, d, "events").filter(scalars.any_of(F.lower("event_type"), ["view", "click", "search", "get", "select", "purchase"]))
    return some.groupBy(F.col("user_id").alias("name")).agg(F.count_distinct("event_type").alias("n")).filter("n >= 2")


@query(f"""with s as {_S}, c as {_C}, m as (select caller, count(distinct callee) as n from c where caller <> '' and regexp_matches(lower(callee), '{"|".join(rules.QUERY_WORDS)}') group by caller having count(distinct callee) >= 2)
select 'n_plus_one' as type, 'high' as severity, name, file_path, line_start as line_no from s join m on m.caller = s.name where type in ('function', 'method')""")
def n_plus_one_functions(spark, d):
    return findings.n_plus_one(_symbols(spark, d), fx.woven(spark, d, fx.CALLS))


@query("select 'large_object' as type, 'medium' as severity, doc_id || '.py' as name, doc_id || '.py' as file_path, 0 as line_no from documents where octet_length(encode(text)) > 5000")
def large_objects(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"))
    return findings.large_objects(files, 5000)


@query("""select 'missing_pagination' as type, 'low' as severity, url as name, page_id || '.py' as file_path, cast(page_id as integer) as line_no from pages
where len(list_filter(string_split(string_split(string_split(url, '#')[1], '?')[2], '&'), lambda x: list_contains(['limit', 'offset', 'page', 'size', 'skip'], lower(string_split(x, '=')[1])))) = 0 or not contains(string_split(url, '#')[1], '?')""")
def missing_pagination(spark, d):
    """Pages as handlers, whose parameters are those of the address."""
    asked = F.coalesce(F.get(F.split(F.split("url", "#")[0], r"\?"), F.lit(1)), F.lit(""))
    parameters = F.transform(F.filter(F.split(asked, "&"), lambda x: x != ""), lambda x: F.struct(F.split(x, "=")[0].alias("name"), F.lit("str").alias("type")))
    path = F.concat(F.col("page_id").cast("string"), F.lit(".py"))
    rows = table(spark, d, "pages").select(F.lit("function").alias("type"), F.col("url").alias("name"), path.alias("file_path"), F.col("page_id").cast("int").alias("line_start"), F.array(F.lit("app.get('/x')")).alias("decorators"), parameters.alias("parameters"))
    return findings.missing_pagination(rows)


# ------------------------------------------------------------------ security


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bounded(pattern: str) -> str:
    """Word bounds that hold for all letters, where the engine's are for ASCII."""
    head, tail = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
    return pattern.replace(r"\b", head, 1).replace(r"\b", tail)


def _family_sql(lines: str, families: list[str] | None = None) -> str:
    """The rules as SQL over rows (file_path, line_no, line)."""
    placeholder = " or ".join(f"contains(lower(line), {_quote(p)})" for p in rules.PLACEHOLDERS)
    comment = "starts_with(trim(line), '#')"
    every = {
        "secret-detection": [(f"regexp_matches(line, {_quote(p)}) and not ({placeholder})", t, s) for p, t, s in rules.SECRETS],
        "sql-injection": [(f"regexp_matches(line, {_quote(p)})", t, "high") for p, t in rules.SQL_INJECTION],
        "dangerous-function": [(f"contains(line, {_quote(p)}) and not {comment}", t, s) for p, t, s in rules.DANGEROUS],
        "weak-crypto": [(f"regexp_matches(line, {_quote(_bounded(p))}) and not {comment}", t, "medium") for p, t in rules.WEAK_CRYPTO],
        "misconfiguration": [(f"regexp_matches(line, {_quote(p)})", t, s) for p, t, s in rules.MISCONFIGURED],
    }
    parts = [f"select file_path, min(line_no) as line_no, {_quote(f)} as family, {_quote(t)} as title, {_quote(s)} as severity from l where {cond} group by file_path" for f, some in every.items() if families is None or f in families for cond, t, s in some]
    return f"with l as ({lines}) " + " union all ".join(parts)


_CODE = f"select * from {fx.woven_sql(fx.CODE_LINES)}"
_DOC_LINES = "select cast(doc_id as varchar) as file_path, cast(unnest(generate_series(1, len(string_split(text, chr(10))))) as integer) as line_no, unnest(string_split(text, chr(10))) as line from documents"


def _doc_lines(spark, d) -> DataFrame:
    lines = F.posexplode(scalars.lines_of(F.col("text"))).alias("at", "line")
    return texts(spark, d, "doc_id", "text").select(F.col("doc_id").cast("string").alias("file_path"), lines).select("file_path", (F.col("at") + 1).alias("line_no"), "line")


@query(_family_sql(_DOC_LINES, ["secret-detection"]))
def secret_scan(spark, d):
    return findings.security_findings(_doc_lines(spark, d), ["secret-detection"])


@query(_family_sql(_DOC_LINES))
def security_scan_documents(spark, d):
    return findings.security_findings(_doc_lines(spark, d))


def _family(name: str, family: str) -> None:
    def run(spark, d):
        return findings.security_findings(fx.woven(spark, d, fx.CODE_LINES), [family])

    QUERIES[name], SQL[name] = run, _family_sql(_CODE, [family])


for _name, _fam in (("secrets", "secret-detection"), ("sqli_scan", "sql-injection"), ("dangerous_calls", "dangerous-function"), ("weak_crypto", "weak-crypto"), ("misconfig", "misconfiguration")):
    _family(_name, _fam)


@query(_family_sql(_CODE))
def union_findings(spark, d):
    return findings.security_findings(fx.woven(spark, d, fx.CODE_LINES))


_RISK = "least(coalesce(sum(case severity when 'critical' then 25 when 'high' then 15 when 'medium' then 5 when 'low' then 2 else 0 end), 0), 100)"
_DEBT_SCORE = "least(coalesce(sum(case severity when 'critical' then 20 when 'high' then 10 when 'medium' then 5 when 'low' then 2 when 'info' then 1 else 0 end), 0), 100)"


@query(f"select file_path, cast({_RISK} as double) as risk_score from ({_family_sql(_CODE)}) group by file_path")
def risk_score_by_file(spark, d):
    found = findings.security_findings(fx.woven(spark, d, fx.CODE_LINES))
    return found.groupBy("file_path").agg(F.least(F.sum(scalars.severity_weight(F.col("severity"), rules.RISK_WEIGHTS)), F.lit(100)).cast("double").alias("risk_score"))


@query(f"select cast({_RISK} as double) as risk_score from ({_family_sql(_DOC_LINES)})")
def risk_score(spark, d):
    return findings.risk_score(findings.security_findings(_doc_lines(spark, d)))


@query(f"with {_DEBT} select cast({_DEBT_SCORE} as double) as debt_score from debt")
def debt_score(spark, d):
    return findings.debt_score(_debt(spark, d)).select("debt_score")


@query(f"""with {_DEBT}, risk as (select {_RISK} as r from ({_family_sql("" + _CODE)})), owed as (select {_DEBT_SCORE} as t from debt)
select cast(greatest(least(100 - least(r, 50) - least(t, 30) - least(2 * (select count(*) from ({SQL["n_plus_one_functions"]})), 20), 100), 0) as double) as health_score from risk, owed""")
def health_score(spark, d):
    code = fx.woven(spark, d, fx.CODE_LINES)
    slow = findings.n_plus_one(_symbols(spark, d), fx.woven(spark, d, fx.CALLS))
    return findings.health_score(findings.risk_score(findings.security_findings(code)), findings.debt_score(_debt(spark, d)), slow).select("health_score")


# ----------------------------------------------------------------- discovery

_METHODS = "case " + " ".join(f"when contains(lower(decorator), {_quote(p.lower())}) then {_quote(m)}" for p, m in rules.ROUTES) + " when contains(lower(decorator), 'route') and regexp_extract(decorator, 'methods\\s*=\\s*\\[([^\\]]+)\\]', 1) <> '' then trim(string_split(regexp_replace(regexp_extract(decorator, 'methods\\s*=\\s*\\[([^\\]]+)\\]', 1), '[''\"]', '', 'g'), ',')[1]) when contains(lower(decorator), 'route') then 'GET' end"


@query(f"""select * from (select handler, {_METHODS} as method, coalesce(nullif(regexp_extract(decorator, '["'']([^"'']+)["'']', 1), ''), '/' || handler) as path,
regexp_matches(lower(decorator), 'login_required|auth|permission|protect|jwt|token|bearer|api_key|depends\\(|security\\(') as auth_required from {fx.woven_sql(fx.DECORATORS)}) where method is not null""")
def api_endpoints(spark, d):
    rows = fx.woven(spark, d, fx.DECORATORS).select(F.col("handler").alias("name"), F.array("decorator").alias("decorators"), F.lit("function").alias("type"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("docstring"))
    return discovery.endpoints(rows).select("handler", "method", "path", "auth_required")


@query("""select host, path, count(*) as pages from (select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') as path from pages) group by 1, 2""")
def url_endpoints(spark, d):
    host, path = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.coalesce(F.nullif(F.regexp_extract("url", "^https?://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    return table(spark, d, "pages").groupBy(host.alias("host"), path.alias("path")).agg(F.count(F.lit(1)).alias("pages"))


_FRAMEWORKS = " union all ".join(f"select {_quote(n)} as framework, {_quote(m.lower())} as mark" for n, marks in rules.FRAMEWORKS.items() for m in marks)


@query(f"select distinct framework from (select decorator as t from (select decorator, {_METHODS} as method from {fx.woven_sql(fx.DECORATORS)}) where method is not null union all select module from {fx.woven_sql(fx.IMPORTS)}) join ({_FRAMEWORKS}) on contains(lower(t), mark)")
def frameworks_detected(spark, d):
    return discovery.frameworks(fx.woven(spark, d, fx.DECORATORS).select(F.array("decorator").alias("decorators")), fx.woven(spark, d, fx.IMPORTS))


_SNAKE = "regexp_replace(lower(regexp_replace(name, '([A-Z])', '_\\1', 'g')), '^_', '')"


@query(f"select name, case when {_SNAKE} like '%s' then {_SNAKE} else {_SNAKE} || 's' end as table_name from {fx.woven_sql(fx.CLASSES)}")
def snake_case_tables(spark, d):
    return fx.woven(spark, d, fx.CLASSES).select("name", scalars.table_name(F.col("name")).alias("table_name"))


_TYPES = "case " + " ".join(f"when contains(coalesce(signature, ''), {_quote(t)}) then {_quote(s)}" for t, s in rules.SQL_TYPES) + " else 'VARCHAR' end"


@query(f"""select name, {_TYPES} as sql_type, not (contains(coalesce(signature, ''), 'nullable=False') or contains(coalesce(signature, ''), 'NOT NULL')) as nullable,
contains(coalesce(signature, ''), 'ForeignKey') or contains(lower(name), 'foreign_key') or name like '%\\_id' escape '\\' as is_fk from {fx.woven_sql(fx.SIGNATURES)} where not starts_with(name, '_') or starts_with(name, '__tablename')""")
def column_types(spark, d):
    return discovery.columns(fx.woven(spark, d, fx.SIGNATURES)).select("name", "sql_type", "nullable", "is_fk")


@query("""select 'nation' as from_table, 'region' as to_table, 'n_regionkey' as column, 'many-to-one' as type, count(*) as n from nation union all select 'customer', 'nation', 'c_nationkey', 'many-to-one', count(*) from customer
union all select 'orders', 'customer', 'o_custkey', 'many-to-one', count(*) from orders""")
def fk_relationships(spark, d):
    """Each row of a table as a table with its foreign key; relationships are counted."""
    key = "array<struct<column:string,referenced_table:string,referenced_column:string,rel_type:string>>"
    known = [("nation", "region", "n_regionkey"), ("customer", "nation", "c_nationkey"), ("orders", "customer", "o_custkey")]
    parts = [table(spark, d, name).select(F.lit(name).alias("name"), F.array(F.struct(F.lit(column), F.lit(to), F.lit("id"), F.lit("many-to-one"))).cast(key).alias("foreign_keys")) for name, to, column in known]
    return discovery.relationships(reduce(DataFrame.unionByName, parts)).groupBy("from_table", "to_table", "column", "type").agg(F.count(F.lit(1)).alias("n"))


def _subsystem_sql() -> str:
    marks = "(" + " or ".join(f"contains(lower(path), {_quote(m)})" for m in rules.PRESENTATION_MARKS) + ")"
    out = []
    for tier, ident, _, words in rules.SUBSYSTEMS:
        tests = []
        for w in words:
            held, named = f"len(list_filter(dirs, lambda x: contains(x, {_quote(w)}))) > 0", f"contains(file, {_quote(w)})"
            tests.append(f"(case when {held} then {marks} else {named} end)" if tier == "presentation" else f"({held} or {named})")
        out.append(f"when {' or '.join(tests)} then {_quote(ident)}")
    return "case " + " ".join(out) + " end"


_PLACED = f"(select path, {_subsystem_sql()} as subsystem from (select path, string_split(lower(path), '/')[:-2] as dirs, string_split(lower(path), '/')[-1] as file from %s))"
_URL_PATHS = "(select distinct regexp_extract(url, '^https?://([^?#]+)', 1) as path from pages)"


@query(f"select path, subsystem from {_PLACED % fx.woven_sql(fx.PATHS)}")
def layer_classification(spark, d):
    return fx.woven(spark, d, fx.PATHS).select("path", discovery.subsystem(F.col("path")).alias("subsystem"))


@query(f"select coalesce(subsystem, 'unmapped') as subsystem, count(*) as files from {_PLACED % _URL_PATHS} group by 1")
def layer_counts(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("path")).distinct()
    return paths.select(F.coalesce(discovery.subsystem(F.col("path")), F.lit("unmapped")).alias("subsystem")).groupBy("subsystem").agg(F.count(F.lit(1)).alias("files"))


@query(f"""select case when s >= 2 or (compose and k8s) then 'Microservices' when h >= 3 then 'Hexagonal / Ports & Adapters' when m >= 2 then 'MVC (Model-View-Controller)' when l >= 3 then 'Layered Architecture' when l >= 2 then 'Modular Monolith' when l = 1 then 'Monolith' else 'Undetermined' end as pattern,
case when s >= 2 or (compose and k8s) then 0.75::double when h >= 3 then 0.8::double when m >= 2 then 0.85::double when l >= 3 then round(least(0.5 + l * 0.1, 0.9), 2)::double when l >= 2 then 0.6::double when l = 1 then 0.5::double else 0.3::double end as confidence
from (select count(distinct case when dir in ('services', 'apps', 'microservices', 'functions') then dir end) as s, count(distinct case when dir in ('ports', 'adapters', 'domain', 'application', 'infrastructure') then dir end) as h, count(distinct case when dir in ('models', 'views', 'controllers') then dir end) as m,
count(distinct layer) as l from (select unnest(string_split(lower(path), '/')[:-2][:2]) as dir from {fx.woven_sql(fx.PATHS)}) left join ({" union all ".join(f"select {_quote(n)} as layer, {_quote(w)} as word" for n, words in rules.LAYERS.items() for w in words)}) on word = dir),
(select bool_or(path like '%docker-compose.yml') as compose, bool_or(contains(path, 'k8s') or contains(path, 'kubernetes')) as k8s from {fx.woven_sql(fx.PATHS)})""")
def pattern_rules(spark, d):
    return discovery.pattern(fx.woven(spark, d, fx.PATHS)).select("pattern", "confidence")


@query("""with hosts as (select host, row_number() over (order by host) as ord from (select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages)),
links as (select regexp_extract(url, '^https?://([^/?#]+)', 1) as src, string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')[-3] as module, count(*) as n from pages group by 1, 2),
first as (select src, module, n, arg_min(host, ord) as dst from links join hosts on host <> src and (contains(host, module) or contains(module, host)) group by src, module, n)
select src, dst, cast(sum(n) as bigint) as n from first group by src, dst""")
def cross_subsystem_edges(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    pages = table(spark, d, "pages").select(host.alias("host"))
    hosts = pages.distinct().select(F.col("host").alias("ord"), F.col("host").alias("dotted"), F.col("host").alias("subsystem"))
    links = pages.select(F.col("host").alias("subsystem"), F.element_at(F.split("host", r"\."), -3).alias("module"))
    return discovery.cross_edges(links, hosts)


@query(f"select module, case when coalesce(module, '') = '' then '' when len(p) >= 2 then p[1] || '/' || p[2] when contains(c, '.') and len(q) >= 2 and q[1] in ('app', 'src', 'backend', 'frontend') then q[1] || '/' || q[2] when contains(c, '.') and len(q) >= 1 then q[1] else p[1] end as target from (select *, string_split(c, '/') as p, list_filter(string_split(c, '.'), lambda x: x <> '') as q from (select module, regexp_replace(module, '^[./]+', '') as c from {fx.woven_sql(fx.IMPORTS)}))")
def import_targets(spark, d):
    return fx.woven(spark, d, fx.IMPORTS).select("module", scalars.import_module(F.col("module")).alias("target"))


@query(f"select path, case when len(p) >= 3 and p[1] in ('backend', 'frontend', 'src', 'packages') then p[1] || '/' || p[2] when len(p) >= 2 and p[1] in ('app', 'lib', 'components') then p[1] || '/' || p[2] else p[1] end as module from (select path, string_split(path, '/') as p from {fx.woven_sql(fx.PATHS)})")
def file_modules(spark, d):
    return fx.woven(spark, d, fx.PATHS).select("path", scalars.file_module(F.col("path")).alias("module"))


@query("""select k as name, cast(sum(cast(json_extract(props, '$."' || k || '"') as bigint)) as bigint) as version_sum, count(*) as n from (select props, unnest(json_keys(props)) as k from events) group by k""")
def manifest_packages(spark, d):
    """Events' properties as the dependencies of package manifests."""
    files = table(spark, d, "events").select(F.concat(F.lit('{"dependencies": '), "props", F.lit("}")).alias("content"))
    return manifests.npm_packages(files).groupBy("name").agg(F.sum(F.col("version").cast("long")).alias("version_sum"), F.count(F.lit(1)).alias("n"))


@query(f"""select line_no, trim(case when sep is null then string_split(t, '[')[1] else string_split(t, sep)[1] end) as name, case when sep is not null then string_split(trim(substr(t, strpos(t, sep) + len(sep))), ',')[1] end as version
from (select line_no, trim(line) as t, case {" ".join(f"when contains(line, {_quote(s)}) then {_quote(s)}" for s in rules.REQUIREMENT_SEPARATORS)} end as sep from {fx.woven_sql(fx.REQUIREMENTS)}) where t <> '' and not starts_with(t, '#') and not starts_with(t, '-')""")
def requirements_parse(spark, d):
    from lodestrata.sources.manifests import requirement_lines

    return requirement_lines(fx.woven(spark, d, fx.REQUIREMENTS)).select("line_no", "name", "version")


# ----------------------------------------------------------------- retrieval


@query("""select doc_id, cast(i as integer) as chunk_index, substr(text, cast(i * 450 + 1 as bigint), 500) as chunk from (select doc_id, text, unnest(range(0, cast((length(text) + 449) // 450 as bigint))) as i from documents where length(text) > 0)""")
def chunks(spark, d):
    return retrieval.chunks(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("select doc_id, substr(sha256('repo:' || doc_id || ':0'), 1, 32) as id, round(list_sum(list_transform(range(0, 32), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as integer) / 255.0::double)), 6) as total from (select doc_id, sha256(text) as h from documents)")
def hash_vector(spark, d):
    docs = table(spark, d, "documents")
    total = F.aggregate(scalars.hash_vector(F.col("text")), F.lit(0.0), lambda s, x: s + x)
    return docs.select("doc_id", scalars.key_of(F.lit("repo"), F.col("doc_id").cast("string"), F.lit("0"), length=32).alias("id"), F.round(total, 6).alias("total"))


@query("""with q as (select embedding::double[] as q, label from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings e, q where e.label = q.label and vec_id <> 0 order by score desc, vec_id limit 5""")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding", F.col("label").alias("wanted"))
    rows = e.join(F.broadcast(q.select("wanted"))).filter("label = wanted and vec_id <> 0")  # one row
    return retrieval.nearest(rows.select("vec_id", "embedding"), "embedding", q.select("embedding"), 5).select("vec_id", "score")


@query("""with t as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents), h as (select doc_id, word, len(list_filter(w, lambda x: x = word)) as tf from t, (values ('licensed'), ('apache'), ('mit')) v(word)),
df as (select word, count(*) as df from h where tf > 0 group by word) select doc_id, round(sum(tf * ln(1 + (select count(*) from documents) / df)), 4) as score, count(*) as matched from h join df using (word) where tf > 0 group by doc_id order by score desc, doc_id limit 10""")
def fulltext_search(spark, d):
    return retrieval.search(texts(spark, d, "doc_id", "text"), "doc_id", "text", ["licensed", "apache", "MIT"], 10)


@query("""with a as (select text, 1.0::double as score, row_number() over (order by doc_id) as rank from documents where contains(text, 'MIT')), b as (select text, 0.5::double as score, row_number() over (order by n_chars desc, doc_id) as rank from documents),
u as (select text, 0 as source, rank, score from a union all select text, 1, rank, score from b)
select md5(text) as text_md5, source, rank, score from (select *, row_number() over (partition by text order by source, rank) as rn from u) where rn = 1 order by source, rank limit 12""")
def retrieval_fusion(spark, d):
    docs = table(spark, d, "documents")
    # 12 texts of the first source, and as many of the second as those could repeat besides
    a = retrieval.first_places(docs.filter(F.col("text").contains("MIT")), "text", F.struct("doc_id"), 12).withColumn("score", F.lit(1.0))
    b = retrieval.first_places(docs, "text", F.struct(-F.col("n_chars").alias("n"), F.col("doc_id")), 24).withColumn("score", F.lit(0.5))
    return retrieval.fuse([a, b], 12).select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", F.col("rank").cast("long").alias("rank"), "score")


def _first_sql(rows: list[tuple[str, list[str]]], other: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower(question), {_quote(w)})" for w in words) + f" then {_quote(n)}" for n, words in rows) + f" else {_quote(other)} end"


_ASKED = f"(select question from {fx.woven_sql(fx.QUESTIONS)} union all select text from conversations where role = 'user')"


def _asked(spark, d) -> DataFrame:
    return fx.woven(spark, d, fx.QUESTIONS).union(table(spark, d, "conversations").filter("role = 'user'").select("text"))


@query(f"select question, {_first_sql(rules.REASONING, 'general')} as reasoning from {_ASKED}")
def reasoning_type(spark, d):
    return _asked(spark, d).select("question", scalars.reasoning_type(F.col("question")).alias("reasoning"))


@query(f"select question, {_first_sql(rules.INTENTS, 'overview')} as intent from {_ASKED}")
def intent_router(spark, d):
    return _asked(spark, d).select("question", scalars.intent(F.col("question")).alias("intent"))


_FLAT = "replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"


@query(f"select doc_id, case when length({_FLAT}) <= 300 then {_FLAT} else regexp_replace(substr({_FLAT}, 1, 299), '\\s+$', '') || '…' end as snippet from documents")
def trim_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as prompt, count(*) as turns from conversations group by conv_id")
def history_prompt(spark, d):
    return retrieval.prompts(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def progress_latest(spark, d):
    return progress.latest_state(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"])


@query("select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, d):
    rows = progress.windowed(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status")), "ts", "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("bucket"), F.col("status").alias("event_type"), "n")


# --------------------------------------------------------------- exploration


@query(f"select raw, case when coalesce(raw, '') = '' then 'Unknown' else coalesce(case regexp_replace(lower(raw), '[\\s_-]+', '', 'g') {' '.join(f'when {_quote(k)} then {_quote(v)}' for k, v in explore.NODE_TYPES.items())} end, upper(substr(raw, 1, 1)) || substr(raw, 2)) end as node_type from {fx.woven_sql(fx.KINDS)}")
def node_types(spark, d):
    return fx.woven(spark, d, fx.KINDS).select("raw", explore.node_type(F.col("raw")).alias("node_type"))


@query(f"select handler, method, path from (select handler, {_METHODS} as method, coalesce(nullif(regexp_extract(decorator, '[\"'']([^\"'']+)[\"'']', 1), ''), '/' || handler) as path from {fx.woven_sql(fx.DECORATORS)}) where method = 'PATCH' and contains(lower(path), 'p')")
def endpoint_search(spark, d):
    rows = fx.woven(spark, d, fx.DECORATORS).select(F.col("handler").alias("name"), F.array("decorator").alias("decorators"), F.lit("function").alias("type"), F.lit("a.y").alias("file_path"), F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("docstring"))
    return explore.find_endpoints(discovery.endpoints(rows), "P", "PATCH").select("handler", "method", "path")


@query(f"select family, {', '.join(f'count(case when severity = {_quote(s)} then 1 end) as {s}' for s in explore.SEVERITIES)} from ({_family_sql(_CODE)}) group by family")
def severity_pivot(spark, d):
    return explore.by_severity(findings.security_findings(fx.woven(spark, d, fx.CODE_LINES)), "family")


@query("select l_partkey as path, count(distinct l_orderkey) as changes, round(count(distinct l_orderkey) * 100.0::double / max(count(distinct l_orderkey)) over (), 2) as share from lineitem group by 1")
def hotspot_share(spark, d):
    return explore.with_share(_commit_files(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("changes")), "changes")


@query("select * from (select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as commits from orders group by 1) order by day desc limit 8")
def recent_days(spark, d):
    return explore.recent(history.frequency(_commits(spark, d)), "day", 8)


@query(f"with {_LINKED} select src as id, 'dependent' as side from linked where dst = 1 union select dst, 'dependency' from linked where src = 1")
def module_sides(spark, d):
    return explore.around(_linked(spark, d), 1)


@query(f"""with s as {fx.woven_sql(fx.SUBSYSTEMS)}, e as {fx.woven_sql(fx.SUBSYSTEM_EDGES)}, f as (select tier, arg_min(subsystem, ord) as first from s group by tier),
flow(a, b, label) as (values {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in explore.TIER_FLOW)})
select src, dst, 'imports' as label from e union all select x.first, y.first, label from flow join f x on x.tier = a join f y on y.tier = b
where not exists (select 1 from e join s p on p.subsystem = e.src join s q on q.subsystem = e.dst where p.tier = a and q.tier = b)""")
def tier_flow(spark, d):
    return explore.flow_edges(fx.woven(spark, d, fx.SUBSYSTEM_EDGES), fx.woven(spark, d, fx.SUBSYSTEMS))


@query("""select user_id, event_id, cast(i as integer) as i, round(20 + i::double / n * 15, 3) as progress from (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events) where i % 40 = 0""")
def progress_points(spark, d):
    return explore.progress(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(f"""with l as (select *, trim(line) as t, cast(starts_with(trim(line), '```') as integer) as fence from {fx.woven_sql(fx.README)}), r as (select *, sum(fence) over w as fences, sum(cast(t = '' as integer)) over w as gap from l window w as (partition by file_path order by line_no)),
p as (select file_path, gap, string_agg(t, ' ' order by line_no) as p from r where t <> '' and not regexp_matches(t, '^(#|---|```|!\\[|\\[!)') group by 1, 2),
d as (select file_path, string_agg(p, chr(10) || chr(10) order by gap) as d from p where length(p) > 60 group by 1),
b as (select file_path, string_agg(regexp_replace(t, '^[-* ]+', ''), ';' order by line_no) as f from r where regexp_matches(t, '^[-*] ') and length(t) > 15 and not regexp_matches(t, 'http|license|badge|npm install') group by 1),
c as (select file_path, string_agg(c, ';' order by fences) as c from (select file_path, fences, string_agg(t, chr(10) order by line_no) as c from r where fences % 2 = 1 and fence = 0 group by 1, 2) where regexp_matches(c, 'npm |python |pip |yarn |docker|manage.py') group by 1)
select file_path, coalesce(d, '') as description, coalesce(f, '') as features, coalesce(c, '') as commands from (select distinct file_path from l) left join d using (file_path) left join b using (file_path) left join c using (file_path)""")
def readme_context(spark, d):
    found = explore.readme(fx.woven(spark, d, fx.README))
    return found.select("file_path", "description", F.array_join("features", ";").alias("features"), F.array_join("commands", ";").alias("commands"))


@query(f"""select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#{{1,6}}[ \\t]+(.+?):?[ \\t]*$', '\\1:' || chr(10), 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '[#*]', '', 'g'), '::\\s*', ': ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as answer from {fx.woven_sql(fx.ANSWERS)}""")
def clean_answers(spark, d):
    return fx.woven(spark, d, fx.ANSWERS).select("id", retrieval.clean_answer(F.col("text")).alias("answer"))


@query(f"select question, case when reasoning in ('code', 'security', 'performance', 'architecture') then 'code' else 'general' end as model, case when reasoning = 'general' then 0.3::double else 0.1::double end as temperature from (select question, {_first_sql(rules.REASONING, 'general')} as reasoning from {_ASKED})")
def model_choice(spark, d):
    r = scalars.reasoning_type(F.col("question"))
    return _asked(spark, d).select("question", retrieval.model_of(r).alias("model"), retrieval.temperature_of(r).alias("temperature"))


@query("""select conv_id, 'system: S' || chr(10) || string_agg(role || ': ' || text, chr(10) order by turn) || chr(10) || 'user: [1] one' || chr(10) || '[2] two' || chr(10) || chr(10) || 'why' as chat from conversations group by conv_id""")
def chat_messages(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("h"))
    said = retrieval.messages("S", F.col("h"), F.array(F.lit("one"), F.lit("two")), F.lit("why"))
    return rows.select("conv_id", F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@query("select substr(sha256('repo:' || url), 1, 32) as id, url as path, string_split(url, '/')[-1] as name, md5(html) as content_md5 from pages")
def search_documents(spark, d):
    rows = table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"), F.lit("HTML").alias("language"))
    return retrieval.search_documents(rows, "repo").select("id", "path", "name", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("select (select count(*) from documents) as documents, (select count(*) from pages) as pages, (select count(*) from events) as events")
def result_summary(spark, d):
    return explore.summary(documents=table(spark, d, "documents"), pages=table(spark, d, "pages"), events=table(spark, d, "events"))


# ------------------------------------------------------------------ flagship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle in miniature: lines, security rules, risk and its grade by document, each
    within its row."""
    docs = texts(spark, sf_dir, "doc_id", "lang", "text")
    rows = docs.select(F.col("doc_id").cast("string").alias("file_path"), "lang", scalars.lines_of_code(F.col("text")).alias("loc"), findings.risk_within(F.col("text")).alias("r"))
    return rows.select("file_path", "lang", "loc", "r.findings", "r.risk_score").withColumn("health_score", 100 - F.least("risk_score", F.lit(50.0)))


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""with f as ({_family_sql(_DOC_LINES)}), r as (select file_path, count(*) as findings, cast({_RISK} as double) as risk_score from f group by file_path)
select cast(doc_id as varchar) as file_path, lang, cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) as integer) as loc, coalesce(findings, 0) as findings, coalesce(risk_score, 0) as risk_score, 100 - least(coalesce(risk_score, 0), 50) as health_score
from documents left join r on r.file_path = cast(doc_id as varchar)"""
