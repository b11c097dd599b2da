"""Further queries: operators over larger graphs, over models and files made of the data
tables, over manifests and over parsed sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import scalars
from lodestrata.operators import discovery, explore, findings, graph, history, retrieval
from lodestrata.plans import answers, rules
from lodestrata.plans import fixtures as fx
from lodestrata.plans import queries as q
from lodestrata.plans.queries import query, table
from lodestrata.sources import files as sources
from lodestrata.sources import manifests, parsers

# ------------------------------------------------------------ a larger graph

_PURCHASES = "bought as (select distinct 'c' || o_custkey as src, 's' || l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey), people as (select 'c' || c_custkey as id from customer union all select 's' || s_suppkey from supplier)"


def _purchases(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers, and who bought from whom."""
    who = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("src"))
    edges = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("dst")).join(who, "l_orderkey").select("src", "dst").distinct()
    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return nodes, edges


def _rounds(n: int) -> str:
    steps = ["r0 as (select id, 1.0::double / (select count(*) from people) as score from people)", "outs as (select src as id, count(*) as o from bought group by src)"]
    for i in range(n):
        steps.append(f"""g{i} as (select dst as id, sum(score / o) as got from bought join r{i} on r{i}.id = src join outs on outs.id = src group by dst),
r{i + 1} as (select r{i}.id, (0.15 + 0.85 * (select coalesce(sum(score), 0) from r{i} where id not in (select id from outs))) / (select count(*) from people) + 0.85 * coalesce(got, 0) as score from r{i} left join g{i} using (id))""")
    return ", ".join(steps)


@query(f"with {_PURCHASES}, {_rounds(4)} select id, cast(round(score * 100000000) as bigint) as score from r4")
def pagerank_purchases(spark, d):
    return graph.pagerank(*_purchases(spark, d), rounds=4, tolerance=0).select("id", F.round(F.col("score") * 100_000_000).cast("long").alias("score"))


@query(f"with {_PURCHASES} select id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (select src as id, 0 as i, 1 as o from bought union all select dst, 1, 0 from bought) group by id")
def degrees_purchases(spark, d):
    return graph.degrees(_purchases(spark, d)[1])


@query(f"""with recursive {_PURCHASES}, ways as (select src, dst from bought union select dst, src from bought), reach as (select 'c1' as id, 0 as hops union select dst, hops + 1 from reach join ways on src = id where hops < 4)
select id, cast(min(hops) as integer) as hops from reach where id = 'c2' group by id""")
def shortest_path_purchases(spark, d):
    return graph.shortest_path(_purchases(spark, d)[1], "c1", "c2", 4).select(F.element_at("path", -1).alias("id"), (F.size("path") - 1).alias("hops"))


_CHAINED = "select lang, n_chars % 50 as g, doc_id, lag(doc_id) over (partition by lang, n_chars % 50 order by doc_id) as before from documents"


@query(f"select id, component from (select doc_id as id, min(doc_id) over (partition by lang, g) as component, count(*) over (partition by lang, g) as n from ({_CHAINED})) where n > 1")
def chained_components(spark, d):
    """Each document is linked to the one before it of its group; components are the groups."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang", F.col("n_chars") % 50).orderBy("doc_id")
    return graph.components(table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.lag("doc_id").over(w).alias("dst")).filter("dst is not null"))


@query(f"""with {q._LINKED} select array_to_string(cycle, '>') as cycle, cast(len(cycle) as integer) as length from (select * from (select [a.src, a.dst] as cycle from linked a join linked b on b.src = a.dst and b.dst = a.src where a.src < a.dst
union all select [a.src, a.dst, b.dst] from linked a join linked b on b.src = a.dst join linked c on c.src = b.dst and c.dst = a.src where a.dst > a.src and b.dst > a.src) order by len(cycle), cycle limit 25)""")
def shortest_cycles(spark, d):
    found = graph.cycles(q._linked(spark, d), 10, limit=25)
    return found.select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), "length")


@query(f"""with {q._LINKED}, target as (select max(dst) as t from linked), p as (select [src, dst] as path from linked, target where src = 0 and dst = t union all select [a.src, a.dst, b.dst] from linked a join linked b on b.src = a.dst, target where a.src = 0 and a.dst not in (0, t) and b.dst = t
union all select [a.src, a.dst, b.dst, c.dst] from linked a join linked b on b.src = a.dst join linked c on c.src = b.dst, target where a.src = 0 and a.dst not in (0, t) and b.dst not in (0, a.dst, t) and c.dst = t)
select array_to_string(path, '>') as path, cast(len(path) - 1 as integer) as depth from (select path from p order by len(path), path limit 10)""")
def paths_first(spark, d):
    edges = q._linked(spark, d)
    found = graph.paths(edges, 0, edges.agg(F.max("dst")).first()[0], 3, limit=10)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


def _typed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nations and customers of two kinds of edges."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id")).union(c.select(F.concat(F.lit("c"), "c_custkey")))
    has = c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("HAS").alias("type"))
    knows = c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25), F.lit("KNOWS"))
    return nodes, has.union(knows)


_TYPED = "e as (select 'n' || c_nationkey as src, 'c' || c_custkey as dst, 'HAS' as type from customer union all select 'c' || c_custkey, 'n' || (c_nationkey + 1) % 25, 'KNOWS' from customer)"


@query(f"""with {_TYPED} select 'out' as side, id from (select dst as id from e where src = 'n3' and type = 'HAS' order by id limit 50) union all select 'out', 'n3'
union all select 'in', id from (select src as id from e where dst = 'n3' and type = 'KNOWS' order by id limit 50) union all select 'in', 'n3'""")
def neighbors_by_side(spark, d):
    nodes, edges = _typed(spark, d)
    out, into = graph.neighbors(nodes, edges, "n3", "out", "HAS", 50), graph.neighbors(nodes, edges, "n3", "in", "KNOWS", 50)
    return out.select(F.lit("out").alias("side"), "id").union(into.select(F.lit("in"), "id"))


@query("select l_orderkey as src, l_suppkey as dst, l_returnflag as type, l_linenumber as line from (select *, row_number() over (partition by l_orderkey, l_suppkey, l_returnflag order by l_linenumber desc) rn from lineitem) where rn = 1")
def last_edges(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("line"))
    return graph.latest_edges(edges, F.col("line"))


def _built(spark, d) -> tuple[DataFrame, DataFrame]:
    """The graphs of two repositories with the same files, in one pair of tables."""
    files = fx.woven(spark, d, fx.IMPORTS).select(F.col("file_path").alias("path"), scalars.language_of(F.col("file_path")).alias("language")).distinct()
    parts = [graph.build(r, files, fx.woven(spark, d, fx.SYMBOLS), fx.woven(spark, d, fx.IMPORTS), fx.woven(spark, d, fx.CALLS)) for r in ("one", "two")]
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


_KEYED = f"""s as (select *, substr(sha256('symbol:' || r || ':' || file_path || ':' || name || ':' || line_start), 1, 16) as id from {fx.woven_sql(fx.SYMBOLS)}, (values ('one'), ('two')) v(r)),
i as (select distinct file_path, module, r from {fx.woven_sql(fx.IMPORTS)}, (values ('one'), ('two')) v(r))"""


@query(f"""with {_KEYED}, n as (select r, 'Repository' as label, r as name from (values ('one'), ('two')) v(r) union all select distinct r, 'File', file_path from i
union all select r, case type when 'class' then 'Class' when 'method' then 'Method' else 'Function' end, name from s union all select distinct r, 'Module', module from i)
select r as repo_id, label, count(*) as n, min(name) as first from n group by 1, 2""")
def graph_nodes(spark, d):
    return _built(spark, d)[0].groupBy("repo_id", F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query(f"""with {_KEYED}, f as (select distinct r, file_path from i), key as (select *, substr(sha256('file:' || r || ':' || file_path), 1, 16) as id from f)
select repo_id, type, count(*) as n from (select distinct r as repo_id, 'CONTAINS' as type, file_path as a, '' as b from f union select r, 'DEFINES', file_path, id from s union select r, 'IMPORTS', file_path, module from i
union select m.r, 'HAS_METHOD', c.id, m.id from s m join s c on m.r = c.r and m.file_path = c.file_path and m.parent = c.name and m.type = 'method' and c.type = 'class'
union select r, 'CALLS', src, dst from (select r from (values ('one'), ('two')) v(r)), ({q.SQL["call_resolution"]})) group by 1, 2""")
def graph_edges(spark, d):
    return _built(spark, d)[1].groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_KEYED} select r as repo_id, name, file_path from s where r = 'two' and name = 'main' and file_path = 'b7.py'")
def graph_node(spark, d):
    """A point look-up within one repository's view."""
    nodes, _ = graph.repository_view(*_built(spark, d), "two")
    key = scalars.key_of(F.lit("symbol"), F.lit("two"), F.lit("b7.py"), F.lit("main"), F.lit("210"))
    return graph.get_node(nodes, key).select("repo_id", "name", "file_path")


@query(f"with {_KEYED} select 'two' as repo_id, (select count(*) from s where r = 'two') + (select count(distinct module) + count(distinct file_path) from i where r = 'two') + 1 as nodes")
def cleared_repository(spark, d):
    nodes, _ = graph.clear_repository(*_built(spark, d), "one")
    return nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"))


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return graph.duplicated(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query(f"""with n as {fx.woven_sql(fx.NODES)}, e as {fx.woven_sql(fx.EDGES)}, s as (select id from n where list_has_any(labels, ['Class', 'Method'])) select id from n where id in (select id from s) or id in (select src from e where type = 'DEFINES' and dst in (select id from s))""")
def nodes_with_parents(spark, d):
    return graph.with_parents(fx.woven(spark, d, fx.NODES), fx.woven(spark, d, fx.EDGES), ["Class", "Method"]).select("id")


@query("""select distinct doc_id, 'n' || n_nationkey as id, n_name as name from nation join (select doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) as w from documents union all select doc_id, lower(n_name) from documents, nation where doc_id % 25 = n_nationkey) on w = lower(n_name)""")
def nodes_named_in(spark, d):
    """Nations that texts name; every text is given one more word."""
    n = table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    docs = table(spark, d, "documents").join(F.broadcast(n), F.col("doc_id") % 25 == F.col("n_nationkey"))
    return graph.named_in(nodes, F.col("said"), docs.select("doc_id", F.concat_ws(" ", "text", "n_name").alias("said")), "doc_id")


# -------------------------------------------------------- models and tables


def _models(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers as classes, their parts as fields, and imports of one file for each nation."""
    none = F.array().cast("array<string>")
    s = table(spark, d, "supplier")
    path = F.concat(F.when(F.col("s_nationkey") % 3 == 0, F.lit("schema/")).otherwise(F.lit("lib/")), F.col("s_nationkey").cast("string"), F.lit(".py"))
    name = F.concat(F.lit("Supplier"), "s_suppkey")
    classes = s.select(name.alias("name"), F.lit("class").alias("type"), F.lit(None).cast("string").alias("parent"), path.alias("file_path"), F.col("s_suppkey").cast("int").alias("line_start"), F.lit(None).cast("string").alias("signature"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("extends BaseEntity"))).otherwise(none).alias("annotations"), F.when(F.col("s_suppkey") % 7 == 0, F.array(F.lit("Table"))).otherwise(none).alias("decorators"))
    held = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).filter("s_suppkey % 2 = 0").distinct()
    fields = held.join(s, "s_suppkey").join(table(spark, d, "part").select("p_partkey", "p_type", "p_size"), "p_partkey")
    said = F.when(F.col("p_size") % 4 == 0, F.lit("Column(Integer, nullable=False)")).when(F.col("p_size") % 4 == 1, F.lit("CharField()")).otherwise(F.col("p_type"))
    own = F.concat(F.lit("f"), "p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.lit("_id")).otherwise(F.lit("")))
    variables = fields.select(own.alias("name"), F.lit("variable").alias("type"), name.alias("parent"), path.alias("file_path"), F.col("p_partkey").cast("int").alias("line_start"), said.alias("signature"), none.alias("annotations"), none.alias("decorators"))
    imports = table(spark, d, "nation").select(F.lower("n_name").alias("module"), F.concat(F.lit("lib/"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("file_path"))
    return classes.unionByName(variables), imports


_MODELS = """c as (select 'Supplier' || s_suppkey as name, case when s_nationkey % 3 = 0 then 'schema/' else 'lib/' end || s_nationkey || '.py' as file_path, s_suppkey from supplier),
m as (select * from c where starts_with(file_path, 'schema') or s_suppkey % 5 = 0 or s_suppkey % 7 = 0),
f as (select distinct 'Supplier' || l_suppkey as model, 'f' || l_partkey || case when l_partkey % 11 = 0 then '_id' else '' end as name, l_partkey % 11 = 0 as fk, p_size % 4 = 0 as strict from lineitem join part on p_partkey = l_partkey where l_suppkey % 2 = 0)"""


@query(f"with {_MODELS} select name, file_path from m")
def orm_models(spark, d):
    return discovery.models(*_models(spark, d)).select("name", "file_path")


@query(f"""with {_MODELS} select 'supplier' || s_suppkey || 's' as name, m.name as model, greatest(count(f.name), 1) as n_columns, case when count(f.name) = 0 then 1 else count(case when strict then 1 end) end as not_null,
count(case when fk then 1 end) as n_keys from m left join f on f.model = m.name group by 1, 2""")
def discovered_tables(spark, d):
    rows = discovery.tables(*_models(spark, d))
    strict = F.size(F.filter("columns", lambda c: ~c["nullable"]))
    return rows.select("name", "model", F.size("columns").cast("long").alias("n_columns"), strict.cast("long").alias("not_null"), F.size("foreign_keys").cast("long").alias("n_keys"))


@query(f"""with {_MODELS} select 'supplier' || s_suppkey || 's' as from_table, replace(f.name, '_id', '') as to_table, f.name as column, 'many-to-one' as type from m join f on f.model = m.name where fk""")
def schema_relationships(spark, d):
    return discovery.relationships(discovery.tables(*_models(spark, d)))


@query(f"with {_MODELS} select name, cast((n - 1) % 3 * 380 + 40 as integer) as x, cast((n - 1) // 3 * 340 + 40 as integer) as y, model from (select 'supplier' || s_suppkey || 's' as name, name as model, row_number() over (order by 'supplier' || s_suppkey || 's') as n from m)")
def schema_diagram(spark, d):
    found = discovery.tables(*_models(spark, d))
    return discovery.diagram_tables(discovery.diagram(found), found).select("name", F.col("x").cast("int").alias("x"), "y", "model")


def _nations_as_tables(spark, d) -> DataFrame:
    key = "array<struct<column:string,referenced_table:string,referenced_column:string,rel_type:string>>"
    n = table(spark, d, "nation").select(F.concat(F.lit("t"), "n_nationkey", F.lit("s")).alias("name"), F.array(F.struct(F.concat(F.lit("t"), (F.col("n_nationkey") * 2).cast("string"), F.lit("_id")), F.concat(F.lit("t"), (F.col("n_nationkey") * 2).cast("string")), F.lit("id"), F.lit("many-to-one"))).cast(key).alias("foreign_keys"))
    return n.withColumn("columns", F.array(F.struct(F.lit("code").alias("name"))))


@query("select 't' || n_nationkey || 's' as src, 't' || n_nationkey * 2 || 's' as dst, 't' || n_nationkey * 2 || '_id' as column, 'many-to-one' as type from nation where n_nationkey * 2 < 25")
def diagram_edges(spark, d):
    return discovery.diagram_edges(_nations_as_tables(spark, d))


@query("select 't' || n_nationkey || 's' as name from nation where contains('t' || n_nationkey || 's', 't1') or contains('code', 't1')")
def table_search(spark, d):
    return explore.find_tables(_nations_as_tables(spark, d), "T1").select("name")


_MIGRATIONS = ("path string", [("db/migrations/001_init.sql",), ("alembic/versions/b1_add.py",), ("db/migrate/plain.sql",), ("src/a_b.py",)], ("supplier", "s_suppkey", {"path": "replace(path, '.', k || '.')"}, "true"))


@query(f"select p[1] as id, file as name from (select string_split(file, '_') as p, file from (select string_split(path, '/')[-1] as file from {fx.woven_sql(_MIGRATIONS)} where not starts_with(path, 'src')))")
def migrations(spark, d):
    return discovery.migrations(fx.woven(spark, d, _MIGRATIONS))


# ------------------------------------------------------------ files and rules

_LANGS = "case lang when 'en' then '.py' when 'de' then '.ts' when 'fr' then '.md' else '.json' end"


def _files(spark, d) -> DataFrame:
    """Documents as files, whose extension follows from their language."""
    known = F.create_map(*[F.lit(x) for p in {"en": ".py", "de": ".ts", "fr": ".md"}.items() for x in p])
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.coalesce(F.try_element_at(known, F.col("lang")), F.lit(".json")))
    rows = table(spark, d, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"))
    return rows.withColumn("language", scalars.language_of(F.col("path")))


_FILES = f"select 'src/' || doc_id || coalesce({_LANGS}, '.json') as path, octet_length(encode(text)) as size_bytes, text, case coalesce({_LANGS}, '.json') when '.py' then 'Python' when '.ts' then 'TypeScript' when '.md' then 'Markdown' else 'JSON' end as language from documents"


@query(f"select language, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from ({_FILES}) group by language")
def files_by_language(spark, d):
    return _files(spark, d).filter("language is not null and language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"select path from ({_FILES}) where language in ('Python', 'TypeScript') and size_bytes between 1 and {rules.MAX_SCANNED_BYTES}")
def scannable_files(spark, d):
    return findings.scannable(_files(spark, d)).select("path")


@query(f"""select file_path, title, 'Review and remediate this ' || severity || '-severity finding.' as recommendation, substr(sha256(file_path || ':' || family || ':' || title || ':' || line_no), 1, 32) as finding_id from ({q.SQL["security_scan_documents"]})""")
def findings_with_advice(spark, d):
    found = findings.security_findings(q._doc_lines(spark, d))
    return findings.with_recommendation(found).select("file_path", "title", "recommendation", "finding_id")


@query(f"select file_path, line_no, title from ({q.SQL['security_scan_documents']}) where severity = 'high' order by file_path, line_no, title limit 20")
def findings_of_severity(spark, d):
    found = explore.find_findings(findings.security_findings(q._doc_lines(spark, d)), "HIGH")
    return found.orderBy("file_path", "line_no", "title").limit(20).select("file_path", "line_no", "title")


@query(f"with {q._DEBT} select cast(round(sum(effort_hours) * 10) as bigint) as effort_tenths from debt")
def debt_effort(spark, d):
    return findings.debt_score(q._debt(spark, d)).select(F.round(F.col("effort_hours") * 10).cast("long").alias("effort_tenths"))


@query("""select 'circular_dep' as type, 'medium' as severity, owner as name, arg_min('n' || n || '.py', n) as file_path, cast(min(n) as integer) as line_no from (select n_name as owner, n_nationkey as n from nation where n_nationkey % 2 = 0) group by owner""")
def circular_imports(spark, d):
    """Nations as modules; the even ones import a name that holds their own."""
    n = table(spark, d, "nation").filter("n_name is not null")
    path = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".py"))
    symbols = n.select(F.lit("function").alias("type"), F.lit("run").alias("name"), F.col("n_name").alias("parent"), path.alias("file_path"), F.col("n_nationkey").cast("int").alias("line_start"))
    imports = n.select(F.concat("n_name", F.lit(".sub")).alias("module"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit("_x"))).otherwise(F.lit("~")).alias("name"))
    return findings.circular_imports(symbols, imports)


@query(f"select module, file_path from {fx.woven_sql(fx.IMPORTS)} where is_relative or starts_with(module, '.') or starts_with(module, 'app.') or starts_with(module, 'src.')")
def relative_imports(spark, d):
    return fx.woven(spark, d, fx.IMPORTS).filter(scalars.is_relative(F.col("module"), F.col("is_relative"))).select("module", "file_path")


@query("select handler, array_to_string(list_filter([decorator, 'app.before_request'], lambda x: regexp_matches(lower(x), 'middleware|before_request|guard|interceptor|pipe')), ';') as middleware from " + fx.woven_sql(fx.DECORATORS) + f" where {q._METHODS} is not null")
def endpoint_middleware(spark, d):
    rows = fx.woven(spark, d, fx.DECORATORS).select(F.col("handler").alias("name"), F.array(F.col("decorator"), F.lit("app.before_request")).alias("decorators"), F.lit("method").alias("type"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("docstring"))
    return discovery.endpoints(rows).select("handler", F.array_join("middleware", ";").alias("middleware"))


# ------------------------------------------------------------- architecture

_PAGE_FILES = "(select distinct regexp_extract(url, '^https?://([^?#]+)', 1) || '/' || v.name as path from pages, (values ('view.tsx'), ('routes.py'), ('models.go')) v(name))"


def _page_files(spark, d) -> DataFrame:
    paths = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]+)", 1).alias("p")).distinct()
    names = F.explode(F.array(*map(F.lit, ["view.tsx", "routes.py", "models.go"])))
    return paths.select("p", names.alias("name")).select(F.concat_ws("/", "p", "name").alias("path"))


_ROLLED = f"""placed as (select path, {q._subsystem_sql()} as subsystem from (select path, string_split(lower(path), '/')[:-2] as dirs, string_split(lower(path), '/')[-1] as file from {_PAGE_FILES}))"""
_TIERS = "case subsystem " + " ".join(f"when {q._quote(i)} then {q._quote(t)}" for t, i, _, _ in rules.SUBSYSTEMS) + " end"


@query(f"""with {_ROLLED} select subsystem, {_TIERS} as tier, count(*) as files, count(*) * 2 as symbols, array_to_string(list_sort(list_distinct(list(case when path like '%.tsx' then 'React / UI' when path like '%.py' then 'Python' else 'Systems' end))), ';') as technologies,
array_to_string(list_sort(list(path))[1:4], ';') as key_files from placed where subsystem is not null group by subsystem""")
def subsystem_rollup(spark, d):
    files = _page_files(spark, d)
    symbols = files.select(F.col("path").alias("file_path"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    return discovery.subsystems(files, symbols).select("subsystem", "tier", "files", "symbols", F.array_join("technologies", ";").alias("technologies"), F.array_join("key_files", ";").alias("key_files"))


@query(f"with {_ROLLED} select tier, cast(sum(n) as bigint) as files, string_agg(subsystem, ';' order by subsystem) as components from (select subsystem, {_TIERS} as tier, count(*) as n from placed where subsystem is not null group by subsystem) group by tier")
def tier_layers(spark, d):
    files = _page_files(spark, d)
    found = discovery.subsystems(files, files.limit(0).select(F.col("path").alias("file_path")))
    return discovery.layers(found).select("tier", "files", F.array_join("components", ";").alias("components"))


@query("select 'core_module' as subsystem, 'application' as tier, count(*) as files from nation")
def architecture_fallback(spark, d):
    """Files in no known place are one application."""
    files = table(spark, d, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string"), F.lit(".zig")).alias("path"))
    return discovery.subsystems(files, files.limit(0).select(F.col("path").alias("file_path"))).select("subsystem", "tier", "files")


@query(f"""with {_ROLLED}, t as (select distinct subsystem, {_TIERS} as tier from placed where subsystem is not null) select subsystem, tier, cast((row_number() over (partition by tier order by subsystem) - 1) * 260 as integer) as x,
cast((list_position({[*dict.fromkeys(t for t, _, _, _ in rules.SUBSYSTEMS)]}, tier) - 1) * 160 as integer) as y from t""")
def subsystem_layout(spark, d):
    files = _page_files(spark, d)
    return discovery.layout(discovery.subsystems(files, files.limit(0).select(F.col("path").alias("file_path"))))


@query(f"select * from ({q.SQL['cross_subsystem_edges']}) order by n desc, src, dst limit 20")
def cross_edges_top(spark, d):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    pages = table(spark, d, "pages").select(host.alias("host"))
    hosts = pages.distinct().select(F.col("host").alias("ord"), F.col("host").alias("dotted"), F.col("host").alias("subsystem"))
    return discovery.cross_edges(pages.select(F.col("host").alias("subsystem"), F.element_at(F.split("host", r"\."), -3).alias("module")), hosts, 20)


# ------------------------------------------------------------------- history


@query("""select l_partkey as path, count(*) as changes, count(distinct o_custkey) as authors from (select * from orders order by o_orderdate desc, o_orderkey limit 300) join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey
group by 1 order by changes desc, path limit 30""")
def hotspots_newest(spark, d):
    return history.hotspots(q._commits(spark, d), q._commit_files(spark, d), newest=300, top=30)


@query("select o_custkey as author, count(*) as commits from orders group by 1 order by commits desc, author limit 15")
def leading_contributors(spark, d):
    return history.leading(history.contributors(q._commits(spark, d)), 15).select("author", "commits")


# ----------------------------------------------------------------- retrieval


@query(f"select row_number() over (order by source, rank) as n, text_md5, score from ({q.SQL['retrieval_fusion']})")
def citations(spark, d):
    docs = table(spark, d, "documents")
    a = retrieval.first_places(docs.filter(F.col("text").contains("MIT")), "text", F.struct("doc_id"), 12).withColumn("score", F.lit(1.0))
    b = retrieval.first_places(docs, "text", F.struct(-F.col("n_chars").alias("n"), F.col("doc_id")), 24).withColumn("score", F.lit(0.5))
    fused = retrieval.fuse([a, b], 12).withColumn("md5", F.md5(F.col("text").cast("binary")))
    return retrieval.citations(fused, "md5").select(F.col("n").cast("long").alias("n"), F.col("md5").alias("text_md5"), "score")


_ATTRIBUTES = """with a as (select page_id as id, lower(url) as path, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) as content from pages), t as (select id, list_filter(string_split_regex(path || ' ' || content, '[^a-z0-9]+'), lambda x: x <> '') as w from a),
h as (select id, word, len(list_filter(w, lambda x: x = word)) as tf from t, (values ('example'), ('en')) v(word)), df as (select word, count(*) as df from h where tf > 0 group by word)
select id, round(sum(tf * ln(1 + (select count(*) from pages) / df)), 4) as score, count(*) as matched from h join df using (word) where tf > 0 group by id order by score desc, id limit 10"""


@query(_ATTRIBUTES)
def attribute_search(spark, d):
    """Full text over several attributes of an index."""
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.regexp_replace("html", "<[^>]*>", " ").alias("content"))
    return retrieval.search_index(rows, "id", ["path", "content"], ["example", "en"], 10)


@query(f"select substr(sha256('repo:' || file_path || ':' || name || ':' || line_start), 1, 32) as id, name, type, file_path from {fx.woven_sql(fx.SYMBOLS)}")
def symbol_documents(spark, d):
    return retrieval.symbol_documents(fx.woven(spark, d, fx.SYMBOLS).withColumn("signature", F.lit("")), "repo").select("id", "name", "type", "file_path")


@query("select substr(sha256('repo:' || url), 1, 32) as id, url as file_path, regexp_replace(string_split(url, '/')[-1], '[.][^.]*$', '') as title, length(html) > 10000 as cut from pages")
def document_documents(spark, d):
    rows = table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").alias("content"))
    return retrieval.document_documents(rows, "repo").select("id", "file_path", "title", "cut")


# ----------------------------------------------------- manifests and sources

#: Manifests, woven with suppliers as repositories, and what they name (name, version, type, source).
_OF_REPOSITORY = ("supplier", "s_suppkey", {"path": "'r' || k || '/' || path", "content": "replace(content, '2.0', '2.' || k)", "version": "replace(version, '2.0', '2.' || k)"}, "true")
_MANIFESTS = ("path string, content string", [
    ("package.json", '{"dependencies": {"react": "^18.0.0", "next": "14"}, "devDependencies": {"jest": "29"}, "peerDependencies": {"vue": "3"}}'),
    ("b/package.json", "not json"),
    ("requirements.txt", "flask==2.0\n# no\n-r x\ncelery[redis]>=5,<6\nplain\n"),
    ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n"fastapi>=0.1",\n"uvicorn"\n]\n[tool.dev]\npytest = "8"\n[other]\nz = 1\n'),
    ("pom.xml", "<project><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>\n<dependency> <groupId>h</groupId> <artifactId>b</artifactId> </dependency></project>"),
], _OF_REPOSITORY)
_PACKAGES = ("name string, version string, type string, source string", [
    ("react", "^18.0.0", "runtime", "package.json"), ("next", "14", "runtime", "package.json"), ("jest", "29", "dev", "package.json"), ("vue", "3", "peer", "package.json"),
    ("flask", "2.0", "runtime", "requirements.txt"), ("celery[redis]", "5", "runtime", "requirements.txt"), ("plain", None, "runtime", "requirements.txt"),
    ("fastapi", "0.1", "runtime", "pyproject.toml"), ("uvicorn", None, "runtime", "pyproject.toml"), ("pytest = \"8", None, "dev", "pyproject.toml"), ("g:a", "1", "runtime", "pom.xml"), ("h:b", None, "runtime", "pom.xml"),
], _OF_REPOSITORY)


def _values(rows: list[tuple], *names: str) -> str:
    value = lambda x: "null" if x is None else str(x) if isinstance(x, (int, bool)) else q._quote(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({', '.join(names)})"


def _manifests(spark, d) -> DataFrame:
    return fx.woven(spark, d, _MANIFESTS)


@query(f"from {fx.woven_sql(_PACKAGES)}")
def manifest_union(spark, d):
    return manifests.packages(_manifests(spark, d)).select("name", "version", "type", "source")


@query("select 'FastAPI;Flask;Maven;Next.js;React;Vue' as frameworks, 'maven;npm;pip;poetry/pip' as managers, false as is_monorepo from supplier limit 1")
def repository_facts(spark, d):
    """Frameworks and package managers of all repositories' manifests, in order."""
    found = discovery.repository_facts(_manifests(spark, d).select("path"), manifests.packages(_manifests(spark, d)))
    return found.select(F.array_join("frameworks", ";").alias("frameworks"), F.array_join("package_managers", ";").alias("managers"), "is_monorepo")


def _named(column: str) -> str:
    """A text in which some names have the supplier's key."""
    for name in ("Sub", "meth", "foo", "greet", "Hello", "Config", "Engine", "Worker", "f2"):
        column = f"replace({column}, '{name}', '{name}' || k)"
    return column


#: Sources in each language, woven with suppliers, and all that their parsers find.
_OF_SOURCE = ("supplier", "s_suppkey", {c: "replace(" + c + ", '.', k || '.')" for c in ("path", "file_path")} | {c: _named(c) for c in ("content", "name", "parent", "caller", "callee", "signature")}, "true")
_SOURCES = ("path string, content string", [
    ("a.py", "import os\nfrom a.b import c as d\n\nclass Sub(Base):\n    def meth(self, x: int = 5) -> str:\n        return str(x)\n"),
    ("b.ts", "import { Foo } from 'mod';\nexport interface I { x: number }\nenum E { A }\ntype T = string;\nclass C extends B {\n  private foo(a: string): number { return bar(a); }\n}\n"),
    ("c.js", "import a from 'm';\nclass A extends B {\n  m() { foo(); }\n}\nfunction f(p) { f2(); }\n"),
    ("D.java", "import java.util.List;\npublic class Hello extends Base {\n  private int count;\n  public void greet(String name) { System.out.println(name); }\n}\n"),
    ("e.go", 'package main\nimport "fmt"\ntype Config struct { Port int }\ntype Runner interface { Run() }\nfunc (c *Config) Address() string { return fmt.Sprint(c.Port) }\nfunc Start() { run() }\n'),
    ("f.rs", "use std::collections::HashMap;\npub struct Engine { n: u32 }\npub trait Worker { fn work(&self); }\nimpl Engine {\n    pub fn new() -> Self { Engine { n: 0 } }\n}\npub fn execute() { println!(\"x\"); }\n"),
    ("g.txt", "class No:\n    pass\n"),
], _OF_SOURCE)
_FOUND = ("file_path string, name string, type string, parent string, signature string", [
    ("a.py", "Sub", "class", None, "class Sub"), ("a.py", "meth", "method", "Sub", "meth(self, x: int = 5) -> str"),
    ("b.ts", "I", "interface", None, "export interface I"), ("b.ts", "E", "enum", None, "enum E"), ("b.ts", "T", "type_alias", None, "type T"), ("b.ts", "C", "class", None, "class C extends B"), ("b.ts", "foo", "method", "C", "foo(a: string): number"),
    ("c.js", "A", "class", None, "class A extends B"), ("c.js", "m", "method", "A", "m()"), ("c.js", "f", "function", None, "f(p)"),
    ("D.java", "Hello", "class", None, "public class Hello extends Base"), ("D.java", "count", "variable", "Hello", "private int count"), ("D.java", "greet", "method", "Hello", "void greet(String name)"),
    ("e.go", "Config", "class", None, "type Config struct"), ("e.go", "Runner", "interface", None, "type Runner interface"), ("e.go", "Address", "method", "Config", "func (c *Config) Address() string"), ("e.go", "Start", "function", None, "func Start()"),
    ("f.rs", "Engine", "class", None, "pub struct Engine"), ("f.rs", "Worker", "interface", None, "pub trait Worker"), ("f.rs", "work", "method", "Worker", "fn work(&self)"), ("f.rs", "new", "method", "Engine", "pub fn new() -> Self"), ("f.rs", "execute", "function", None, "pub fn execute()"),
], _OF_SOURCE)
_IMPORTED = ("file_path string, module string, symbol string, alias string", [
    ("a.py", "os", None, None), ("a.py", "a.b", "c", "d"), ("b.ts", "mod", "Foo", None), ("c.js", "m", "a", None), ("D.java", "java.util", "List", None), ("e.go", "fmt", None, None), ("f.rs", "std::collections::HashMap", "HashMap", None),
], _OF_SOURCE)
_CALLED = ("file_path string, caller string, callee string", [
    ("a.py", "meth", "str"), ("b.ts", "foo", "bar"), ("c.js", "m", "foo"), ("c.js", "f", "f2"), ("D.java", "greet", "System.out.println"), ("e.go", "Config.Address", "fmt.Sprint"), ("e.go", "Start", "run"), ("f.rs", "execute", "println!"),
], _OF_SOURCE)
_COUNTED = ("file_path string, language string, loc int", [("a.py", "Python", 5), ("b.ts", "TypeScript", 7), ("c.js", "JavaScript", 5), ("D.java", "Java", 5), ("e.go", "Go", 6), ("f.rs", "Rust", 7)], _OF_SOURCE)


def _parsed(spark, d) -> DataFrame:
    return parsers.parse(fx.woven(spark, d, _SOURCES))


@query(f"select file_path, name, type, parent from {fx.woven_sql(_FOUND)}")
def parsed_symbols(spark, d):
    return parsers.records(_parsed(spark, d), "symbols").select("file_path", "name", "type", F.nullif("parent", F.lit("")).alias("parent"))


@query(f"select file_path, module, symbol, alias from {fx.woven_sql(_IMPORTED)}")
def parsed_imports(spark, d):
    return parsers.records(_parsed(spark, d), "imports").select("file_path", "module", F.col("name").alias("symbol"), "alias")


@query(f"from {fx.woven_sql(_CALLED)}")
def parsed_calls(spark, d):
    return parsers.records(_parsed(spark, d), "calls").select("file_path", "caller", "callee")


@query(f"from {fx.woven_sql(_COUNTED)}")
def parsed_files(spark, d):
    return _parsed(spark, d).select("file_path", "language", "loc")


@query(f"select file_path, name, signature from {fx.woven_sql(_FOUND)}")
def parsed_signatures(spark, d):
    return parsers.records(_parsed(spark, d), "symbols").select("file_path", "name", "signature")


@query("select conv_id, turn, role, text from conversations where turn % 2 = 0 union all select conv_id, turn, 'new', '' from conversations where turn % 2 = 1")
def upserted(spark, d):
    """Rows that take the place of those with their key."""
    old = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return sources.upsert(old, old.filter("turn % 2 = 1").select("conv_id", "turn", F.lit("new").alias("role"), F.lit("").alias("text")), ["conv_id", "turn"])


# ------------------------------------------------------------------- answers


def _said(rows: DataFrame) -> DataFrame:
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["reference"], F.lit("="), c["snippet"])), ";")
    return rows.select("intent", "answer", cited.alias("cited"))


def _ranked(order: str) -> str:
    return f"string_agg(line, chr(10) order by {order})"


@query(f"""with f as ({q.SQL["security_scan_documents"]}), o as (select *, row_number() over (order by list_position(['critical', 'high', 'medium', 'low', 'info'], severity), file_path, line_no, title) as n, file_path || ':' || line_no as place from f)
select 'security' as intent, 'Security' || chr(10) || '- Risk score: ' || cast({q._RISK} as double) || '/100' || chr(10) || '- Findings: ' || count(*) || chr(10) || {" || ', ' || ".join(f"'{s} ' || count(case when severity = '{s}' then 1 end)" for s in explore.SEVERITIES)} || chr(10) || 'Most severe:' || chr(10) ||
string_agg(case when n <= 8 then '- [' || upper(severity) || '] ' || title || ' at ' || place end, chr(10) order by n) as answer, string_agg(case when n <= 6 then place || '=' || title end, ';' order by n) as cited from o""")
def answer_security(spark, d):
    return _said(answers.answer(spark, {"security": findings.security_findings(q._doc_lines(spark, d))}, "security"))


@query(f"""with {_MODELS}, t as (select 'supplier' || s_suppkey || 's' as name, m.name as model, file_path from m), k as (select model, name, row_number() over (partition by model order by p) as i from (select distinct 'Supplier' || l_suppkey as model, l_partkey as p, 'f' || l_partkey || case when l_partkey % 11 = 0 then '_id' else '' end as name from lineitem where l_suppkey % 2 = 0)),
o as (select t.name, file_path, coalesce(string_agg(k.name, ', ' order by i), 'id') as cols, row_number() over (order by t.name, file_path) as n from t left join k on k.model = t.model and i <= 5 group by t.name, file_path)
select 'database' as intent, 'Database' || chr(10) || '- Tables: ' || count(*) || chr(10) || '- Relationships: ' || (select count(*) from m join f on f.model = m.name where fk) || chr(10) || 'Tables:' || chr(10) ||
string_agg(case when n <= 10 then '- ' || name || ': ' || cols || ' in ' || file_path end, chr(10) order by n) as answer, string_agg(case when n <= 5 then file_path || '=Table ' || name end, ';' order by n) as cited from o""")
def answer_database(spark, d):
    found = discovery.tables(*_models(spark, d))
    return _said(answers.answer(spark, {"tables": found, "relationships": discovery.relationships(found)}, "database"))


@query(f"""with p as (from {fx.woven_sql(_PACKAGES)}), c as ({q.SQL["module_cycles"]}), pn as (select *, row_number() over (order by name, type) as n from p),
cn as (select *, row_number() over (order by length, list_transform(string_split(cycle, '>'), lambda x: cast(x as integer))) as n from c)
select 'dependencies' as intent, 'Dependencies' || chr(10) || '- Packages: ' || (select count(*) from p) || chr(10) || '- Circular dependencies: ' || (select count(*) from c) || chr(10) ||
(select 'Cycles:' || chr(10) || string_agg('- ' || replace(cycle, '>', ' -> '), chr(10) order by n) from cn where n <= 5) || chr(10) || (select 'Packages:' || chr(10) || string_agg('- ' || name || ' (' || type || ')', chr(10) order by n) from pn where n <= 10) as answer,
(select replace(cycle, '>', ' -> ') || '=Circular dependency' from cn where n = 1) as cited""")
def answer_dependencies(spark, d):
    return _said(answers.answer(spark, {"packages": manifests.packages(_manifests(spark, d)), "cycles": graph.cycles(q._linked(spark, d), 3)}, "dependencies"))


@query("""with h as (select l_partkey as path, count(*) as changes from (select distinct l_orderkey, l_partkey from lineitem) group by 1), o as (select *, row_number() over (order by changes desc, path) as n from h)
select 'git' as intent, 'History' || chr(10) || '- Commits: ' || (select count(*) from orders) || ' by ' || (select count(distinct o_custkey) from orders) || ' contributors' || chr(10) || 'Changed most:' || chr(10) ||
string_agg(case when n <= 6 then '- ' || path || ': ' || changes || ' changes' end, chr(10) order by n) as answer, string_agg(case when n <= 4 then path || '=' || changes || ' changes' end, ';' order by n) as cited from o""")
def answer_git(spark, d):
    commits = q._commits(spark, d)
    hot = history.hotspots(commits, q._commit_files(spark, d), top=30).withColumn("path", F.col("path"))
    return _said(answers.answer(spark, {"contributors": history.contributors(commits), "hotspots": hot}, "git"))


@query("select r_name as repository, intent, title || coalesce(chr(10) || rest, '') as answer, '' as cited from region, (" + _values([
    ("explain", "What it is", None), ("setup", "How to run it", "The documentation names no command."), ("entry_points", "Where it starts", "No file has a name that programs start from."), ("tech_stack", "What it is made with", "- Endpoints: 0\n- Tables: 0"),
    ("health", "How healthy it is", None), ("security", "Security", "- Risk score: 0.0/100\n- Findings: 0\ncritical 0, high 0, medium 0, low 0, info 0\nThe rules found nothing."), ("architecture", "Architecture", "No layer was recognised."), ("performance", "Performance", "- Performance findings: 0\nNo antipattern was found."),
    ("dependencies", "Dependencies", "- Packages: 0\n- Circular dependencies: 0\nThe modules form no cycle."), ("apis", "Endpoints", "- Endpoints: 0\nNo endpoint was found."), ("database", "Database", "- Tables: 0\n- Relationships: 0\nNo model was found."), ("debt", "Technical debt", "- Debt score: 0.0/100, 0.0 hours\n- Items: 0\nNothing was found."),
    ("git", "History", "- Commits: 0 by 0 contributors\nNo history was read."), ("symbols", "Symbols", "The question names nothing that the graph holds."), ("overview", "Overview", "- Security findings: 0\nAsk about its purpose, set-up, architecture, security, dependencies, endpoints, tables, debt, history or health."),
], "intent", "title", "rest") + ")")
def answers_without_results(spark, d):
    """Every builder on no results, for each region as a repository."""
    said = _said(reduce(DataFrame.unionByName, [answers.answer(spark, {}, i) for i in answers.BUILDERS]))
    return table(spark, d, "region").select(F.col("r_name").alias("repository")).join(F.broadcast(said))  # a row for each builder
