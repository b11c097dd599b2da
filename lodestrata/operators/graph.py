"""A property graph as two tables, nodes and edges, and the algorithms over it.

nodes: (id, labels array<string>, ...), edges: (src, dst, type, ...).  Iterative
algorithms are loops over DataFrames whose rounds are written to the shared
folder, so that plans stay short; only counts and sums reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import key_of
from lodestrata.session import cut

LABELS = {"class": "Class", "function": "Function", "method": "Method", "interface": "Interface", "variable": "Variable", "type_alias": "TypeAlias"}


def build(repo_id: str, files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a repository: it contains files, which define symbols and import
    modules; symbols call symbols, and classes have methods."""
    root, known = F.lit(repo_id), F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    file_key, symbol_key, module_key = (lambda *c: key_of(F.lit("file"), root, *c)), (lambda *c: key_of(F.lit("symbol"), root, *c)), (lambda *c: key_of(F.lit("module"), root, *c))
    some = files.filter(F.col("language").isNotNull() & (F.col("language") != ""))
    sym = symbols.withColumn("id", symbol_key(F.col("file_path"), F.col("name"), F.col("line_start").cast("string")))
    none = F.lit(None).cast("string")

    def node(df: DataFrame, i: Column, label: Column, name: Column, path: Column, doc: Column = none, returns: Column = none) -> DataFrame:
        return df.select(i.alias("id"), F.array(label).alias("labels"), name.alias("name"), path.alias("file_path"), F.substring(doc, 1, 500).alias("docstring"), returns.alias("return_type"), root.alias("repo_id"))

    for c in ("docstring", "return_type"):
        sym = sym if c in sym.columns else sym.withColumn(c, none)
    nodes = [
        node(files.sparkSession.range(1), key_of(F.lit("repo"), root), F.lit("Repository"), root, none),
        node(some, file_key(F.col("path")), F.lit("File"), F.col("path"), F.col("path")),
        node(sym, F.col("id"), F.coalesce(F.try_element_at(known, F.col("type")), F.lit("Function")), F.col("name"), F.col("file_path"), F.col("docstring"), F.col("return_type")),
        node(imports.select("module").distinct(), module_key(F.col("module")), F.lit("Module"), F.col("module"), none),
    ]
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), root.alias("repo_id"))
    edges = [
        edge(some, key_of(F.lit("repo"), root), file_key(F.col("path")), "CONTAINS"),
        edge(sym, file_key(F.col("file_path")), F.col("id"), "DEFINES"),
        edge(imports, file_key(F.col("file_path")), module_key(F.col("module")), "IMPORTS"),
        edge(class_methods(sym), F.col("src"), F.col("dst"), "HAS_METHOD"),
        edge(resolve_calls(sym, calls), F.col("src"), F.col("dst"), "CALLS"),
    ]
    return reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"]), reduce(DataFrame.unionByName, edges).distinct()


def class_methods(symbols: DataFrame) -> DataFrame:
    """(src, dst): classes and their methods, by file and the parent's name; a merge as in ``resolve_calls``."""
    methods, classes = symbols.filter("type = 'method'").alias("m"), symbols.filter("type = 'class'").hint("merge").alias("c")
    return methods.join(classes, (F.col("m.file_path") == F.col("c.file_path")) & (F.col("m.parent") == F.col("c.name"))).select(F.col("c.id").alias("src"), F.col("m.id").alias("dst"))


def get_node(nodes: DataFrame, node_id) -> DataFrame:
    """The node with an id, or no row."""
    return nodes.filter(F.col("id") == node_id).limit(1)


def repository_view(nodes: DataFrame, edges: DataFrame, repo_id: str) -> tuple[DataFrame, DataFrame]:
    """One repository's nodes and edges; where the tables are partitioned by it, only they are read."""
    return nodes.filter(F.col("repo_id") == repo_id), edges.filter(F.col("repo_id") == repo_id)


def clear_repository(nodes: DataFrame, edges: DataFrame, repo_id: str) -> tuple[DataFrame, DataFrame]:
    """The tables without one repository."""
    return nodes.filter(~F.col("repo_id").eqNullSafe(repo_id)), edges.filter(~F.col("repo_id").eqNullSafe(repo_id))


def duplicated(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that stand more than once: what a uniqueness constraint would refuse."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def with_parents(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes with one of the labels, and the files that define one."""
    some = nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    above = edges.filter("type = 'DEFINES'").join(some.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.join(some.select("id").union(above).distinct(), "id", "left_semi")


def named_in(nodes: DataFrame, text: Column, rows: DataFrame, key: str) -> DataFrame:
    """(key, id, name) of nodes that a row's text names: its words are joined with the names,
    without regard to case."""
    words = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("__word"))
    return words.join(nodes.select("id", "name", F.lower("name").alias("__word")), "__word").select(key, "id", "name").distinct()


def resolve_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst) of calls: the caller by file and name, the callee by name, preferring the
    caller's file and then the last one by (file, line); a symbol doesn't call itself.

    The joins are merges: symbols that are exploded from few rows look small enough to be
    broadcast, which would bring all of them to the driver."""
    place = F.struct("file_path", "line_start", "id")
    caller = symbols.groupBy("file_path", F.col("name").alias("caller")).agg(F.max(place).getField("id").alias("src"))
    near = symbols.groupBy("file_path", F.col("name").alias("callee")).agg(F.max(place).getField("id").alias("near"))
    far = symbols.groupBy(F.col("name").alias("callee")).agg(F.max(place).getField("id").alias("far"))
    rows = calls.select("file_path", "caller", "callee").distinct().join(caller.hint("merge"), ["file_path", "caller"]).join(near.hint("merge"), ["file_path", "callee"], "left").join(far.hint("merge"), "callee", "left")
    return rows.select("src", F.coalesce("near", "far").alias("dst")).filter("dst is not null and src <> dst").distinct()


def latest_edges(edges: DataFrame, order: Column) -> DataFrame:
    """One edge for each (src, dst, type): the last one."""
    w = Window.partitionBy("src", "dst", "type").orderBy(order.desc())
    return edges.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id, direction: str = "both", kind: str | None = None, limit: int | None = None) -> DataFrame:
    """The node and those one edge away from it, by the first ``limit`` edges of each direction."""
    some = edges if kind is None else edges.filter(F.col("type") == kind)
    first = lambda rows: rows if limit is None else rows.orderBy("id").limit(limit)
    out = first(some.filter(F.col("src") == node_id).select(F.col("dst").alias("id")))
    into = first(some.filter(F.col("dst") == node_id).select(F.col("src").alias("id")))
    parts = {"out": [out], "in": [into], "both": [out, into]}[direction]
    ids = reduce(DataFrame.union, [*parts, nodes.filter(F.col("id") == node_id).select("id")]).distinct()
    return nodes.join(ids, "id", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with one of the labels, the first ``limit`` by id, and the edges between them."""
    some = nodes if labels is None else nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    some = some if limit is None else some.orderBy("id").limit(limit)
    ids = some.select("id")
    return some, edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def extend_paths(paths: DataFrame, edges: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Simple paths, one edge longer."""
    grown = paths.join(edges.select(F.col("src").alias("last"), "dst"), "last").filter(~F.array_contains("path", F.col("dst")))
    grown = grown if allowed is None else grown.filter(allowed)
    return grown.select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))


def distances_to(edges: DataFrame, dst, most: int) -> DataFrame:
    """(id, left): the fewest directed edges from a node to ``dst``, up to ``most``."""
    seen = edges.sparkSession.range(1).select(F.lit(dst).alias("id"), F.lit(0).alias("left"))
    front = seen
    for k in range(1, most + 1):
        step = edges.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("left", F.lit(k)), "distances")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, src, dst, max_depth: int = 5, limit: int | None = None) -> DataFrame:
    """All simple directed paths from src to dst of up to ``max_depth`` edges, or the shortest
    ``limit`` of them.  A path grows only to nodes from which dst is near enough."""
    plain = cut(simple_edges(edges), "path-edges")
    left = distances_to(plain, dst, max_depth - 1)

    def near(level: DataFrame, depth: int) -> DataFrame:
        return level.join(left.filter(F.col("left") <= max_depth - depth).select(F.col("id").alias("last")), "last", "left_semi")

    level = near(plain.filter((F.col("src") == src) & (F.col("dst") != src)).select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")), 1)
    found = []
    for depth in range(1, max_depth + 1):
        found.append(level.filter(F.col("last") == dst))
        if depth < max_depth:
            level = near(extend_paths(level.filter(F.col("last") != dst), plain), depth + 1)
    out = reduce(DataFrame.unionByName, found).select("path", (F.size("path") - 1).alias("depth"))
    return out if limit is None else out.orderBy("depth", "path").limit(limit)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(src, dst, path) of pairs (src, dst) that are connected by up to ``max_depth`` edges, taken
    both ways: of the shortest paths, the first.

    All pairs are searched at once, from both ends: the side with fewer open nodes takes the
    next step, each node keeps its first path, and a pair is done where its sides first meet.
    Only what is new at each step is joined with the adjacency, which is written once."""
    both = cut(simple_edges(edges.select("src", "dst").union(edges.select("dst", "src"))), "adjacency")
    kind = both.schema["src"].dataType
    left = cut(pairs.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct(), "pairs")
    pair, key = ["src", "dst"], ["src", "dst", "id"]
    # each side's nodes, with their path from the source or to the target
    seen = [left.select(*pair, F.col(end).alias("id"), F.array(end).alias("path")) for end in pair]
    front, sizes, found, side = list(seen), [1, 1], [], 0
    for depth in range(max_depth + 1):
        if depth:
            side = 0 if sizes[0] <= sizes[1] else 1
            step = front[side].join(left, pair, "left_semi").join(both.toDF("id", "next"), "id")
            grown = F.concat("path", F.array("next")) if side == 0 else F.concat(F.array("next"), F.col("path"))
            new = step.select(*pair, F.col("next").alias("id"), grown.alias("path")).groupBy(key).agg(F.min("path").alias("path"))
            front[side] = cut(new.join(seen[side].select(key), key, "left_anti"), "frontier")
            sizes[side] = front[side].count()
            if not sizes[side]:
                break
            seen[side] = seen[side].unionByName(front[side])
        near, far = front[side], seen[1 - side].withColumnRenamed("path", "rest")
        first, last = ("path", "rest") if side == 0 else ("rest", "path")
        met = near.join(far, key).select(*pair, F.concat(first, F.slice(last, F.lit(2), F.size(last))).alias("path"))
        found.append(cut(met.groupBy(pair).agg(F.min("path").alias("path")), "met"))
        left = cut(left.join(found[-1], pair, "left_anti"), "pairs")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def shortest_path(edges: DataFrame, src, dst, max_depth: int = 10) -> DataFrame:
    """One shortest path, edges taken both ways."""
    return shortest_paths(edges, edges.sparkSession.range(1).select(F.lit(src).alias("src"), F.lit(dst).alias("dst")), max_depth).select("path")


def cycles(edges: DataFrame, max_length: int = 10, limit: int | None = None, components: DataFrame | None = None) -> DataFrame:
    """All simple cycles of up to ``max_length`` nodes, or the shortest ``limit`` of them, each
    once: it starts at its smallest node.  Edges that no cycle can pass go first: those between
    ``strong_components`` where these are given, or else those of nodes with no edge in or none
    out.  With a limit, longer cycles are looked for only while it isn't met."""
    plain = simple_edges(edges).filter("src <> dst")
    if components is not None:
        plain = plain.join(components.toDF("src", "a"), "src").join(components.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")
    for _ in range(0 if components is not None else 3):
        plain = plain.join(plain.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(plain.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    plain = cut(plain.select("src", "dst"), "cycle-edges")
    level = plain.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    back = plain.select(F.col("src").alias("last"), F.col("dst").alias("start"))
    found = []
    for length in range(2, max_length + 1):
        found.append(level.join(back, ["last", "start"], "left_semi"))
        if limit is not None and reduce(DataFrame.unionByName, found).limit(limit).count() == limit:
            break
        if length < max_length:
            level = cut(extend_paths(level, plain, F.col("dst") > F.col("start")), "cycle-paths")
            if level.isEmpty():
                break
    out = reduce(DataFrame.unionByName, found).select(F.col("path").alias("cycle"), F.size("path").alias("length"))
    return out if limit is None else out.orderBy("length", "cycle").limit(limit)


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): parallel edges count once, and nodes without edges out spread their score
    evenly.  Stops when the scores' total change is below the tolerance (0 runs all rounds).

    A round is one join along the edges and one aggregation, which also carries the nodes
    that nothing points to; what isn't sent along edges is what loose nodes spread, so that
    share follows from one sum and needs no join."""
    plain = simple_edges(edges)
    out = plain.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    state = nodes.select("id").distinct().join(out, "id", "left")
    n = nodes.select("id").distinct().count()
    if not n:
        return state.select("id", F.lit(0.0).alias("score"))
    plain = cut(plain, "rank-edges")
    state = cut(state.select("id", "out", F.lit(1.0 / n).alias("score")), "ranks")
    for _ in range(rounds):
        sent = plain.join(state.select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("part")), "src")
        rows = sent.select(F.col("dst").alias("id"), F.lit(None).cast("long").alias("out"), F.col("part"), F.lit(None).cast("double").alias("before"))
        rows = rows.unionByName(state.select("id", "out", F.lit(0.0).alias("part"), F.col("score").alias("before")))
        got, total = rows.groupBy("id").agg(F.max("out").alias("out"), F.sum("part").alias("part"), F.max("before").alias("before")), Observation()
        got = cut(got.observe(total, F.sum("part").alias("sent")), "ranks")  # summed while it is written
        loose = max(0.0, 1.0 - total.get["sent"])
        new = got.select("id", "out", (F.lit((1 - alpha) / n + alpha * loose / n) + alpha * F.col("part")).alias("score"), "before")
        if tolerance and new.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] < tolerance:
            return new.select("id", "score")
        state = new.select("id", "out", "score")
    return state.select("id", "score")


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 10, **options) -> DataFrame:
    ranked = pagerank(nodes, edges, **options).join(degrees(simple_edges(edges)), "id", "left")
    rows = ranked.select("id", F.round("score", 4).alias("score"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    return rows.orderBy(F.desc("score"), "id").limit(top)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that a node is connected with, edges taken both ways."""
    both = simple_edges(edges.select("src", "dst").union(edges.select("dst", "src")))
    state = cut(both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")), "components")
    both = cut(both, "component-edges")
    while True:
        low = both.join(state.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("low"))
        new = state.join(low, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("c"), F.col("component").alias("before"))
        # follow the label of the label
        new = new.join(new.select(F.col("id").alias("c"), F.col("c").alias("further")), "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("component"), "before")
        new = cut(new, "components")
        if new.filter("component <> before").isEmpty():
            return new.select("id", "component")
        state = new.select("id", "component")


def least_reaching(edges: DataFrame) -> DataFrame:
    """(id, label): the least node with a directed path to a node, itself included.

    A round passes labels along the edges, and takes over the labels of three nodes from which
    the node is reached: that of its label, and two that each round doubles the distance of,
    first the greatest and the least with an edge to it.  So a chain is passed in rounds
    that grow with the logarithm of its length, whether its numbers go up, down or anyhow."""
    both = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.col("src").alias("by")), F.struct(F.col("src").alias("id"), F.lit(None).alias("by")))).alias("e"))
    state = cut(both.groupBy("e.id").agg(F.max("e.by").alias("high"), F.min("e.by").alias("low")).select("id", F.col("id").alias("label"), F.coalesce("high", "id").alias("high"), F.coalesce("low", "id").alias("low")), "labels")
    while True:
        asked = state.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("to")) for k, c in enumerate(("id", "label", "high", "low"))])).alias("q")).select("id", "q.*")
        asked = asked.unionByName(edges.select(F.col("dst").alias("id"), F.lit(4).alias("kind"), F.col("src").alias("to")))
        told = asked.join(state.toDF("to", "label", "high", "low"), "to").groupBy("id")
        only = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
        new = told.agg(F.min("label").alias("label"), only(2, "high").alias("high"), only(3, "low").alias("low"), only(0, "label").alias("before"))
        changed = Observation()
        state = cut(new.observe(changed, F.count(F.when(F.col("label") != F.col("before"), 1)).alias("n")), "labels").drop("before")
        if not changed.get["n"]:
            return state.select("id", "label")


def strong_components(edges: DataFrame, trims: int = 3) -> DataFrame:
    """(id, component) of every node of the edges: the least node that it reaches and is reached
    from (itself where there is no other).

    Rounds of: trimming (nodes without an edge in or out are on no cycle), forward labels and
    backward labels (the least node that reaches a node, and that it reaches).  A node whose two
    labels agree is in the component of that node; every class of equal labels gives at least
    one component a round.  An edge whose ends' labels differ is on no cycle and goes."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rest = cut(simple_edges(edges).filter("src <> dst"), "strong-edges")
    found = []
    while True:
        for _ in range(trims):
            rest = rest.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            rest = cut(rest, "strong-edges")
        rest = cut(rest, "strong-edges") if not trims else rest
        if rest.isEmpty():
            break
        forward = least_reaching(rest)
        same = lambda labels: rest.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")  # noqa: B023, E731
        within = cut(same(forward), "strong-edges")
        backward = least_reaching(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        labels = cut(forward.join(backward.withColumnRenamed("label", "back"), "id").select("id", "label", "back"), "strong-labels")
        found.append(labels.filter("label = back").select("id", F.col("label").alias("component")))
        open_ = labels.filter("label <> back").select("id", F.struct("label", "back").alias("key"))
        rest = within.join(open_.toDF("src", "a"), "src").join(open_.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")
    if not found:
        return ids.withColumn("component", F.col("id"))
    return ids.join(reduce(DataFrame.unionByName, found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def circular(components: DataFrame) -> DataFrame:
    """The nodes (id) on a cycle of any length through another node, of (id, component)."""
    shared = components.filter("id <> component").select("component").distinct()
    return components.join(shared, "component", "left_semi").select("id")


# ------------------------------------------------------------- service graph


def service_edges(links: DataFrame) -> DataFrame:
    """(src, dst, call_count) of links between different modules."""
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("call_count"))


def service_nodes(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(id, in_count, out_count, dependents, impact, is_circular) of weighted edges; the
    dependents are the blast radius.  A node is circular if its strong component
    (``strong_components`` unless given) has other nodes: cycles of any length count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).cast("long").alias("i"), F.col("call_count").alias("o"), F.lit(0).alias("d")), F.struct(F.col("dst").alias("id"), F.col("call_count").alias("i"), F.lit(0).cast("long").alias("o"), F.lit(1).alias("d")))).alias("e"))
    rows = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_count"), F.sum("e.o").alias("out_count"), F.sum("e.d").alias("dependents")).withColumn("impact", impact(F.col("dependents")))
    members = circular(strong_components(edges) if components is None else components).withColumn("c", F.lit(True))
    return rows.join(members, "id", "left").withColumn("is_circular", F.coalesce("c", F.lit(False))).drop("c")


def impact(dependents: Column) -> Column:
    return F.when(dependents >= 5, "Critical").when(dependents >= 2, "Moderate").otherwise("Low")
