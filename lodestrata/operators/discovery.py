"""Discovery of endpoints, schemas, packages, frameworks and architecture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import any_of, extension_of, first_of, table_name
from lodestrata.operators.ranking import numbered
from lodestrata.operators.substrings import held
from lodestrata.plans import rules
from lodestrata.session import cut

# ---------------------------------------------------------------------- APIs


def route_method(decorator: Column) -> Column:
    """The HTTP method of a route decorator; null if it is none."""
    low = F.lower(decorator)
    methods = F.regexp_extract(decorator, r"methods\s*=\s*\[([^\]]+)\]", 1)
    first = F.trim(F.split(F.regexp_replace(methods, "['\"]", ""), ",")[0])
    found = reduce(lambda c, r: c.when(low.contains(r[0].lower()), r[1]), rules.ROUTES[1:], F.when(low.contains(rules.ROUTES[0][0].lower()), rules.ROUTES[0][1]))
    return found.when(low.contains("route") & (methods != ""), first).when(low.contains("route"), "GET")


def route_path(decorator: Column) -> Column:
    """The first quoted text of a decorator; null without one."""
    return F.nullif(F.regexp_extract(decorator, "[\"']([^\"']+)[\"']", 1), F.lit(""))


def frameworks_in(text: Column) -> Column:
    """The frameworks whose marks a text holds, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(low, [m.lower() for m in marks]), F.lit(name)) for name, marks in rules.FRAMEWORKS.items()])))


def endpoints(symbols: DataFrame) -> DataFrame:
    """One row for each route decorator of a function or method."""
    said = F.lower(F.concat_ws(" ", F.array_join("decorators", " "), F.coalesce("docstring", F.lit(""))))
    rows = symbols.filter(F.col("type").isin("function", "method")).select("*", F.explode("decorators").alias("decorator"))
    rows = rows.withColumn("method", route_method(F.col("decorator"))).filter("method is not null")
    middle = F.filter("decorators", lambda d: any_of(F.lower(d), rules.MIDDLEWARE_WORDS))
    return rows.select("method", F.coalesce(route_path(F.col("decorator")), F.concat(F.lit("/"), F.col("name"))).alias("path"), F.col("name").alias("handler"), "file_path", F.col("line_start").alias("line_no"), any_of(said, rules.AUTH_WORDS).alias("auth_required"), middle.alias("middleware"))


def frameworks(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(framework) of route decorators and imported modules."""
    routes = symbols.select(F.explode("decorators").alias("text")).filter(route_method(F.col("text")).isNotNull())
    return routes.unionByName(imports.select(F.col("module").alias("text"))).select(F.explode(frameworks_in(F.col("text"))).alias("framework")).distinct()


# ------------------------------------------------------------------ database


def column_type(signature: Column) -> Column:
    """The SQL type of the first type token in a signature."""
    return first_of(F.coalesce(signature, F.lit("")), [(sql, [token]) for token, sql in rules.SQL_TYPES], "VARCHAR")


def is_foreign_key(name: Column, signature: Column) -> Column:
    return F.coalesce(signature, F.lit("")).contains("ForeignKey") | F.lower(name).contains("foreign_key") | name.endswith("_id")


def columns(fields: DataFrame) -> DataFrame:
    """Columns of model fields (name, signature): type, nullability and foreign key."""
    name, sig = F.col("name"), F.coalesce("signature", F.lit(""))
    rows = fields.filter(~name.startswith("_") | name.startswith("__tablename"))
    fk = is_foreign_key(name, sig)
    return rows.withColumns({"sql_type": column_type(sig), "nullable": ~(sig.contains("nullable=False") | sig.contains("NOT NULL")), "is_fk": fk, "fk_table": F.when(fk, F.replace(F.replace(name, F.lit("_id"), F.lit("")), F.lit("Id"), F.lit("")))})


def models(symbols: DataFrame, imports: DataFrame, whole_repository: bool = False) -> DataFrame:
    """Classes that are models: by their bases, decorators or path; with ``whole_repository``,
    all classes once any ORM is imported."""
    based = F.exists("annotations", lambda a: any_of(a, rules.ORM_BASES))
    marked = F.exists("decorators", lambda d: d.contains("Entity") | d.contains("Table") | F.lower(d).contains("model"))
    placed = any_of(F.lower("file_path"), ["model", "schema", "entities"])
    found = F.coalesce(based, F.lit(False)) | F.coalesce(marked, F.lit(False)) | placed
    classes = symbols.filter("type = 'class'")
    if not whole_repository:
        return classes.filter(found)
    module = F.lower("module")
    orm = reduce(lambda c, m: c | (module == m) | module.startswith(m + "."), rules.ORM_MODULES, F.lit(False))
    used = imports.agg(F.coalesce(F.max(orm), F.lit(False)).alias("__orm"))
    return classes.join(F.broadcast(used)).filter(found | F.col("__orm")).drop("__orm")  # one row


def tables(symbols: DataFrame, imports: DataFrame, whole_repository: bool = False) -> DataFrame:
    """Discovered tables with their columns and foreign keys; a model without fields has an id."""
    found = models(symbols, imports, whole_repository).select("file_path", F.col("name").alias("model"))
    fields = columns(symbols.filter("type = 'variable'")).select("file_path", F.col("parent").alias("model"), F.struct(F.col("line_start").alias("at"), "name", F.col("sql_type").alias("type"), "nullable", "is_fk", "fk_table").alias("c"))
    own = fields.groupBy("file_path", "model").agg(F.array_sort(F.collect_list("c")).alias("columns"))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit("id").alias("name"), F.lit("UUID").alias("type"), F.lit(False).alias("nullable"), F.lit(False).alias("is_fk"), F.lit(None).cast("string").alias("fk_table")))
    rows = found.join(own, ["file_path", "model"], "left").withColumn("columns", F.coalesce("columns", none))
    keys = F.transform(F.filter("columns", lambda c: c["is_fk"]), lambda c: F.struct(c["name"].alias("column"), c["fk_table"].alias("referenced_table"), F.lit("id").alias("referenced_column"), F.lit("many-to-one").alias("rel_type")))
    return rows.select(table_name(F.col("model")).alias("name"), "columns", keys.alias("foreign_keys"), "file_path", "model")


def relationships(found: DataFrame) -> DataFrame:
    return found.select(F.col("name").alias("from_table"), F.explode("foreign_keys").alias("k")).select("from_table", F.col("k.referenced_table").alias("to_table"), F.col("k.column").alias("column"), F.col("k.rel_type").alias("type"))


def diagram(found: DataFrame, columns: int = 3) -> DataFrame:
    """Grid places of tables by name."""
    i = F.col("__n") - 1
    rows = numbered(found.select("name"), "name", name="__n")
    return rows.select("name", (i % columns * 380 + 40).cast("int").alias("x"), (F.floor(i / columns) * 340 + 40).cast("int").alias("y"))


def diagram_edges(found: DataFrame) -> DataFrame:
    """(src, dst, column, type) of the relationships between tables of a diagram."""
    names = found.select(F.col("name").alias("dst")).distinct()
    links = relationships(found).select(F.col("from_table").alias("src"), F.explode(F.array("to_table", F.concat("to_table", F.lit("s")))).alias("dst"), "column", "type")
    return links.join(names, "dst").select("src", "dst", "column", "type")


def diagram_tables(places: DataFrame, found: DataFrame) -> DataFrame:
    """A diagram's places with their tables; a place without one keeps nulls."""
    return places.join(found.drop("x", "y"), "name", "left")


def migrations(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(any_of(F.lower("path"), rules.MIGRATION_PATHS)).select(F.when(name.contains("_"), F.substring_index(name, "_", 1)).otherwise(name).alias("id"), name.alias("name")).orderBy("name")


# -------------------------------------------------------------- architecture


def directories(files: DataFrame) -> DataFrame:
    """First and second directories of paths, in lower case."""
    p = F.split(F.lower("path"), "/")
    return files.select(F.explode(F.slice(p, 1, F.least(F.size(p) - 1, F.lit(2)))).alias("dir")).distinct()


def pattern(files: DataFrame) -> DataFrame:
    """One row: the architectural pattern and its confidence."""
    inside = lambda names: F.coalesce(F.count_distinct(F.when(F.col("dir").isin(*names), F.col("dir"))), F.lit(0))
    layers = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.col("dir").isin(*names).cast("int")), F.lit(0)) for names in rules.LAYERS.values()])
    by_dir = directories(files).agg(inside(rules.MICROSERVICE_DIRS).alias("services"), inside(rules.HEXAGONAL_DIRS).alias("hexagonal"), inside(rules.MVC_DIRS).alias("mvc"), layers.alias("layers"))
    by_file = files.agg(F.coalesce(F.max(F.col("path").endswith("docker-compose.yml")), F.lit(False)).alias("compose"), F.coalesce(F.max(F.col("path").contains("k8s") | F.col("path").contains("kubernetes")), F.lit(False)).alias("k8s"))
    rows = by_dir.join(F.broadcast(by_file))  # one row each
    kind = (
        F.when((F.col("services") >= 2) | (F.col("compose") & F.col("k8s")), "microservices").when(F.col("hexagonal") >= 3, "hexagonal").when(F.col("mvc") >= 2, "mvc")
        .when(F.col("layers") >= 3, "layered").when(F.col("layers") >= 2, "modular").when(F.col("layers") == 1, "monolith").otherwise("unknown")
    )
    sure = {"microservices": 0.75, "hexagonal": 0.80, "mvc": 0.85, "modular": 0.60, "monolith": 0.50, "unknown": 0.30}
    confidence = F.when(F.col("kind") == "layered", F.least(0.5 + F.col("layers") * 0.1, F.lit(0.9))).otherwise(F.element_at(F.create_map(*[F.lit(x) for p in sure.items() for x in p]), F.col("kind")))
    label = F.element_at(F.create_map(*[F.lit(x) for p in rules.PATTERN_LABELS.items() for x in p]), F.col("kind"))
    return rows.withColumn("kind", kind).select(label.alias("pattern"), F.round(confidence, 2).alias("confidence"), F.col("layers").cast("int").alias("layers"))


def _holds(word: str):
    return lambda text: text.contains(word)


def subsystem(path: Column) -> Column:
    """The first subsystem, in order, with a pattern in the path; null if there is none."""
    p = F.split(F.lower(path), "/")
    dirs, name = F.slice(p, 1, F.size(p) - 1), F.element_at(p, -1)
    front = any_of(F.lower(path), rules.PRESENTATION_MARKS)
    found = None
    for tier, ident, _, words in rules.SUBSYSTEMS:
        matched = F.lit(False)
        for w in words:
            held = F.exists(dirs, _holds(w))
            # a guarded directory match isn't tried on the file's name
            matched = matched | (F.when(held, front).otherwise(name.contains(w)) if tier == "presentation" else held | name.contains(w))
        found = (F if found is None else found).when(matched, F.lit(ident))
    return found


def tier_of(ident: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for tier, i, _, _ in rules.SUBSYSTEMS for x in (i, tier)]), ident)


def technologies(path: Column) -> Column:
    e = extension_of(path)
    return F.array_compact(F.array(F.when(e.isin(".tsx", ".jsx", ".vue", ".svelte"), "React / UI"), F.when(e.isin(".ts", ".js"), "TypeScript"), F.when(e == ".py", "Python"), F.when(e == ".java", "Java"), F.when(e.isin(".go", ".rs", ".cpp", ".c"), "Systems")))


def subsystems(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """By subsystem: files, symbols, technologies and the first key files.  Where no file is in
    a subsystem, all are one application."""
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    rows = files.select("path", subsystem(F.col("path")).alias("subsystem"), technologies(F.col("path")).alias("tech")).join(n, "path", "left")
    # the first files of a subsystem are ranked, which Spark limits before the shuffle
    rank = F.row_number().over(Window.partitionBy("subsystem").orderBy("path"))
    first = rows.select("subsystem", "path").withColumn("n", rank).filter("n <= 4").groupBy("subsystem").agg(F.array_sort(F.collect_list("path")).alias("key_files"))
    out = rows.groupBy("subsystem").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tech")))).alias("technologies"))
    out = out.alias("o").join(first.alias("f"), F.col("o.subsystem").eqNullSafe(F.col("f.subsystem"))).select("o.*", "key_files")
    mapped = F.count("subsystem").over(Window.partitionBy())
    out = out.withColumn("mapped", mapped).filter("subsystem is not null or mapped = 0").drop("mapped")
    return out.withColumn("tier", F.coalesce(tier_of(F.col("subsystem")), F.lit("application"))).withColumn("subsystem", F.coalesce("subsystem", F.lit("core_module")))


def layout(found: DataFrame, width: int = 260, height: int = 160) -> DataFrame:
    """Places of subsystems: a row for each tier, in the tiers' order, and a column for each
    subsystem by name."""
    order = F.array_position(F.array(*[F.lit(t) for t in dict.fromkeys(t for t, _, _, _ in rules.SUBSYSTEMS)]), F.col("tier")) - 1
    column = F.row_number().over(Window.partitionBy("tier").orderBy("subsystem")) - 1
    row = F.when(order < 0, F.lit(len({t for t, _, _, _ in rules.SUBSYSTEMS}))).otherwise(order)
    return found.select("subsystem", "tier", (column * width).cast("int").alias("x"), (row * height).cast("int").alias("y"))


def layers(found: DataFrame) -> DataFrame:
    """Tiers of subsystems: files and component names."""
    return found.groupBy("tier").agg(F.sum("files").alias("files"), F.array_sort(F.collect_list("subsystem")).alias("components"))


def cross_edges(imports: DataFrame, places: DataFrame, top: int | None = None) -> DataFrame:
    """(src, dst, n): imports from one subsystem to another.  ``imports`` (subsystem, module) are
    counted; a module belongs to the first place (ord, dotted, subsystem) of another subsystem
    that holds it as a substring, or is held by it.  Pairs come from an index of substrings."""
    counted = cut(imports.filter("module is not null").groupBy(F.col("subsystem").alias("src"), "module").agg(F.count(F.lit(1)).alias("n")), "import-counts")
    pairs = held("module", counted, "dotted", places).toDF("module", "dotted").unionByName(held("dotted", places, "module", counted).toDF("dotted", "module")).distinct()
    near = counted.join(pairs, "module").join(places.select("ord", "dotted", "subsystem"), "dotted").select("src", "module", "n", "ord", "subsystem")
    for empty, all_of in ((F.col("module") == "", places), (F.lit(True), places.filter("dotted = ''"))):  # an empty text is in all others
        some = all_of.filter("subsystem is not null").groupBy("subsystem").agg(F.min("ord").alias("ord")).orderBy("ord", "subsystem").select("ord", "subsystem")
        if first := [(r[0], r[1]) for r in some.limit(2).collect()]:  # one of two subsystems isn't the module's own
            firsts = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(s).alias("subsystem")) for o, s in first])).alias("p")
            near = near.unionByName(counted.filter(empty).select("src", "module", "n", firsts).select("src", "module", "n", "p.*"))
    first = near.filter(F.col("src") != F.col("subsystem")).groupBy("src", "module", "n").agg(F.min(F.struct("ord", "subsystem")).alias("p"))
    rows = first.groupBy("src", F.col("p.subsystem").alias("dst")).agg(F.sum("n").alias("n"))
    return rows if top is None else rows.orderBy(F.desc("n"), "src", "dst").limit(top)


# ------------------------------------------------------------------ metadata


def repository_facts(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row: frameworks, package managers and whether it is a monorepo, from paths and from
    packages (name, source)."""
    known = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for p in d.items() for x in p]), c)
    base, top = F.element_at(F.split("path", "/"), -1), F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    by_path = files.agg(F.array_sort(F.collect_set(known(rules.FILE_FRAMEWORKS, base))).alias("a"), F.array_sort(F.collect_set(known(rules.PACKAGE_MANAGERS, base))).alias("package_managers"), F.coalesce(F.max(base.isin(*rules.MONOREPO_FILES) | F.coalesce(top.isin(*rules.MONOREPO_DIRS), F.lit(False))), F.lit(False)).alias("is_monorepo"))
    named = F.when(F.col("source") == "package.json", known(rules.JS_FRAMEWORKS, F.col("name"))).otherwise(known(rules.PY_FRAMEWORKS, F.lower("name")))
    by_package = manifests.agg(F.collect_set(named).alias("b"))
    return by_path.join(F.broadcast(by_package)).select(F.array_sort(F.array_union("a", "b")).alias("frameworks"), "package_managers", "is_monorepo")
