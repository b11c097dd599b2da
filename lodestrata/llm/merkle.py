"""A Merkle manifest: a hash trie over ranked rows, with the proof of each.

Rows are leaves of their language's branch, ordered by doc_id.  A leaf's rank
is exact without a global sort: ids (and, beneath them, leaf digests) are read
as digits of base 4,096, rows are counted by the prefixes of those digits, and
a rank is the sum of what stands before each of its prefixes among the at most
4,096 that share the shorter one, and before the row within the longest.  So no
window holds more than ``BUCKET`` rows, whatever the ids are: prefixes grow by
a digit until none holds more.

The rank's digits of base ``FANOUT`` key the trie's nodes.  Nodes are reduced
by longest prefix, three levels in a group of up to 512 neighbours, until each
branch has one, its subroot; the subroots are reduced likewise.  On the way
back a group's path to the root is joined once for all its members.

Defined results: null fields count as ``-``; a null doc_id comes first, and a
null language's branch before all others.  Rows that share a doc_id are ordered
by their digests; equal rows are leaves of their own next to each other, each
with its own proof.  A lone leaf is its branch's subroot, a lone subroot the
root; a proof without siblings is the hash of nothing.  Empty and very long
texts are hashed whole, as are texts of ill-formed UTF-8, by their bytes.  An
empty table has no rows.  Only the columns named here are read.  Subroots (one
row for each language) meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import let, materialize

FANOUT = 8
#: Levels that one group reduces.
STEP = 3
GROUP = FANOUT**STEP
#: Hex digits of one digit of the order, and of the order's first prefix: its null flag, and the id without its last digit.
DIGIT, FIRST, WHOLE = 3, 14, 1 + 16 + 64
BUCKET = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(said: Column) -> Column:
    return F.sha2(said, 256)


def leaf(**instead: Column) -> Column:
    """A row's digest; keyword arguments stand in for its fields."""

    def field(name: str) -> Column:
        said = instead.get(name, F.col(name)).cast("string")
        return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))

    return digest(F.concat(*map(field, FIELDS)))


def _order(doc_id: Column, leaf: Column) -> Column:
    """Sorts as (doc_id, leaf), nulls first: a flag, 16 digits of the id, 64 of the digest."""
    plain = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), "0" + "0" * 16).otherwise(F.concat(F.lit("1"), plain)), leaf)


def _prefix(length: int) -> Column:
    return F.substring("order", 1, length)


def ranks(rows: DataFrame, *keep: str) -> DataFrame:
    """(branch, rank, leaf, *keep, total) of rows (branch, order, *keep): equal rows are counted
    first, and come out again at the end."""
    rows = materialize(rows.groupBy("branch", "order", *keep).agg(F.count(F.lit(1)).alias("n")), "ordered")
    ends = rows.agg(F.min("order").alias("a"), F.max("order").alias("b")).first()
    if ends["a"] is None:
        return rows.select("branch", F.lit(0).cast("long").alias("rank"), F.col("order").alias("leaf"), *keep, F.lit(0).cast("long").alias("total"))
    shared = next((k for k in range(WHOLE) if ends["a"][k] != ends["b"][k]), WHOLE)  # digits that all rows have
    longest = FIRST
    while True:
        counts = materialize(rows.groupBy("branch", _prefix(longest).alias("order")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")), "prefixes")
        if longest == WHOLE or counts.agg(F.max("held")).first()[0] <= BUCKET:
            break
        longest = min(longest + DIGIT, WHOLE)
    lengths = [k for k in range(longest, 0, -DIGIT) if k > shared][::-1] or [longest]
    starts = None
    for k, length in enumerate(lengths):
        above = F.substring("order", 1, lengths[k - 1] if k else 0)
        level = counts.groupBy("branch", _prefix(length).alias("order")).agg(F.sum("n").alias("n")).withColumn("above", above)
        siblings = Window.partitionBy("branch", "above").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        if starts is None:
            starts = level.select("branch", "order", F.col("before").alias("start"), F.sum("n").over(Window.partitionBy("branch")).alias("total"))
        else:
            up = starts.withColumnRenamed("order", "above")
            starts = level.join(up, ["branch", "above"]).select("branch", "order", (F.col("start") + F.col("before")).alias("start"), "total")
    within = Window.partitionBy("branch", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bucket", _prefix(longest)).withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(starts.withColumnRenamed("order", "bucket"), ["branch", "bucket"])
    leaf, block = F.substring("order", 18, 64).alias("leaf"), 4096
    placed = placed.select("branch", leaf, *keep, "total", (F.col("start") + F.col("before")).alias("first"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(block))).alias("at"))
    copy = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + block, F.col("n")) - 1)).alias("copy")
    return placed.select("branch", "first", "leaf", *keep, "total", copy).select("branch", (F.col("first") + F.col("copy")).alias("rank"), "leaf", *keep, "total")


def _height(total: Column) -> Column:
    """Levels from the leaves of a branch to its subroot."""
    return sum((F.when(total > FANOUT**k, 1).otherwise(0) for k in range(21)), F.lit(0))


def _above(nodes: Column, there: Column) -> Column:
    """The next level of a group's nodes; the same nodes where there is none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT)), lambda i: digest(F.array_join(F.slice(nodes, i, F.lit(FANOUT)), "")))
    return F.when(there, runs).otherwise(nodes)


def _grouped(nodes: DataFrame, *keep: str) -> DataFrame:
    """Groups of neighbours (branch, at, height, digest, *keep): their members in order, the
    nodes of their levels, and what they reduce to."""
    members = F.array_sort(F.collect_list(F.struct("at", "digest", *keep)))
    groups = nodes.groupBy("branch", F.floor(F.col("at") / GROUP).alias("node"), "height").agg(members.alias("members"))
    height = F.col("height")

    def reduced(first: Column) -> Column:
        second = lambda b: let(_above(b, height > 1), lambda c: F.struct(F.array(first, b, c).alias("levels"), _above(c, height > 2)[0].alias("digest")))
        return let(_above(first, height > 0), second)

    groups = groups.withColumn("r", let(F.transform("members", lambda m: m["digest"]), reduced))
    return materialize(groups.select("branch", "node", "height", "members", "r.levels", "r.digest"), "trie")


def _path(at: Column) -> Column:
    """A member's way up through its group: at each level its place in a run, and the run."""
    width = F.array(*[F.lit(FANOUT**k) for k in range(STEP)])

    def step(level: Column) -> Column:
        place = F.floor(F.pmod(at, F.lit(GROUP)) / F.get(width, level)).cast("int")
        return let(place, lambda p: F.struct((p % FANOUT).alias("at"), F.slice(F.get("levels", level), p - p % FANOUT + 1, F.lit(FANOUT)).alias("run")))

    levels = F.sequence(F.lit(0), F.least(F.col("height"), F.lit(STEP)) - 1)
    return F.when(F.col("height") > 0, F.transform(levels, step)).otherwise(F.array().cast("array<struct<at:int,run:array<string>>>"))


def _reduced(nodes: DataFrame, *keep: str) -> tuple[list[DataFrame], DataFrame]:
    """The groups of each stage, and (branch, digest) of what each branch reduces to."""
    stages = [_grouped(nodes, *keep)]
    for _ in range(STEP, stages[0].agg(F.max("height")).first()[0] or 0, STEP):
        below = stages[-1].select("branch", F.col("node").alias("at"), F.greatest(F.col("height") - STEP, F.lit(0)).alias("height"), "digest")
        stages.append(_grouped(below))
    return stages, stages[-1].select("branch", "digest")


def _expanded(stages: list[DataFrame], tops: DataFrame, *keep: str) -> DataFrame:
    """(branch, at, path, *keep, and the other columns of ``tops``) of the first stage's members;
    ``tops`` has each branch's path to the root."""
    above = tops.withColumn("node", F.lit(0).cast("long"))
    for k, stage in enumerate(reversed(stages)):
        groups, own = stage.join(above, ["branch", "node"]), keep if k + 1 == len(stages) else ()
        carried = [c for c in tops.columns if c not in ("branch", "path")]
        inner = F.transform("members", lambda m: F.struct(m["at"].alias("at"), m["digest"].alias("digest"), F.concat(_path(m["at"]), F.col("path")).alias("path"), *[m[c].alias(c) for c in own]))  # noqa: B023
        above = groups.select("branch", *carried, F.explode(inner).alias("m")).select("branch", *carried, "m.*").withColumnRenamed("at", "node")
    return above.withColumnRenamed("node", "at")


def manifest(rows: DataFrame, *keep: str) -> DataFrame:
    """(lang, doc_id, leaf, path, subroot, root, *keep) of rows (lang, doc_id, leaf, *keep): a
    path is an array of (at, run), from the leaf's run to the root's."""
    branch = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))
    ordered = ranks(rows.select(branch.alias("branch"), _order(F.col("doc_id"), F.col("leaf")).alias("order"), "doc_id", *keep), "doc_id", *keep)
    stages, subroots = _reduced(ordered.select("branch", F.col("rank").alias("at"), _height(F.col("total")).alias("height"), F.col("leaf").alias("digest"), "doc_id", *keep), "doc_id", *keep)
    subroots = materialize(subroots, "subroots")
    place = (F.row_number().over(Window.orderBy("branch")) - 1).cast("long")  # one row for each language
    top, root = _reduced(subroots.select(F.lit("").alias("branch"), place.alias("at"), _height(F.lit(subroots.count())).alias("height"), "digest", F.col("branch").alias("of")), "of")
    none = F.array().cast("array<struct<at:int,run:array<string>>>")
    tops = _expanded(top, root.select("branch", F.col("digest").alias("root"), none.alias("path")), "of")
    tops = materialize(tops.select(F.col("of").alias("branch"), "path", F.col("digest").alias("subroot"), "root"), "subroot-paths")
    leaves = _expanded(stages, tops, "doc_id", *keep)
    lang = F.when(F.col("branch") != "0", F.substr("branch", F.lit(2)))
    return leaves.select(lang.alias("lang"), "doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", *keep)


def siblings(path: Column) -> Column:
    """The digests beside a path, level by level, left to right, in one text."""
    return F.array_join(F.transform(path, lambda s: F.array_join(F.filter(s["run"], lambda _, i: i != s["at"]), "")), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the digests beside its path."""
    run = lambda h, s: F.array_join(F.transform(s["run"], lambda x, i: F.when(i == s["at"], h).otherwise(x)), "")
    return F.aggregate(path, leaf, lambda h, s: digest(run(h, s)))


def oracle(levels: int = 10, roots: int = 4) -> str:
    """The contract's rows in DuckDB's SQL, over ``documents``; ``levels`` and ``roots`` bound
    the heights that the statement is unrolled for."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {field(text)})"
    a_to_z = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"docs as (select row_number() over () r, doc_id, coalesce('1' || lang, '0') b, {leaf('text')} leaf, {leaf(a_to_z)} lowered from documents)"]
    ctes.append("s0 as (select *, row_number() over (partition by b order by doc_id nulls first, leaf, r) - 1 i from docs)")
    ctes.append("n0 as (select b, i, leaf h from s0), p0 as (select r, b, i, '' proof, [] :: struct(a bigint, run varchar[])[] path from s0)")

    def up(n: str, p: str, to: int, tag: str) -> None:
        many = f"b in (select b from {n} group by b having count(*) > 1)"
        ctes.append(f"r{tag} as (select b, i // 8 i, list(h order by i) run from {n} where {many} group by b, i // 8)")
        ctes.append(f"n{to} as (select b, i, sha256(array_to_string(run, '')) h from r{tag} union all select b, i, h from {n} where not {many})")
        ctes.append(f"p{to} as (select p.r, p.b, p.i // 8 i, case when x.run is null then proof else proof || array_to_string(list_filter(x.run, lambda _, k: k <> p.i % 8 + 1), '') end proof, "
                    f"case when x.run is null then path else list_append(path, {{'a': p.i % 8 + 1, 'run': x.run}}) end path from {p} p left join r{tag} x on x.b = p.b and x.i = p.i // 8)")  # fmt: skip

    for k in range(levels):
        up(f"n{k}", f"p{k}", k + 1, f"l{k}")
    t = levels + 1
    ctes.append(f"subroots as (select b, h, row_number() over (order by b) - 1 i from n{levels})")
    ctes.append(f"n{t} as (select '' b, i, h from subroots), p{t} as (select r, '' b, s.i, proof, path from p{levels} p join subroots s on s.b = p.b)")
    for k in range(roots):
        up(f"n{t + k}", f"p{t + k}", t + k + 1, f"l{t + k}")
    # folds a leaf along its path, a level at a time
    ctes.append(f"f0 as (select p.r, path, case when crc % 3 = 0 then lowered else leaf end h from p{t + roots} p join (select r, lowered, leaf, {_crc32('doc_id')} crc from docs) using (r))")
    for k in range(levels + roots):
        ctes.append(f"f{k + 1} as (select r, path, case when len(path) > {k} then sha256(array_to_string(list_transform(path[{k + 1}].run, lambda x, j: case when j = path[{k + 1}].a then h else x end), '')) else h end h from f{k})")
    return f"""with {', '.join(ctes)}
select s.doc_id, s.leaf, sub.h subroot, top.h root, sha256(proof) proof_sha256, f.h folded_root, f.h = top.h verified
from s0 s join subroots sub on sub.b = s.b cross join n{t + roots} top join p{t + roots} p on p.r = s.r join f{levels + roots} f on f.r = s.r"""


def _crc32(column: str) -> str:
    """CRC-32 (reversed polynomial 0xEDB88320) of a number's decimal text, as DuckDB has no function for it."""
    shifted = "list_reduce(list_concat([xor(c, cast(o as bigint))], range(8)), lambda v, _: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    step = shifted.replace("cast(o as bigint)", "o")
    return f"xor(list_reduce(list_concat([4294967295 :: bigint], list_transform(string_split(cast({column} as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, o: {step}), 4294967295)"
