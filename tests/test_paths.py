"""Paths and motifs against plain searches on random graphs."""

import itertools
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, motifs


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(25), rng.randrange(25), rng.choice("xyz")) for _ in range(34)} | {(0, 0, "x"), (3, 4, "x"), (3, 4, "y"), (40, 41, "x")})
    return rows, spark.createDataFrame(rows, "src int, dst int, type string")


def test_shortest_paths_of_many_pairs(spark, edges):
    rows, frame = edges
    ways = {}
    for a, b, _ in rows:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)

    def first(a, b):
        todo = deque([(a,)])
        best, seen = [], {a: 0}
        while todo:
            path = todo.popleft()
            if path[-1] == b:
                best.append(path)
            for c in sorted(ways.get(path[-1], ())):
                if seen.setdefault(c, len(path)) == len(path):
                    todo.append((*path, c))
        return min(best, default=None)

    pairs = [(a, b) for a in (0, 3, 5, 9, 40, 77) for b in (0, 1, 4, 17, 24, 41, 78)] + [(7, 12)]
    want = {(a, b): p for a, b in pairs if (p := first(a, b)) is not None and len(p) <= 7}
    found = graph.shortest_paths(frame, spark.createDataFrame([*pairs, pairs[0]], "src long, dst long"), 6)
    assert {(r["src"], r["dst"]): tuple(r["path"]) for r in found.collect()} == want
    assert found.count() == len(want)
    assert [tuple(r["path"]) for r in graph.shortest_path(frame, 3, 4).collect()] == [(3, 4)]


def plain_match(rows, hops, where):
    """All placements, tried one by one."""

    def pairs(hop):
        one = {(a, b) for a, b, t in rows if hop.type in (None, t)}
        one |= {(b, a) for a, b in one} if hop.both else set()
        far, out = one, set(one) if hop.least == 1 else set()
        for k in range(2, hop.most + 1):
            far = {(a, c) for a, b in far for b2, c in one if b == b2}
            out |= far if k >= hop.least else set()
        return out

    names = [*dict.fromkeys(v for h in hops for v in (h.src, h.dst))]
    found = []
    for chosen in itertools.product(*[sorted(pairs(h)) for h in hops]):
        at = {}
        if not all(at.setdefault(v, x) == x for h, p in zip(hops, chosen) for v, x in zip((h.src, h.dst), p)):
            continue
        if any(at[v] not in ids for v, ids in where.items() if v in at):
            continue
        same = False
        for (h, p), (g, q) in itertools.combinations(zip(hops, chosen), 2):
            if h.most == g.most == 1 and (None in (h.type, g.type) or h.type == g.type):
                same |= p == q or (h.both or g.both) and p == q[::-1]
        if not same:
            found.append(tuple(at[v] for v in names))
    return sorted(set(found))


HOP = motifs.Hop
MOTIFS = [
    [HOP("a", "x", "b"), HOP("b", "y", "c")], [HOP("a", None, "b"), HOP("b", None, "a")], [HOP("a", "x", "b"), HOP("a", "x", "c")], [HOP("a", "x", "a")],
    [HOP("a", "z", "b", both=True), HOP("b", "z", "c", both=True)], [HOP("a", "x", "b", 1, 3), HOP("c", "y", "b")], [HOP("a", None, "b", 2, 2), HOP("b", "x", "a", both=True)],
]


@pytest.mark.parametrize("hops", MOTIFS)
@pytest.mark.parametrize("limited", [False, True])
def test_motifs(spark, edges, hops, limited):
    rows, frame = edges
    where = {"b": set(range(12))} if limited else {}
    given = {v: spark.createDataFrame([(i,) for i in ids], "id int") for v, ids in where.items()}
    assert sorted(map(tuple, motifs.match(frame, hops, given).collect())) == plain_match(rows, hops, where)


@pytest.mark.parametrize("limited", [False, True])
def test_hubs_are_passed_as_a_condition(spark, limited):
    """All live in two places: no two of them are joined by where they live alone."""
    rows = [(f"c{i}", f"n{i % 2}", "LIVES") for i in range(400)] + [(f"s{i}", f"n{i % 2}", "LIVES") for i in range(50)]
    rows += [(f"c{i % 400}", f"o{i}", "PLACED") for i in range(1000)] + [(f"o{i}", f"s{(i * k) % 50}", "FROM") for i in range(1000) for k in (1, 3)]
    where = {"n": spark.createDataFrame([("n1",)], "id string")} if limited else {}
    found = motifs.match(spark.createDataFrame(rows, "src string, dst string, type string"), [HOP("c", "PLACED", "o"), HOP("o", "FROM", "s"), HOP("c", "LIVES", "n"), HOP("s", "LIVES", "n")], where)
    joins = re.findall(r"Join Inner, (.*)", found._jdf.queryExecution().optimizedPlan().toString())
    by = [set(re.findall(r"(\w+)#\d+ = ", re.sub(r"NOT \(.*?\)", "", j))) for j in joins]
    assert len(by) == 3 and {"n"} not in by
    sold = {(f"c{i % 400}", f"o{i}", f"s{(i * k) % 50}", f"n{i % 2}") for i in range(1000) for k in (1, 3) if i * k % 50 % 2 == i % 2}
    assert set(map(tuple, found.collect())) == {x for x in sold if not limited or x[3] == "n1"}


def test_a_pattern_that_falls_apart(edges):
    with pytest.raises(ValueError, match="falls apart"):
        motifs.match(edges[1], [HOP("a", "x", "b"), HOP("c", "y", "d")])


def test_paths_grow_only_towards_their_end(spark, edges):
    rows, frame = edges
    dead_ends = spark.createDataFrame([(3, 100 + i, "x") for i in range(50)], "src int, dst int, type string")
    whole = {tuple(r["path"]) for r in graph.paths(frame, 3, 4, 4).collect()}
    assert (3, 4) in whole and {tuple(r["path"]) for r in graph.paths(frame.union(dead_ends), 3, 4, 4).collect()} == whole
    left = {r["id"]: r["left"] for r in graph.distances_to(frame.select("src", "dst").distinct(), 4, 3).collect()}
    assert left[4] == 0 and left[3] == 1 and all(left[a] <= left[b] + 1 for a, b, _ in rows if b in left and left[b] < 3)
    assert frame.filter(F.col("src") == 3).count() >= 2
