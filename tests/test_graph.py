"""Graph operators against plain models."""

import random
from collections import defaultdict

import pytest

from orrery.operators import graph

SCHEMA = "source_id string, target_id string, type string"


def make(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) if len((a, b)) == 2 else () for a, b in pairs], SCHEMA)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def reach(pairs, start):
    out, todo, seen = defaultdict(set), [start], {start: 0}
    for a, b in pairs:
        out[a].add(b)
    for x in todo:
        for y in out[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def test_random_graphs(spark):
    r = random.Random(7)
    for n, m in ((12, 24), (30, 40)):
        pairs = {(f"v{r.randint(0, n)}", f"v{r.randint(0, n)}") for _ in range(m)}
        e = make(spark, pairs)
        assert {x.id: x.depth for x in graph.bfs(e, ids(spark, "v0"), 50).collect()} == reach(pairs, "v0")
        back = {(b, a) for a, b in pairs}
        assert {x.id: x.depth for x in graph.bfs(e, ids(spark, "v0"), 50, reverse=True).collect()} == reach(back, "v0")
        names = {x for p in pairs for x in p}
        all_reach = {x: set(reach(pairs, x)) for x in names}
        want = {x: min(y for y in names if y in all_reach[x] and x in all_reach[y]) for x in names if any(y != x and y in all_reach[x] and x in all_reach[y] for y in names)}
        assert {x.id: x.component for x in graph.components(e).collect()} == want


def test_paths_and_prefix_ids(spark):
    e = make(spark, [("f:1", "f:12"), ("f:12", "f:2"), ("f:1", "f:2"), ("f:2", "f:3"), ("f:3", "f:1"), ("s", "s")])
    assert graph.find_path(e, ids(spark, "f:1"), ids(spark, "f:3")).first().path == ["f:1", "f:2", "f:3"]
    assert graph.find_path(e, ids(spark, "s"), ids(spark, "s")).first().path == ["s"]
    assert graph.find_path(e, ids(spark, "s"), ids(spark, "f:1")).count() == 0
    exact = {(r.id, r.depth) for r in graph.all_depths(e, ids(spark, "f:1"), 5).collect()}
    assert exact == {("f:12", 1), ("f:2", 1), ("f:2", 2), ("f:3", 2), ("f:3", 3)}
    assert ("f:12", 1) in exact and graph.bfs(e, ids(spark, "f:1"), 0).count() == 1
    assert graph.callees(e, ids(spark, "s"), 3).count() == 0


def test_pagerank(spark):
    pairs = [("a", "b"), ("a", "b2"), ("b", "c"), ("b2", "c"), ("c", "a"), ("a", "ghost")]
    nodes = spark.createDataFrame([(x, "f", 0) for x in ("a", "b", "b2", "c", "lone")], "id string, file_path string, is_test int")
    e = make(spark, pairs).unionByName(make(spark, [("a", "b")], "imports"))
    got = {r.id: r.rank for r in graph.pagerank(e, nodes, 40).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    rank = dict.fromkeys(got, 0.2)
    real = [p for p in pairs if p[1] != "ghost"] + [("a", "b")]
    for _ in range(40):
        lost = sum(rank[x] for x in rank if not any(p[0] == x for p in real))
        new = {x: 0.15 / 5 + 0.85 * lost / 5 for x in rank}
        for a, b in real:
            new[b] += 0.85 * rank[a] / sum(p[0] == a for p in real)
        rank = new
    assert all(abs(rank[x] - got[x]) < 1e-9 for x in rank)
    own = {r.id: r.rank for r in graph.pagerank(e, nodes, 10, personal=ids(spark, "a")).collect()}
    assert abs(sum(own.values()) - 1) < 1e-6 and "lone" not in own
    assert graph.pagerank(e, nodes, 3, personal=ids(spark, "none")).count() == 0


def test_impact_and_empty(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"f{i % 2}", i % 2) for i in range(4)], "id string, file_path string, is_test int")
    e = make(spark, [("n1", "n0"), ("n2", "n1"), ("n3", "n1"), ("file:x", "n0"), (None, "n0")])
    r = graph.impact(e, nodes, ids(spark, "n0")).first()
    assert (r.direct_dependents, r.transitive_dependents, r.affected_files, r.risk) == (1, 3, "f0,f1", "low")
    assert {(x.id, x.impact) for x in graph.impact_buckets(e, nodes, ids(spark, "n0")).collect()} == {("n1", "high"), ("n2", "medium"), ("n3", "medium")}
    none = e.limit(0)
    assert graph.cycles(none).count() == 0 and graph.bfs(none, ids(spark, "a"), 3).count() == 1
    assert {r.vertex_type for r in graph.vertices(nodes, e).collect()} == {"symbol", "file"}


def test_components_meet_no_silent_bound(spark):
    e = make(spark, [(f"v{i}", f"v{(i + 1) % 6}") for i in range(6)])
    with pytest.raises(RuntimeError):
        graph.components(e, max_rounds=3)
    assert {(r.component, r["size"]) for r in graph.cycles(e).collect()} == {("v0", 6)}
