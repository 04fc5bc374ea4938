import random

import pytest
from conftest import rows

from crosslattice.operators import consistency, graph, hierarchy

N = "tax string, node_id string, depth int, loaded_at int, name string"
E = "tax string, child_id string, parent_id string, ord int"


def tables(spark, parents, tax="x", depth=None, names=None):
    n = spark.createDataFrame([(tax, k, (depth or {}).get(k), 1, (names or {}).get(k, k)) for k in parents], N)
    e = spark.createDataFrame([(tax, k, p, i) for k, ps in parents.items() for i, p in enumerate(ps)], E)
    return n, e


def brute(parents):
    known = {k: [p for p in set(ps) if p in parents] for k, ps in parents.items()}
    up = {}
    for k in known:
        seen, work = set(), list(known[k])
        while work:
            p = work.pop()
            if p not in seen:
                seen.add(p)
                work += known[p]
        up[k] = seen
    cyc = {k for k in known if k in up[k]}
    below = {k for k in known if up[k] & cyc} - cyc
    deep = {}

    def d(k):
        if k not in deep:
            deep[k] = max((d(p) + 1 for p in known[k]), default=0)
        return deep[k]

    return {k: ("cycle", None) if k in cyc else ("below_cycle", None) if k in below else (None, d(k)) for k in known}


@pytest.mark.parametrize("limit", [hierarchy.MAX_LOCAL, 1])
def test_states_against_brute_force(spark, limit):
    r = random.Random(1)
    graphs = {}
    for g in range(2 if limit == 1 else 30):
        k = r.randrange(1, 10)
        graphs[f"g{g}"] = {f"n{i}": [f"n{r.randrange(k + 1)}" for _ in range(r.choice([0, 1, 1, 2]))] for i in range(k)}
    n = spark.createDataFrame([(g, k, None, 1, k) for g, ps in graphs.items() for k in ps], N)
    e = spark.createDataFrame([(g, k, p, i) for g, x in graphs.items() for k, ps in x.items() for i, p in enumerate(ps)], E)
    got = {(x.tax, x.node_id): (x.state, x.depth) for x in hierarchy.node_states(spark, n, e, limit).collect()}
    assert got == {(g, k): v for g, ps in graphs.items() for k, v in brute(ps).items()}


def below(parents):
    up = {}
    for k in parents:
        seen, work = set(), [p for p in parents[k] if p in parents]
        while work:
            p = work.pop()
            if p not in seen:
                seen.add(p)
                work += [q for q in parents[p] if q in parents]
        up[k] = seen
    return {(a, k) for k, s in up.items() for a in s}


@pytest.mark.parametrize("limit", [hierarchy.MAX_LOCAL, 1])
def test_descendants_reached_and_sizes_against_brute_force(spark, limit):
    r = random.Random(5)
    graphs = {}
    for g in range(2 if limit == 1 else 40):
        k = r.randrange(1, 12)
        graphs[f"g{g}"] = {f"n{i}": [f"n{r.randrange(k + 1)}" for _ in range(r.choice([0, 1, 1, 2, 3]))] for i in range(k)}
    n = spark.createDataFrame([(g, k, None, 1, k) for g, ps in graphs.items() for k in ps], N)
    e = spark.createDataFrame([(g, k, p, i) for g, x in graphs.items() for k, ps in x.items() for i, p in enumerate(ps)], E)
    want = {(g, a, b) for g, ps in graphs.items() for a, b in below(ps)}
    assert {tuple(x) for x in hierarchy.all_descendants(spark, n, e, limit).collect()} == want
    sizes = {(x.tax, x.node_id): x.descendants for x in hierarchy.hierarchies(spark, n, e, limit).select("tax", "node_id", "descendants").collect()}
    assert sizes == {(g, k): sum(x[:2] == (g, k) for x in want) for g, ps in graphs.items() for k in ps}
    roots = {(g, k) for g, ps in graphs.items() for k, p in ps.items() if not p}
    assert {tuple(x) for x in graph.reachable(spark, n, e, limit).collect()} == roots | {(g, b) for g, a, b in want if (g, a) in roots}


def test_chain_of_100_000_nodes():
    names = [f"n{i:06}" for i in range(100_000)]
    t = hierarchy.Tree(names, zip(names[1:], names))
    sizes = {t.names[members[0]]: sum(hi - lo for lo, hi in stretches) for members, stretches, _ in t.lists()}
    assert t.depth[-1] == 99_999 and all(t.reached) and sizes["n000000"] == 99_999 and sizes["n099999"] == 0 and sizes["n050000"] == 49_999
    t = hierarchy.Tree(names, [*zip(names[1:], names), (names[10], names[90_000])])
    assert t.state(5) is None and t.state(10) == "cycle" == t.state(90_000) and t.state(90_001) == "below_cycle"
    sizes = {t.names[v]: sum(hi - lo for lo, hi in stretches) for members, stretches, _ in t.lists() for v in members}
    assert sizes["n000000"] == 99_999 and sizes["n000010"] == 99_990 == sizes["n090000"] and sizes["n090001"] == 9_998


def test_paths_roots_descendants(spark):
    n, e = tables(spark, {"r": [], "a": ["r"], "b": ["a"], "c": ["b", "r"]})
    h = {x.node_id: x for x in hierarchy.hierarchies(spark, n, e).collect()}
    assert h["c"].path == ["r", "a", "b", "c"] and h["c"].depth == 3 and h["c"].root_id == "r" and h["r"].descendants == 3
    assert rows(hierarchy.all_descendants(spark, n, e).filter("node_id = 'a'").select("descendant_id")) == [("b",), ("c",)]


def test_findings(spark):
    n, e = tables(spark, {"r": [], "a": ["r"], "x": ["y"], "y": ["x"], "z": ["y"], "s": ["s"], "q": ["gone"]}, depth={"r": 0, "a": 7, "x": 0, "q": 0})
    got = {x.node_id: x.finding for x in hierarchy.depth_findings(spark, n.unionByName(n), e.unionByName(e)).collect()}
    assert got == {"a": "depth", "x": "cycle", "y": "cycle", "z": "below_cycle", "s": "cycle"}


def test_empty_and_null_rows(spark):
    n, e = spark.createDataFrame([], N), spark.createDataFrame([], E)
    assert hierarchy.depth_findings(spark, n, e).count() == 0
    n = spark.createDataFrame([("x", None, 1, 1, None), ("x", "a", None, None, None)], N)
    e = spark.createDataFrame([("x", "a", None, 0), ("x", None, "a", 0), (None, "a", "a", 0)], E)
    assert rows(hierarchy.depth_findings(spark, n, e)) == [("x", "a", "depth")]


def test_chain_ties_cycles_and_absent_parents(spark):
    n, e = tables(spark, {"r1": [], "r2": [], "b": ["r2", "r1"], "x": ["y"], "y": ["x"], "q": ["gone"]})
    for limit in (graph.MAX_LOCAL, 1):
        c = {x.node_id: x.chain for x in graph.shortest_chains(spark, n, e, limit).collect()}
        assert c["b"] == ["r1", "b"] and c["x"] == ["x"] and c["q"] == ["q"]


def test_ancestors_hold_absent_parents_and_not_self(spark):
    n, e = tables(spark, {"x": ["y"], "y": ["x", "gone"]})
    assert rows(graph.ancestors(spark, n, e).select("node_id", "ancestor_id")) == [("x", "gone"), ("x", "y"), ("y", "gone"), ("y", "x")]
    assert rows(graph.roots(n, e)) == []


def test_every_kind_of_finding_once(spark):
    n, e = tables(spark, {"a": ["b"], "b": ["a"], "c": ["a", "absent"]}, names={"a": "A", "b": " a ", "c": "C"})
    d = spark.createDataFrame([("x", "a", "c", 0)], "tax string, node_id string, other_id string, ord int")
    got = {r.kind: r.n for r in consistency.kind_counts(consistency.taxonomy_findings(spark, n, e, d)).collect()}
    assert got == {"cycle": 1, "dangling-parent": 1, "duplicate-label": 1, "disjoint-ancestor": 1, "unreachable": 1}
    n, e = tables(spark, {"r": [], "c1": ["r"], "c2": ["r"]})
    assert consistency.taxonomy_findings(spark, n, e, d.limit(0)).count() == 0


def test_alignment_flags(spark):
    n, e = tables(spark, {"a": [], "b": ["a"], "c": [], "x": [], "y": ["x"]})
    m = spark.createDataFrame([("p", "a", "c"), ("p", "b", "c")], "pair string, source_id string, target_id string")
    assert [(r.side, r.n) for r in consistency.cardinality_groups(m).collect()] == [("target", 2)]
    m = spark.createDataFrame([("p", "a", "y"), ("p", "b", "x")], "pair string, source_id string, target_id string")
    assert rows(consistency.subsumption_violations(m, e, graph.ancestors(spark, n, e))) == [("p", "b", "x")]
