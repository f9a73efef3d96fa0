"""Graph operators against plain Python."""

import random

from lodestrata.operators import graphs


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_components_match_mutual_reachability(spark):
    rng = random.Random(2)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(34)] + [("n01", "n01"), (None, "n02"), ("n03", None)]
    out = {a: {b for x, b in pairs if x == a and b is not None} for a in names}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in names}
    want = {a: min({b for b in names if b in far[a] and a in far[b]} | {a}) for a in names if any(b != a and b in far[a] and a in far[b] for b in names)}
    got = {r.node: r.component for r in graphs.components(edges_of(spark, pairs)).collect()}
    assert got == want and want


def test_reach_is_bounded_and_leaves_seeds_out(spark):
    e = edges_of(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "b"), ("b", "a")])
    got = {(r.node, r.hops) for r in graphs.reach(spark.createDataFrame([("a",)], "node string"), e, 3).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_downgrades_cascade(spark):
    nodes = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False), ("e", True), ("f", True)], "node string, verified boolean")
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("e", "e"), ("f", "gone")])
    assert {r.node for r in graphs.downgraded(nodes, e).collect()} == {"a", "b", "c", "f"}
    assert graphs.downgraded(nodes.where("false"), e).count() == 0


def test_coupling_counts_distinct_edges(spark):
    got = {r.node: (r.afferent, r.efferent, r.instability) for r in graphs.coupling(edges_of(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), ("b", "b")])).collect()}
    assert got == {"a": (1, 2, 0.666667), "b": (1, 0, 0.0), "c": (1, 1, 0.5)}


def test_empty_graph(spark):
    none = edges_of(spark, [])
    assert graphs.components(none).count() == 0 and graphs.coupling(none).count() == 0


def _brute_components(edges):
    nodes = {n for e in edges for n in e}
    ahead = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = ahead[b] - ahead[a]
            if new:
                ahead[a] |= new
                changed = True
    groups = {n: frozenset(m for m in ahead[n] if n in ahead[m]) for n in nodes}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


def test_components_match_brute_force(spark):
    import random

    rng = random.Random(6)
    for n, m in ((40, 60), (60, 55), (15, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = {tuple(r) for r in graphs.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
        assert got == _brute_components([e for e in edges if e[0] != e[1]])


def test_long_chains_have_no_end(spark):
    n = 66
    nodes = spark.createDataFrame([(i, i < n) for i in range(n + 1)], "node int, verified boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    assert graphs.downgraded(nodes, edges).count() == n
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src int, dst int")
    assert {r.component for r in graphs.components(ring).collect()} == {0} and graphs.components(edges).count() == 0
