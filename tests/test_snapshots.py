"""Snapshot differences against a dict-based brute force."""

import random

from lodestrata.operators.snapshots import atlas_changes, change_counts

SCHEMA = "snapshot_no int, delivery_no int, node_id string, name string, path string, version string, licenses array<string>, owners array<string>, coverage double, changes bigint, _key string, _next int, field string"


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is not None:
            last[r[0]] = max(last.get(r[0], -1), r[1])
    norm = lambda r: (r[3] and r[3].strip(), r[4], r[5] and r[5].strip(), frozenset(r[6] or ()), frozenset(r[7] or ()), None if r[8] is None or r[8] != r[8] else round(r[8], 3) + 0.0)
    snaps = {s: {r[2]: norm(r) for r in rows if r[0] == s and r[1] == last[s] and r[2] is not None} for s in last}
    out, order = set(), sorted(snaps)
    for a, b in zip(order, order[1:]):
        for k in snaps[a].keys() | snaps[b].keys():
            if k not in snaps[a]:
                out.add((b, k, "added"))
            elif k not in snaps[b]:
                out.add((b, k, "removed"))
            elif snaps[a][k] != snaps[b][k]:
                out.add((b, k, "changed"))
    return out


def row(s, d, k, **x):
    get = x.get
    return (s, d, k, get("name", "n"), get("path"), get("version", "1"), get("licenses"), get("owners"), get("coverage"), get("changes", 1), "clash", 7, "clash")


def test_random_snapshots_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for s in (1, 2, 4):
        for d in (1, 2) if s == 2 else (1,):
            for k in [f"k{i}" for i in range(60)] + [None]:
                if rng.random() < 0.8:
                    rows.append(row(s, d, k, name=rng.choice(["a", "b", None]), version=rng.choice(["1", " 1 ", "2"]), licenses=rng.choice([None, [], ["MIT", "ISC"], ["ISC", "MIT", "MIT"]]), coverage=rng.choice([None, 0.5, 0.5000001, 0.51]), changes=rng.randint(0, 9)))
    rows += rows[:20]
    got = {(r.snapshot_no, r.node_id, r.change_kind) for r in atlas_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and got


def test_fields_that_changed(spark):
    rows = [row(1, 1, "k", coverage=0.1, owners=["x"]), row(2, 1, "k", coverage=0.2, owners=["x", "y"], changes=5)]
    (r,) = atlas_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.changed_fields == ["owners", "coverage"]


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert atlas_changes(empty).count() == 0 and change_counts(atlas_changes(empty), "snapshot_no").count() == 0
    assert atlas_changes(spark.createDataFrame([row(3, 1, "k")], SCHEMA)).count() == 0
    assert atlas_changes(spark.createDataFrame([row(1, 1, "k", coverage=float("nan")), row(2, 1, "k")], SCHEMA)).count() == 0
