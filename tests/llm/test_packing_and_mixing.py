"""Packing and mixing: invariants, brute force and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing, packing, tokens

PROFILES = "profile string, capacity_tokens int, separator_tokens int"


def greedy(sizes, capacity):
    """The sum-of-squares rule by trying every open bin."""
    gaps, placed = [], []
    for size in sizes:
        best = None
        counts = {}
        for g in gaps:
            counts[g] = counts.get(g, 0) + (g > 0)
        total = lambda c: sum(v * v for v in c.values())
        options = sorted({g for g in gaps if g >= size and (g > 0)} | {capacity})
        for gap in options:
            after = dict(counts)
            if gap in counts and not (gap == capacity and gap not in gaps):
                after[gap] -= 1
            if gap - size > 0:
                after[gap - size] = after.get(gap - size, 0) + 1
            cost = total(after)
            if best is None or cost < best[0]:
                best = cost, gap
        placed.append(best[0])
        gap = best[1]
        if gap in gaps:
            gaps[len(gaps) - 1 - gaps[::-1].index(gap)] -= size
        else:
            gaps.append(gap - size)
    return placed


@pytest.mark.parametrize("seed", range(4))
def test_rule_reaches_the_least_sum_of_squares(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 9) for _ in range(80)]
    numbers = packing.sum_of_squares(sizes, 10)
    fill, sums = {}, []
    for n, s in zip(numbers, sizes):
        fill[n] = fill.get(n, 0) + s
        assert fill[n] <= 10
        gaps = {}
        for v in fill.values():
            if v < 10:
                gaps[10 - v] = gaps.get(10 - v, 0) + 1
        sums.append(sum(v * v for v in gaps.values()))
    assert sums == greedy(sizes, 10)


def test_packed_documents(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 350])) for i in range(400)]
    sized = spark.createDataFrame(docs, "doc_id bigint, n_tokens bigint")
    profiles = spark.createDataFrame([("a", 100, 1), ("b", 64, 0), ("bad", 0, 1), (None, 5, 1), ("c", 128, None)], PROFILES)
    rows = packing.packed_documents(sized, profiles).collect()
    for profile, capacity, separator in (("a", 100, 1), ("b", 64, 0), ("c", 128, 0)):
        mine = [r for r in rows if r.profile == profile]
        boxes = {}
        for r in mine:
            boxes.setdefault(r.container, []).append(r)
        assert all(sum(r.n_tokens for r in b) + separator * (len(b) - 1) <= capacity for b in boxes.values())
        assert all(sorted(r.place for r in b) == list(range(1, len(b) + 1)) for b in boxes.values())
        for doc, size in docs:
            pieces = sorted((r.piece, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(n for _, n in pieces) == size and [p for p, _ in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(1, -(-size // capacity)) and all(n == capacity for _, n in pieces[:-1])
    assert {r.profile for r in rows} == {"a", "b", "c"}
    report = {r.profile: r.unused_share for r in packing.fill_report(packing.packed_documents(sized, profiles), profiles.where("profile = 'b'")).collect()}
    assert report["b"] < 0.2
    assert packing.packed_documents(sized.where("false"), profiles).count() == 0 and packing.packed_documents(sized, profiles.where("false")).count() == 0


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world", "a", 1), (2, None, "a", 1), (3, "", None, 1), (None, "x", "a", 1), (1, "hello world", "a", 1)], "doc_id bigint, text string, source string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in tokens.sized_documents(docs).collect()} == {1: 2, 2: 0, 3: 0}


TARGETS = "mix_name string, source string, weight double, max_repeats int"


def test_mix_meets_weights_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    rng = random.Random(5)
    docs = [(i, "big" if i % 3 else "small", rng.randint(1, 40)) for i in range(900)] + [(1000, None, 5), (1001, "big", 0), (1002, "unasked", 9)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("n", "small", 1.0, None), ("n", "missing", 0.2, 2), ("n", "big", 0.0, 2), (None, "big", 1.0, 1)], TARGETS)
    rows = mixing.mixed_documents(sized, targets).collect()
    tokens_of = lambda m, s: sum(r.n_tokens for r in rows if r.mix_name == m and r.source == s)
    a, b = tokens_of("m", "big"), tokens_of("m", "small")
    assert abs(a - b) <= 80 and max(r.repeats for r in rows if r.source == "small" and r.mix_name == "m") <= 3
    assert a >= sum(d[2] for d in docs if d[1] == "big") - 40  # the larger share uses all of its source
    assert {r.source for r in rows if r.mix_name == "n"} == {"small"} and {r.source for r in rows} == {"big", "small"}
    shares = {(r.mix_name, r.source): r for r in mixing.share_report(spark.createDataFrame(rows), targets).collect()}
    assert abs(shares["m", "big"].share - 0.5) < 0.01 and shares["n", "missing"].tokens == 0
    some = mixing.mixed_documents(sized, targets, budget=1000).where("mix_name = 'm'")
    assert 900 <= some.agg(F.sum("n_tokens")).first()[0] <= 1000
    assert mixing.mixed_documents(sized.where("false"), targets).count() == 0 and mixing.mixed_documents(sized, targets.where("false")).count() == 0


def test_queue_order_follows_virtual_finish_times(spark):
    sized = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aabbbb")], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], TARGETS)
    rows = mixing.in_order(mixing.mixed_documents(sized, targets)).collect()
    assert len(rows) == 4 and [r.finish for r in rows] == [20.0, 20.0, 40.0, 40.0] and {r.source for r in rows[:2]} == {"a", "b"}


def queue(docs, targets, order, budget):
    """The queue by brute force: every copy with its finish time, sorted, cut where the next one exceeds the budget."""
    copies = []
    for source, weight, most in targets:
        total, so_far = sum(n for _, s, n in docs if s == source), 0
        for k in range(most):
            for i in order[source]:
                n = next(n for j, _, n in docs if j == i)
                so_far += n
                copies.append((so_far / weight, source, i, k + 1, n))
        assert so_far == most * total
    taken, spent = [], 0
    for c in sorted(copies):
        if spent + c[4] > budget:
            break
        spent += c[4]
        taken.append(c)
    return taken


def test_queue_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    rng = random.Random(8)
    docs = [(i, rng.choice("abc"), rng.randint(1, 30)) for i in range(60)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    order = {}
    for r in sorted(mixing.running_tokens(sized, 7, 60).collect(), key=lambda r: r.cumulative):
        order.setdefault(r.source, []).append(r.doc_id)
    wanted = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4)]
    targets = spark.createDataFrame([("m", *t) for t in wanted], TARGETS)
    totals = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    reach = min(totals[s] * most / w for s, w, most in wanted)
    for budget in (None, 200):
        rows = mixing.in_order(mixing.mixed_documents(sized, targets, budget=budget)).collect()
        want = queue(docs, wanted, order, int(reach * 1.0 + 1e-9) if budget is None else budget)
        assert [(r.source, r.doc_id, r.copy) for r in rows] == [(s, i, k) for _, s, i, k, _ in want]
        assert all(r.repeats == max(k for _, _, i, k, _ in want if i == r.doc_id) for r in rows)


def test_long_texts_fill_containers_of_their_own(spark):
    sized = spark.createDataFrame([(1, 1_000_007), (2, 3)], "doc_id bigint, n_tokens bigint")
    rows = packing.packed_documents(sized, spark.createDataFrame([("a", 10, 1)], PROFILES)).collect()
    assert len(rows) == 100_002 and sum(r.n_tokens for r in rows) == 1_000_010 and len({r.container for r in rows if r.n_tokens == 10}) == 100_000


def test_too_many_profiles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PROFILES", 1)
    with pytest.raises(ValueError):
        packing.packed_documents(spark.createDataFrame([(1, 1)], "doc_id bigint, n_tokens bigint"), spark.createDataFrame([("a", 10, 1), ("b", 10, 1)], PROFILES))
