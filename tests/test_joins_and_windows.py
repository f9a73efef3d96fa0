"""Joins beyond equality, burn rates and budgets on small tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.operators import joins, windows


def test_sole_or_exact(spark):
    left = spark.createDataFrame([(1, "s", "a"), (2, "s", "z"), (3, "t", "z"), (4, "u", "z")], "row_id int, k string, want string")
    right = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], "k string, name string")
    got = {r.row_id: r.matched for r in joins.sole_or_exact(left, right, ["k"], F.col("name") == F.col("want")).collect()}
    assert got == {1: "a", 2: None, 3: "c", 4: None}


def test_longest_prefix(spark):
    left = spark.createDataFrame([("a.b.c.D",), ("x.y",), (None,)], "symbol string")
    right = spark.createDataFrame([("a",), ("a.b",), ("a.b.cc",)], "p string")
    assert {r.symbol: r.resolved for r in joins.longest_prefix(left, "symbol", right, "p").collect()} == {"a.b.c.D": "a.b", "x.y": None, None: None}


def test_path_templates(spark):
    changed = spark.createDataFrame([("/orders/{}",), ("/{}/orders",), ("/a/b",)], "path string")
    used = spark.createDataFrame([("/orders/7?x=1",), ("/t/orders",), ("/a/b/c",), ("/a/b",)], "url string")
    assert {(r.path, r.url) for r in joins.path_template_match(changed, used).collect()} == {("/orders/{}", "/orders/7?x=1"), ("/{}/orders", "/t/orders"), ("/a/b", "/a/b")}


def test_line_runs(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, " b "), (1, 3, "a"), (2, 1, "a"), (2, 2, "c")], "file_id int, line_no int, line string")
    anchors = spark.createDataFrame([(9, ["a", "b"])], "anchor_id int, needles array<string>")
    assert [(r.anchor_id, r.file_id, r.line_no) for r in joins.line_runs(anchors, lines, 2).collect()] == [(9, 1, 1)]


def test_burn_rate_needs_both_windows(spark):
    start = datetime(2024, 1, 1)
    rows = [("k", start + timedelta(minutes=m), "error" if m >= 50 else "ok") for m in range(60)] + [("k", None, "error")]
    e = spark.createDataFrame(rows, "key string, ts timestamp_ntz, t string")
    out = windows.burn_rates(e, ["key"], "ts", F.col("t") == "error", 0.01).orderBy("ts").collect()
    assert len(out) == 60 and out[-1].fast and not out[49].fast
    # at minute 55 the short window is all errors, the long one holds six of 56
    assert out[55].fast == (6 / 56 > 14.4 * 0.01)


def test_budget_keeps_all_rows(spark):
    df = spark.createDataFrame([("p", i) for i in range(5)], "pool string, v int")
    got = windows.ranked_budget(df, ["pool"], [F.col("v")], 2).collect()
    assert sorted((r.v, r.result) for r in got) == [(0, "kept"), (1, "kept"), (2, "capped"), (3, "capped"), (4, "capped")]


def test_line_run_classes(spark):
    files = spark.createDataFrame([(20, "a\n b\r\nc\na\nb\n"), (2, "a\nb"), (3, None), (40, ""), (60, "a\n\nb")], "file_id bigint, content string")
    got = sorted((r.file_id, r.line_no, r.n_places, r.n_files) for r in joins.line_run_classes(files, F.col("file_id") % 20 == 0).collect())
    assert got == [(20, 1, 3, 2), (20, 2, 1, 1), (20, 3, 1, 1), (20, 4, 3, 2)]


def test_global_rank(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "hot" if i % 3 else str(i)) for i in range(101)] + [(None, "x")], "a int, b string")
    got = {(r.a, r.b): r.place for r in windows.global_rank(rows, [F.asc_nulls_last("a"), F.col("b")]).collect()}
    assert sorted(got.values()) == list(range(1, 103)) and all(got[k] == k[0] + 1 for k in got if k[0] is not None)
    assert windows.global_rank(rows.where("false"), [F.col("a")]).count() == 0


def test_burn_rates_across_spans_of_time(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 4 * 86_400), rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, s bigint, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.bad_3600, r.bad_21600) for r in windows.burn_rates(df, ["k"], "ts", F.col("bad"), 0.02).collect()}
    for i, k, s, _ in rows:
        share = lambda w: (lambda x: sum(x) / len(x))([b for _, k2, s2, b in rows if k2 == k and s - w <= s2 <= s])
        assert abs(got[i][0] - share(3600)) < 1e-9 and abs(got[i][1] - share(21600)) < 1e-9
