"""Joins that equality alone doesn't express, each with an equality to shuffle by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sole_or_exact(left: DataFrame, right: DataFrame, key: list[str], exact: Column, when_unknown: Column | None = None) -> DataFrame:
    """Left rows with the right row that fits exactly, else with the only candidate of their key, else with none.

    `left` needs a column row_id. `when_unknown` limits the sole-candidate rule to rows where it holds. Several exact
    candidates are one match only if they are the only exact one; ties give the first by right's column `name`.
    """
    joined = left.join(right, key, "left").withColumn("_exact", F.coalesce(exact, F.lit(False)))
    per_row = Window.partitionBy("row_id")
    counted = joined.withColumns({"_n": F.count("name").over(per_row), "_place": F.row_number().over(per_row.orderBy(F.desc("_exact"), "name"))})
    sole = F.col("_n") == 1
    if when_unknown is not None:
        sole = sole & when_unknown
    return counted.where("_place = 1").withColumn("matched", F.when(F.col("_exact") | sole, F.col("name"))).drop("_exact", "_n", "_place", "name")


def enclosing(points: DataFrame, starts: DataFrame, key: list[str], at: str, name: str) -> DataFrame:
    """Points with the last start at or before them in the same key (a line's enclosing definition); one sort, no range join."""
    marks = starts.select(*key, F.col(at).alias("_at"), F.col(name).alias("_name"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_point"))
    asked = points.select(*key, F.col(at).alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(1).alias("_kind"), F.col("point_id").alias("_point"))
    before = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("enclosing", F.last("_name", ignorenulls=True).over(before))
    return both.where("_kind = 1").select(*key, F.col("_point").alias("point_id"), F.col("_at").alias(at), "enclosing")


def longest_prefix(left: DataFrame, symbol: str, right: DataFrame, prefix: str) -> DataFrame:
    """Left rows with the longest dotted prefix of `symbol` that occurs in right, null if none does.

    Every symbol is unfolded to its own prefixes, a few rows each, and joined by equality.
    """
    parts = F.split(F.col(symbol), r"\.")
    each = left.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("_prefix"))
    known = right.select(F.col(prefix).alias("_prefix")).distinct()
    hits = each.join(known, "_prefix").groupBy(symbol).agg(F.max_by("_prefix", F.length("_prefix")).alias("resolved"))
    return left.join(hits, symbol, "left")


def path_template_match(changed: DataFrame, used: DataFrame) -> DataFrame:
    """(path, url) pairs where a template path with {} matches a used path segment by segment.

    Distinct paths are joined by their number of segments and first fixed segment, then compared in full.
    """
    segments = lambda c: F.filter(F.split(F.split_part(F.col(c), F.lit("?"), F.lit(1)), "/"), lambda s: s != "")
    a = changed.select("path", segments("path").alias("p")).distinct().where("size(p) > 0")
    b = used.select("url", segments("url").alias("u")).distinct().where("size(u) > 0")
    keyed = a.where(F.get("p", 0) != "{}").join(b, (F.size("p") == F.size("u")) & (F.get("p", 0) == F.get("u", 0)))
    open_ = a.where(F.get("p", 0) == "{}").join(b, (F.size("p") == F.size("u")) & F.when(F.size("p") > 1, F.get("p", 1) == F.get("u", 1)).otherwise(F.lit(True)))
    fits = F.forall(F.zip_with("p", "u", lambda x, y: (x == "{}") | (x == y)), lambda ok: ok)
    return keyed.unionByName(open_).where(fits).select("path", "url")


def line_runs(anchors: DataFrame, lines: DataFrame, width: int) -> DataFrame:
    """(anchor_id, file_id, line_no): where a file has an anchor's lines one after the other, blanks at line ends aside.

    `anchors` has anchor_id and needles (array of at most `width` stripped lines); `lines` has file_id, line_no and line.
    Files meet anchors by the first line's text; the lines after it are checked by place. For lines that many files
    share, use `line_run_classes`, which pairs nothing.
    """
    text = F.trim("line")
    ahead = Window.partitionBy("file_id").orderBy("line_no")
    firsts = anchors.select(F.get("needles", 0).alias("_first")).distinct()
    window = [F.lead(text, i).over(ahead) for i in range(width)]
    runs = lines.select("file_id", "line_no", text.alias("_first"), F.array(*window).alias("_run"))
    hit = runs.join(firsts, "_first", "left_semi").join(anchors.withColumn("_first", F.get("needles", 0)), "_first")
    return hit.where(F.slice("_run", F.lit(1), F.size("needles")) == F.col("needles")).select("anchor_id", "file_id", "line_no")


def line_run_classes(files: DataFrame, asked: Column) -> DataFrame:
    """(file_id, line_no, run, n_places, n_files) of each run of two lines with text in the files that `asked` picks.

    `files` has file_id and content, one row a file. `run` names the class of equal runs; its counts are over all files.
    Runs are hashed where their file is read and counted per file first, so a header that all files share is one row a
    file in the exchange, and no pairs are made.
    """
    lines = F.transform(F.regexp_extract_all("content", F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\r?\n$", "")))
    each = files.select("file_id", lines.alias("ls"), asked.alias("asked")).where("size(ls) > 1")
    run = F.transform(F.sequence(F.lit(1), F.size("ls") - 1), lambda i: F.struct(i.alias("line_no"), F.when((F.get("ls", i - 1) != "") & (F.get("ls", i) != ""), F.md5(F.concat(F.get("ls", i - 1), F.lit("\n"), F.get("ls", i)))).alias("run")))
    runs = each.select("file_id", "asked", F.explode(run).alias("r")).select("file_id", "asked", "r.line_no", "r.run").where("run is not null")
    counted = runs.groupBy("run", "file_id").agg(F.count("*").alias("n")).groupBy("run").agg(F.sum("n").alias("n_places"), F.count("*").alias("n_files"))
    return runs.where("asked").drop("asked").join(counted, "run").select("file_id", "line_no", "run", "n_places", "n_files")
