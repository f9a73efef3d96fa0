"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents per bucket of a source's shuffled order; running sums stay within a bucket.
BUCKET_DOCS = 100_000


def running_tokens(sized: DataFrame, seed: int, n_docs: int) -> DataFrame:
    """doc_id, source, n_tokens, cumulative (its source's tokens up to and with it in shuffled order) and total.

    The order is by a seeded hash. A source of any size is cut into buckets of that order; sums of whole buckets are
    added up over the few bucket rows, and running sums only run within a bucket.
    """
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    turn = F.xxhash64(F.lit(seed), "doc_id")
    # the upper bits give the bucket, so buckets follow the order of the hash itself
    placed = sized.withColumns({"turn": turn, "bucket": F.floor((turn.cast("double") / 2.0**64 + 0.5) * buckets)})
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket")
    starts = sums.select(
        "source",
        "bucket",
        (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("start"),
        F.sum("in_bucket").over(Window.partitionBy("source")).alias("total"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("so_far", F.sum("n_tokens").over(within)).join(starts, ["source", "bucket"]).select(
        "doc_id", "source", "n_tokens", (F.col("start") + F.col("so_far")).alias("cumulative"), "total"
    )


#: Rows up to which a table of targets is broadcast; beyond it Spark chooses the join.
SMALL_ROWS = 100_000


def mixed_documents(sized: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None) -> DataFrame:
    """mix_name, doc_id, source, n_tokens, copy, repeats, finish: one row per use of a document in each mix.

    Each pass over a source queues its documents in shuffled order; a copy's virtual finish time is the source's tokens
    so far, earlier passes included, over its weight. The mix is the queue in the order of these times, truncated where
    the next copy would exceed the budget: the largest that no source's cap (`max_repeats` uses of each document) cuts
    short, or `budget` if that is less. `repeats` is how often the mix uses the document in all. Sources without a
    target, without tokens or with a weight of 0 or less take no part; a null max_repeats or one under 1 counts as 1.
    """
    docs = sized.where("source is not null and n_tokens > 0")
    n_docs = docs.count()
    queued = running_tokens(docs, seed, n_docs)
    wanted = targets.where("mix_name is not null and source is not null and weight > 0").groupBy("mix_name", "source").agg(
        F.max("weight").alias("weight"), F.greatest(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("longest"))
    reach = wanted.join(totals, "source").groupBy("mix_name").agg(
        F.min(F.col("total") * F.col("max_repeats") / F.col("weight")).alias("reach"),
        F.sum("weight").alias("weights"),
        F.max(F.col("longest") / F.col("weight")).alias("slack"),
        F.sum(F.col("total") * F.col("max_repeats")).alias("most"),
    )
    if budget is not None:
        reach = reach.withColumn("reach", F.least("reach", F.lit(float(budget)) / F.col("weights")))
    # sources that no document has take no part in the budget
    reach = reach.withColumn("budget", F.floor(F.col("reach") * F.col("weights") * (1 + 1e-12)))
    plan = wanted.join(reach, "mix_name").select("mix_name", "source", "weight", "max_repeats", "reach", "slack", "budget")
    plan = F.broadcast(plan) if targets.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else plan
    # the last copies before the budget is full finish at most one document behind the common time
    until = F.col("reach") + F.col("slack")
    passes = F.least(F.col("max_repeats").cast("bigint"), F.greatest(F.lit(0), F.floor((until * F.col("weight") - F.col("cumulative")) / F.col("total")) + 1))
    each = queued.join(plan, "source").withColumn("passes", passes).where("passes > 0")
    copies = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes"))))
    copies = copies.withColumn("finish", (F.col("cumulative") + (F.col("copy") - 1) * F.col("total")) / F.col("weight"))
    return truncated(copies, n_docs).select("mix_name", "doc_id", "source", "n_tokens", F.col("copy").cast("int").alias("copy"), "repeats", "finish")


def truncated(copies: DataFrame, n_docs: int) -> DataFrame:
    """The copies of each mix up to its budget in the order of their finish times, with `repeats` per document.

    Ranges of finish time are summed first; the running total then only runs within a range. A mix's times are even in
    tokens, so ranges are of one size however the sources differ.
    """
    ranges = max(1, -(-n_docs // BUCKET_DOCS)) * 8
    placed = copies.withColumn("range", F.floor(F.col("finish") / (F.col("reach") + F.col("slack")) * ranges))
    sums = placed.groupBy("mix_name", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy("mix_name").orderBy("range")
    starts = sums.select("mix_name", "range", (F.sum("in_range").over(before) - F.col("in_range")).alias("start"))
    within = Window.partitionBy("mix_name", "range").orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("so_far", F.sum("n_tokens").over(within)).join(starts, ["mix_name", "range"])
    taken = running.where(F.col("start") + F.col("so_far") <= F.col("budget"))
    # a document's copies are taken in turn: the last one taken tells how many there are
    return taken.withColumn("repeats", F.max("copy").over(Window.partitionBy("mix_name", "doc_id")).cast("int"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix in the order of its virtual finish times, range-sorted over all tasks."""
    return mixed.orderBy("mix_name", "finish", "source", "doc_id", "copy")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target weight, tokens with repeats, share reached, most uses of one document."""
    per = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeats").alias("most_repeats"), F.count_if(F.col("copy") == 1).alias("n_docs"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(per, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_repeats", "n_docs"])
    all_tokens = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return joined.withColumn("share", F.round(F.try_divide("tokens", all_tokens), 6))
