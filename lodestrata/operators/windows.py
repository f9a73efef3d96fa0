"""Burn rates, request rates and ranked budgets over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

#: Long window, confirming window and factor of each burn rate, in seconds.
BURN_WINDOWS = {"fast": (3600, 300, 14.4), "slow": (21_600, 1_800, 6.0)}


def burn_rates(events: DataFrame, key: list[str], ts: str, bad: Column, budget: float) -> DataFrame:
    """Each event with the bad share over every window and whether the fast and the slow alert fire.

    Both windows of a pair must exceed factor times budget. An event without time or key takes no part. A key's events
    are cut into spans of time four longest windows wide; each span also gets the events of the longest window before
    it, so no window is cut and a hot key spreads over as many tasks as it has spans.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    longest = max(long for long, _, _ in BURN_WINDOWS.values()) * 1_000_000
    span = 4 * longest
    base = events.where(F.col(ts).isNotNull()).withColumns({"_at": at, "_bad": F.when(bad, 1.0).otherwise(0.0)})
    own = F.floor(F.col("_at") / span)
    ahead = F.when(F.col("_at") >= (own + 1) * span - longest, F.array(own, own + 1)).otherwise(F.array(own))
    spread = base.withColumn("_own", own).withColumn("_span", F.explode(ahead))
    frames = {s: Window.partitionBy(*key, "_span").orderBy("_at").rangeBetween(-s * 1_000_000, 0) for long, short, _ in BURN_WINDOWS.values() for s in (long, short)}
    out = spread.withColumns({f"bad_{s}": F.avg("_bad").over(w) for s, w in frames.items()}).where("_span = _own")
    fires = {name: (F.col(f"bad_{long}") > factor * budget) & (F.col(f"bad_{short}") > factor * budget) for name, (long, short, factor) in BURN_WINDOWS.items()}
    return out.withColumns(fires).drop("_at", "_bad", "_own", "_span")


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in one order over all rows, sorted by ranges: no task sees more than its range.

    Ranges are written once, so that places count over the same ranges; their sizes are one row a range.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_in", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def ranked_budget(df: DataFrame, pool: list[str], order: list[Column], cap: int) -> DataFrame:
    """Rows with their place in their pool and whether they are kept or capped; nothing is dropped."""
    place = F.row_number().over(Window.partitionBy(*pool).orderBy(*order))
    return df.withColumn("place", place).withColumn("result", F.when(F.col("place") <= cap, "kept").otherwise("capped"))
