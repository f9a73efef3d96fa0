"""Filling containers of fixed capacity with documents by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs; a group's open containers at its end are the price, less than one in a thousand here.
GROUP_ITEMS = 50_000


def sum_of_squares(sizes: Iterable[int], capacity: int) -> list[int]:
    """Bin number of each item in turn; sizes are between 0 and the capacity.

    Each item goes where the sum over gaps of (open bins with that gap) squared becomes smallest, a new bin being one
    of the choices; ties go to the smallest gap. Full bins have no gap and don't count.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, opened = [], 0
    for size in sizes:
        # moving a bin from gap g to g - size changes the sum by 2 * (counts[g - size] - counts[g] + 1)
        after, before = counts[: capacity + 1 - size], counts[size:]
        if size == 0:
            gaps = np.flatnonzero(counts)
            gap = int(gaps[0]) if len(gaps) else capacity
        else:
            change = 2 * (after - before + 1)
            change[0] = 1 - 2 * before[0]
            change = np.where(before > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
            fresh = 2 * int(after[-1]) + 1 if size < capacity else 0
            gap = best + size if before[best] > 0 and change[best] <= fresh else capacity
        if gap == capacity and not (size == 0 and counts[capacity]):
            number, opened = opened, opened + 1
        else:
            number = bins[gap].pop()
            counts[gap] -= 1
        if (rest := gap - size) > 0:
            bins[rest].append(number)
            counts[rest] += 1
        placed.append(number)
    return placed


_PACKED = "profile string, container string, place int, doc_id bigint, piece int, n_tokens bigint"


def pack(items: DataFrame, profiles: list[tuple[str, int, int]], n_items: int) -> DataFrame:
    """Assigns items (doc_id, n_tokens) to containers of each profile (name, capacity, separator).

    Result: profile, container, place, doc_id, piece, n_tokens. A document longer than the capacity is cut into full
    containers, which need no packer, and a rest that is packed like any other; nothing else is split. An empty
    document takes a place of size 0. A separator is counted between two items of a container. Rests fall into groups
    of about `GROUP_ITEMS` by a hash of their document's id, each packed in one task: one rest a document and profile,
    so tasks stay the same size however many documents there are and however long they are.
    """
    blocks = max(1, -(-n_items // GROUP_ITEMS))
    wanted = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("int").alias("capacity"), F.lit(s).cast("int").alias("separator")) for p, c, s in profiles])
    each = items.select("doc_id", "n_tokens", F.xxhash64("doc_id").alias("turn"), F.explode(wanted).alias("w")).select("doc_id", "n_tokens", "turn", "w.*")
    n_full = F.floor((F.greatest("n_tokens", F.lit(1)) - 1) / F.col("capacity"))
    each = each.withColumns({"n_full": n_full, "block": F.pmod("turn", F.lit(blocks)).cast("int")})
    full = each.where("n_full > 0").select("profile", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)).alias("piece"))
    full = full.select(
        "profile", F.concat_ws("-", "profile", F.lit("full"), "doc_id", "piece").alias("container"), F.lit(1).alias("place"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("capacity").cast("bigint").alias("n_tokens")
    )
    rests = each.select("profile", "block", "capacity", "separator", "turn", "doc_id", F.col("n_full").cast("int").alias("piece"), (F.col("n_tokens") - F.col("n_full") * F.col("capacity")).alias("size"))

    def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        profile, block = key
        capacity, separator = int(rows["capacity"].iloc[0]), int(rows["separator"].iloc[0])
        rows = rows.sort_values(["turn", "doc_id", "piece"])
        # an item brings its separator along and the container has room for one more: n items then cost n - 1
        numbers = sum_of_squares((rows["size"] + separator).tolist(), capacity + separator)
        out = rows[["doc_id", "piece"]].assign(n_tokens=rows["size"], container=[f"{profile}-{block}-{n}" for n in numbers], profile=profile)
        out["place"] = out.groupby("container").cumcount() + 1
        return out[["profile", "container", "place", "doc_id", "piece", "n_tokens"]]

    return full.unionByName(rests.groupBy("profile", "block").applyInPandas(one_group, _PACKED))


#: A profile table is a handful of settings; a longer one is a mistake and is refused, never cut.
MOST_PROFILES = 10_000


def packed_documents(sized: DataFrame, profiles: DataFrame) -> DataFrame:
    """`pack` for all documents and all rows of the profile table; bad capacities are left out, too many profiles raise."""
    wanted = profiles.where("profile is not null and capacity_tokens > 0").select("profile", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator")).distinct()
    rows = [tuple(r) for r in wanted.limit(MOST_PROFILES + 1).collect()]
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} packing profiles")
    if not rows:
        return sized.sparkSession.createDataFrame([], _PACKED)
    return pack(sized, rows, sized.select("doc_id").count())


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, separators and the share of the capacity left unused."""
    per = packed.groupBy("profile", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    total = per.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum(F.col("n") - 1).alias("joints"))
    used = F.col("tokens") + F.col("joints") * F.col("separator_tokens")
    unused = F.round(1 - used / (F.col("containers") * F.col("capacity_tokens")), 6)
    return total.join(profiles, "profile").select("profile", "containers", "tokens", unused.alias("unused_share"))
