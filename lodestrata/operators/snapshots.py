"""What changed between full snapshots, by cancelling signed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_set(column: str) -> Column:
    """An array as a set: sorted, without repeats and nulls; null counts as empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(column), F.array().cast("array<string>")))))


def rounded(column: str, digits: int) -> Column:
    """A number to `digits` decimals; NaN counts as null and -0 as 0."""
    return F.when(~F.isnan(column), F.round(column, digits) + F.lit(0.0))


def valid_deliveries(df: DataFrame, snapshot: str, delivery: str) -> DataFrame:
    """Per snapshot its highest delivery, the snapshot that follows it and whether one came before: one row per snapshot."""
    last = df.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.max(delivery).alias("_delivery"))
    order = Window.orderBy(snapshot)
    return last.withColumns({"_next": F.lead(snapshot).over(order), "_follows": F.lag(snapshot).over(order).isNotNull()})


def snapshot_changes(df: DataFrame, key: str, snapshot: str, fields: dict[str, Column], delivery: str | None = None) -> DataFrame:
    """Rows added, removed or changed in each snapshot but the first, against the one before.

    Result: (`snapshot`, `key`, change_kind, changed_fields). `fields` maps a field's name to the expression that is
    compared. Null keys are left out, repeated rows count once (one of them if they differ), an empty or single snapshot gives nothing.

    Every row speaks twice, +1 in its own snapshot and -1 in the next. Whole rows cancel first by a fingerprint of
    their fields; what is left is unpivoted into signed key-field-value cells with a presence marker, and nonzero
    sums give class and fields. All sums group by the key and more, so one exchange by key serves them. Values are
    held as 64-bit hashes, so the exchange carries numbers instead of texts.
    """
    names = list(fields)
    hashes = F.array(*[F.xxhash64(F.lit(name), fields[name].isNull(), fields[name]) for name in names])
    # only our own columns go on, whatever else the table has
    kept = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(key).alias("_key"), F.col(snapshot).alias("_snapshot"), F.col(delivery or snapshot).alias("_got"), hashes.alias("_cells"))
    # the list of snapshots is one row per delivery date, far below any broadcast limit
    steps = valid_deliveries(df.select(F.col(snapshot).alias("_snapshot"), F.col(delivery or snapshot).alias("_got")), "_snapshot", "_got")
    valid = kept.join(steps, "_snapshot").where(F.col("_got").eqNullSafe(F.col("_delivery")) if delivery else F.lit(True))
    rows = valid.select("_key", F.when(F.col("_follows"), F.col("_snapshot")).alias("_at"), "_next", "_cells")
    # one row per key and snapshot; should repeated rows differ, the greatest counts
    rows = rows.repartition("_key").groupBy("_key", "_at", "_next").agg(F.max("_cells").alias("_cells"))
    signed = rows.select("_key", "_cells", F.explode(F.array(F.struct(F.col("_at").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")))).alias("s"))
    whole = (
        signed.where("s.at is not null")
        .groupBy("_key", F.col("s.at").alias("_at"), "_cells")
        .agg(F.sum("s.sign").alias("_sign"))
        .where("_sign <> 0")
    )
    presence = F.struct(F.lit(-1).alias("field"), F.lit(0).cast("bigint").alias("value"))
    cells = F.concat(F.array(presence), F.transform("_cells", lambda v, i: F.struct(i.alias("field"), v.alias("value"))))
    sums = whole.select("_key", "_at", "_sign", F.explode(cells).alias("c")).groupBy("_key", "_at", "c.field", "c.value").agg(F.sum("_sign").alias("_sum"))
    labels = F.array(*[F.lit(n) for n in names])
    per_key = sums.groupBy("_key", "_at").agg(
        F.sum(F.when(F.col("field") == -1, F.col("_sum"))).alias("_there"),
        F.array_sort(F.collect_set(F.when((F.col("field") >= 0) & (F.col("_sum") != 0), F.col("field")))).alias("_fields"),
    )
    kind = F.when(F.col("_there") > 0, "added").when(F.col("_there") < 0, "removed").when(F.size("_fields") > 0, "changed")
    return (
        per_key.withColumn("change_kind", kind)
        .where("change_kind is not null")
        .select(
            F.col("_at").alias(snapshot),
            F.col("_key").alias(key),
            "change_kind",
            F.when(F.col("change_kind") == "changed", F.transform("_fields", lambda i: F.get(labels, i))).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


def atlas_changes(snapshots: DataFrame) -> DataFrame:
    """Changes of graph nodes: name, path, version, licences, owners and coverage are compared, nothing else."""
    fields = {c: F.trim(F.col(c)) for c in ("name", "path", "version")}
    fields |= {c: as_set(c) for c in ("licenses", "owners")}
    fields["coverage"] = rounded("coverage", 3)
    return snapshot_changes(snapshots, "node_id", "snapshot_no", fields, "delivery_no")


def change_counts(changes: DataFrame, snapshot: str) -> DataFrame:
    """Per snapshot how many rows were added, removed and changed."""
    return changes.groupBy(snapshot).agg(*[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")])
