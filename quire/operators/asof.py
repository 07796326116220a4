"""As-of merges: for each row of one side the last row of the other at or before it, and the first at or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """left's columns, before and after: structs of right's columns but for the keys, null where there is no such row.

    Equal places count on either side. right has at most one row for each key and place. Both sides are sorted once, within
    stretches of `width`; what a stretch doesn't hold is carried over from the nearest one that has a row, so a key with most
    of the rows is many tasks, and no row meets more than its neighbours. Rows of left without key or place stay, with nulls.
    """
    held = [c for c in right.columns if c not in keys]
    place = F.floor(F.col(at) / F.lit(width)).alias("_range")
    found = right.filter(F.col(at).isNotNull()).select(*keys, place, F.col(at).alias("_at"), F.struct(*held).alias("_r"))
    empty = F.lit(None).cast(found.schema["_r"].dataType)
    asked = left.select(*keys, place, F.col(at).alias("_at"), F.struct(*left.columns).alias("_l"))
    rows = asked.withColumn("_r", empty).unionByName(found.withColumn("_l", F.lit(None).cast(asked.schema["_l"].dataType)))
    within = Window.partitionBy(*keys, "_range")
    side = F.col("_l").isNotNull()
    last = lambda order: F.last("_r", ignorenulls=True).over(within.orderBy(order, side).rowsBetween(Window.unboundedPreceding, 0))
    merged = rows.withColumns({"_before": last(F.col("_at")), "_after": last(F.col("_at").desc())}).filter("_l is not null")
    ends = found.groupBy(*keys, "_range").agg(F.max_by("_r", "_at").alias("_last"), F.min_by("_r", "_at").alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_range")
    stretches = asked.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "full_outer")
    carried = stretches.select(
        *keys, "_range", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_before"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_carry_after"),
    )
    both = merged.join(carried, [*keys, "_range"], "left")
    return both.select("_l.*", F.coalesce("_before", "_carry_before").alias("before"), F.coalesce("_after", "_carry_after").alias("after"))
