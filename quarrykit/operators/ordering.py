"""Places, ranks and medians over whole tables: ranges of values are counted, and only rows inside a range are ordered, so no task sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, parts_for


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Every row with its place from 0 in the order of the columns given, over the whole table. Equal rows have an arbitrary order among each other.

    Rows are dealt into ranges of the order; the driver gets one count for each range."""
    x = cut_lineage(df.repartitionByRange(parts_for(df), *order).withColumn("_p", F.spark_partition_id()))
    before, total = [], 0
    for r in x.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        before.append((r["_p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_p int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return x.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + place).drop("_p", "_before")


def ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, below, total) of each distinct value in each group: rows with it, rows with less, rows of the group. Nulls don't count.

    Values are counted before the shuffle and dealt into ranges of (group, value), so a group or value of a third of all rows is no task's work."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    x = cut_lineage(counts.repartitionByRange(parts_for(df), *by, value).withColumn("_p", F.spark_partition_id()))
    here = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*by, "_p").agg(F.sum("n").alias("_s"))
    group = Window.partitionBy(*by)
    sums = sums.select(*by, "_p", F.sum("_s").over(group).alias("total"), F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.withColumn("_here", F.coalesce(F.sum("n").over(here), F.lit(0)))
    same = [x[c].eqNullSafe(sums[c]) for c in by] + [x["_p"] == sums["_p"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return x.join(F.broadcast(sums), on).select(*[x[c] for c in by], x[value], "n", (F.col("_before") + F.col("_here")).alias("below"), "total")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the exact median of each group's values, the mean of the two in the middle where their number is even."""
    r = ranks(df, by, value)
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    r = r.where(holds(low) | holds(high))
    return r.groupBy(*by).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
