"""Joins whose keys may be hot: a key of a third of all rows is never one task's work, and none is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The keys with the most rows, at most HOT of them, meet their entries by broadcast; every other key has less than one in HOT of the rows.
HOT = 1000
#: Rows below which a key is no work to speak of.
FLOOR = 10_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", floor: int = FLOOR) -> DataFrame:
    """`rows` joined with `table`, which holds each key once or seldom; how is inner, left, left_semi or left_anti.

    Rows are counted by key before the shuffle, and the driver gets the hottest keys, at most HOT whatever the corpus. Their entries are
    broadcast, all others meet in a shuffle. Null keys meet nothing. `rows` is read once more for the counts."""
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= floor)
    hot = counts.orderBy(F.col("_n").desc(), *keys).limit(HOT).select(*keys).collect()
    if not hot:
        return rows.join(table, keys, how)
    mark = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema).withColumn("_hot", F.lit(True)))
    marked = rows.join(mark, keys, "left")
    warm = marked.where("_hot is null").drop("_hot").join(table, keys, how)
    entries = table.join(mark.drop("_hot"), keys, "left_semi")
    return marked.where("_hot").drop("_hot").join(F.broadcast(entries), keys, how).unionByName(warm)
