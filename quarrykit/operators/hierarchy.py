"""Class hierarchies: Python's own order of classes (C3), worked out from the top down."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.skew import lookup
from quarrykit.runtime import cut_lineage


def merged(own: str, orders: list[list[str]], bases: list[str]) -> list[str] | None:
    """The C3 order of a class from the orders of its bases and the bases themselves; None if there is none."""
    out, left = [own], [list(x) for x in [*orders, bases] if x]
    while left:
        for seq in left:
            if not any(seq[0] in other[1:] for other in left):
                break
        else:
            return None
        head = seq[0]
        out.append(head)
        left = [x for x in ([y for y in s if y != head] for s in left) if x]
    return out


def class_orders(parents: DataFrame) -> DataFrame:
    """(repo, cls, line): the C3 order of each class that has bases and an order; line begins with the class itself.

    `parents` has repo, cls, ord, up: the bases of each class in order. Classes on a cycle of bases, below one, or whose bases have no
    order, get none. Each round takes the classes of which every base is in order, so there are as many rounds as the hierarchy is high."""
    edges = cut_lineage(parents.select("repo", "cls", "ord", "up"))
    left = edges.select("repo", "cls").dropDuplicates()
    tops = edges.select("repo", F.col("up").alias("cls")).dropDuplicates().join(left, ["repo", "cls"], "left_anti")
    done = cut_lineage(tops.withColumn("line", F.array("cls")))
    out = None

    @F.pandas_udf("array<string>")
    def merge(own: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([merged(o, [list(p["line"]) for p in ps], list(dict.fromkeys(p["up"] for p in ps))) for o, ps in zip(own, (sorted(x, key=lambda p: p["ord"]) for x in parts))])

    open_ = edges
    while True:
        # the bases in order of the classes that wait; a class is ready if it waits for none
        known = done.select("repo", F.col("cls").alias("up"), "line")
        met = lookup(open_, known, ["repo", "up"], "left")
        ready = met.groupBy("repo", "cls").agg(F.count_if(F.col("line").isNull()).alias("waits"), F.collect_list(F.when(F.col("line").isNotNull(), F.struct("ord", "up", "line"))).alias("parts")).where("waits = 0")
        new = cut_lineage(ready.select("repo", "cls", merge("cls", "parts").alias("line")).where("line is not null"))
        if new.isEmpty():
            return out if out is not None else done.limit(0)
        out = new if out is None else out.unionByName(new)
        done = cut_lineage(done.unionByName(new))
        open_ = cut_lineage(open_.join(new.select("repo", "cls"), ["repo", "cls"], "left_anti"))
