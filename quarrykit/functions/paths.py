"""Paths as they are spelled in the wild, in one normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """`path` with forward slashes, without outer space, empty, `.` and `..` steps; null stays null. A JVM expression."""
    steps = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    kept = F.aggregate(
        steps,
        F.expr("cast(array() as array<string>)"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(x == "..", acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def id_path(component_id: Column) -> Column:
    """The normal path of a component id `name@path`; null where the id is null or has no path."""
    return F.when(component_id.contains("@"), normal_path(F.substring_index(component_id, "@", -1)))
