"""Line windows over files: sliding, trailing, centred, current-file and prediction windows, merged by equal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import lines

WINDOW, SLICE = 20, 2


def _cut(xs: Column, start: Column, end: Column) -> Column:
    """xs[start:end] with 0-based ends."""
    return F.slice(xs, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def sliding(files: DataFrame, text: str, window: int = WINDOW, slices: int = SLICE) -> DataFrame:
    """Each file's windows of `window` lines around every (window // slices)-th line: line_no, start_line_no, end_line_no, context.

    A file without lines has none. Narrow: a row explodes where it stands."""
    step, half = max(1, window // slices), window // 2
    x = files.withColumn("_lines", lines(F.col(text))).where(F.size("_lines") > 0).drop(text)
    x = x.withColumn("line_no", F.explode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step))))
    start = F.greatest(F.lit(0), F.col("line_no") - half)
    end = F.least(F.size("_lines"), F.col("line_no") + window - half)
    return x.withColumn("start_line_no", start).withColumn("end_line_no", end).withColumn("context", F.array_join(_cut(F.col("_lines"), start, end), "\n")).drop("_lines")


def without_lines(text: Column, first: int, last: int) -> Column:
    """The text without lines first..last (from 1): how a task's solution is taken out of its file."""
    xs = lines(text)
    return F.array_join(F.concat(F.slice(xs, 1, first - 1), F.slice(xs, last + 1, F.greatest(F.size(xs) - last, F.lit(0)))), "\n")


def trailing(text: Column, line_no: Column, context_start: Column, window: int = WINDOW) -> Column:
    """The `window` lines before line_no, not before context_start."""
    return F.array_join(_cut(lines(text), F.greatest(context_start, line_no - window), F.least(F.size(lines(text)), line_no)), "\n")


def centred(text: Column, line_no: Column, context_start: Column, window: int = WINDOW, slices: int = SLICE) -> Column:
    """The lines around line_no, a slice of the window before it."""
    delta = window // slices
    xs = lines(text)
    return F.array_join(_cut(xs, F.greatest(context_start, line_no - delta), F.least(F.size(xs), line_no + window - delta)), "\n")


def prediction(text: Column, predicted: Column, line_no: Column, context_start: Column, window: int = WINDOW, slices: int = SLICE) -> Column:
    """As `centred`, the lines from line_no on being the predicted ones; blank lines go."""
    delta = window // slices
    before = _cut(lines(text), F.greatest(context_start, line_no - delta), line_no)
    new = F.filter(lines(predicted), lambda x: F.trim(x) != "")
    return F.array_join(F.filter(F.concat(before, F.slice(new, 1, window - delta)), lambda x: F.trim(x) != ""), "\n")


def merged(windows: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row for each text of a group, with the places it stands at in first-seen order. The list holds places, not texts."""
    place = F.struct(*order, *[c for c in keep if c not in order])
    out = windows.groupBy(*group, "context").agg(F.array_sort(F.collect_list(place)).alias("places"))
    return out.withColumn("first_seen", F.element_at("places", 1))
