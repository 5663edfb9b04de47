"""Evaluation metrics: pass@k, recall, agreement, latency, votes, BLEU."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.operators.ordering import medians


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of c right ones among n: 1 - prod_{i=n-c+1..n} (1 - k/i); 1 where fewer than k are wrong, 0 where none is right."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - prod)


def task_totals(results: DataFrame, task: str, passed: Column) -> DataFrame:
    """(task, n, c): runs and passed runs; a null outcome is a failure."""
    return results.groupBy(task).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(F.coalesce(passed, F.lit(False)).cast("int")).cast("int").alias("c"))


def mean_pass_at_k(totals: DataFrame, ks: list[int], need_all: bool) -> DataFrame:
    """(k, pass_at_k): the mean over tasks. need_all: null unless every task has k runs; else over tasks that have k."""
    rows = totals.select("n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    value = F.lit(None).cast("double")
    for k in ks:
        value = F.when(F.col("k") == k, pass_at_k(F.col("n"), F.col("c"), k)).otherwise(value)
    rows = rows.withColumn("v", value)
    enough = F.col("n") >= F.col("k")
    if need_all:
        return rows.groupBy("k").agg(F.when(F.bool_and(enough), F.avg("v")).alias("pass_at_k"))
    return rows.groupBy("k").agg(F.avg(F.when(enough, F.col("v"))).alias("pass_at_k"))


def set_recall(reference: Column, predicted: Column) -> Column:
    """Share of the distinct reference that is predicted; null predictions count as none, an empty reference gives null."""
    ref = F.array_distinct(reference)
    return F.when(F.size(ref) > 0, F.size(F.array_intersect(ref, F.coalesce(predicted, F.array().cast("array<string>")))) / F.size(ref))


def recall_at_k(scored: DataFrame, group: str, order: str, value: str, ks: list[int]) -> DataFrame:
    """(k, recall): the best value among each group's first k, then the mean over groups. One window for all k."""
    w = Window.partitionBy(group).orderBy(order)
    x = scored.withColumn("_r", F.row_number().over(w))
    return x.groupBy(group).agg(*[F.max(F.when(F.col("_r") <= k, F.col(value))).alias(f"k{k}") for k in ks]).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("v")) for k in ks])).alias("x")).groupBy("x.k").agg(F.avg("x.v").alias("recall"))


def latency(df: DataFrame, seconds: Column, *by: str) -> DataFrame:
    """count, mean, min, max and exact median, in seconds and milliseconds; without groups always one row."""
    keys = list(by) or ["_all"]
    v = (df if by else df.withColumn("_all", F.lit(1))).select(*keys, seconds.alias("s")).where("s is not null")
    g = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))
    m = medians(v, keys, "s").withColumnRenamed("median", "median_s")
    g = (g if by else g.withColumn("_all", F.lit(1))).join(m, keys, "left")
    return g.select(*by, "n", *[f"{x}_s" for x in ("mean", "min", "max", "median")], *[(F.col(f"{x}_s") * 1000).alias(f"{x}_ms") for x in ("mean", "min", "max", "median")])


def classification_report(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 of both classes, macro averages; a ratio with nothing under it is 0."""
    x = df.select(label.cast("int").alias("y"), predicted.cast("int").alias("p")).where("y is not null and p is not null")
    cell = lambda y, p: F.sum(((F.col("y") == y) & (F.col("p") == p)).cast("bigint"))
    t = x.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fn), over(tn, tn + fp)
    t = t.select("*", over(tp + tn, tp + tn + fp + fn).alias("accuracy"), p1.alias("precision_1"), r1.alias("recall_1"), p0.alias("precision_0"), r0.alias("recall_0"))
    f = lambda p, r: over(2 * p * r, p + r)
    return t.select("*", f(F.col("precision_1"), F.col("recall_1")).alias("f1_1"), f(F.col("precision_0"), F.col("recall_0")).alias("f1_0"),
                    ((F.col("precision_1") + F.col("precision_0")) / 2).alias("macro_precision"), ((F.col("recall_1") + F.col("recall_0")) / 2).alias("macro_recall"))


def robust_pass(df: DataFrame, transformation: str, task: str, seed: str, passed: Column) -> DataFrame:
    """(transformation, robust, product): the share of tasks that pass under every seed, and the mean over tasks of the product of per-seed means."""
    x = df.select(transformation, task, seed, F.coalesce(passed, F.lit(False)).alias("ok"))
    per_seed = x.groupBy(transformation, task, seed).agg(F.bool_and("ok").alias("all_ok"), F.avg(F.col("ok").cast("double")).alias("m"))
    per_task = per_seed.groupBy(transformation, task).agg(F.bool_and("all_ok").alias("all_ok"), F.product("m").alias("m"))
    return per_task.groupBy(transformation).agg(F.avg(F.col("all_ok").cast("double")).alias("robust"), F.avg("m").alias("product"))


def majority(df: DataFrame, task: str, answer: str, order: str) -> DataFrame:
    """(task, answer, votes): the most frequent answer of each task, of equal ones the first seen; null answers don't vote."""
    votes = df.where(F.col(answer).isNotNull()).groupBy(task, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(task).orderBy(F.col("votes").desc(), F.col("first"), F.col(answer))
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(task, answer, "votes")


def within_tolerance(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Whether two numbers given as text agree; false where one is none."""
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < tolerance, F.lit(False))


def bleu(reference: list[str], hypothesis: list[str], order: int = 4) -> float:
    """Smoothed sentence BLEU of token lists: clipped n-gram counts, add-one smoothing beyond unigrams, brevity min(0, 1 - (r+1)/(h+1)); 0 to 1."""
    total = 0.0
    for n in range(1, order + 1):
        h = Counter(zip(*(hypothesis[i:] for i in range(n))))
        r = Counter(zip(*(reference[i:] for i in range(n))))
        add = n > 1
        hit, all_ = (h & r).total() + add, h.total() + add
        if not hit or not all_:
            return 0.0
        total += math.log(hit / all_)
    return math.exp(total / order + min(0.0, 1 - (len(reference) + 1) / (len(hypothesis) + 1)))


def sentence_bleu(reference: Column, hypothesis: Column) -> Column:
    """BLEU of token arrays in Arrow batches; n-gram counts inside a lambda would cost the square of a text's length."""
    @F.pandas_udf("double")
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([bleu(list(r) if r is not None else [], list(h) if h is not None else []) for r, h in zip(reference, hypothesis)], dtype="float64")

    return run(reference, hypothesis)


def mteval_tokens(text: Column) -> Column:
    """Tokens as the public mteval-v13a normalisation cuts them, in lower case.

    Fixed values: skipped marks go, lines that end in a hyphen are joined, four entities are decoded; marks stand alone, but for points and
    commas between digits and hyphens not behind one."""
    t = F.regexp_replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), "\n", " ")
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    t = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    for pattern, to in ((r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, to)
    return F.filter(F.split(t, r"[ \t\r\f]+"), lambda x: x != "")


def _gram_counts(df: DataFrame, key: list[str], tokens: str, order: int) -> DataFrame:
    """(key, n, gram, c): how often each n-gram of up to `order` tokens stands in each row."""
    grams = F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i + (n - 1) <= F.size(tokens)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(F.col(tokens), i, n), "\u0001").alias("gram"))) for n in range(1, order + 1)]))
    return df.select(*key, F.explode(grams).alias("g")).groupBy(*key, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))


def corpus_bleu(pairs: DataFrame, key: str, reference: str, hypothesis: str, order: int = 4) -> DataFrame:
    """(n, hits, total, bleu): clipped n-gram hits of all rows for each order, and the corpus's BLEU with its brevity penalty; both columns are token
    arrays. n-grams are counted by row before anything is summed; an order without hits makes the BLEU 0."""
    h = _gram_counts(pairs, [key], hypothesis, order).withColumnRenamed("c", "h")
    r = _gram_counts(pairs, [key], reference, order).withColumnRenamed("c", "r")
    by = h.join(r, [key, "n", "gram"], "left").groupBy("n").agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("hits"), F.sum("h").alias("total"))
    orders = pairs.sparkSession.range(1, order + 1).select(F.col("id").cast("int").alias("n"))
    by = orders.join(by, "n", "left").select("n", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0)).alias("total"), F.lit(1).alias("k"))
    size = pairs.agg(F.sum(F.greatest(F.size(reference), F.lit(0))).alias("rl"), F.sum(F.greatest(F.size(hypothesis), F.lit(0))).alias("hl")).withColumn("k", F.lit(1))
    mean = by.groupBy("k").agg(F.min("hits").alias("least"), F.avg(F.log(F.col("hits") / F.col("total"))).alias("mean"))
    brevity = F.when(F.col("hl") < F.col("rl"), F.exp(1 - F.col("rl") / F.col("hl"))).otherwise(1.0)
    score = mean.join(size, "k").select("k", F.when(F.col("least") > 0, brevity * F.exp("mean")).otherwise(0.0).alias("bleu"))
    return by.join(score, "k").select("n", "hits", "total", "bleu")


def functional_accuracy(runs: DataFrame, task: str, passed: Column) -> DataFrame:
    """(tasks, accuracy): the mean over tasks of the share of their runs that passed; a run without a result did not pass."""
    per = runs.groupBy(task).agg(F.avg(F.coalesce(passed.cast("double"), F.lit(0.0))).alias("a"))
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.avg("a").alias("accuracy"))


def polyglot_pass_at_k(runs: DataFrame, problem: str, status: str, exit_code: str, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """(k, pass_at_k, problems) of runs in any language: one passed if its status is OK and its exit code 0; each k counts the problems with that many runs."""
    totals = task_totals(runs.withColumn("_ok", (F.col(status) == "OK") & (F.col(exit_code) == 0)), problem, F.col("_ok"))
    return mean_pass_at_k(totals, list(ks), False)
