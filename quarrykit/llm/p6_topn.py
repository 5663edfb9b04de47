"""The N highest-scoring items of each of very many groups.

Rows are taken in descending bands of score. Bands are set by quantiles of all scores, so each is about as large as wished
wherever the scores lie. From the top band on, the rows of groups that are already filled are dropped by an anti-join, and only
what still counts is shuffled. Inside a band a group limit runs before the shuffle: a group that holds a third of all rows sends
N rows a task, not its rows. Ties at the boundary are settled exactly by the tie columns.

Defined cases: null and NaN scores don't count; a null group is no group; -0.0 equals 0.0; repeated rows (same group and tie
key) count once; a group with fewer than N items gives what it has; n < 1 gives no rows; an empty table gives no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, read_table

#: Share of the scored rows in the first band, growth of each further band, number of bands; the last takes the rest.
FIRST_BAND, BAND_GROWTH, BANDS = 0.25, 1.2, 3


def band_edges(scored: DataFrame, score: str, bands: int = BANDS, first: float = FIRST_BAND, growth: float = BAND_GROWTH) -> list[float]:
    """Lower score edges of the bands but the last, from the quantiles of all rows."""
    shares, total = [], 0.0
    for i in range(bands - 1):
        total += first * growth**i
        if total < 1:
            shares.append(1 - total)
    got = scored.agg(F.percentile_approx(score, shares, 2000)).first()[0] if shares else None
    return sorted(set(got or []), reverse=True)


def _ranked(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """The first n distinct (score, tie) of each group; dense ranks make repeated rows share a place, and the
    limit on them runs before the shuffle too."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n).dropDuplicates([group, "rank"])


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, bands: int = BANDS) -> DataFrame:
    """(group, tie, score, rank): the n best of each group, rank from 1."""
    s = F.col(score).cast("double")
    scored: DataFrame = df.select(
        F.col(group), F.col(tie), F.when(s == 0, F.lit(0.0)).otherwise(s).alias(score)
    ).where(F.col(group).isNotNull() & F.col(tie).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    if n < 1:
        return scored.withColumn("rank", F.lit(0)).limit(0)
    edges = band_edges(scored, score, bands)
    done: list[DataFrame] = []
    partial: DataFrame | None = None
    filled: DataFrame | None = None
    for i in range(len(edges) + 1):
        keep: list[Column] = []
        if i:
            keep.append(F.col(score) < edges[i - 1])
        if i < len(edges):
            keep.append(F.col(score) >= edges[i])
        band = scored.where(reduce(lambda a, b: a & b, keep)) if keep else scored
        if partial is not None:
            full = partial.where(F.col("rank") == n).select(group)
            filled = full if filled is None else filled.unionByName(full)
            band = band.join(filled, group, "left_anti").unionByName(partial.join(full, group, "left_anti").drop("rank"))
            done.append(partial.join(full, group, "left_semi"))
        ranked = _ranked(band, group, score, tie, n)
        partial = cut_lineage(ranked) if i < len(edges) else ranked
    done.append(partial)
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.col("rank").cast("int"))


def p6_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(read_table(spark, sf_dir, "retrieval_result"), "task_id", "bm25_score", "cand_no", 3).select(
        "task_id", "cand_no", F.col("bm25_score").alias("score"), "rank")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(read_table(spark, sf_dir, "retrieval_result"), "task_id", "bm25_score", "cand_no", 3).select("task_id", "cand_no")


SQL_TOP3 = """
WITH d AS (SELECT DISTINCT task_id, cand_no, CASE WHEN bm25_score = 0 THEN 0.0 ELSE bm25_score END AS score FROM retrieval_result
           WHERE task_id IS NOT NULL AND cand_no IS NOT NULL AND bm25_score IS NOT NULL AND NOT isnan(bm25_score)),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, cand_no) AS rank FROM d)
SELECT task_id, cand_no, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
SQL = {"p6_top3": SQL_TOP3, "p6_found": f"SELECT task_id, cand_no FROM ({SQL_TOP3})"}
