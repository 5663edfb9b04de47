"""Splits, downsampling, picks and packing, ordered by hashes so that every run and every engine draws the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*keys: str, seed: int = 0) -> Column:
    """An order like a shuffle: the md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _placed(df: DataFrame, key: str, seed: int, cuts: Column, facts: DataFrame | None = None) -> DataFrame:
    """The rows with _place, their place from 0 in hash order, exact where it matters: rows are counted under the 12-bit heads of the hash, and ranked
    only inside the heads that hold one of the places `cuts` (of _total, and of the one row of `facts`); elsewhere a head's rows share its first place."""
    h = df.withColumn("_h", hash_order(key, seed=seed)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    heads = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # 4096 rows at most, whatever the table
    heads = heads.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    if facts is not None:
        heads = heads.withColumn("_one", F.lit(1)).join(F.broadcast(facts.withColumn("_one", F.lit(1))), "_one").drop("_one")
    heads = heads.withColumn("_cut", F.exists(cuts, lambda c: (c > F.col("_before")) & (c < F.col("_before") + F.col("_n"))))
    x = h.join(F.broadcast(heads), "_b")
    ranked = x.where("_cut").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    return ranked.unionByName(x.where("not _cut").withColumn("_place", F.col("_before"))).drop("_h", "_b", "_n", "_before", "_cut")


def random_split(df: DataFrame, key: str, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("valid", 0.1), ("test", 0.1)), seed: int = 0) -> DataFrame:
    """Each row's split, sizes floor(total * cumulative share) exactly; boundaries are places in hash order."""
    ends, cum = [], 0.0
    for _, share in shares[:-1]:
        cum += share
        ends.append(F.floor(F.col("_total") * F.lit(round(cum, 10))))
    x = _placed(df, key, seed, F.array(*ends))
    name = F.lit(shares[-1][0])
    for (split, _), end in reversed(list(zip(shares[:-1], ends))):
        name = F.when(F.col("_place") < end, split).otherwise(name)
    return x.withColumn("split", name).drop("_total", "_place")


def downsample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Class 0 cut to the size of class 1 if it is larger; labels other than 0 and 1 drop out."""
    x = df.where(F.col(label).isin(0, 1))
    sizes = x.agg(F.sum((F.col(label) == 1).cast("bigint")).alias("_ones"))
    zero = _placed(x.where(F.col(label) == 0), key, seed, F.array("_ones"), sizes)
    return zero.where(F.col("_place") < F.col("_ones")).drop("_place", "_total", "_ones").unionByName(x.where(F.col(label) == 1))


def pick_one(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """One row of each group, by least hash. A min aggregate, combined before the shuffle."""
    return df.groupBy(group).agg(F.min_by(key, hash_order(key, seed=seed)).alias(key))


def pack(df: DataFrame, tokens: str, key: str, budget: int, packs: int = 1000) -> DataFrame:
    """(key, tokens, pack): rows put together up to a token budget; a row over the budget has a pack of its own.

    Rows are dealt by the hash of their key into buckets of about `packs` packs each, and packed in the order of their hash and key there, so the
    packs are the same however the rows lie in parts. A bucket is small whatever the corpus; repeated keys are packed each."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), F.xxhash64(F.col(key)).alias("h"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // (budget * packs)))
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets))).repartition("b").sortWithinPartitions("b", "h", "k", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, no, used = None, 0, 0
        for pdf in batches:
            out = []
            for b, n in zip(pdf.b, pdf.n):
                if b != bucket:
                    bucket, no, used = b, 0, 0
                elif used and used + n > budget:
                    no, used = no + 1, 0
                used += n
                out.append(f"{b}-{no}")
            yield pd.DataFrame({"k": pdf.k, "tokens": pdf.n, "pack": out})

    return rows.mapInPandas(run, f"k {kind}, tokens bigint, pack string").withColumnRenamed("k", key)
