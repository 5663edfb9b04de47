"""Ranking of candidates: BM25, vectors, thresholds, hybrids, and the scope of what is ranked.

Every ranking carries an ordinal, so ties have one order. BM25 joins on terms inside a task, never tasks with all candidates;
counts are pre-aggregated before each shuffle. Nearest vectors use a stated query block against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import tokens
from quarrykit.functions.vectors import softmax_positive
from quarrykit.operators.skew import lookup
from quarrykit.runtime import cut_lineage, spread, widened

#: Okapi constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: The lines around the blocks of a structured prompt.
PROMPT_HEADER = "You are a Python programmer working with a repository. Here is all the context you may find useful to complete the function:"
PROMPT_FOOTER = "Based on the information above, please complete the function in the current file:"
#: Rows of one query block; bounds what is broadcast to QUERY_BLOCK vectors.
QUERY_BLOCK = 4096


def term_counts(docs: DataFrame, task: str, doc: str, text: str) -> DataFrame:
    """(task, doc, dl, term, tf): counts of every term, with the document's length; documents without terms give no row."""
    split = docs.select(task, doc, tokens(F.col(text)).alias("_ts")).select(task, doc, F.size("_ts").alias("dl"), F.explode("_ts").alias("term"))
    return split.groupBy(task, doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_table(tf: DataFrame, sizes: DataFrame, task: str) -> DataFrame:
    """(task, term, idf): ln(N - n + 1/2) - ln(n + 1/2), a negative one becoming EPSILON times the task's mean idf.

    sizes: (task, n_docs, avgdl). The mean is a second aggregate over the task's vocabulary, not a cross join. Occurrences are summed
    and asked for, which keeps the plan of `tf` the same here and where it is scored, so that its shuffle is reused."""
    df = tf.groupBy(task, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("longest")).where("cf > 0 and longest > 0").drop("cf", "longest")
    raw = df.join(sizes, task).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(task).agg(F.avg("raw").alias("mean_idf"))
    return raw.join(mean, task).select(task, "term", "df", "raw", "mean_idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def corpus_sizes(docs: DataFrame, task: str, text: str) -> DataFrame:
    """(task, n_docs, avgdl), documents without terms included."""
    return docs.groupBy(task).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce(F.size(tokens(F.col(text))), F.lit(0))).alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, task: str, doc: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(task, doc, score) of every candidate of every task; one without a query term scores 0.

    A query term counts as often as the query has it. Terms meet by equi-join on (task, term)."""
    tf = term_counts(docs, task, doc, text)
    sizes = corpus_sizes(docs, task, text)
    idf = idf_table(tf, sizes, task)
    q = queries.select(task, F.explode(tokens(F.col(query))).alias("term")).groupBy(task, "term").agg(F.count(F.lit(1)).alias("qn"))
    weight = q.join(idf.select(task, "term", "idf"), [task, "term"]).join(sizes.select(task, "avgdl"), task).select(task, "term", (F.col("qn") * F.col("idf")).alias("w"), "avgdl")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    got = tf.join(weight, [task, "term"]).groupBy(task, doc).agg(F.sum(part).alias("score"))
    return docs.select(task, doc).join(queries.select(task).dropDuplicates(), task, "left_semi").join(got, [task, doc], "left").select(task, doc, F.coalesce("score", F.lit(0.0)).alias("score"))


def component_terms(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, terms): each text's length in terms and its distinct terms with their counts, as hashes; a text without terms has an empty list.

    Each text is cut into terms once, however many tasks it is a candidate of. `bodies` has each key once."""
    split = spread(bodies.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_ts")))
    counts = split.select(key, F.explode("_ts").alias("t")).groupBy(key, F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).cast("int").alias("tf"))
    terms = counts.groupBy(key).agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("terms"))
    none = F.array().cast("array<struct<term:bigint,tf:int>>")
    return bodies.select(key).join(terms, key, "left").select(key, F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("terms", none).alias("terms"))


def bm25_shared(cands: DataFrame, bodies: DataFrame, queries: DataFrame, task: str, doc: str, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(task, doc, score) as of `bm25`, where the text of a candidate is that of `bodies` with its key.

    Candidates carry counts of hashed terms, never texts. For idf the candidates' terms are counted by task, before the shuffle. The
    query's weights then come to the candidates as one map a task - of the query's own terms - and scores are summed inside the row. Tasks and components
    that very many rows name meet by broadcast."""
    terms = component_terms(bodies, key, text)
    q = queries.select(task, F.explode(tokens(F.col(query))).alias("_t")).groupBy(task, F.xxhash64("_t").alias("term")).agg(F.count(F.lit(1)).alias("qn"))
    docs = widened(cut_lineage(lookup(cands.select(task, doc, key), terms, [key]).select(task, doc, "dl", "terms")))
    sizes = docs.groupBy(task).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = docs.select(task, F.explode("terms.term").alias("term")).groupBy(task, "term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(sizes, task).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).join(q, [task, "term"], "left")
    # of a task's vocabulary only the query's terms are kept; the mean idf is over all of it
    kept = raw.groupBy(task).agg(F.avg("raw").alias("mean"), F.collect_list(F.when(F.col("qn").isNotNull(), F.struct("term", "raw", "qn"))).alias("w"))
    weight = F.map_from_entries(F.transform("w", lambda x: F.struct(x["term"], x["qn"] * F.when(x["raw"] < 0, EPSILON * F.col("mean")).otherwise(x["raw"]))))
    asked = sizes.join(queries.select(task).dropDuplicates([task]), task, "left_semi").join(kept.select(task, weight.alias("weights")), task, "left")
    met = lookup(docs, asked, [task])
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    hits = F.filter("terms", lambda t: F.map_contains_key(F.col("weights"), t["term"]))
    score = F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + F.element_at(F.col("weights"), t["term"]) * t["tf"] * (k1 + 1) / (t["tf"] + norm))
    return met.select(task, doc, F.coalesce(score, F.lit(0.0)).alias("score"))


def top_k(scored: DataFrame, task: str, score: str | Column, k: int, *order: str) -> DataFrame:
    """The k best of each task with their rank from 1; a null or NaN score counts as 0, ties go by the ordinals given."""
    s = F.col(score) if isinstance(score, str) else score
    w = Window.partitionBy(task).orderBy(F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0)).desc(), *[F.col(o).asc() for o in order])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, cosine, rank): the k nearest rows of every query row, itself left out.

    Queries are dealt in blocks of QUERY_BLOCK, which bounds the broadcast. Each task multiplies its Arrow batches with
    the block and keeps k rows a query before anything is shuffled."""
    spark = vectors.sparkSession
    parts = []
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["q"]).orderBy("q")

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    def scan(ids: np.ndarray, block: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, block = shared.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                sims = np.round(block @ unit(np.stack(pdf.v.to_numpy()).astype(float)).T, 12)
                keys = pdf.k.to_numpy()
                take = min(len(keys), k + 1)
                order = np.lexsort((np.broadcast_to(keys, sims.shape), -sims), axis=1)[:, :take]
                got = pd.DataFrame({"query": np.repeat(ids, take), "key": keys[order].ravel(), "cosine": np.take_along_axis(sims, order, 1).ravel()})
                best = got if best is None else pd.concat([best, got])
                best = best[best["query"] != best["key"]]
                best = best.sort_values(["query", "cosine", "key"], ascending=[True, False, True]).groupby("query").head(k)
            if best is not None:
                yield best

        cand = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))
        return cand.mapInPandas(run, "query bigint, key bigint, cosine double")

    block: list = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            parts.append(scan(np.array([x["q"] for x in block]), unit(np.array([x["v"] for x in block], float))))
            block = []
    if block:
        parts.append(scan(np.array([x["q"] for x in block]), unit(np.array([x["v"] for x in block], float))))
    if not parts:
        return spark.createDataFrame([], "query bigint, key bigint, cosine double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out.dropDuplicates(["query", "key"]), "query", "cosine", k, "key")


def over_threshold(scored: DataFrame, z0: Column, z1: Column, least: float = 0.25) -> DataFrame:
    """Rows whose class-1 probability is at least `least`, with it as `probability`."""
    return scored.withColumn("probability", softmax_positive(z0, z1)).where(F.col("probability") >= least)


def hybrid(bm25_hits: DataFrame, classified: DataFrame, key: list[str], task: str) -> DataFrame:
    """BM25 hits and classifier hits as one list: where both have a candidate the classifier's score replaces BM25's and the place stays,
    further classifier hits follow in their order. Inputs have the key, score and rank."""
    a = bm25_hits.select(*key, F.col("score").alias("bm25_score"), F.col("rank").alias("a_rank"))
    b = classified.select(*key, F.col("score").alias("class_score"), F.col("rank").alias("b_rank"))
    both = a.join(b, key, "full_outer")
    place = F.coalesce(F.col("a_rank").cast("bigint"), F.lit(1_000_000_000) + F.col("b_rank"))
    w = Window.partitionBy(task).orderBy(place)
    return both.select(*key, F.coalesce("class_score", "bm25_score").alias("score"), F.when(F.col("class_score").isNotNull(), "classifier").otherwise("bm25").alias("source"), F.row_number().over(w).alias("place"))


def in_scope(windows: DataFrame, key: str, metadata: str, targets: DataFrame, imports: DataFrame | None) -> DataFrame:
    """Windows (key, repo, ..) with a place outside the target file of their repository, and inside its imported files unless `imports` is None; the other places
    are pruned. `targets`: repo, target; `imports`: repo, path, each once. Places meet files by join, whatever number of files a repository has."""
    places = windows.select(key, "repo", F.posexplode(metadata).alias("_i", "_m")).withColumn("path", F.array_join("_m.fpath_tuple", "/"))
    kept = lookup(places, targets.select("repo", "target"), ["repo"]).where(F.col("path") != F.col("target"))
    if imports is not None:
        kept = lookup(cut_lineage(kept), imports.select("repo", "path"), ["repo", "path"], "left_semi")
    lists = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias("_kept"))
    return windows.join(lists, key).withColumn(metadata, F.col("_kept")).drop("_kept")


def with_current_file(scoped: DataFrame, current: DataFrame, target: str, metadata: str) -> DataFrame:
    """The scoped windows and those of the current file, whose places become the target path alone; the latter come last."""
    cur = current.withColumn(metadata, F.array(F.struct(F.split(F.col(target), "/").alias("fpath_tuple")))).withColumn("is_current", F.lit(1))
    base = scoped.withColumn(metadata, F.transform(metadata, lambda m: F.struct(m["fpath_tuple"].alias("fpath_tuple")))).withColumn("is_current", F.lit(0))
    return base.unionByName(cur)


def structured_prompts(tasks: DataFrame, hits: DataFrame, header: str = PROMPT_HEADER, footer: str = PROMPT_FOOTER) -> DataFrame:
    """(task_id, prompt): a block for each file in the order of its best hit, classes before variables before functions, each text followed by an empty
    line; the target's own file comes last, with its import statements ahead, and only if it has hits; then the footer and the task.

    `tasks`: task_id, own_path, prompt, imports; `hits`: task_id, cand_type, relative_path, source_code, rank. Candidates of other types are left out.
    The lists hold one task's hits."""
    kind = F.array_position(F.array(F.lit("class"), F.lit("variable"), F.lit("function")), F.col("cand_type"))
    own = tasks.select("task_id", "own_path", "imports").dropDuplicates(["task_id"])
    x = hits.join(own, "task_id").withColumn("k", kind).where("k > 0").withColumn("current", F.coalesce(F.col("relative_path") == F.col("own_path"), F.lit(False)))
    texts = F.array_sort(F.collect_list(F.struct("k", "rank", F.coalesce("source_code", F.lit("")).alias("s"))))
    per = x.groupBy("task_id", "current", F.coalesce("relative_path", F.lit("")).alias("relative_path")).agg(F.min("rank").alias("first"), F.first("imports").alias("imports"), texts.alias("xs"))
    bodies = F.flatten(F.transform("xs", lambda e: F.array(e["s"], F.lit(""))))
    said = F.when(F.col("current") & (F.size("imports") > 0), F.concat("imports", F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.when(F.col("current"), "#CURRENT FILE: ").otherwise("#FILE: "), F.col("relative_path"))
    block = F.array_join(F.concat(F.array(head), said, bodies), "\n")
    blocks = per.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("current", "first", "relative_path", block.alias("b")))), lambda e: e["b"]), "\n").alias("blocks"))
    return tasks.select("task_id", "prompt").dropDuplicates(["task_id"]).join(blocks, "task_id", "left").select("task_id", F.concat_ws("\n", F.lit(header), "blocks", F.lit(footer), "prompt").alias("prompt"))
