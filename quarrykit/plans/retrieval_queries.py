"""Queries on ranking, windows and prompts, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import lines
from quarrykit.operators import retrieval as R
from quarrykit.operators import windows as W
from quarrykit.runtime import cut_lineage, read_table, spread

#: SQL of the shared table expressions.
COMPONENT_ONCE = "comp AS (SELECT id, arg_min(source_code, comp_no) AS source_code, arg_min(repo, comp_no) AS repo FROM component WHERE id IS NOT NULL GROUP BY id)"
CAND = f"""{COMPONENT_ONCE},
cand AS (SELECT DISTINCT r.task_id, r.cand_no, r.cand_id FROM retrieval_result r WHERE r.task_id IN (SELECT task_id FROM generation WHERE prompt IS NOT NULL)),
docs AS (SELECT c.task_id, c.cand_no, coalesce(p.source_code, '') AS text FROM cand c JOIN comp p ON c.cand_id = p.id),
q AS (SELECT DISTINCT task_id, prompt FROM generation WHERE prompt IS NOT NULL)"""
TOK = "list_filter(string_split_regex({}, '[ \\t\\n\\f\\r]+'), lambda t: t <> '')"
BM25 = f"""{CAND},
toks AS (SELECT task_id, cand_no, {TOK.format('text')} AS ts FROM docs),
tf AS (SELECT task_id, cand_no, term, count(*) AS tf FROM (SELECT task_id, cand_no, unnest(ts) AS term FROM toks) GROUP BY ALL),
len AS (SELECT task_id, cand_no, len(ts) AS dl FROM toks),
sizes AS (SELECT task_id, count(*) AS n_docs, avg(dl) AS avgdl FROM len GROUP BY task_id),
dfs AS (SELECT task_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT d.task_id, d.term, ln(s.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS raw FROM dfs d JOIN sizes s USING (task_id)),
idf AS (SELECT r.task_id, r.term, CASE WHEN r.raw < 0 THEN 0.25 * m.m ELSE r.raw END AS idf FROM raw r JOIN (SELECT task_id, avg(raw) AS m FROM raw GROUP BY task_id) m USING (task_id)),
qt AS (SELECT task_id, term, count(*) AS qn FROM (SELECT task_id, unnest({TOK.format('prompt')}) AS term FROM q) GROUP BY ALL),
hit AS (SELECT tf.task_id, tf.cand_no, sum(qt.qn * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len.dl / sizes.avgdl))) AS score
  FROM tf JOIN qt USING (task_id, term) JOIN idf USING (task_id, term) JOIN len USING (task_id, cand_no) JOIN sizes USING (task_id) GROUP BY ALL),
scored AS (SELECT len.task_id, len.cand_no, round(coalesce(hit.score, 0), 6) AS score FROM len LEFT JOIN hit USING (task_id, cand_no))"""


def _component_once(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "component").where("id is not null").groupBy("id").agg(F.min_by("source_code", "comp_no").alias("source_code"), F.min_by("repo", "comp_no").alias("repo"))


def _task_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = read_table(spark, sf, "generation").where("prompt is not null").select("task_id", "prompt").dropDuplicates(["task_id"])
    cand = read_table(spark, sf, "retrieval_result").select("task_id", "cand_no", "cand_id").dropDuplicates(["task_id", "cand_no"]).join(q.select("task_id"), "task_id", "left_semi")
    docs = cand.join(_component_once(spark, sf).withColumnRenamed("id", "cand_id"), "cand_id").select("task_id", "cand_no", F.coalesce("source_code", F.lit("")).alias("text"))
    return docs, q


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of each candidate; components are cut into terms once, whatever number of tasks they are candidates of."""
    q = read_table(spark, sf, "generation").where("prompt is not null").select("task_id", "prompt").dropDuplicates(["task_id"])
    cand = read_table(spark, sf, "retrieval_result").select("task_id", "cand_no", "cand_id").dropDuplicates(["task_id", "cand_no"]).join(q.select("task_id"), "task_id", "left_semi")
    bodies = _component_once(spark, sf).withColumnRenamed("id", "cand_id")
    return R.bm25_shared(cand, bodies, q, "task_id", "cand_no", "cand_id", "source_code", "prompt").withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best candidates of each task by BM25 of its prompt over the task's candidates."""
    return R.top_k(_scored(spark, sf), "task_id", "score", 10, "cand_no").select("task_id", "cand_no", "score", "rank")


def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary, mean length and idf of each repository's functions as a BM25 corpus."""
    c = read_table(spark, sf, "component").where("source_code is not null").select("repo", "comp_no", "source_code").dropDuplicates(["comp_no"])
    tf = R.term_counts(c, "repo", "comp_no", "source_code")
    sizes = R.corpus_sizes(c, "repo", "source_code")
    idf = R.idf_table(tf, sizes, "repo").groupBy("repo").agg(
        F.count(F.lit(1)).alias("vocabulary"), F.round(F.avg("raw"), 6).alias("mean_idf"), F.round(F.min("idf"), 6).alias("least_idf"), F.sum((F.col("raw") < 0).cast("bigint")).alias("negative"))
    return sizes.join(idf, "repo").select("repo", "n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary", "mean_idf", "least_idf", "negative")


def bm25_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each task grouped by candidate file, files in the order of their best hit."""
    hits = R.top_k(_scored(spark, sf), "task_id", "score", 10, "cand_no")
    path = read_table(spark, sf, "retrieval_result").select("task_id", "cand_no", "file_path").dropDuplicates(["task_id", "cand_no"])
    g = hits.join(path, ["task_id", "cand_no"]).groupBy("task_id", "file_path").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("hits"), F.round(F.max("score"), 6).alias("best"))
    w = Window.partitionBy("task_id").orderBy("first_rank")
    return g.withColumn("file_no", F.row_number().over(w))


def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose class-1 probability of two logits reaches a quarter."""
    r = read_table(spark, sf, "retrieval_result").select("cand_no", "task_id", "bm25_score").dropDuplicates(["cand_no"]).where("bm25_score is not null and not isnan(bm25_score)")
    x = R.over_threshold(r, F.lit(2.0), F.col("bm25_score") / 10)
    return x.select("cand_no", "task_id", F.round("probability", 6).alias("probability"))


def _class_hits(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "retrieval_result").select("task_id", "cand_no", "bm25_score").dropDuplicates(["task_id", "cand_no"]).where("bm25_score is not null and not isnan(bm25_score)")
    r = r.join(read_table(spark, sf, "generation").where("prompt is not null").select("task_id").dropDuplicates(), "task_id", "left_semi")
    x = R.over_threshold(r, F.lit(3.0), F.col("bm25_score") / 10).withColumn("score", F.round("probability", 6))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("cand_no")))


def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The five best by BM25 and all by the classifier, as one list."""
    top = R.top_k(_scored(spark, sf), "task_id", "score", 5, "cand_no").select("task_id", "cand_no", "score", "rank")
    return R.hybrid(top, _class_hits(spark, sf).select("task_id", "cand_no", "score", "rank"), ["task_id", "cand_no"], "task_id")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50, against all."""
    v = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    got = R.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return got.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


def line_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's windows of 20 lines at steps of 10."""
    f = read_table(spark, sf, "source_file").select("file_no", "repo", "relative_path", "code").where("code is not null").dropDuplicates(["file_no"])
    return W.sliding(f, "code").select("file_no", "line_no", "start_line_no", "end_line_no", F.md5("context").alias("context_md5"))


def current_file_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of each file without its lines 1 to 5, as if they were the solution."""
    f = read_table(spark, sf, "source_file").select("file_no", "code").where("code is not null").dropDuplicates(["file_no"])
    f = f.select("file_no", W.without_lines(F.col("code"), 1, 5).alias("code"))
    return W.sliding(f, "code").select("file_no", "line_no", "start_line_no", "end_line_no", F.md5("context").alias("context_md5"))


def merged_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of equal text in one repository as one, with the number of places and the first."""
    f = read_table(spark, sf, "source_file").select("file_no", "repo", "code").where("code is not null and repo is not null").dropDuplicates(["file_no"])
    m = W.merged(W.sliding(f, "code"), ["repo"], ["file_no", "line_no"], ["start_line_no", "end_line_no"])
    return m.select("repo", F.md5("context").alias("context_md5"), F.size("places").cast("bigint").alias("places"), F.col("first_seen.file_no").alias("file_no"), F.col("first_seen.line_no").alias("line_no"))


def trailing_and_centred_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Around line 25 of each file: the 20 lines before, and the window that reaches 10 lines back; the context begins at line 3."""
    f = read_table(spark, sf, "source_file").select("file_no", "code").where("code is not null").dropDuplicates(["file_no"])
    at, start = F.lit(25), F.lit(3)
    return f.select("file_no", F.md5(W.trailing(F.col("code"), at, start)).alias("trailing_md5"), F.md5(W.centred(F.col("code"), at, start)).alias("centred_md5"))


def prediction_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Each prompt's last ten lines and the first answer's lines, blank ones left out."""
    g = read_table(spark, sf, "generation").where("prompt is not null and size(response) > 0").dropDuplicates(["task_id"])
    n = F.size(lines(F.col("prompt")))
    w = W.prediction(F.col("prompt"), F.coalesce(F.col("response")[0], F.lit("")), n, F.lit(0))
    return g.select("task_id", F.md5(w).alias("window_md5"))


def _scope(spark: SparkSession, sf: str, whole: bool) -> DataFrame:
    w = read_table(spark, sf, "code_window").where("context is not null").dropDuplicates(["window_no"]).withColumn("repo", F.col("metadata")[0]["repo"])
    files = read_table(spark, sf, "source_file").where("repo is not null and relative_path is not null").select("repo", F.col("relative_path").alias("path"))
    targets = files.groupBy("repo").agg(F.min("path").alias("target"))
    imports = files.where(F.col("path").startswith("src/")).dropDuplicates(["repo", "path"])
    return R.in_scope(w, "window_no", "metadata", targets, None if whole else imports)


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with a place in an imported file (those under src/) other than the target file (the first of the repository)."""
    return _scope(spark, sf, False).select("window_no", "repo", F.size("metadata").cast("bigint").alias("places"))


def scope_whole_repo(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with a place outside the target file, whatever is imported."""
    return _scope(spark, sf, True).select("window_no", "repo", F.size("metadata").cast("bigint").alias("places"))


def _anchor(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "source_file").where("repo is not null and code is not null").groupBy("repo").agg(F.min_by(F.struct("relative_path", "code"), "file_no").alias("f")).select(
        "repo", F.col("f.relative_path").alias("target"), F.array_join(F.slice(lines(F.col("f.code")), 1, 20), "\n").alias("query"))


def window_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best windows of each repository for the first 20 lines of its first file, out of that file's scope."""
    a = cut_lineage(_anchor(spark, sf))
    w = read_table(spark, sf, "code_window").where("context is not null").dropDuplicates(["window_no"]).withColumn("repo", F.col("metadata")[0]["repo"])
    w = R.in_scope(w, "window_no", "metadata", a.select("repo", "target"), None).select("repo", "window_no", "context")
    s = R.bm25(cut_lineage(spread(w)), a, "repo", "window_no", "context", "query").withColumn("score", F.round("score", 6))
    return R.top_k(s, "repo", "score", 10, "window_no").select("repo", "window_no", "score", "rank")


def prompt_structured(spark: SparkSession, sf: str) -> DataFrame:
    """Structured prompts as digests: blocks of the files of a task's ten hits, the last file by name standing for the target's own, with the
    import lines of its first source file ahead. Lists hold the hits of a task."""
    hits = R.top_k(_scored(spark, sf), "task_id", "score", 10, "cand_no").select("task_id", "cand_no", "rank")
    r = read_table(spark, sf, "retrieval_result").select("task_id", "cand_no", "cand_id", "cand_type", F.col("file_path").alias("relative_path")).dropDuplicates(["task_id", "cand_no"])
    comp = _component_once(spark, sf).select(F.col("id").alias("cand_id"), "source_code")
    x = cut_lineage(hits.join(r, ["task_id", "cand_no"]).join(comp, "cand_id"))
    files = read_table(spark, sf, "source_file").where("code is not null and relative_path is not null").groupBy(F.col("relative_path").alias("own_path")).agg(F.min_by("code", "file_no").alias("code"))
    own = x.groupBy("task_id").agg(F.max("relative_path").alias("own_path")).join(files, "own_path", "left")
    q = read_table(spark, sf, "generation").where("prompt is not null").select("task_id", "prompt").dropDuplicates(["task_id"])
    tasks = q.join(own.select("task_id", "own_path", F.regexp_extract_all("code", F.lit(r"(^|\n)((?:import|from) [^\r\n]*)"), F.lit(2)).alias("imports")), "task_id")
    return R.structured_prompts(tasks, x).select("task_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("chars"))


def first_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first five candidates of each task by number: a head of each group."""
    r = read_table(spark, sf, "retrieval_result").where("task_id is not null").select("task_id", "cand_no").dropDuplicates()
    return R.top_k(r.withColumn("s", -F.col("cand_no").cast("double")), "task_id", "s", 5, "cand_no").select("task_id", "cand_no", "rank")


def prompt_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of numbered chunks for each repository's first file, as digests."""
    top = window_bm25_topk(spark, sf).select("repo", "window_no", "rank")
    w = read_table(spark, sf, "code_window").where("context is not null").dropDuplicates(["window_no"]).select("window_no", "context")
    x = top.join(w, "window_no").groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("rank", "context"))).alias("cs"))
    body = F.array_join(F.transform("cs", lambda e: F.concat(F.lit("##CHUNK "), e["rank"].cast("string"), F.lit("\n"), e["context"])), "\n")
    text = F.concat(body, F.lit("\n#CURRENT FILE: "), "target", F.lit("\n"), "query")
    return x.join(_anchor(spark, sf), "repo").select("repo", F.md5(text).alias("prompt_md5"))


LINES = "CASE WHEN {0} = '' THEN [] WHEN ends_with(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) THEN string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10))[:-2] ELSE string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) END"
FILES = f"f AS (SELECT DISTINCT file_no, repo, relative_path, {LINES.format('code')} AS ls FROM source_file WHERE code IS NOT NULL)"


def _windows_sql(src: str) -> str:
    return f"w AS (SELECT *, greatest(0, line_no - 10) AS start_line_no, least(len(ls), line_no + 10) AS end_line_no FROM (SELECT *, unnest(range(0, len(ls), 10)) AS line_no FROM {src}))"


TOP = "SELECT {0}, {1}, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY score DESC, {1}) AS rank FROM {2}) WHERE rank <= {3}"
SCOPE = """w AS (SELECT DISTINCT window_no, context, metadata, metadata[1].repo AS repo FROM code_window WHERE context IS NOT NULL),
p AS (SELECT repo, min(relative_path) AS target, list(DISTINCT relative_path) FILTER (starts_with(relative_path, 'src/')) AS imports FROM source_file WHERE repo IS NOT NULL AND relative_path IS NOT NULL GROUP BY repo)"""
ANCHOR = f"""a AS (SELECT repo, arg_min(relative_path, file_no) AS target, array_to_string(({LINES.format('arg_min(code, file_no)')})[1:20], chr(10)) AS query FROM source_file WHERE repo IS NOT NULL AND code IS NOT NULL GROUP BY repo)"""
WBM = f"""{ANCHOR},
cw AS (SELECT DISTINCT window_no, context, metadata, metadata[1].repo AS repo FROM code_window WHERE context IS NOT NULL),
docs AS (SELECT cw.repo, cw.window_no, cw.context AS text FROM cw JOIN a USING (repo) WHERE len(list_filter(cw.metadata, lambda m: array_to_string(m.fpath_tuple, '/') <> a.target)) > 0),
toks AS (SELECT repo, window_no, {TOK.format('text')} AS ts FROM docs),
tf AS (SELECT repo, window_no, term, count(*) AS tf FROM (SELECT repo, window_no, unnest(ts) AS term FROM toks) GROUP BY ALL),
len AS (SELECT repo, window_no, len(ts) AS dl FROM toks),
sizes AS (SELECT repo, count(*) AS n_docs, avg(dl) AS avgdl FROM len GROUP BY repo),
raw AS (SELECT d.repo, d.term, ln(s.n_docs - d.df + 0.5) - ln(d.df + 0.5) AS raw FROM (SELECT repo, term, count(*) AS df FROM tf GROUP BY ALL) d JOIN sizes s USING (repo)),
idf AS (SELECT r.repo, r.term, CASE WHEN r.raw < 0 THEN 0.25 * m.m ELSE r.raw END AS idf FROM raw r JOIN (SELECT repo, avg(raw) AS m FROM raw GROUP BY repo) m USING (repo)),
qt AS (SELECT repo, term, count(*) AS qn FROM (SELECT repo, unnest({TOK.format('query')}) AS term FROM a) GROUP BY ALL),
hit AS (SELECT tf.repo, tf.window_no, sum(qt.qn * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len.dl / sizes.avgdl))) AS score
  FROM tf JOIN qt USING (repo, term) JOIN idf USING (repo, term) JOIN len USING (repo, window_no) JOIN sizes USING (repo) GROUP BY ALL),
scored AS (SELECT len.repo, len.window_no, round(coalesce(hit.score, 0), 6) AS score FROM len LEFT JOIN hit USING (repo, window_no)),
top AS ({TOP.format('repo', 'window_no', 'scored', 10)})"""

SQL = {
    "bm25_topk": f"WITH {BM25} {TOP.format('task_id', 'cand_no', 'scored', 10)}",
    "bm25_stats": f"""WITH c AS (SELECT DISTINCT repo, comp_no, {TOK.format('source_code')} AS ts FROM component WHERE source_code IS NOT NULL AND repo IS NOT NULL),
sizes AS (SELECT repo, count(*) AS n_docs, avg(len(ts)) AS avgdl FROM c GROUP BY repo),
df AS (SELECT repo, term, count(DISTINCT comp_no) AS df FROM (SELECT repo, comp_no, unnest(ts) AS term FROM c) GROUP BY ALL),
raw AS (SELECT d.repo, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df d JOIN sizes USING (repo)),
m AS (SELECT repo, avg(raw) AS m FROM raw GROUP BY repo)
SELECT s.repo, s.n_docs, round(s.avgdl, 6) AS avgdl, count(*) AS vocabulary, round(any_value(m.m), 6) AS mean_idf, round(min(CASE WHEN raw < 0 THEN 0.25 * m.m ELSE raw END), 6) AS least_idf, count(*) FILTER (raw < 0) AS negative
FROM raw JOIN m USING (repo) JOIN sizes s USING (repo) GROUP BY s.repo, s.n_docs, s.avgdl""",
    "bm25_of_groups": f"""WITH {BM25}, top AS ({TOP.format('task_id', 'cand_no', 'scored', 10)}),
g AS (SELECT t.task_id, r.file_path, min(rank) AS first_rank, count(*) AS hits, max(score) AS best FROM top t JOIN (SELECT DISTINCT task_id, cand_no, file_path FROM retrieval_result) r USING (task_id, cand_no) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY first_rank) AS INTEGER) AS file_no FROM g""",
    "score_threshold": "SELECT * FROM (SELECT DISTINCT cand_no, task_id, round(1 / (1 + exp(2.0 - bm25_score / 10)), 6) AS probability, 1 / (1 + exp(2.0 - bm25_score / 10)) >= 0.25 AS ok FROM retrieval_result WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score)) WHERE ok".replace("SELECT * FROM", "SELECT cand_no, task_id, probability FROM", 1),
    "hybrid_merge": f"""WITH {BM25}, top AS ({TOP.format('task_id', 'cand_no', 'scored', 5)}),
r AS (SELECT DISTINCT task_id, cand_no, round(1 / (1 + exp(3.0 - bm25_score / 10)), 6) AS score, 1 / (1 + exp(3.0 - bm25_score / 10)) AS p FROM retrieval_result WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score) AND task_id IN (SELECT task_id FROM q)),
c AS (SELECT task_id, cand_no, score, row_number() OVER (PARTITION BY task_id ORDER BY cand_no) AS rank FROM r WHERE p >= 0.25),
b AS (SELECT task_id, cand_no, coalesce(c.score, top.score) AS score, CASE WHEN c.score IS NOT NULL THEN 'classifier' ELSE 'bm25' END AS source, coalesce(top.rank, 1000000000 + c.rank) AS p FROM top FULL JOIN c USING (task_id, cand_no))
SELECT task_id, cand_no, score, source, CAST(row_number() OVER (PARTITION BY task_id ORDER BY p) AS INTEGER) AS place FROM b""",
    "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "line_windows": f"WITH {FILES}, {_windows_sql('f')} SELECT file_no, line_no, start_line_no, end_line_no, md5(array_to_string(ls[start_line_no + 1 : end_line_no], chr(10))) AS context_md5 FROM w",
    "current_file_windows": f"WITH {FILES}, f2 AS (SELECT file_no, array_to_string(ls[6:], chr(10)) AS code FROM f), f3 AS (SELECT file_no, {LINES.format('code')} AS ls FROM f2), {_windows_sql('f3')} SELECT file_no, line_no, start_line_no, end_line_no, md5(array_to_string(ls[start_line_no + 1 : end_line_no], chr(10))) AS context_md5 FROM w",
    "merged_windows": f"""WITH {FILES}, {_windows_sql('f')}, c AS (SELECT repo, file_no, line_no, array_to_string(ls[start_line_no + 1 : end_line_no], chr(10)) AS context FROM w WHERE repo IS NOT NULL)
SELECT repo, md5(context) AS context_md5, count(*) AS places, min((file_no, line_no))[1] AS file_no, min((file_no, line_no))[2] AS line_no FROM c GROUP BY repo, context""",
    "trailing_and_centred_windows": f"WITH {FILES} SELECT file_no, md5(array_to_string(ls[6 : least(len(ls), 25)], chr(10))) AS trailing_md5, md5(array_to_string(ls[16 : least(len(ls), 35)], chr(10))) AS centred_md5 FROM f",
    "scope_filter": f"WITH {SCOPE} SELECT window_no, repo, len(l) AS places FROM (SELECT window_no, repo, list_filter(metadata, lambda m: array_to_string(m.fpath_tuple, '/') <> target AND list_contains(imports, array_to_string(m.fpath_tuple, '/'))) AS l FROM w JOIN p USING (repo)) WHERE len(l) > 0",
    "scope_whole_repo": f"WITH {SCOPE} SELECT window_no, repo, len(l) AS places FROM (SELECT window_no, repo, list_filter(metadata, lambda m: array_to_string(m.fpath_tuple, '/') <> target) AS l FROM w JOIN p USING (repo)) WHERE len(l) > 0",
    "window_bm25_topk": f"WITH {WBM} SELECT * FROM top",
    "prompt_structured": f"""WITH {BM25}, top AS ({TOP.format('task_id', 'cand_no', 'scored', 10)}),
x AS (SELECT t.task_id, t.rank, r.file_path, list_position(['class', 'variable', 'function'], r.cand_type) AS k, coalesce(comp.source_code, '') AS s FROM top t JOIN (SELECT DISTINCT task_id, cand_no, cand_id, cand_type, file_path FROM retrieval_result) r USING (task_id, cand_no) JOIN comp ON comp.id = r.cand_id),
sf AS (SELECT relative_path, regexp_extract_all(arg_min(code, file_no), '(^|\n)((?:import|from) [^\r\n]*)', 2) AS imports FROM source_file WHERE code IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1),
own AS (SELECT o.task_id, o.own_path, sf.imports FROM (SELECT task_id, max(file_path) AS own_path FROM x GROUP BY 1) o LEFT JOIN sf ON sf.relative_path = o.own_path),
pf AS (SELECT x.task_id, coalesce(x.file_path = o.own_path, false) AS cur, coalesce(x.file_path, '') AS f, min(rank) AS r, any_value(o.imports) AS imports, string_agg(s || chr(10), chr(10) ORDER BY k, rank) AS body FROM x JOIN own o USING (task_id) WHERE k > 0 GROUP BY ALL),
pt AS (SELECT task_id, string_agg(CASE WHEN cur THEN '#CURRENT FILE: ' ELSE '#FILE: ' END || f || chr(10) || CASE WHEN cur AND len(imports) > 0 THEN array_to_string(imports, chr(10)) || chr(10) || chr(10) ELSE '' END || body, chr(10) ORDER BY cur, r, f) AS blocks FROM pf GROUP BY task_id),
t AS (SELECT q.task_id, '{R.PROMPT_HEADER}' || chr(10) || CASE WHEN blocks IS NULL THEN '' ELSE blocks || chr(10) END || '{R.PROMPT_FOOTER}' || chr(10) || prompt AS text FROM q JOIN own USING (task_id) LEFT JOIN pt USING (task_id))
SELECT task_id, md5(text) AS prompt_md5, length(text) AS chars FROM t""",
    "first_candidates": "SELECT task_id, cand_no, CAST(rank AS INTEGER) AS rank FROM (SELECT task_id, cand_no, row_number() OVER (PARTITION BY task_id ORDER BY cand_no) AS rank FROM (SELECT DISTINCT task_id, cand_no FROM retrieval_result WHERE task_id IS NOT NULL)) WHERE rank <= 5",
    "prediction_windows": f"""WITH g AS (SELECT DISTINCT task_id, {LINES.format('prompt')} AS ls, {LINES.format("coalesce(response[1], '')")} AS nl FROM generation WHERE prompt IS NOT NULL AND len(response) > 0)
SELECT task_id, md5(array_to_string(list_filter(list_concat(list_slice(ls, greatest(0, len(ls) - 10) + 1, len(ls)), list_slice(list_filter(nl, lambda x: trim(x, ' ') <> ''), 1, 10)), lambda x: trim(x, ' ') <> ''), chr(10))) AS window_md5 FROM g""",
    "prompt_chunks": f"""WITH {WBM}, x AS (SELECT top.repo, string_agg('##CHUNK ' || rank || chr(10) || context, chr(10) ORDER BY rank) AS body FROM top JOIN cw USING (window_no) GROUP BY top.repo)
SELECT repo, md5(body || chr(10) || '#CURRENT FILE: ' || target || chr(10) || query) AS prompt_md5 FROM x JOIN a USING (repo)""",
}


#: Columns whose type differs in SQL by default, cast to the query's.
_TYPES = {
    "line_windows": {"line_no": "INTEGER", "start_line_no": "INTEGER", "end_line_no": "INTEGER"},
    "current_file_windows": {"line_no": "INTEGER", "start_line_no": "INTEGER", "end_line_no": "INTEGER"},
    "merged_windows": {"line_no": "INTEGER"},
}
for _name, _types in _TYPES.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _types.items())}) FROM ({SQL[_name]})"
