"""Queries on generations, runs and their metrics, and on texts, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions import responses as P
from quarrykit.functions import text as T
from quarrykit.operators import metrics as M
from quarrykit.operators.ordering import medians, numbered
from quarrykit.runtime import read_table

KS = [1, 3, 5]
STOPS = ["\nclass ", "\ndef ", "\n#", "\nif ", "\nprint", "```"]


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "execution_result").dropDuplicates(["task_id", "prediction_id"])


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    g = read_table(spark, sf, "generation").dropDuplicates(["task_id"])
    return g.select("task_id", "prompt", "model", F.posexplode("response").alias("answer_no", "answer"))


def task_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and passed runs of each task."""
    return M.task_totals(_runs(spark, sf), "task_id", F.col("passed"))


def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Unbiased pass@k, the mean over tasks that have k runs."""
    return M.mean_pass_at_k(task_totals(spark, sf), KS, False).withColumn("pass_at_k", F.round("pass_at_k", 6))


def pass_at_k_gated(spark: SparkSession, sf: str) -> DataFrame:
    """Unbiased pass@k, only where every task has k runs."""
    return M.mean_pass_at_k(task_totals(spark, sf), KS, True).withColumn("pass_at_k", F.round("pass_at_k", 6))


def pass_at_k_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """pass@1 of each model and of all."""
    g = read_table(spark, sf, "generation").select(F.col("task_id").cast("int").alias("task_id"), "model").dropDuplicates(["task_id"])
    t = task_totals(spark, sf).join(g, "task_id").withColumn("p1", M.pass_at_k(F.col("n"), F.col("c"), 1)).withColumn("model", F.coalesce("model", F.lit("unknown")))
    return t.rollup("model").agg(F.round(F.avg("p1"), 6).alias("pass_at_1"), F.sum("c").cast("bigint").alias("num_correct")).select(F.coalesce("model", F.lit("all")).alias("model"), "pass_at_1", "num_correct")


def pass_at_k_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """pass@1 of each number of runs a task has."""
    t = task_totals(spark, sf).withColumn("p1", M.pass_at_k(F.col("n"), F.col("c"), 1))
    return t.groupBy("n").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("p1"), 6).alias("pass_at_1"))


def distinct_passed(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct passing texts of each task and how many runs have one of them."""
    r = _runs(spark, sf).where("generation is not null")
    ok = r.where("passed").select("task_id", "generation").dropDuplicates()
    per = ok.groupBy("task_id").agg(F.count(F.lit(1)).alias("texts"))
    hits = r.join(ok, ["task_id", "generation"], "left_semi").groupBy("task_id").agg(F.count(F.lit(1)).alias("runs"))
    return per.join(hits, "task_id")


def dependency_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of each target's positive contexts among the contexts of its first half of pairs."""
    p = read_table(spark, sf, "training_pair").where("repo is not null and target_id is not null and context_id is not null").dropDuplicates(["pair_no"])
    w = Window.partitionBy("repo", "target_id")
    x = p.select("repo", "target_id", "context_id", "label", F.row_number().over(w.orderBy("pair_no")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    # contexts of one target, a bounded list of a function's neighbours
    g = x.groupBy("repo", "target_id").agg(F.collect_set(F.when(F.col("label") == 1, F.col("context_id"))).alias("ref"), F.collect_set(F.when(2 * F.col("r") <= F.col("n") + 1, F.col("context_id"))).alias("pred"))
    return g.select("repo", "target_id", F.round(M.set_recall(F.col("ref"), F.col("pred")), 6).alias("recall")).where("recall is not null")


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Best passed outcome among each task's first k runs, the mean over tasks."""
    r = _runs(spark, sf).withColumn("v", F.coalesce(F.col("passed").cast("double"), F.lit(0.0)))
    return M.recall_at_k(r, "task_id", "prediction_id", "v", KS).withColumn("recall", F.round("recall", 6))


def dir_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the prompt's identifiers that each run uses, the mean of each task; a null run uses none."""
    g = read_table(spark, sf, "generation").where("prompt is not null").dropDuplicates(["task_id"]).select(F.col("task_id").cast("int").alias("task_id"), T.identifiers(F.col("prompt")).alias("gold"))
    x = _runs(spark, sf).join(g, "task_id").select("task_id", M.set_recall(F.col("gold"), T.identifiers(F.coalesce("generation", F.lit("")))).alias("v"))
    return x.groupBy("task_id").agg(F.round(F.avg("v"), 6).alias("dir"))


def identifier_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean share of a held-out solution's identifiers in its own prompt."""
    t = read_table(spark, sf, "repoexec_task").where("solution is not null")
    return t.select("id", F.round(M.set_recall(T.identifiers(F.col("solution")), T.identifiers(F.coalesce("target_function_prompt", F.lit("")))), 6).alias("overlap"))


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds between a run and its arrival."""
    r = _runs(spark, sf)
    s = (F.unix_micros("arrived_at") - F.unix_micros("run_at")) / F.lit(1e6)
    x = M.latency(r, s)
    return x.select("n", *[F.round(c, 6).alias(c) for c in x.columns if c != "n"])


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs' labels against a length rule."""
    p = read_table(spark, sf, "training_pair").dropDuplicates(["pair_no"])
    x = M.classification_report(p, F.col("label"), (F.length("code") > 500).cast("int"))
    return x.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in x.columns[4:]])


def robust_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Passing under all seeds: models as transformations, predictions as seeds."""
    g = read_table(spark, sf, "generation").select(F.col("task_id").cast("int").alias("task_id"), F.coalesce("model", F.lit("unknown")).alias("model")).dropDuplicates(["task_id"])
    x = M.robust_pass(_runs(spark, sf).join(g, "task_id"), "model", "task_id", "prediction_id", F.col("passed"))
    return x.select("model", F.round("robust", 6).alias("robust"), F.round("product", 6).alias("product"))


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent message of each task."""
    return M.majority(_runs(spark, sf), "task_id", "message", "prediction_id")


def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that are an answer of the same task, word for word."""
    a = _answers(spark, sf).where("answer is not null").select(F.col("task_id").cast("int").alias("task_id"), F.col("answer").alias("generation")).dropDuplicates()
    r = _runs(spark, sf).where("generation is not null").select("task_id", "prediction_id", "generation")
    hit = r.join(a.withColumn("hit", F.lit(1)), ["task_id", "generation"], "left")
    return hit.agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("exact_match"), F.count(F.lit(1)).alias("n"))


def run_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes by kind of message."""
    kind = F.when(F.col("message").isNull(), "none").when(F.col("message").startswith("failed:"), "failed").otherwise(F.col("message"))
    return _runs(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce(F.col("passed"), F.lit(False)).cast("bigint")).alias("passed"))


def average_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Mean candidates of a task by type, tasks without any counted."""
    r = read_table(spark, sf, "retrieval_result").dropDuplicates(["task_id", "cand_no"])
    g = read_table(spark, sf, "generation").select("task_id").dropDuplicates()
    per = g.join(r.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("cand_type") == "class").cast("bigint")).alias("classes")), "task_id", "left")
    return per.agg(F.round(F.avg(F.coalesce("n", F.lit(0)).cast("double")), 6).alias("candidates"), F.round(F.avg(F.coalesce("classes", F.lit(0)).cast("double")), 6).alias("classes"), F.count(F.lit(1)).alias("tasks"))


def tolerance_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as text within a thousandth of their rounded selves."""
    r = read_table(spark, sf, "retrieval_result").dropDuplicates(["task_id", "cand_no"])
    return r.select("cand_no", M.within_tolerance(F.col("bm25_score").cast("string"), F.round("bm25_score", 2).cast("string"), 0.004).alias("correct")).groupBy("correct").agg(F.count(F.lit(1)).alias("n"))


def bleu4(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed BLEU-4 of each target prompt's docstring words against the solution's."""
    t = read_table(spark, sf, "repoexec_task").where("docstring is not null and solution is not null")
    return t.select("id", F.round(100 * M.sentence_bleu(T.tokens(F.lower("solution")), T.tokens(F.lower("docstring"))), 6).alias("bleu"))


def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Answers still to run: those without a finished run of the same task and number."""
    a = _answers(spark, sf).select(F.col("task_id").cast("int").alias("task_id"), "answer_no")
    done = _runs(spark, sf).where("passed is not null").select("task_id", F.col("prediction_id").alias("answer_no")).dropDuplicates()
    return a.join(done, ["task_id", "answer_no"], "left_anti")


def missing_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers that an order lacks below its greatest."""
    r = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()
    full = r.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")).select("l_orderkey", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("l_linenumber"))
    return full.join(r, ["l_orderkey", "l_linenumber"], "left_anti")


def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    """Generations and held-out tasks zipped by their places, each in the order of its own number."""
    g = read_table(spark, sf, "generation").select(F.col("task_id").cast("int").alias("task_id")).dropDuplicates()
    t = read_table(spark, sf, "repoexec_task").select("id", "entry_point").dropDuplicates(["id"])
    return numbered(g, "task_id").join(numbered(t, "id"), "place").select(F.col("place").cast("int").alias("place"), "task_id", "id", "entry_point")


def stop_token_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Answers before their earliest stop string."""
    return _answers(spark, sf).where("answer is not null").select("task_id", "answer_no", F.md5(T.before_stop(F.col("answer"), STOPS)).alias("cut_md5"))


def whitespace_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    """Solutions with runs of white space as one space."""
    return read_table(spark, sf, "repoexec_task").select("id", F.md5(T.squeeze(F.col("solution"))).alias("squeezed_md5"), F.size(T.tokens(F.col("solution"))).cast("bigint").alias("tokens"))


def answer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are empty completions, fenced, or behind a chat mark."""
    a = _answers(spark, sf)
    kind = F.when(F.col("answer").isNull(), "null").when(F.col("answer") == "    pass\n", "pass only").when(F.trim("answer") == "", "blank").when(F.col("answer").contains("```"), "fenced").otherwise("plain")
    return a.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def prompt_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts under 400 tokens whose text begins with a request, and the line of the last definition."""
    g = read_table(spark, sf, "generation").where("prompt is not null").select("task_id", "prompt").dropDuplicates(["task_id"])
    n = F.size(T.tokens(F.col("prompt")))
    return g.where((n < 400) & ~F.col("prompt").startswith("#FILE")).select("task_id", n.cast("bigint").alias("tokens"), F.size(T.lines(F.col("prompt"))).cast("bigint").alias("lines"))


def contained_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out tasks that are not contained in their context."""
    return read_table(spark, sf, "repoexec_task").where("not is_contained").select("id", "entry_point")


def task_splice(spark: SparkSession, sf: str) -> DataFrame:
    """Tests with the entry point renamed, and the target prompt's last line."""
    t = read_table(spark, sf, "repoexec_task").where("check_code is not null")
    return t.select("id", F.md5(F.replace("check_code", "entry_point", F.lit("candidate"))).alias("check_md5"), F.element_at(T.lines(F.col("target_function_prompt")), -1).alias("last_line"), T.number(F.regexp_extract("check_code", r"== *(-?[\d,]+)", 1)).alias("expected"))


def json_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A key of the event properties, with a default."""
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"))


def event_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type and user with exact median value."""
    e = read_table(spark, sf, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return g.join(medians(e, ["event_type"], "value"), "event_type", "left").select("event_type", "n", "users", F.round("median", 6).alias("median"))


def order_parts_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity by return flag and status, with totals: the grouping-sets surface."""
    x = read_table(spark, sf, "lineitem")
    return x.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


def mteval_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Docstrings in the tokens of the public BLEU normalisation, as digests."""
    t = M.mteval_tokens(F.coalesce("docstring", F.lit("")))
    return read_table(spark, sf, "repoexec_task").select("id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus BLEU of the held-out docstrings against their solutions, and its parts."""
    t = read_table(spark, sf, "repoexec_task").where("docstring is not null and solution is not null")
    t = t.select("id", M.mteval_tokens(F.col("solution")).alias("r"), M.mteval_tokens(F.col("docstring")).alias("h"))
    return M.corpus_bleu(t, "id", "r", "h").withColumn("bleu", F.round("bleu", 6))


def functional_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean share of passed runs over tasks."""
    return M.functional_accuracy(_runs(spark, sf), "task_id", F.col("passed")).withColumn("accuracy", F.round("accuracy", 6))


def polyglot_pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """pass@1, @10 and @100 by status and exit code, taking a run's result for both."""
    r = _runs(spark, sf).withColumn("status", F.when(F.col("passed"), "OK").otherwise("Exception")).withColumn("code", F.when(F.col("passed"), 0).otherwise(1))
    return M.polyglot_pass_at_k(r, "task_id", "status", "code", (1, 2, 100)).withColumn("pass_at_k", F.round("pass_at_k", 6))


def named_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a known generation whose number is that of one of its answers; the others are passed over."""
    g = read_table(spark, sf, "generation").dropDuplicates(["task_id"]).select(F.col("task_id").try_cast("int").alias("task_id"), F.greatest(F.coalesce(F.size("response"), F.lit(0)), F.lit(0)).alias("n"))
    r = _runs(spark, sf).where("task_id is not null").select("task_id", "prediction_id").join(g, "task_id")
    return r.where((F.col("prediction_id") >= 0) & (F.col("prediction_id") < F.col("n"))).select("task_id", "prediction_id")


def fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned function of every answer, as a digest."""
    a = _answers(spark, sf).where("answer is not null")
    sig = F.regexp_extract("prompt", r"(?s).*\n((?:async )?def \w+)", 1)
    return a.select("task_id", "answer_no", F.md5(P.clean_body_col(F.col("answer"), F.coalesce(sig, F.lit("")))).alias("clean_md5"))


R = "r AS (SELECT DISTINCT * FROM execution_result)"
A = "a AS (SELECT task_id, prompt, model, unnest(range(len(response))) AS answer_no, unnest(response) AS answer FROM (SELECT DISTINCT task_id, prompt, response, model FROM generation))"
TOTALS = f"{R}, t AS (SELECT task_id, CAST(count(*) AS INTEGER) AS n, CAST(coalesce(sum(CASE WHEN passed THEN 1 ELSE 0 END), 0) AS INTEGER) AS c FROM r GROUP BY task_id)"
PK = "CASE WHEN n - c < {0} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {0} / i), lambda x, y: x * y) END"
TOK = "list_filter(string_split_regex({0}, '[ \\t\\n\\f\\r]+'), lambda t: t <> '')"
IDS = "list_distinct(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'))"
MODEL = "g AS (SELECT DISTINCT CAST(task_id AS INTEGER) AS task_id, coalesce(model, 'unknown') AS model FROM generation)"
LN = "CASE WHEN {0} = '' THEN [] WHEN ends_with(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) THEN string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10))[:-2] ELSE string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) END"
RATIO = "CASE WHEN {1} > 0 THEN ({0}) / ({1}) ELSE 0.0 END"
_GRAMS = "list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string(list_slice({0}, i, i + n - 1), chr(1)))"
#: Clipped n-gram counts of t (id, r, h), for the BLEU queries.
BLEU = f"""o AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest({_GRAMS.format('h')}) AS g FROM t, o) GROUP BY ALL), rg AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, unnest({_GRAMS.format('r')}) AS g FROM t, o) GROUP BY ALL),
k AS (SELECT hg.id, hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS hits, sum(hg.c) AS total FROM hg LEFT JOIN rg USING (id, n, g) GROUP BY ALL)"""
_mt = "replace(replace(@text, '<skipped>', ''), '-' || chr(10), '')"
for _e, _c in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _mt = f"replace({_mt}, '{_e}', '{_c}')" if _e != "&quot;" else f"replace(replace({_mt}, chr(10), ' '), '{_e}', '{_c}')"
_mt = f"(' ' || lower({_mt}) || ' ')"
for _p, _r in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _mt = f"regexp_replace({_mt}, '{_p}', '{_r}', 'g')"
MTEVAL = f"list_filter(string_split_regex({_mt}, '[ \\t\\r\\f]+'), lambda x: x <> '')"
_stop = "least(" + ", ".join("CASE WHEN instr(answer, '{0}') > 0 THEN instr(answer, '{0}') ELSE 2147483647 END".format(s) for s in STOPS) + ")"


def _report() -> str:
    p1, r1, p0, r0 = RATIO.format("tp", "tp + fp"), RATIO.format("tp", "tp + fn"), RATIO.format("tn", "tn + fn"), RATIO.format("tn", "tn + fp")
    return f"""WITH x AS (SELECT label AS y, CASE WHEN length(code) > 500 THEN 1 WHEN code IS NOT NULL THEN 0 END AS p FROM (SELECT DISTINCT pair_no, label, code FROM training_pair)),
t AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM x WHERE y IS NOT NULL AND p IS NOT NULL),
m AS (SELECT *, {RATIO.format('tp + tn', 'tp + fp + fn + tn')} AS a, {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0 FROM t)
SELECT tp, fp, fn, tn, round(a, 6) AS accuracy, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round({RATIO.format('2 * p1 * r1', 'p1 + r1')}, 6) AS f1_1, round({RATIO.format('2 * p0 * r0', 'p0 + r0')}, 6) AS f1_0,
round((p1 + p0) / 2, 6) AS macro_precision, round((r1 + r0) / 2, 6) AS macro_recall FROM m"""


def _lat(c: str, f: str) -> str:
    return f"round({f}, 6) AS {c}_s, round({f} * 1000, 6) AS {c}_ms"


SQL = {
    "tolerance_accuracy": "SELECT coalesce(abs(bm25_score - round(bm25_score, 2)) < 0.004, false) AS correct, count(*) AS n FROM (SELECT DISTINCT task_id, cand_no, bm25_score FROM retrieval_result) GROUP BY 1",
    "mteval_tokens": f"SELECT id, len({MTEVAL.replace('@text', "coalesce(docstring, '')")}) AS n, md5(array_to_string({MTEVAL.replace('@text', "coalesce(docstring, '')")}, ' ')) AS tokens_md5 FROM repoexec_task",
    "corpus_bleu": f"""WITH t AS (SELECT id, {MTEVAL.replace('@text', 'solution')} AS r, {MTEVAL.replace('@text', 'docstring')} AS h FROM repoexec_task WHERE docstring IS NOT NULL AND solution IS NOT NULL), {BLEU},
b AS (SELECT o.n, coalesce(sum(k.hits), 0) AS hits, coalesce(sum(k.total), 0) AS total FROM o LEFT JOIN k USING (n) GROUP BY 1), z AS (SELECT sum(len(r)) AS rl, sum(len(h)) AS hl FROM t)
SELECT CAST(n AS INTEGER) AS n, CAST(hits AS BIGINT) AS hits, CAST(total AS BIGINT) AS total, (SELECT round(CASE WHEN min(b.hits) > 0 THEN exp(avg(ln(greatest(b.hits, 1) / b.total))) * any_value(CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1.0 END) ELSE 0.0 END, 6) FROM b, z) AS bleu FROM b""",
    "bleu4": f"""WITH t AS (SELECT id, {TOK.format('lower(solution)')} AS r, {TOK.format('lower(docstring)')} AS h FROM repoexec_task WHERE docstring IS NOT NULL AND solution IS NOT NULL), {BLEU},
f AS (SELECT t.id, len(r) AS rl, len(h) AS hl, coalesce(k.hits, 0) + (o.n > 1)::INT AS a, coalesce(k.total, 0) + (o.n > 1)::INT AS b FROM t CROSS JOIN o LEFT JOIN k ON k.id = t.id AND k.n = o.n)
SELECT id, round(100 * CASE WHEN min(least(a, b)) <= 0 THEN 0.0 ELSE exp(sum(ln(greatest(a, 1) / greatest(b, 1))) / 4 + least(0.0, 1 - (any_value(rl) + 1) / (any_value(hl) + 1))) END, 6) AS bleu FROM f GROUP BY id""",
    "polyglot_pass_at_k": f"WITH {TOTALS} " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg({PK.format(k)}) FILTER (n >= {k}), 6) AS pass_at_k FROM t" for k in (1, 2, 100)),
    "functional_accuracy": f"WITH {TOTALS} SELECT count(*) AS tasks, round(avg(c / n), 6) AS accuracy FROM t",
    "named_tasks": f"WITH {R} SELECT task_id, prediction_id FROM r JOIN (SELECT DISTINCT try_cast(task_id AS INTEGER) AS task_id, coalesce(len(response), 0) AS n FROM generation) g USING (task_id) WHERE prediction_id >= 0 AND prediction_id < n",
    "task_totals": f"WITH {TOTALS} SELECT * FROM t",
    "pass_at_k": f"WITH {TOTALS} " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg({PK.format(k)}) FILTER (n >= {k}), 6) AS pass_at_k FROM t" for k in KS),
    "pass_at_k_gated": f"WITH {TOTALS} " + " UNION ALL ".join(f"SELECT {k} AS k, CASE WHEN bool_and(n >= {k}) THEN round(avg({PK.format(k)}), 6) END AS pass_at_k FROM t" for k in KS),
    "pass_at_k_by_model": f"WITH {TOTALS}, {MODEL}, x AS (SELECT model, c, {PK.format(1)} AS p1 FROM t JOIN g USING (task_id)) SELECT model, round(avg(p1), 6) AS pass_at_1, sum(c) AS num_correct FROM x GROUP BY model UNION ALL SELECT 'all', round(avg(p1), 6), sum(c) FROM x",
    "pass_at_k_by_length": f"WITH {TOTALS} SELECT n, count(*) AS tasks, round(avg({PK.format(1)}), 6) AS pass_at_1 FROM t GROUP BY n",
    "distinct_passed": f"WITH {R}, ok AS (SELECT DISTINCT task_id, generation FROM r WHERE passed AND generation IS NOT NULL) SELECT task_id, (SELECT count(*) FROM ok o WHERE o.task_id = r.task_id) AS texts, count(*) AS runs FROM r SEMI JOIN ok USING (task_id, generation) GROUP BY task_id",
    "dependency_recall": """WITH p AS (SELECT DISTINCT pair_no, repo, target_id, context_id, label FROM training_pair WHERE repo IS NOT NULL AND target_id IS NOT NULL AND context_id IS NOT NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY repo, target_id ORDER BY pair_no) AS r, count(*) OVER (PARTITION BY repo, target_id) AS n FROM p),
g AS (SELECT repo, target_id, list(DISTINCT context_id) FILTER (label = 1) AS ref, list(DISTINCT context_id) FILTER (2 * r <= n + 1) AS pred FROM x GROUP BY ALL)
SELECT repo, target_id, round(len(list_intersect(ref, coalesce(pred, []))) / len(ref), 6) AS recall FROM g WHERE len(ref) > 0""",
    "recall_at_k": f"WITH {R}, x AS (SELECT task_id, coalesce(CAST(passed AS INTEGER), 0) AS v, row_number() OVER (PARTITION BY task_id ORDER BY prediction_id) AS n FROM r) " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg(m), 6) AS recall FROM (SELECT task_id, max(v) AS m FROM x WHERE n <= {k} GROUP BY task_id)" for k in KS),
    "dir_metric": f"WITH {R}, g AS (SELECT DISTINCT CAST(task_id AS INTEGER) AS task_id, {IDS.format('prompt')} AS gold FROM generation WHERE prompt IS NOT NULL) SELECT task_id, round(avg(CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, {IDS.format("coalesce(generation, '')")})) / len(gold) END), 6) AS dir FROM r JOIN g USING (task_id) GROUP BY task_id",
    "identifier_overlap": f"SELECT id, round(len(list_intersect({IDS.format('solution')}, {IDS.format("coalesce(target_function_prompt, '')")})) / len({IDS.format('solution')}), 6) AS overlap FROM repoexec_task WHERE solution IS NOT NULL",
    "latency_stats": f"WITH {R}, x AS (SELECT (epoch_us(arrived_at) - epoch_us(run_at)) / 1e6 AS s FROM r), y AS (SELECT s FROM x WHERE s IS NOT NULL) SELECT count(*) AS n, {_lat('mean', 'avg(s)')}, {_lat('min', 'min(s)')}, {_lat('max', 'max(s)')}, {_lat('median', 'median(s)')} FROM y",
    "classification_report": _report(),
    "robust_pass": f"WITH {R}, {MODEL}, x AS (SELECT model, task_id, prediction_id, coalesce(passed, false) AS ok FROM r JOIN g USING (task_id)), y AS (SELECT model, task_id, bool_and(ok) AS ok, product(CAST(ok AS DOUBLE)) AS m FROM x GROUP BY ALL) SELECT model, round(avg(CAST(ok AS DOUBLE)), 6) AS robust, round(avg(m), 6) AS product FROM y GROUP BY model",
    "majority_vote": f"WITH {R}, v AS (SELECT task_id, message, count(*) AS votes, min(prediction_id) AS f FROM r WHERE message IS NOT NULL GROUP BY ALL) SELECT task_id, message, votes FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY votes DESC, f, message) AS rn FROM v) WHERE rn = 1",
    "exact_match": f"WITH {R}, {A}, u AS (SELECT DISTINCT CAST(task_id AS INTEGER) AS task_id, answer AS generation FROM a WHERE answer IS NOT NULL) SELECT round(avg(CASE WHEN u.task_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS exact_match, count(*) AS n FROM r LEFT JOIN u USING (task_id, generation) WHERE r.generation IS NOT NULL",
    "run_tallies": f"WITH {R} SELECT CASE WHEN message IS NULL THEN 'none' WHEN starts_with(message, 'failed:') THEN 'failed' ELSE message END AS kind, count(*) AS runs, count(*) FILTER (passed) AS passed FROM r GROUP BY 1",
    "average_candidates": "WITH r AS (SELECT task_id, count(*) AS n, count(*) FILTER (cand_type = 'class') AS k FROM (SELECT DISTINCT task_id, cand_no, cand_type FROM retrieval_result) GROUP BY 1), g AS (SELECT DISTINCT task_id FROM generation) SELECT round(avg(coalesce(n, 0)), 6) AS candidates, round(avg(coalesce(k, 0)), 6) AS classes, count(*) AS tasks FROM g LEFT JOIN r USING (task_id)",
    "resume_antijoin": f"WITH {R}, {A} SELECT CAST(a.task_id AS INTEGER) AS task_id, CAST(answer_no AS INTEGER) AS answer_no FROM a ANTI JOIN (SELECT * FROM r WHERE passed IS NOT NULL) d ON CAST(a.task_id AS INTEGER) = d.task_id AND a.answer_no = d.prediction_id",
    "missing_numbers": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), f AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS l_linenumber FROM r GROUP BY 1) SELECT f.l_orderkey, CAST(f.l_linenumber AS INTEGER) AS l_linenumber FROM f ANTI JOIN r USING (l_orderkey, l_linenumber)",
    "positional_join": "WITH g AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS place FROM (SELECT DISTINCT CAST(task_id AS INTEGER) AS task_id FROM generation)), t AS (SELECT id, entry_point, row_number() OVER (ORDER BY id) - 1 AS place FROM repoexec_task) SELECT place, task_id, id, entry_point FROM g JOIN t USING (place)",
    "stop_token_truncate": f"WITH {A} SELECT task_id, answer_no, md5(CASE WHEN {_stop} = 2147483647 THEN answer ELSE answer[1 : {_stop} - 1] END) AS cut_md5 FROM a WHERE answer IS NOT NULL",
    "whitespace_squeeze": f"SELECT id, md5(array_to_string({TOK.format('solution')}, ' ')) AS squeezed_md5, len({TOK.format('solution')}) AS tokens FROM repoexec_task",
    "answer_kinds": f"WITH {A} SELECT CASE WHEN answer IS NULL THEN 'null' WHEN answer = '    pass' || chr(10) THEN 'pass only' WHEN trim(answer, ' ') = '' THEN 'blank' WHEN contains(answer, '```') THEN 'fenced' ELSE 'plain' END AS kind, count(*) AS n FROM a GROUP BY 1",
    "prompt_filters": f"SELECT * FROM (SELECT DISTINCT task_id, len({TOK.format('prompt')}) AS tokens, len({LN.format('prompt')}) AS lines FROM generation WHERE prompt IS NOT NULL AND NOT starts_with(prompt, '#FILE')) WHERE tokens < 400",
    "contained_filter": "SELECT id, entry_point FROM repoexec_task WHERE NOT is_contained",
    "task_splice": f"SELECT id, md5(replace(check_code, entry_point, 'candidate')) AS check_md5, ({LN.format('target_function_prompt')})[-1] AS last_line, TRY_CAST(replace(regexp_extract(check_code, '== *(-?[\\d,]+)', 1), ',', '') AS DOUBLE) AS expected FROM repoexec_task WHERE check_code IS NOT NULL",
    "json_lookup": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k FROM events",
    "event_tallies": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(median(value), 6) AS median FROM events GROUP BY 1",
    "order_parts_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
}
SQL = {k: v for k, v in SQL.items() if v}


#: Columns whose type differs in SQL by default, cast to the query's.
_TYPES = {
    "pass_at_k_by_model": {"num_correct": "BIGINT"},
    "positional_join": {"place": "INTEGER"},
    "stop_token_truncate": {"answer_no": "INTEGER"},
}
for _name, _types in _TYPES.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _types.items())}) FROM ({SQL[_name]})"
