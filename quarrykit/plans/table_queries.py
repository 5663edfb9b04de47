"""Queries on reshaping, filters and prompt templates, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.functions.vectors import argmax, mean_pool, softmax_positive
from quarrykit.operators import dependencies as D
from quarrykit.operators import tables as B
from quarrykit.plans import tasks as K
from quarrykit.runtime import read_table

EXAMPLES = [("Add 1 and 2.", "3"), ("Reverse ab.", "ba")]


def _component(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "component").dropDuplicates(["comp_no"])


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "generation").where("prompt is not null").select("task_id", "prompt").dropDuplicates(["task_id"])


def component_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Components with defaults for what is missing."""
    c = B.with_defaults(_component(spark, sf).select("comp_no", "docstring", "has_docstring", "signature", "start_line", "end_line"))
    return c.select("comp_no", F.md5("docstring").alias("doc_md5"), "has_docstring", "signature", "start_line", "end_line", "component_type")


def component_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each component's JSON text, as a digest."""
    c = _component(spark, sf)
    return c.select("comp_no", F.md5(B.target_json(F.col("id"), F.col("docstring"), F.col("signature"), F.col("source_code"))).alias("json_md5"))


def failed_run_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of runs, failed ones as empty answers."""
    r = read_table(spark, sf, "execution_result").dropDuplicates(["task_id", "prediction_id"]).select("task_id", "prediction_id", "message")
    return B.successes(r, "message")


def numbered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A running number for the runs of each task."""
    r = read_table(spark, sf, "execution_result").dropDuplicates(["task_id", "prediction_id"]).select("task_id", "prediction_id")
    return B.numbered(r, "task_id", "prediction_id", "completion_id")


def namespace_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Components whose id begins with `get_` or is a method of a class that begins with Local."""
    c = _component(spark, sf).where("id is not null").select("comp_no", "id")
    return B.in_namespace(c, "id", "get_").unionByName(B.in_namespace(c, "id", "Local"))


def first_document(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each text, with how many share it."""
    d = read_table(spark, sf, "documents").where("text is not null").withColumn("text_md5", F.md5("text")).select("doc_id", "text_md5")
    n = d.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"))
    return B.first_with(d, "text_md5", "doc_id").join(n, "text_md5")


def regrouped_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes by task and prediction, each key once."""
    r = read_table(spark, sf, "execution_result").select("task_id", "prediction_id", "message").dropDuplicates()
    return B.regrouped(r, ["task_id", "prediction_id"], "message")


def collapsed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with methods and inner functions lifted to what holds them."""
    c = D.keep_last(read_table(spark, sf, "component").where("repo is not null and id is not null"), ["repo", "id"], "comp_no")
    e = D.edges(c, "outgoing_calls", "repo", "id").select(F.concat_ws(":", "repo", "id").alias("src"), F.concat_ws(":", "repo", "dst_id").alias("dst"))
    inner = c.where(T.id_name(F.col("id")).contains(".")).select(F.concat_ws(":", "repo", "id").alias("id"), F.concat(F.concat_ws(":", "repo", F.regexp_replace(T.id_name(F.col("id")), r"\.[^.]*$", "")), F.lit("@"), F.substring_index("id", "@", -1)).alias("parent"))
    return B.collapse_inner(e, inner)


def refreshed_index(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every file, with those of JavaScript files read again as if they had changed."""
    f = read_table(spark, sf, "source_file").where("code is not null and relative_path is not null").dropDuplicates(["file_no"])
    old = f.select("file_no", F.size(T.lines(F.col("code"))).cast("bigint").alias("lines"))
    new = f.where("relative_path like '%.js'").select("file_no", (-F.size(T.lines(F.col("code")))).cast("bigint").alias("lines"))
    return B.refreshed(old, new, ["file_no"])


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every prompt in every chat style, as digests."""
    p = _prompts(spark, sf)
    styles = F.explode(F.array(*[F.struct(F.lit(s).alias("style"), K.chat(F.col("prompt"), s).alias("text")) for s in sorted(K.CHAT)]))
    return p.select("task_id", styles.alias("x")).select("task_id", "x.style", F.md5("x.text").alias("text_md5"))


def infill_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out prompts and checks as fill-in-the-middle, few-shot and repair prompts, as digests."""
    t = read_table(spark, sf, "repoexec_task")
    a, b = F.coalesce("target_function_prompt", F.lit("")), F.coalesce("check_code", F.lit(""))
    return t.select("id", F.md5(K.infill(a, b)).alias("psm_md5"), F.md5(K.infill(a, b, "spm")).alias("spm_md5"), F.md5(K.few_shot(EXAMPLES, a)).alias("shots_md5"), F.md5(K.bug_prompt(a, F.lit("Fix"), "edit")).alias("edit_md5"))


def relationship_of_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by namespace prefix: in the caller's class, file, or elsewhere."""
    c = D.keep_last(read_table(spark, sf, "component").where("repo is not null and id is not null"), ["repo", "id"], "comp_no")
    e = D.edges(c, "outgoing_calls", "repo", "id")
    dotted = lambda x: F.concat(T.module_of(F.substring_index(x, "@", -1)), F.lit("."), F.substring_index(x, "@", 1))
    file_name = T.module_of(F.substring_index("id", "@", -1))
    cls = F.concat(file_name, F.lit("."), F.substring_index(T.id_name(F.col("id")), ".", 1))
    return e.groupBy(T.relationship(dotted("dst_id"), cls, file_name).alias("relationship")).agg(F.count(F.lit(1)).alias("calls"))


def wildcard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose path matches one of three shell patterns."""
    f = read_table(spark, sf, "source_file").where("relative_path is not null").select("file_no", "relative_path").dropDuplicates(["file_no"])
    return f.where(T.wildcard(F.col("relative_path"), ["src/*_pb2.py", "vendor/*", "*.js"])).select("file_no")


def model_math(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of two components of each vector, the place of its greatest one, and the pooled mean of its halves."""
    v = read_table(spark, sf, "embeddings").where("embedding is not null and size(embedding) >= 4").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pooled = mean_pool(F.array(F.slice("e", 1, 2), F.slice("e", 3, 2)), F.array(F.lit(1), F.lit(1)))
    return v.select("vec_id", F.round(softmax_positive(F.col("e")[0], F.col("e")[1]), 6).alias("probability"), argmax(F.col("e")).cast("bigint").alias("greatest"), F.round(pooled[0], 6).alias("pooled"))


def short_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts under 120 tokens."""
    p = _prompts(spark, sf)
    return B.short_prompts(p, F.size(T.tokens(F.col("prompt"))), 120).select("task_id")


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Users with purchases and no errors, and how they compare with those who signed up."""
    e = read_table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()
    of = lambda t: e.where(F.col("event_type") == t).select("user_id")
    some = of("purchase").exceptAll(of("error"))
    return some.select("user_id", F.lit("purchase, no error").alias("kind")).unionByName(of("purchase").intersect(of("signup")).select("user_id", F.lit("purchase and signup").alias("kind")))


def _sql_chat() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for s in sorted(K.CHAT):
        a, b = K.CHAT[s].split("{i}")
        parts.append(f"SELECT task_id, '{s}' AS style, md5({lit(a)} || prompt || {lit(b)}) AS text_md5 FROM p")
    return "WITH p AS (SELECT DISTINCT task_id, prompt FROM generation WHERE prompt IS NOT NULL) " + " UNION ALL ".join(parts)


C_ONCE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY comp_no DESC) AS rn FROM (SELECT DISTINCT * FROM component) WHERE repo IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)"
E_SQL = f"{C_ONCE}, e AS (SELECT repo, id, unnest(list_concat(list_concat(outgoing_calls.classes, outgoing_calls.functions), outgoing_calls.variables)) AS dst_id FROM c)"
LN = "CASE WHEN {0} = '' THEN [] WHEN ends_with(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) THEN string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10))[:-2] ELSE string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10)) END"
JS = "to_json(coalesce({0}, ''))::VARCHAR"
MOD = "replace(regexp_replace(regexp_replace(split_part({0}, '@', -1), '\\.py$', ''), '/__init__$', ''), '/', '.')"
PRE = "coalesce(target_function_prompt, '')"
CHK = "coalesce(check_code, '')"

SQL = {
    "component_defaults": "SELECT DISTINCT comp_no, md5(coalesce(docstring, 'DOCSTRING')) AS doc_md5, coalesce(has_docstring, false) AS has_docstring, coalesce(signature, '') AS signature, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, '' AS component_type FROM component",
    "component_json": f"SELECT comp_no, md5('{{\"name\": ' || {JS.format('id')} || ', \"description\": ' || {JS.format("coalesce(docstring, 'DOCSTRING')")} || ', \"code\": ' || {JS.format('source_code')} || ', \"signature\": ' || {JS.format('signature')} || '}}') AS json_md5 FROM (SELECT DISTINCT comp_no, id, docstring, source_code, signature FROM component)",
    "failed_run_filter": "SELECT DISTINCT task_id, prediction_id, CASE WHEN message IS NULL OR starts_with(message, 'failed:') THEN '' ELSE message END AS message FROM execution_result",
    "numbered_runs": "SELECT task_id, prediction_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY prediction_id) - 1 AS INTEGER) AS completion_id FROM (SELECT DISTINCT task_id, prediction_id FROM execution_result)",
    "namespace_prefix": "SELECT DISTINCT comp_no, id FROM component WHERE starts_with(id, 'get_') OR starts_with(id, 'Local')",
    "first_document": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "regrouped_runs": "SELECT DISTINCT task_id, prediction_id, message FROM execution_result",
    "collapsed_edges": f"""WITH {E_SQL}, i AS (SELECT repo, id, regexp_replace(split_part(id, '@', 1), '\\.[^.]*$', '') || '@' || split_part(id, '@', -1) AS parent FROM c WHERE contains(split_part(id, '@', 1), '.'))
SELECT * FROM (SELECT DISTINCT e.repo || ':' || coalesce(a.parent, e.id) AS src, e.repo || ':' || coalesce(b.parent, e.dst_id) AS dst FROM e LEFT JOIN i a ON a.repo = e.repo AND a.id = e.id LEFT JOIN i b ON b.repo = e.repo AND b.id = e.dst_id) WHERE src <> dst""",
    "refreshed_index": f"SELECT DISTINCT file_no, CAST(CASE WHEN relative_path LIKE '%.js' THEN -1 ELSE 1 END * len({LN.format('code')}) AS BIGINT) AS lines FROM source_file WHERE code IS NOT NULL AND relative_path IS NOT NULL",
    "chat_prompts": _sql_chat(),
    "infill_prompts": f"SELECT id, md5('<fim_prefix>' || {PRE} || '<fim_suffix>' || {CHK} || '<fim_middle>') AS psm_md5, md5('<fim_suffix>' || {CHK} || '<fim_prefix>' || {PRE} || '<fim_middle>') AS spm_md5, md5('Add 1 and 2.' || chr(10) || '3' || chr(10) || chr(10) || 'Reverse ab.' || chr(10) || 'ba' || chr(10) || chr(10) || {PRE}) AS shots_md5, md5('<commit_before>' || {PRE} || '<commit_msg>Fix<commit_after>') AS edit_md5 FROM repoexec_task",
    "relationship_of_calls": f"""WITH {E_SQL}, x AS (SELECT {MOD.format('dst_id')} || '.' || split_part(dst_id, '@', 1) AS d, {MOD.format('id')} AS f, {MOD.format('id')} || '.' || split_part(split_part(id, '@', 1), '.', 1) AS k FROM e)
SELECT CASE WHEN starts_with(d, k || '.') THEN 'intra_class' WHEN starts_with(d, f || '.') THEN 'intra_file' ELSE 'cross_file' END AS relationship, count(*) AS calls FROM x GROUP BY 1""",
    "wildcard_files": "SELECT DISTINCT file_no FROM source_file WHERE relative_path GLOB 'src/*_pb2.py' OR starts_with(relative_path, 'vendor/') OR ends_with(relative_path, '.js') OR (starts_with(relative_path, 'src/') AND ends_with(relative_path, '_pb2.py'))",
    "model_math": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 4) SELECT vec_id, round(1 / (1 + exp(e[1] - e[2])), 6) AS probability, list_position(e, list_max(e)) - 1 AS greatest, round((e[1] + e[3]) / 2, 6) AS pooled FROM v",
    "short_prompts": "SELECT DISTINCT task_id FROM generation WHERE prompt IS NOT NULL AND len(list_filter(string_split_regex(prompt, '[ \\t\\n\\f\\r]+'), lambda t: t <> '')) < 120",
    "set_operations": "WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, 'purchase, no error' AS kind FROM e WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'error') UNION ALL SELECT user_id, 'purchase and signup' FROM e WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM e WHERE event_type = 'signup')",
}


#: Columns whose type differs in SQL by default, cast to the query's.
_TYPES = {
    "model_math": {"greatest": "BIGINT"},
}
for _name, _types in _TYPES.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _types.items())}) FROM ({SQL[_name]})"
