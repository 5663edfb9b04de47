"""Reshaping of task, answer and component tables between the forms that producers and consumers use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import id_name, json_string, lines

NO_DOC = "DOCSTRING"
#: Component columns and what a missing one becomes.
DEFAULTS = {"component_type": "", "clean_name": "", "file_path": "", "relative_path": "", "source_code": "", "docstring": NO_DOC, "signature": "", "start_line": 0, "end_line": 0, "out_count": 0, "has_docstring": False}


def with_defaults(components: DataFrame) -> DataFrame:
    """Every component column present, nulls replaced by their defaults."""
    have = set(components.columns)
    return components.select(*[c for c in components.columns if c not in DEFAULTS], *[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in have else F.lit(v).alias(k) for k, v in DEFAULTS.items()])


def target_json(name: Column, description: Column, signature: Column, code: Column | None = None) -> Column:
    """A component as JSON text: name, description, code if given, signature; a space after colons and commas, characters beyond ASCII kept."""
    parts = [F.lit('{"name": '), json_string(name), F.lit(', "description": '), json_string(F.coalesce(description, F.lit(NO_DOC)))]
    if code is not None:
        parts += [F.lit(', "code": '), json_string(code)]
    return F.concat(*parts, F.lit(', "signature": '), json_string(signature), F.lit("}"))


def predictions(raw: DataFrame) -> DataFrame:
    """(task_id, prompt, response) of model outputs with metadata and choices."""
    return raw.select(F.col("metadata.task_id").alias("task_id"), "prompt", F.transform("choices", lambda c: c["text"]).alias("response"))


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """A running number from 0 in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def with_positions(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks with the texts of their signature and body lines, a running id in each project, and the lines left out of their file.

    `tasks`: namespace, project_path, completion_path, signature_position, body_position (1-based, both ends); `files`: path, code."""
    x = tasks.join(files.select(F.col("path").alias("completion_path"), "code"), "completion_path")
    xs = lines(F.col("code"))
    cut = lambda p: F.array_join(F.slice(xs, p[0], p[1] - p[0] + 1), "\n")
    x = x.withColumn("target_function_prompt", cut(F.col("signature_position"))).withColumn("ground_truth", cut(F.col("body_position"))).drop("code")
    return numbered(x, "project_path", "namespace", "id").withColumn("task_id", F.concat_ws("/", "project_path", F.col("id").cast("string")))


def of_repo(task_id: Column) -> Column:
    """The repository of a task id `repo/number`."""
    return F.regexp_replace(task_id, "/[^/]*$", "")


def by_position(rows: DataFrame, samples: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows joined with the sample their number points at, in the samples' order. Samples are a benchmark: numbered in one window."""
    n = samples.withColumn("_place", F.row_number().over(Window.orderBy(order)) - 1)
    return rows.withColumn("_place", key).join(n, "_place").drop("_place")


def successes(results: DataFrame, column: str) -> DataFrame:
    """Programs' outputs as lists, failed ones as an empty answer."""
    ok = ~F.coalesce(F.col(column).startswith("failed:"), F.lit(True))
    return results.withColumn(column, F.when(ok, F.col(column)).otherwise(F.lit("")))


def in_namespace(nodes: DataFrame, name: str, prefix: str) -> DataFrame:
    """Nodes whose name begins with a prefix."""
    return nodes.where(F.col(name).startswith(prefix))


def first_with(docs: DataFrame, reference: str, order: str) -> DataFrame:
    """The first document of each reference text."""
    w = Window.partitionBy(reference).orderBy(order)
    return docs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def regrouped(results: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Results by keys; a key that comes twice raises when the plan runs."""
    g = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(values).alias(values))
    return g.withColumn(values, F.when(F.assert_true(F.col("_n") == 1, F.lit("a key comes twice")).isNull(), F.col(values))).drop("_n")


def collapse_inner(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Edges with inner functions replaced by the function that holds them. `inner`: id, parent."""
    out = edges
    for side in ("src", "dst"):
        out = out.join(inner.select(F.col("id").alias(side), F.col("parent").alias("_p")), side, "left").withColumn(side, F.coalesce("_p", side)).drop("_p")
    return out.where("src <> dst").dropDuplicates(["src", "dst"])


def refreshed(table: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """A table with the rows of changed files replaced: only those files are read again."""
    return table.join(changed.select(*keys).dropDuplicates(), keys, "left_anti").unionByName(changed)


def nested_candidates(candidates: DataFrame, task: str) -> DataFrame:
    """(task, candidate): candidates as a map of type to a map of id to fields, as prompt builders take them. A task's candidates are the
    calls and noise of one function, a list bounded by a file."""
    entry = F.struct(F.col("cand_id"), F.struct("relative_path", "source_code", "dar_sample").alias("v"))
    per = candidates.groupBy(task, "cand_type").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("xs"))
    inner = F.map_from_entries(F.transform("xs", lambda x: F.struct(x["e"]["cand_id"], x["e"]["v"])))
    return per.groupBy(task).agg(F.map_from_entries(F.collect_list(F.struct("cand_type", inner.alias("m")))).alias("candidate"))


def short_prompts(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows under a token limit."""
    return df.where(tokens < most)


def same_name(component_id: Column, name: Column) -> Column:
    """Whether a component's own name is `name`."""
    return F.substring_index(id_name(component_id), ".", -1) == name
