"""Reading repositories, JSON lines, graphs and reports; a bad record or file is passed over, or counted, never fatal."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALLS = "struct<classes:array<string>,functions:array<string>,variables:array<string>>"
RAW_CALLS = "struct<class:array<string>,function:array<string>,variable:array<string>>"
COMPONENT = (
    "id string, component_type string, clean_name string, file_path string, relative_path string, source_code string, start_line int, end_line int, has_docstring boolean, "
    f"docstring string, outgoing_calls {RAW_CALLS}, noise {RAW_CALLS}, out_count int, signature string"
)
TASK = "namespace string, type string, project_path string, completion_path string, signature_position array<int>, body_position array<int>, dependency struct<intra_class:array<string>,intra_file:array<string>,cross_file:array<string>>, indent int, tests array<string>, requirement struct<Functionality:string,Arguments:string>"
GENERATION = "task_id string, prompt string, response array<string>"
RUN = "task_id int, prediction_id int, generation string, message string, passed boolean"


def repo_files(spark: SparkSession, root: str, depth: int = 1, pattern: str = "*.py") -> DataFrame:
    """(repo, path, code) of the files below root whose first `depth` folders name the repository (1: repo, 2: category/repo).

    Files are split over tasks by size; bytes that are no UTF-8 are replaced, so an unreadable file costs its bad characters only."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(rel, "/")
    return raw.select(
        F.array_join(F.slice(parts, 1, depth), "/").alias("repo"), F.array_join(F.slice(parts, depth + 1, F.size(parts) - depth), "/").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("code"), "length", "modificationTime").where("repo <> '' and path <> ''")


def repos(files: DataFrame) -> DataFrame:
    """Repositories with their numbers of files and bytes."""
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("code")).alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = True) -> DataFrame:
    """JSON lines, plain or gzipped; blank lines don't count. tolerant: malformed lines are dropped; else they raise."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_lines_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the malformed lines with their files."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    parsed = text.withColumn("row", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    names = [f.name for f in parsed.schema["row"].dataType if f.name != "_bad"]
    return parsed.where("row._bad is null").select(*[F.col(f"row.{n}") for n in names]), parsed.where("row._bad is not null").select("file", F.col("value").alias("line"))


def graph(spark: SparkSession, path: str, by_repo: bool = True) -> DataFrame:
    """Components of graph files (one JSON object id -> component), with file, repo and order in the object; a file that does not parse gives none."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    entries = raw.withColumn("m", F.from_json("value", f"map<string,struct<{', '.join(':'.join(c.strip().split(' ', 1)) for c in _fields(COMPONENT))}>>"))
    x = entries.where("m is not null").select("file", F.posexplode(F.map_entries("m")).alias("ord", "e"))
    repo = F.element_at(F.split("file", "/"), -2) if by_repo else F.lit(None).cast("string")
    names = [c.split(" ")[0] for c in _fields(COMPONENT)]
    lift = lambda c: F.struct(F.col(f"e.value.{c}.class").alias("classes"), F.col(f"e.value.{c}.function").alias("functions"), F.col(f"e.value.{c}.variable").alias("variables")).alias(c)
    return x.select("file", repo.alias("repo"), "ord", F.coalesce("e.value.id", "e.key").alias("id"), *[lift(n) if n in ("outgoing_calls", "noise") else F.col(f"e.value.{n}") for n in names if n != "id"])


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL string, struct commas left alone."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def union_graphs(graphs: DataFrame) -> DataFrame:
    """One component of each (repo, id): the last file by name, the last entry in it, as later entries overwrite."""
    w = Window.partitionBy("repo", "id").orderBy(F.col("file").desc(), F.col("ord").desc())
    return graphs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(file, relative_path, import_statements, external_entity) of knowledge files."""
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    m = raw.withColumn("m", F.from_json("value", "map<string,struct<import_statements:array<string>,external_entity:array<string>>>"))
    return m.select("file", F.explode(F.map_entries("m")).alias("e")).select("file", F.col("e.key").alias("relative_path"), "e.value.import_statements", "e.value.external_entity")


def imports_of(tasks: DataFrame, knowledge_table: DataFrame, key: list[str]) -> DataFrame:
    """Tasks with the import statements of their file, an empty list where none are known."""
    k = knowledge_table.select(*key, "import_statements").dropDuplicates(key)
    return tasks.join(k, key, "left").withColumn("import_statements", F.coalesce("import_statements", F.array().cast("array<string>")))


def graph_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file): the graph file in the repository's own folder, else the first whose path holds the repository's name.

    `files` is a list of graph files, one for each repository; it is joined on its folders, and by containment only for repositories
    that no folder names, a side of at most the unmatched repositories."""
    own = files.select("file", F.explode(F.split("file", "/")).alias("repo"))
    exact = wanted.join(own, "repo").groupBy("repo").agg(F.min("file").alias("file"))
    rest = wanted.join(exact, "repo", "left_anti")
    near = rest.join(files, files.file.contains(rest.repo)).groupBy("repo").agg(F.min("file").alias("file"))
    return exact.unionByName(near)


def pytest_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of test reports as CSV, with multi-line quoted fields."""
    return spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').schema(
        "id string, module string, name string, file string, doc string, markers string, status string, message string, duration double").csv(path)


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(report, file, executed_lines, missing_lines, percent) of coverage reports."""
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("report"))
    m = raw.withColumn("m", F.from_json("value", "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>,summary:struct<percent_covered:double>>>>"))
    return m.select("report", F.explode(F.map_entries("m.files")).alias("e")).select("report", F.col("e.key").alias("file"), "e.value.executed_lines", "e.value.missing_lines", F.col("e.value.summary.percent_covered").alias("percent"))


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of per-task result files with the task number of the file's name."""
    x = spark.read.schema(RUN).json(path).withColumn("file", F.input_file_name())
    return x.withColumn("file_task", F.regexp_extract("file", r"_(\d+)\.jsonl?$", 1).try_cast("int"))


def leaderboard(spark: SparkSession, path: str, tasks: list[str]) -> DataFrame:
    """(task, file, pass_at_1) of metric files named for their task, of the tasks listed."""
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    x = raw.withColumn("task", F.regexp_replace("file", r"\.json$", "")).where(F.col("task").isin(*tasks))
    m = F.from_json("value", "map<string,map<string,double>>")
    return x.select("task", "file", F.try_element_at(F.try_element_at(m, F.col("task")), F.lit("pass@1")).alias("pass_at_1"))


def splits(spark: SparkSession, paths: dict[str, str], schema: str = "text string, label int") -> DataFrame:
    """JSON lines of several splits with the split's name."""
    parts = [json_lines(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset(spark: SparkSession, path: str, split: str | None = None, language: str | None = None) -> DataFrame:
    """A saved dataset in parquet or JSON lines: a folder with one folder or file for each split, below one for each language where there are several.

    Stands for datasets of a public hub or of one configuration a language, once they are saved; nothing is fetched."""
    base = "/".join([path.rstrip("/"), *([language] if language else [])])
    base = f"{base}/{split}*" if split else base
    reader = spark.read.option("recursiveFileLookup", "true")
    try:
        return reader.option("pathGlobFilter", "*.parquet").parquet(base)
    except AnalysisException:  # no parquet there
        return reader.option("pathGlobFilter", "*.json*").json(base)
