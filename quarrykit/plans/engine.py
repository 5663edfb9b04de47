"""The whole path from repositories to metrics, each step one lazy plan.

    e = Engine(spark)
    files = e.files("/data/repos")
    graph = e.index(files)                       # components with calls and noise
    tasks = ...                                  # repo, task_id, target_id, prompt
    hits = e.retrieve(tasks, e.candidates(tasks, graph), "hybrid", 10)
    prompts = e.prompts(tasks, hits)
    answers = e.generate(prompts, load_model)
    e.evaluate(results)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.functions import code_index as CI
from quarrykit.functions import models
from quarrykit.functions.vectors import cosine
from quarrykit.operators import dependencies as D
from quarrykit.operators import metrics as M
from quarrykit.operators import retrieval as R
from quarrykit.operators import windows as W
from quarrykit.operators.tables import target_json
from quarrykit.runtime import cut_lineage
from quarrykit.sources import files as sources

METHODS = ("bm25", "dense", "classifier", "hybrid")


class Engine:
    def __init__(self, spark: SparkSession, encoder: Callable = models.HashEncoder, scorer: Callable = models.LexicalPairScorer):
        self.spark, self.encoder, self.scorer = spark, encoder, scorer

    def files(self, root: str, depth: int = 1) -> DataFrame:
        """(repo, path, code) of a folder of repositories."""
        return sources.repo_files(self.spark, root, depth).select("repo", "path", "code")

    def index(self, files: DataFrame) -> DataFrame:
        """Components of the files with outgoing_calls and noise as structs of id lists, and out_count.

        References are resolved by equi-joins; a reference to an enclosing class or function is no call. The id lists are those of one
        component, bounded by its source."""
        t = CI.index_files(files, {"component": (CI.file_components, CI.COMPONENT_SCHEMA), "reference": (CI.file_references, CI.REFERENCE_SCHEMA), "import": (CI.file_imports, CI.IMPORT_SCHEMA)})
        c = cut_lineage(D.keep_last(t["component"], ["repo", "id"], "ord"))
        refs = t["reference"]
        named = refs.where("not is_star").select("repo", F.col("src_id"), F.concat("name", F.lit("@"), "module").alias("ref"), "ord")
        star = refs.where("is_star").select("repo", "path", "src_id", "module")
        used = refs.where("not is_star and module = path").select("repo", "src_id", "name")
        by_star = star.join(used, ["repo", "src_id"]).select("repo", "src_id", F.concat("name", F.lit("@"), "module").alias("ref"))
        brought = cut_lineage(self.brought(t["import"], c))
        found = D.resolve(named.select("repo", "src_id", "ref").unionByName(by_star).dropDuplicates(), c)
        own = F.substring_index("src_id", "@", 1)
        other = F.substring_index("id", "@", 1)
        found = found.where((F.col("id") != F.col("src_id")) & ~own.startswith(F.concat(other, F.lit(".")))).select("repo", "src_id", "id").dropDuplicates()
        calls = self._lists(found.join(c.select("repo", "id", "component_type"), ["repo", "id"]), "outgoing_calls")
        x = c.join(calls, [c.repo == calls.r, c.id == calls.s], "left").drop("r", "s")
        x = cut_lineage(self._filled(x, "outgoing_calls"))
        noise = D.noise(x, brought).withColumnRenamed("noise_id", "n").select("repo", F.col("id").alias("src_id"), F.col("n").alias("id"))
        lists = self._lists(noise.join(c.select("repo", "id", "component_type"), ["repo", "id"]), "noise")
        x = self._filled(x.join(lists, [x.repo == lists.r, x.id == lists.s], "left").drop("r", "s"), "noise")
        return x.withColumn("out_count", D.out_degree("outgoing_calls")).withColumnRenamed("path", "relative_path")

    @staticmethod
    def brought(imports: DataFrame, components: DataFrame) -> DataFrame:
        """(repo, path, id, alias): the components that each file's imports bring in. A module may be a file or a package; a name that a package's own
        file does not define is looked for in its submodules."""
        i = imports.select("repo", "path", "module", "name", "alias", (F.col("kind") == "star").alias("is_star"), (F.col("kind") == "import").alias("is_module"))
        package = i.withColumn("module", F.regexp_replace("module", r"\.py$", "/__init__.py"))
        direct = cut_lineage(D.expand_imports(i.unionByName(package), components))
        # a name of a package that neither way gave
        wanted = package.where("not is_star and not is_module").select("repo", "path", F.regexp_replace("module", "/__init__\\.py$", "").alias("package"), "name", F.coalesce("alias", "name").alias("alias")).dropDuplicates()
        missing = wanted.join(direct.select("repo", "path", "alias").dropDuplicates(), ["repo", "path", "alias"], "left_anti")
        again = D.reexported(missing.select("repo", "package", "name").dropDuplicates(), components)
        return direct.unionByName(missing.join(again, ["repo", "package", "name"]).select("repo", "path", "id", "alias")).dropDuplicates()

    @staticmethod
    def _lists(edges: DataFrame, name: str) -> DataFrame:
        kinds = {"classes": "class", "functions": "function", "variables": "variable"}
        return edges.groupBy(F.col("repo").alias("r"), F.col("src_id").alias("s")).agg(
            F.struct(*[F.array_sort(F.collect_set(F.when(F.col("component_type") == k, F.col("id")))).alias(f) for f, k in kinds.items()]).alias(name))

    @staticmethod
    def _filled(df: DataFrame, name: str) -> DataFrame:
        none = F.array().cast("array<string>")
        return df.withColumn(name, F.struct(*[F.coalesce(F.col(f"{name}.{f}"), none).alias(f) for f in ("classes", "functions", "variables")]))

    def windows(self, files: DataFrame, window: int = W.WINDOW, slices: int = W.SLICE) -> DataFrame:
        """Sliding windows of the files, equal texts of one repository merged."""
        return W.merged(W.sliding(files, "code", window, slices), ["repo"], ["path", "line_no"], ["start_line_no", "end_line_no"])

    def candidates(self, tasks: DataFrame, graph: DataFrame) -> DataFrame:
        """(task_id, cand_id, cand_type, relative_path, source_code, dar_sample, ord): calls and noise of each task's target."""
        t = tasks.select("repo", "task_id", F.col("target_id").alias("id"))
        comp = graph.select("repo", F.col("id").alias("dst_id"), F.col("component_type").alias("cand_type"), "relative_path", "source_code", "docstring", "signature")
        c = D.candidates(graph.join(t, ["repo", "id"]), ["repo", "task_id"], comp)
        sample = F.when(F.col("cand_type") == "variable", F.col("source_code")).otherwise(target_json(F.col("dst_id"), F.col("docstring"), F.col("signature"), F.col("source_code")))
        return c.select("task_id", F.col("dst_id").alias("cand_id"), "cand_type", "relative_path", "source_code", sample.alias("dar_sample"), "ord")

    def retrieve(self, tasks: DataFrame, candidates: DataFrame, method: str = "bm25", k: int = 10, least: float = 0.25) -> DataFrame:
        """The candidates of each task, with score and rank. hybrid: five by BM25 and all the classifier accepts; classifier: all it accepts."""
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        candidates = cut_lineage(candidates)
        q = tasks.select("task_id", "prompt").dropDuplicates(["task_id"])
        if method in ("bm25", "hybrid"):
            s = R.bm25(candidates, q, "task_id", "cand_id", "source_code", "prompt").join(candidates.select("task_id", "cand_id", "ord"), ["task_id", "cand_id"])
            top = R.top_k(s, "task_id", "score", k if method == "bm25" else 5, "ord").select("task_id", "cand_id", "score", "rank")
            if method == "bm25":
                return top.join(candidates, ["task_id", "cand_id"])
        if method == "dense":
            e = candidates.withColumn("v", models.embed(F.col("source_code"), self.encoder))
            qe = q.withColumn("qv", models.embed(F.col("prompt"), self.encoder)).select("task_id", "qv")
            s = e.join(qe, "task_id").withColumn("score", cosine(F.col("v"), F.col("qv")))
            return R.top_k(s, "task_id", "score", k, "ord").drop("v", "qv")
        p = models.score_pairs(candidates.join(q, "task_id"), "prompt", "dar_sample", self.scorer, least).where("predicted")
        p = p.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))).select("task_id", "cand_id", F.col("probability").alias("score"), "rank")
        if method == "classifier":
            return p.join(candidates, ["task_id", "cand_id"])
        return R.hybrid(top, p, ["task_id", "cand_id"], "task_id").withColumnRenamed("place", "rank").join(candidates, ["task_id", "cand_id"])

    def prompts(self, tasks: DataFrame, hits: DataFrame, imports: DataFrame | None = None, header: str = R.PROMPT_HEADER, footer: str = R.PROMPT_FOOTER) -> DataFrame:
        """(task_id, prompt) of each task, with a block for each file of its hits. `imports`, if given, has repo, path, statement, ord: the import
        statements of the target's file, which stand at the head of its block."""
        own = tasks.select("task_id", "repo", F.substring_index("target_id", "@", -1).alias("own_path"), "prompt").dropDuplicates(["task_id"])
        if imports is not None:
            said = imports.groupBy("repo", F.col("path").alias("own_path")).agg(F.array_sort(F.collect_list(F.struct("ord", "statement"))).alias("_i"))
            own = own.join(said.select("repo", "own_path", F.array_distinct(F.transform("_i", lambda e: e["statement"])).alias("imports")), ["repo", "own_path"], "left")
        else:
            own = own.withColumn("imports", F.lit(None).cast("array<string>"))
        return R.structured_prompts(own, hits, header, footer)

    def generate(self, prompts: DataFrame, load: Callable) -> DataFrame:
        """(task_id, prompt, response) of an injected model."""
        return models.generate(prompts, "task_id", "prompt", load)

    def evaluate(self, results: DataFrame, ks: tuple[int, ...] = (1, 3, 5), need_all: bool = True) -> DataFrame:
        """(k, pass_at_k) of runs with task_id and passed."""
        return M.mean_pass_at_k(M.task_totals(results, "task_id", F.col("passed")), list(ks), need_all)

    def training_pairs(self, graph: DataFrame) -> DataFrame:
        """(repo, id, cand_id, text, label): a called component as 1, a noise one as 0."""
        c = cut_lineage(graph)
        t = c.where(F.col("component_type").isin("class", "function")).select("repo", "id", target_json(F.col("id"), F.col("docstring"), F.col("signature")).alias("target"))
        code = F.when(F.col("component_type") == "variable", F.col("source_code")).otherwise(target_json(F.col("id"), F.col("docstring"), F.col("signature"), F.col("source_code")))
        ctx = c.select("repo", F.col("id").alias("dst_id"), code.alias("context"))
        e = D.edges(c, "outgoing_calls", "repo", "id").withColumn("label", F.lit(1)).unionByName(D.edges(c, "noise", "repo", "id").withColumn("label", F.lit(0)))
        return e.join(t, ["repo", "id"]).join(ctx, ["repo", "dst_id"]).select("repo", "id", F.col("dst_id").alias("cand_id"), F.concat("target", F.lit("</s>"), "context").alias("text"), "label")
