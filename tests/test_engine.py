import json

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import retrieval as R
from quarrykit.operators import tables as T
from quarrykit.plans.engine import Engine

UTIL = "LIMIT = 10\n\n\ndef read_rows(path):\n    \"\"\"Reads rows of a file.\"\"\"\n    return open(path).readlines()[:LIMIT]\n\n\ndef unused(x):\n    return x\n"
MAIN = "from util import read_rows, LIMIT\nfrom extra import *\n\n\nclass Job:\n    def start(self, path):\n        return read_rows(path)\n\n\ndef run(path):\n    job = Job()\n    return bonus(read_rows(path), LIMIT)\n\n\ndef other():\n    return 1\n"
EXTRA = "def bonus(rows, n):\n    return rows[:n]\n"


@pytest.fixture(scope="module")
def graph(spark):
    f = spark.createDataFrame([("r", "util.py", UTIL), ("r", "main.py", MAIN), ("r", "extra.py", EXTRA), ("q", "util.py", "def read_rows(): pass\n")], "repo string, path string, code string")
    return Engine(spark).index(f).cache()


def test_index(graph):
    rows = {(r["repo"], r["id"]): r for r in graph.collect()}
    run = rows["r", "run@main.py"]
    assert run["outgoing_calls"]["functions"] == ["bonus@extra.py", "read_rows@util.py"] and run["outgoing_calls"]["classes"] == ["Job@main.py"] and run["outgoing_calls"]["variables"] == ["LIMIT@util.py"]
    assert run["noise"]["functions"] == ["other@main.py"] and run["out_count"] == 4
    assert rows["q", "read_rows@util.py"]["out_count"] == 0


@pytest.mark.parametrize("method", ["bm25", "dense", "classifier", "hybrid"])
def test_retrieve_and_prompt(spark, graph, method):
    e = Engine(spark)
    tasks = spark.createDataFrame([("r", "1", "run@main.py", "def run(path): read_rows path"), ("r", "2", "bonus@extra.py", "LIMIT =")], "repo string, task_id string, target_id string, prompt string")
    cands = e.candidates(tasks, graph)
    assert {r["cand_id"] for r in cands.collect()} == {"bonus@extra.py", "read_rows@util.py", "Job@main.py", "LIMIT@util.py", "other@main.py"}
    hits = e.retrieve(tasks, cands, method, 3, least=0.0)
    ranks = [r["rank"] for r in hits.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    text = {r["task_id"]: r["prompt"] for r in e.prompts(tasks, hits).collect()}
    assert text["2"] == f"{R.PROMPT_HEADER}\n{R.PROMPT_FOOTER}\nLIMIT =" and text["1"].endswith(f"{R.PROMPT_FOOTER}\ndef run(path): read_rows path") and "#FILE: " in text["1"]
    with pytest.raises(ValueError):
        e.retrieve(tasks, cands, "none")


def test_prompt_layout(spark):
    """Files by their best hit, types in order, the target's own file last with its imports; other types and files without hits leave no trace."""
    tasks = spark.createDataFrame([("1", "m.py", "def t():", ["import os", "from a import b"]), ("2", "z.py", "def u():", ["import sys"]), ("3", None, "def v():", None)], "task_id string, own_path string, prompt string, imports array<string>")
    hits = [("1", "function", "a.py", "def f(): 1", 1), ("1", "class", "m.py", "class M: 1", 2), ("1", "variable", "b.py", "V = 1", 3), ("1", "class", "a.py", "class A: 1", 4), ("1", "other", "c.py", "no", 5), ("1", "class", "d.py", None, 6), ("2", "class", "a.py", "class A: 1", 1)]
    got = {r["task_id"]: r["prompt"] for r in R.structured_prompts(tasks, spark.createDataFrame(hits, "task_id string, cand_type string, relative_path string, source_code string, rank int")).collect()}
    lines = ["#FILE: a.py", "class A: 1", "", "def f(): 1", "", "#FILE: b.py", "V = 1", "", "#FILE: d.py", "", "", "#CURRENT FILE: m.py", "import os", "from a import b", "", "class M: 1", ""]
    assert got["1"] == "\n".join([R.PROMPT_HEADER, *lines, R.PROMPT_FOOTER, "def t():"])
    assert got["2"] == "\n".join([R.PROMPT_HEADER, "#FILE: a.py", "class A: 1", "", R.PROMPT_FOOTER, "def u():"]) and got["3"] == "\n".join([R.PROMPT_HEADER, R.PROMPT_FOOTER, "def v():"])


def test_index_follows_packages(spark):
    """Names of a package's submodules, packages as modules, and imports that are not used as noise."""
    files = [("r", "pkg/__init__.py", "TOP = 1\n"), ("r", "pkg/deep.py", "def hid():\n    return 1\n\n\ndef spare():\n    return 2\n"), ("r", "use.py", "import pkg\nfrom pkg import hid, spare\n\n\ndef go():\n    return 3\n")]
    g = {r["id"]: r for r in Engine(spark).index(spark.createDataFrame(files, "repo string, path string, code string")).collect()}
    assert g["go@use.py"]["noise"]["functions"] == ["hid@pkg/deep.py", "spare@pkg/deep.py"] and g["hid@pkg/deep.py"]["noise"]["functions"] == ["spare@pkg/deep.py"]


def test_training_pairs_and_metrics(spark, graph):
    e = Engine(spark)
    pairs = e.training_pairs(graph).where("id = 'run@main.py'").collect()
    assert {(p["cand_id"], p["label"]) for p in pairs} == {("bonus@extra.py", 1), ("read_rows@util.py", 1), ("Job@main.py", 1), ("LIMIT@util.py", 1), ("other@main.py", 0)}
    target, context = next(p["text"] for p in pairs if p["cand_id"] == "read_rows@util.py").split("</s>")
    assert json.loads(target)["name"] == "run@main.py" and json.loads(context)["description"] == "Reads rows of a file."
    r = spark.createDataFrame([("1", True), ("1", False), ("2", False), ("2", None)], "task_id string, passed boolean")
    assert {x["k"]: x["pass_at_k"] for x in e.evaluate(r, (1, 2, 3)).collect()} == {1: 0.25, 2: 0.5, 3: None}
    w = e.windows(spark.createDataFrame([("r", "a.py", "x\ny"), ("r", "b.py", "x\ny")], "repo string, path string, code string")).collect()
    assert len(w) == 1 and len(w[0]["places"]) == 2


def test_tables(spark):
    c = T.with_defaults(spark.createDataFrame([("f@a.py", None)], "id string, docstring string")).first()
    assert c["docstring"] == "DOCSTRING" and c["out_count"] == 0
    tasks = spark.createDataFrame([("n.b", "p", "a.py", [1, 1], [2, 3]), ("n.a", "p", "a.py", [1, 2], [3, 3])], "namespace string, project_path string, completion_path string, signature_position array<int>, body_position array<int>")
    x = {r["namespace"]: r for r in T.with_positions(tasks, spark.createDataFrame([("a.py", "l1\nl2\nl3")], "path string, code string")).collect()}
    assert x["n.b"]["ground_truth"] == "l2\nl3" and x["n.a"]["task_id"] == "p/0" and x["n.b"]["task_id"] == "p/1"
    raw = spark.createDataFrame([((("7",)), "p", [("a",), ("b",)])], "metadata struct<task_id:string>, prompt string, choices array<struct<text:string>>")
    assert T.predictions(raw).first()["response"] == ["a", "b"]
    e = spark.createDataFrame([("a.in", "b"), ("a", "b"), ("a.in", "a")], "src string, dst string")
    assert [(r["src"], r["dst"]) for r in T.collapse_inner(e, spark.createDataFrame([("a.in", "a")], "id string, parent string")).collect()] == [("a", "b")]
    old, new = spark.createDataFrame([("x", 1), ("y", 1)], "p string, v int"), spark.createDataFrame([("y", 2)], "p string, v int")
    assert {(r["p"], r["v"]) for r in T.refreshed(old, new, ["p"]).collect()} == {("x", 1), ("y", 2)}
    rows = T.by_position(spark.createDataFrame([(1, "g")], "n int, g string"), spark.createDataFrame([("b",), ("a",)], "s string"), F.col("n"), "s").first()
    assert rows["s"] == "b"
    with pytest.raises(Exception, match="comes twice"):
        T.regrouped(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"], "v").collect()
    n = T.nested_candidates(spark.createDataFrame([("1", "f", "function", "p", "c", "d", 0)], "task_id string, cand_id string, cand_type string, relative_path string, source_code string, dar_sample string, ord int"), "task_id").first()
    assert n["candidate"]["function"]["f"]["source_code"] == "c"
