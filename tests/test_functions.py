import json
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import callgraph as CG
from quarrykit.functions import code_index as CI
from quarrykit.functions import diffs, execution, models
from quarrykit.functions import responses as P
from quarrykit.functions import text as T
from quarrykit.functions import vectors as V
from quarrykit.operators.hierarchy import merged
from quarrykit.plans import tasks
from quarrykit.sources import files, names, sinks
from quarrykit.streaming import log

CODE = '''import os
import pkg.tools as pt
from .base import Base as B, helper
from util import *

LIMIT = 3
A, C = 1, 2
X: int = 4


class Leaf(B):
    """A leaf."""

    def run(self, n):
        item = Leaf()
        item.stop()
        helper(n)
        pt.build(n)
        return self.stop() + super().run(n)

    def stop(self):
        def inner(q):
            return q
        return inner(LIMIT)


@deco
def make(
    a, b: dict = {"x": ":"},
):
    return Leaf()
'''
BASE = "class Base:\n    def run(self, n):\n        return n\n\n    def stop(self):\n        pass\n\n\ndef helper(n):\n    return n\n"


def test_components():
    rows = {r[2]: r for r in CI.file_components("r", "d/m.py", CODE)}
    assert set(rows) == {"LIMIT@d/m.py", "Leaf@d/m.py", "Leaf.run@d/m.py", "Leaf.stop@d/m.py", "stop.inner@d/m.py", "make@d/m.py"}
    assert rows["Leaf@d/m.py"][9] == "A leaf." and rows["make@d/m.py"][9] == "DOCSTRING" and rows["make@d/m.py"][10] == 'def make( a, b: dict = {"x": ":"}, ):'
    assert rows["make@d/m.py"][6] == CODE[: CODE.index("@deco")].count("\n") + 1
    assert CI.file_components("r", "x.py", "def f(:") == []


def test_imports_and_references():
    imports = {(r[2], r[3], r[4], r[5], r[7]) for r in CI.file_imports("r", "d/m.py", CODE)}
    assert ("from", "d/base.py", "Base", "B", "from .base import Base as B") in imports and ("star", "util.py", "*", None, "from util import *") in imports and ("import", "pkg/tools.py", None, "pt", "import pkg.tools as pt") in imports
    refs = {(r[2], r[3], r[4]) for r in CI.file_references("r", "d/m.py", CODE)}
    assert ("Leaf@d/m.py", "Base", "d/base.py") in refs and ("Leaf.run@d/m.py", "helper", "d/base.py") in refs and ("Leaf.run@d/m.py", "build", "pkg/tools.py") in refs
    assert CI.gold_dependencies("import os\ndef used(): pass\ndef other(): pass\n", "def f():\n    return used(os.x)", "f") == ["os", "used"]


def test_call_graph(spark):
    df = spark.createDataFrame([("r", "d/m.py", CODE), ("r", "d/base.py", BASE), ("r", "bad.py", "def ("), ("r", "none.py", None)], "repo string, path string, code string")
    comp = CI.index_components(df).cache()
    bases = CI.index_references(df).where("via = 'base'").select("repo", F.col("src_id").alias("cls_id"), F.concat("name", F.lit("@"), "module").alias("up_id"), "ord")
    got = {(r["caller"], r["chain"], r["callee"]) for r in CG.call_edges(CG.calls(df), comp, bases).collect()}
    assert {("Leaf.run@d/m.py", "helper", "helper@d/base.py"), ("Leaf.run@d/m.py", "self.stop", "Leaf.stop@d/m.py"), ("Leaf.run@d/m.py", "item.stop", "Leaf.stop@d/m.py"), ("Leaf.run@d/m.py", "super.run", "Base.run@d/base.py"),
            ("Leaf.stop@d/m.py", "inner", "stop.inner@d/m.py"), ("make@d/m.py", "Leaf", "Leaf@d/m.py")} <= got


def test_tables_of_one_parse(spark):
    """Each table of one pass equals the table of a pass of its own; files that give none are named."""
    df = spark.createDataFrame([("r", "d/m.py", CODE), ("r", "d/base.py", BASE), ("r", "bad.py", "def ("), ("r", "none.py", None), ("r", "blank.py", "")], "repo string, path string, code string")
    t = CI.index_files(df, {"component": (CI.file_components, CI.COMPONENT_SCHEMA), "reference": (CI.file_references, CI.REFERENCE_SCHEMA), "call": (CG.file_calls, CG.CALL_SCHEMA)})
    for name, alone in (("component", CI.index_components(df)), ("reference", CI.index_references(df)), ("call", CG.calls(df))):
        assert t[name].schema.simpleString() == alone.schema.simpleString() and sorted(map(str, t[name].collect())) == sorted(map(str, alone.collect()))
    assert {(r["path"], r["reason"]) for r in CI.skipped_files(df).collect()} == {("bad.py", "unparsable"), ("none.py", "empty"), ("blank.py", "empty")}


def test_inherited_calls_follow_python(spark):
    """C(A, B) with A(P): run of P comes before that of B, and a hierarchy of 40 classes is followed to its top."""
    code = "class P:\n    def run(self):\n        pass\nclass B:\n    def run(self):\n        pass\nclass A(P):\n    pass\nclass C(A, B):\n    def go(self):\n        self.run()\n"
    tall = "class T0:\n    def up(self):\n        pass\n" + "".join(f"class T{i}(T{i - 1}):\n    pass\n" for i in range(1, 40)) + "class Top(T39):\n    def go(self):\n        self.up()\n"
    df = spark.createDataFrame([("r", "c.py", code), ("r", "t.py", tall)], "repo string, path string, code string")
    bases = CI.index_references(df).where("via = 'base'").select("repo", F.col("src_id").alias("cls_id"), F.concat("name", F.lit("@"), "module").alias("up_id"), "ord")
    got = {(r["caller"], r["callee"]) for r in CG.call_edges(CG.calls(df), CI.index_components(df), bases).collect()}
    assert got == {("C.go@c.py", "P.run@c.py"), ("Top.go@t.py", "T0.up@t.py")}


def test_c3():
    assert merged("D", [["B", "A"], ["C", "A"]], ["B", "C"]) == ["D", "B", "C", "A"] and merged("E", [["A", "B"], ["B", "A"]], ["A", "B"]) is None


def test_text(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n\n", " x  y\n", "1,234.5", "a STOP b END")], "l string, s string, n string, t string")
    r = df.select(T.lines(F.col("l")).alias("l"), T.squeeze(F.col("s")).alias("s"), T.number(F.col("n")).alias("n"), T.before_stop(F.col("t"), ["END", "STOP"]).alias("b"), T.after_last(F.col("t"), "STOP ").alias("al"), T.indented(F.col("l"), 2).alias("i"),
                  T.module_of(F.lit("a/b/__init__.py")).alias("m"), T.wildcard(F.lit("multi-x"), ["multi-*", "y"]).alias("w"), T.json_string(F.lit('é"')).alias("j"), T.hidden(F.lit("a/.git/x")).alias("h")).first()
    assert r["l"] == ["a", "b", "c", ""] and r["s"] == "x y" and r["n"] == 1234.5 and r["b"] == "a " and r["al"] == "b END" and r["m"] == "a.b" and r["w"] and json.loads(r["j"]) == 'é"' and r["h"]


def test_vectors(spark):
    r = spark.range(1).select(V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), V.softmax_positive(F.lit(0.0), F.lit(0.0)).alias("s"), V.argmax(F.array(F.lit(1), F.lit(5), F.lit(5))).alias("a"),
                              V.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1), F.lit(0))).alias("p")).first()
    assert r["c"] == pytest.approx(0.5**0.5) and r["z"] == 0 and r["s"] == 0.5 and r["a"] == 1 and r["p"] == [1.0, 2.0]


def test_responses():
    answer = "Sure.\n```python\nimport os\n\ndef f(a):\n    \"\"\"Doc.\"\"\"\n\n    return a\n\nif __name__ == '__main__':\n    f(1)\n```\nDone."
    assert P.clean_body(answer, "def f(a):") == 'def f(a):\n    """Doc."""\n    return a' and P.body_only(answer, "def f(a):", 8) == "        return a"
    assert P.fenced("x\n```\na\n```\n```\nb\n```", last=True) == "b\n" and P.fenced(None) is None and P.fenced("plain") == "plain"
    assert P.first_block("    return 1\n\nprint(2)") == "    return 1" and P.balanced("f{a{b}c}d") == "f{a{b}c}" and P.beyond_prompt("def f():\n", "def f():\n    pass") == "    pass"
    assert P.splice("a\nb\nc", 1, 2, "X\nY\n") == "a\nX\nY\nc" and P.render_import("m", "x", "y", 2) == "from ..m import x as y"


def test_diffs():
    text, diff = "a\nb\nc\nd", "--- x\n+++ x\n@@ -2,2 +2,3 @@\n b\n-c\n+C\n+C2\n"
    assert diffs.apply(text, diff) == "a\nb\nC\nC2\nd" and diffs.state(text, diff) == "applies" and diffs.state("z", diff) == "misfit" and diffs.state(text, "garbage") == "malformed" and diffs.state(text, " ") == "empty"


def test_execution_is_off_unless_asked(spark, monkeypatch):
    df = spark.createDataFrame([(1, "print(1)"), (2, "raise ValueError('x')"), (3, "while True: pass"), (4, "print(1)")], "id int, program string")
    monkeypatch.delenv(execution.ALLOW, raising=False)
    assert {r["message"] for r in execution.execute(df, "program").collect()} == {"execution is off"}
    monkeypatch.setenv(execution.ALLOW, "1")
    got = {r["id"]: (r["passed"], r["message"]) for r in execution.execute(df, "program", 1.0).collect()}
    assert got[1] == got[4] == (True, "passed") and got[2] == (False, "failed: ValueError: x") and got[3] == (False, "timed out")
    assert execution.spliced_test("a SOL b", "SOL", "X") == "a X b"
    with pytest.raises(ValueError):
        execution.spliced_test("a", "SOL", "X")


def test_models(spark):
    df = spark.createDataFrame([("k", "read the file", "read the file"), ("l", "a", None)], "id string, a string, b string")
    assert np.allclose([np.linalg.norm(r["e"]) for r in df.select(models.embed(F.col("a")).alias("e")).collect()], 1)
    assert {r["id"]: r["predicted"] for r in models.score_pairs(df, "a", "b", least=0.5).collect()} == {"k": True, "l": False}
    assert {r["id"]: list(r["response"]) for r in models.generate(df, "id", "a", lambda: lambda p: [p.upper()] if " " in p else 1 / 0).collect()} == {"k": ["READ THE FILE"], "l": [""]}


def test_tasks(spark):
    assert [t.name for t in tasks.select(["repair*"])] == ["repair", "repair-edit", "repair-parity"]
    t = tasks.REGISTRY["function-completion"]
    df = spark.createDataFrame([("1", " def f():\n", "    return 1\nprint(2)")], "task_id string, prompt string, answer string")
    r = t.programs(t.prompts(df), "answer").first()
    assert r["prompt_text"] == "def f():\n".strip() or r["prompt_text"].strip() == "def f():"
    assert r["program"] == "    return 1"
    v = spark.createDataFrame([("1", "4.0", 0, "4"), ("1", "5", 1, "4"), ("1", "4.0", 2, "4")], "task_id string, answer string, answer_no int, reference string")
    assert tasks.REGISTRY["program-aided-math"].score(v).first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        tasks.register(t)


def test_sources(spark, tmp_path):
    root = tmp_path / "repos"
    for p, t in {"one/a.py": "x = 1", "one/sub/b.py": "y = 2", "two/c.py": "z", "two/d.txt": "no"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "two/bad.py").write_bytes(b"caf\xe9 = 1")
    got = {(r["repo"], r["path"]): r["code"] for r in files.repo_files(spark, str(root)).collect()}
    assert set(got) == {("one", "a.py"), ("one", "sub/b.py"), ("two", "c.py"), ("two", "bad.py")} and got["one", "sub/b.py"] == "y = 2"
    (tmp_path / "g.jsonl").write_text('{"task_id": "1", "prompt": "p", "response": ["a"]}\n\nnot json\n{"task_id": "2"}\n')
    assert files.json_lines(spark, str(tmp_path / "g.jsonl"), files.GENERATION).count() == 2
    good, bad = files.json_lines_with_errors(spark, str(tmp_path / "g.jsonl"), files.GENERATION)
    assert good.count() == 2 and [r["line"] for r in bad.collect()] == ["not json"]
    g = tmp_path / "graphs" / "one"
    g.mkdir(parents=True)
    (g / "graph.json").write_text(json.dumps({"f@a.py": {"id": "f@a.py", "component_type": "function", "outgoing_calls": {"class": [], "function": ["g@a.py"], "variable": []}}, "g@a.py": {"id": "g@a.py"}}))
    x = {r["id"]: r for r in files.graph(spark, str(tmp_path / "graphs")).collect()}
    assert x["f@a.py"]["outgoing_calls"]["functions"] == ["g@a.py"] and x["g@a.py"]["ord"] == 1 and x["f@a.py"]["repo"] == "one"
    assert files.union_graphs(files.graph(spark, str(tmp_path / "graphs"))).count() == 2
    (tmp_path / "results_12.jsonl").write_text('{"task_id": 12, "prediction_id": 0, "passed": true}\n')
    assert files.run_files(spark, str(tmp_path / "results_12.jsonl")).first()["file_task"] == 12
    (tmp_path / "report.csv").write_text('id,module,name,file,doc,markers,status,message,duration\n"a","m","n","f","two\nlines","","passed","",0.5\n')
    assert files.pytest_reports(spark, str(tmp_path / "report.csv")).first()["doc"] == "two\nlines"
    assert names.generations("o", "RepoX") == "o/repox.final.generated.jsonl"


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a.b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a.b", "c", "uses")], "src string, dst string, kind string")
    sinks.lines(sinks.tgf(nodes, edges), str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a__b a.b", "c c", "#", "a__b c uses"]
    assert sinks.dot(nodes, edges).count() == 5 and sinks.yed(nodes, edges).count() == 5
    comp = spark.createDataFrame([("r", "f@a.py", 0), ("r", "g@a.py", 1)], "repo string, id string, ord int")
    sinks.graph(comp, str(tmp_path / "g"))
    (text,) = [open(os.path.join(d, f)).read() for d, _, fs in os.walk(tmp_path / "g") for f in fs if f.endswith(".txt")]
    assert list(json.loads(text)) == ["f@a.py", "g@a.py"]
    sinks.json_lines(comp, str(tmp_path / "j"), gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_resume_and_stream(spark, tmp_path):
    schema, path = "id int, v string", str(tmp_path / "log")
    todo = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema)
    assert log.run_and_append(todo, path, schema, ["id"], lambda d: d) == 2 and log.run_and_append(todo, path, schema, ["id"], lambda d: d) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text('{"id": 2, "v": "b"}\n{"id": 3, "v": "c"}\n{"id": 3, "v": "c"}\n')
    q = log.append_log(log.follow(spark, str(tmp_path / "in"), schema), path, schema, ["id"], lambda d: d, str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == [1, 2, 3]


def test_assembled_programs(spark):
    df = spark.createDataFrame([("p(){\n", "  return 1;\n}\nint main() { return 2; }", "int main() { assert(p()); }")], "p string, c string, t string")
    out = df.select(tasks.assembled("cpp", F.col("p"), F.col("c"), F.col("t")).alias("x")).first()["x"]
    assert out.count("main") == 1 and out.startswith("#include") and out.endswith("int main() { assert(p()); }")
    go = spark.createDataFrame([('import (\n    "math"\n)\nfunc F() int {\n', "    return 1\n}", 'package main\nimport "testing"\nimport "math"\nfunc T() {}')], "p string, c string, t string").select(tasks.assembled("go", F.col("p"), F.col("c"), F.col("t")).alias("x")).first()["x"]
    assert go.count('"math"') == 1 and go.count("package main") == 1 and go.index('"testing"') < go.index("func F") and "import" not in go[go.index("func F") :]
    with pytest.raises(ValueError):
        tasks.assembled("cobol", F.lit(""), F.lit(""), F.lit(""))


def test_suites_never_touch_the_repository(tmp_path):
    (tmp_path / "m.py").write_text("def f():\n    return 1\n")
    (tmp_path / "t_ok.py").write_text("import m\nassert m.f() == 2\n")
    (tmp_path / "t_slow.py").write_text("import time\ntime.sleep(60)\n")
    run = lambda patches, tests, t=20.0: execution.run_suite(str(tmp_path), patches, tests, t, 2048, (sys.executable,))
    assert run([("m.py", 1, 2, "    return 2\n")], ["t_ok.py"]) == "Pass" and run([], ["t_ok.py"]) == "Error" and (tmp_path / "m.py").read_text() == "def f():\n    return 1\n"
    assert run([], ["t_slow.py"], 1.0) == "TimeOut" and run([("../x.py", 0, 0, "")], []) == "Error" and run([("m.py", 5, 99, "")], []) == "Error"


def test_answers_and_guards(spark, monkeypatch):
    assert execution.answer_of("x = 6 * 7", "x") == "42" and execution.answer_of("print('a', 1)") == "a 1" and execution.answer_of("1 / 0", "x") is None
    ok, _, out = execution.run_program(execution.guarded("import os\ntry:\n    os.remove('program.py')\nexcept TypeError:\n    print('held')"))
    assert ok and out.strip() == "held"
    df = spark.createDataFrame([("/nowhere", [], ["t"])], "f string, p array<struct<file:string,start:int,stop:int,text:string>>, t array<string>")
    monkeypatch.delenv(execution.ALLOW, raising=False)
    assert execution.suites(df, "f", "p", "t").first()["status"] is None


def test_saved_datasets(spark, tmp_path):
    for lang in ("py", "go"):
        for split in ("train", "test"):
            spark.createDataFrame([(lang, split)], "lang string, split string").write.parquet(str(tmp_path / "p" / lang / split))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "test.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [tuple(r) for r in files.dataset(spark, str(tmp_path / "p"), "test", "go").collect()] == [("go", "test")]
    assert files.dataset(spark, str(tmp_path / "p"), None, "py").count() == 2 and files.dataset(spark, str(tmp_path / "j"), "test").count() == 2
