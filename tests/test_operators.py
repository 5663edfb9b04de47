import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions.paths import id_path, normal_path
from quarrykit.operators import dependencies as D
from quarrykit.operators import metrics as M
from quarrykit.operators import retrieval as R
from quarrykit.operators import sampling as S
from quarrykit.operators import windows as W
from quarrykit.operators.components import connected_components
from quarrykit.plans import graph_queries


def okapi(docs, query):
    toks = [d.split() for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for q in query.split()) for t in toks]


def test_bm25_is_okapi(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    docs = [(t, i, " ".join(rng.choices(words, k=rng.randrange(0, 20)))) for t in "ab" for i in range(15)] + [("b", 99, "")]
    queries = [("a", "w1 w1 w2  zz\tw3"), ("b", "w4 w5"), ("c", "w1")]
    got = {(r["task"], r["doc"]): r["score"] for r in R.bm25(spark.createDataFrame(docs, "task string, doc int, text string"), spark.createDataFrame(queries, "task string, query string"), "task", "doc", "text", "query").collect()}
    for task, q in queries[:2]:
        mine = [d for d in docs if d[0] == task]
        for d, want in zip(mine, okapi([x[2] for x in mine], q)):
            assert got[task, d[1]] == pytest.approx(want, abs=1e-9)
    assert len(got) == len(docs)


def test_top_k_orders_ties(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, None), ("a", 2, 2.0), ("a", 4, float("nan"))], "t string, d int, s double")
    assert [(r["d"], r["rank"]) for r in R.top_k(df, "t", "s", 3, "d").orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_nearest_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    x[7] = x[3]
    x[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, v array<double>").repartition(5)
    got = defaultdict(list)
    for r in R.nearest(df, df.where("id % 10 = 0"), "id", "v", 4).orderBy("query", "rank").collect():
        got[r["query"]].append(r["key"])
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    for q in range(0, 80, 10):
        sims = np.round(unit @ unit[q], 12)
        assert got[q] == sorted((k for k in range(80) if k != q), key=lambda k: (-sims[k], k))[:4]


def test_hybrid_places(spark):
    a = spark.createDataFrame([("t", 1, 9.0, 1), ("t", 2, 8.0, 2)], "t string, c int, score double, rank int")
    b = spark.createDataFrame([("t", 2, 0.5, 1), ("t", 7, 0.4, 2)], "t string, c int, score double, rank int")
    got = [(r["c"], r["score"], r["source"]) for r in R.hybrid(a, b, ["t", "c"], "t").orderBy("place").collect()]
    assert got == [(1, 9.0, "bm25"), (2, 0.5, "classifier"), (7, 0.4, "classifier")]


def py_windows(text, ws, ss):
    xs = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if xs and xs[-1] == "":
        xs.pop()
    return [(c, max(0, c - ws // 2), min(len(xs), c + ws - ws // 2), "\n".join(xs[max(0, c - ws // 2) : min(len(xs), c + ws - ws // 2)])) for c in range(0, len(xs), max(1, ws // ss))]


@pytest.mark.parametrize("ws, ss", [(20, 2), (5, 3), (1, 1)])
def test_windows(spark, ws, ss):
    texts = {1: "\n".join(f"l{i}" for i in range(47)) + "\n", 2: "a", 3: "", 4: "x\r\ny\rz\n\n", 5: None}
    df = spark.createDataFrame(list(texts.items()), "f int, code string")
    got = defaultdict(list)
    for r in W.sliding(df, "code", ws, ss).orderBy("f", "line_no").collect():
        got[r["f"]].append((r["line_no"], r["start_line_no"], r["end_line_no"], r["context"]))
    assert dict(got) == {k: py_windows(v, ws, ss) for k, v in texts.items() if v}


def test_other_windows(spark):
    t = "\n".join(f"l{i}" for i in range(10))
    df = spark.createDataFrame([(t, "p0\n\np1\np2")], "t string, p string")
    r = df.select(W.without_lines(F.col("t"), 2, 4).alias("cut"), W.trailing(F.col("t"), F.lit(6), F.lit(4), 5).alias("tr"), W.centred(F.col("t"), F.lit(5), F.lit(0), 4, 2).alias("ce"), W.prediction(F.col("t"), F.col("p"), F.lit(5), F.lit(0), 4, 2).alias("pr")).first()
    assert r["cut"].split("\n") == ["l0", "l4", "l5", "l6", "l7", "l8", "l9"] and r["tr"] == "l4\nl5" and r["ce"] == "l3\nl4\nl5\nl6" and r["pr"] == "l3\nl4\np0\np1"


def test_merged_windows(spark):
    df = spark.createDataFrame([("r", 2, 0, "x"), ("r", 1, 5, "x"), ("r", 1, 0, "y"), ("s", 1, 0, "x")], "repo string, f int, line int, context string")
    got = {(r["repo"], r["context"]): [(p["f"], p["line"]) for p in r["places"]] for r in W.merged(df, ["repo"], ["f", "line"], []).collect()}
    assert got == {("r", "x"): [(1, 5), (2, 0)], ("r", "y"): [(1, 0)], ("s", "x"): [(1, 0)]}


@pytest.mark.parametrize("n, c, k", [(10, 0, 1), (10, 3, 1), (10, 3, 5), (5, 5, 3), (4, 3, 2), (2, 1, 1), (2, 1, 2)])
def test_pass_at_k(spark, n, c, k):
    want = 1 - math.comb(n - c, k) / math.comb(n, k)
    assert spark.range(1).select(M.pass_at_k(F.lit(n), F.lit(c), k).alias("v")).first()["v"] == pytest.approx(want)


def test_bleu():
    assert M.bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)
    assert M.bleu(["a"], []) == 0 and 0 < M.bleu("a b c d".split(), "a x c d".split()) < 1


def test_metrics_edge_cases(spark):
    empty = spark.createDataFrame([], "y int, p int")
    assert M.classification_report(empty, F.col("y"), F.col("p")).count() == 1
    r = spark.range(1).select(M.set_recall(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>")).alias("none"), M.set_recall(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("empty")).first()
    assert r["none"] == 0 and r["empty"] is None
    v = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, None, 2), (2, None, 0)], "t int, a string, o int")
    assert [(r["t"], r["a"]) for r in M.majority(v, "t", "a", "o").collect()] == [(1, "b")]


@pytest.mark.parametrize("total", [0, 1, 7, 1000])
def test_split_sizes(spark, total):
    got = Counter(r["split"] for r in S.random_split(spark.range(total), "id").collect())
    assert got["train"] == int(total * 0.8) and got["train"] + got["valid"] == int(total * 0.9) and sum(got.values()) == total


def test_downsample_and_pack(spark):
    df = spark.createDataFrame([(i, 0 if i < 70 else 1 if i < 90 else None) for i in range(100)], "id int, label int")
    assert Counter(r["label"] for r in S.downsample(df, "label", "id").collect()) == {0: 20, 1: 20}
    rows = spark.createDataFrame([(i, i % 7 * 10) for i in range(500)] + [(999, 500), (1000, None)], "id int, n int")
    packs = defaultdict(int)
    got = sorted(map(tuple, S.pack(rows, "n", "id", 100, 20).collect()))
    for _, tokens, name in got:
        packs[name] += tokens
    assert sum(v > 100 for v in packs.values()) == 1 and sum(packs.values()) == sum(r["n"] or 0 for r in rows.collect()) and len(got) == 502 and len(packs) < 220
    # the packs are the same however rows lie in parts
    assert got == sorted(map(tuple, S.pack(rows.repartition(7), "n", "id", 100, 20).collect())) and S.pack(rows.limit(0), "n", "id", 100).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(0, i) for i in range(40)] + [(5, 5)] + [(i, i + 1) for i in range(200, 260)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want


@pytest.mark.parametrize("path, want", [("./a/b.py", "a/b.py"), ("a//b.py", "a/b.py"), ("a\\b.py ", "a/b.py"), ("a/x/../b.py", "a/b.py"), ("a/./b.py", "a/b.py"), ("../a.py", "a.py"), ("", ""), (None, None)])
def test_paths(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(normal_path(F.col("p")).alias("v")).first()["v"] == want
    assert df.select(id_path(F.concat(F.lit("n@"), "p")).alias("v")).first()["v"] == want


def component(spark, rows):
    calls = "struct<classes:array<string>,functions:array<string>,variables:array<string>>"
    return spark.createDataFrame([(r, i, t, ([], fs, []), ([], [], [])) for r, i, t, fs in rows], f"repo string, id string, component_type string, outgoing_calls {calls}, noise {calls}")


def test_dependencies(spark):
    c = component(spark, [("r", "A@a.py", "class", []), ("r", "A.m@a.py", "method", ["f@a.py", "zz@q.py", "f@a.py"]), ("r", "f@a.py", "function", []), ("r", "g@a.py", "function", ["f@a.py"]), ("r", "V@a.py", "variable", [])])
    noise = {(x["id"], x["noise_id"]) for x in D.noise(c).collect()}
    assert ("A.m@a.py", "A@a.py") not in noise and ("A.m@a.py", "f@a.py") not in noise and ("A.m@a.py", "g@a.py") in noise and not any(n == "V@a.py" for _, n in noise)
    cand = D.candidates(c, ["repo", "id"], c.select("repo", F.col("id").alias("dst_id"))).collect()
    assert sorted((x["id"], x["dst_id"]) for x in cand) == [("A.m@a.py", "f@a.py"), ("g@a.py", "f@a.py")]
    raw = spark.createDataFrame([("r", "s", "f@a.py"), ("r", "s", "g@a"), ("r", "s", "none@a.py")], "repo string, src_id string, ref string")
    assert {(x["ref"], x["id"]) for x in D.resolve(raw, c).collect()} == {("f@a.py", "f@a.py"), ("g@a", "g@a.py")}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(x["root"], x["node"]): x["depth"] for x in D.reachable(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3}


def test_reachability_of_long_chains(spark, tmp_path):
    """Every node of a chain of 12 calls is reached, and a safety limit that is hit raises."""
    c = component(spark, [("r", f"f{i}@a.py", "function", [f"f{i + 1}@a.py"]) for i in range(12)]).withColumn("comp_no", F.monotonically_increasing_id())
    c.write.parquet(f"{tmp_path}/component.parquet")
    got = {x["root"]: (x["nodes"], x["depth"]) for x in graph_queries.reachability(spark, str(tmp_path)).collect()}
    assert got == {f"r:f{i}@a.py": (13 - i, 12 - i) for i in range(12)}
    e, root = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("a",)], "node string")
    assert D.reachable(e, root, 2).count() == 3
    with pytest.raises(RuntimeError):
        D.reachable(e, root, 1)
