import ast
import math
import random
import textwrap
from collections import defaultdict

import pytest

from quarrykit.llm import p6_topn as p6
from quarrykit.llm import p7_docpairs as p7
from quarrykit.llm import p8_tokenize as p8
from quarrykit.llm import p9_leaks as p9
from quarrykit.llm import p10_quality as p10


@pytest.mark.parametrize("n, bands", [(1, 1), (3, 3), (3, 6), (7, 2)])
def test_top_n(spark, n, bands):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", f"g{rng.randrange(60)}", None]), i, rng.choice([None, float("nan"), 0.0, -0.0, -2.5, 1.0, 1.0, rng.random() * 50]), "x", 1) for i in range(1500)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "task_id string, cand_no bigint, bm25_score double, rank string, score int")
    groups = defaultdict(set)
    for g, i, s, *_ in rows:
        if g is not None and s is not None and not math.isnan(s):
            groups[g].add((-s + 0.0, i))
    want = {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n])}
    got = p6.top_n(df, "task_id", "bm25_score", "cand_no", n, bands).collect()
    assert {(r["task_id"], r["cand_no"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert p6.top_n(df.limit(0), "task_id", "bm25_score", "cand_no", n, bands).count() == 0
    assert p6.top_n(df, "task_id", "bm25_score", "cand_no", 0).count() == 0


SOURCES = [
    'def f(a, b: dict[str, int] = {"x": 1}) -> int:\n    """Reads the row."""\n    return a', "async def f():\n    # note\n    r'''Raw \\d text'''\n", 'def f():\n    b"""bytes"""', 'def f():\n    f"""x {1}"""',
    'def f():\n    usage = """x"""', 'def f():\n    ("one "\n     "two")\n    return 1', 'def f():\n    "a" + "b"', 'def f():\n    "abc".strip()', 'def f(): "one line"', "@deco(x=':')\ndef f(\n    a,  # :\n    b=lambda q: q,\n):\n    'esc \\n'\n",
    'def f():\n    def g():\n        """Inner."""\n    return g', "def f():\n    pass", 'def f():\n    ("a", "b")', '    def f(self):\n        """Indented."""\n        return 1', 'def f():\n    "x" "y"; return 1', "def f():\n    42",
]


@pytest.mark.parametrize("source", SOURCES)
def test_own_doc_is_pythons(source):
    node = next(n for n in ast.parse(textwrap.dedent(source)).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    assert p7.own_doc(source) == ast.get_docstring(node, clean=False)


def test_own_doc_of_broken_sources():
    assert p7.own_doc(None) is None and p7.own_doc("") is None and p7.own_doc("def f(:") is None and p7.own_doc('def f():\n    """never closed') is None
    assert p7.own_doc("def f():\n    '''Kept.'''\n    print 'x', 1") == "Kept."


@pytest.mark.parametrize("doc, name, want", [("", "f", True), (" \n ", "f", True), ("TODO: document this", "f", True), ("_summary_", "f", True), ("...", "f", True), ("-", "f", True), ("Load rows.", "load_rows", True), ("load rows()", "C.load_rows", True), ("Loads rows of a table.", "load_rows", False), (None, "f", True)])
def test_trivial(doc, name, want):
    assert p7.is_trivial(doc, name) is want


def test_documented(spark):
    d = '    """%s"""\n'
    rows = [
        (1, "r", "Base@m.py", "class", "Base", "class Base:\n    pass"), (2, "r", "Mid@m.py", "class", "Mid", "class Mid(Base):\n    pass"), (3, "r", "Leaf@n.py", "class", "Leaf", "class Leaf(Mid, Generic[T]):\n    pass"),
        (4, "r", "Base.run@m.py", "method", "run", "def run(self):\n" + d % "Runs the job to its end."), (5, "r", "Mid.run@m.py", "method", "run", "def run(self):\n    return 2"), (6, "r", "Leaf.run@n.py", "method", "run", "def run(self):\n" + d % "See base class."),
        (7, "r", "Leaf.stop@n.py", "method", "stop", "def stop(self):\n    pass"), (8, "r", "f@n.py", "function", "f", "def f():\n" + d % "Counts the open rows."), (8, "r", "f@n.py", "function", "f", "def f():\n" + d % "Counts the open rows."),
        (9, "r", "g@n.py", "function", "g", None), (10, "r", "V@n.py", "variable", "V", "V = '''no'''"), (11, "r", "A@c.py", "class", "A", "class A(B):\n    pass"), (12, "r", "B@c.py", "class", "B", "class B(A):\n    pass"), (13, "r", "A.go@c.py", "method", "go", "def go(self):\n    pass"),
        (14, None, "h@n.py", " Function", None, "def h():\n" + d % ("Long. " * 50000)),
    ]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "comp_no bigint, repo string, id string, component_type string, clean_name string, source_code string, doc string, depth int")
    got = {r["comp_no"]: (r["doc"][:20], r["depth"]) for r in p7.documented(df).collect()}
    assert got == {4: ("Runs the job to its ", 0), 5: ("Runs the job to its ", 1), 6: ("Runs the job to its ", 2), 8: ("Counts the open rows", 0), 14: ("Long. Long. Long. Lo", 0)}
    assert p7.documented(df.limit(0)).count() == 0


COMPONENT = "comp_no bigint, repo string, id string, component_type string, clean_name string, source_code string"


def test_inheritance_is_pythons(spark):
    """Random hierarchies of any height, several bases: the first text in Python's own order of classes."""
    rng = random.Random(3)
    rows, want, n = [], {}, 0
    for f in range(25):
        space: dict = {}
        classes: list[str] = []
        for i in range(rng.randrange(2, 14)):
            bases = rng.sample(classes, min(len(classes), rng.choice([0, 1, 1, 2, 3])))
            name, methods = f"K{i}", [m for m in ("run", "stop", "load") if rng.random() < 0.6]
            head = f"class {name}({', '.join(bases)}{', metaclass=type' if rng.random() < 0.2 and bases else ''}):"
            body = {m: f"    def {m}(self):\n        " + (f'"""Text of {m} in class {name}."""' if rng.random() < 0.35 else "return 1") for m in methods}
            try:
                exec(head + "\n" + ("\n".join(body.values()) or "    pass"), space)
            except TypeError:  # no order
                continue
            classes.append(name)
            rows.append((n := n + 1, "r", f"{name}@f{f}.py", "class", name, head + "\n    ..."))
            for m in methods:
                rows.append((n := n + 1, "r", f"{name}.{m}@f{f}.py", "method", m, textwrap.dedent(body[m])))
                docs = [k.__dict__[m].__doc__ for k in space[name].__mro__ if m in k.__dict__]
                if found := [d for d in docs if d]:
                    want[n] = found[0]
    got = {r["comp_no"]: r["doc"] for r in p7.documented(spark.createDataFrame(rows, COMPONENT)).collect()}
    assert got == want and len(want) > 100


def test_inheritance_by_names(spark):
    """Bases of the same name elsewhere, cycles, brackets in heads, nested classes, tall hierarchies, and no order at all."""
    doc, bare = 'def run(self):\n    """Runs %s to its end."""', "def run(self):\n    return 1"
    rows = [
        (1, "r", "Client@a/base.py", "class", "Client", "class Client:\n    pass"), (2, "r", "Client.run@a/base.py", "method", "run", doc % "base"),
        (3, "r", "Client@b/http.py", "class", "Client", "class Client(base.Client):\n    pass"), (4, "r", "Client.run@b/http.py", "method", "run", bare),
        (5, "r", "Client@c/more.py", "class", "Client", "class Client(nowhere.Client):\n    pass"), (6, "r", "Client.run@c/more.py", "method", "run", bare),
        (7, "r", "P@d.py", "class", "P", "class P:\n    pass"), (8, "r", "P.run@d.py", "method", "run", doc % "P"), (9, "r", "B@d.py", "class", "B", "class B:\n    pass"), (10, "r", "B.run@d.py", "method", "run", doc % "B"),
        (11, "r", "A@d.py", "class", "A", "class A(P):\n    pass"), (12, "r", "C@e.py", "class", "C", "class C(A, with_(x=(1, 2)), B):\n    pass"), (13, "r", "C.run@e.py", "method", "run", bare),
        (14, "r", "X@f.py", "class", "X", "class X(Y):\n    pass"), (15, "r", "Y@f.py", "class", "Y", "class Y(X):\n    pass"), (16, "r", "X.run@f.py", "method", "run", bare), (17, "r", "Z@f.py", "class", "Z", "class Z(X, P):\n    pass"), (18, "r", "Z.run@f.py", "method", "run", bare),
        (19, "r", "Out.In@g.py", "class", "In", "class In(P):\n    pass"), (20, "r", "Out.In.run@g.py", "method", "run", bare), (21, None, "P@h.py", "class", "P", None), (22, "r", "odd", "class", None, "class Odd(P):"), (23, "r", "noclass@h.py", "method", "noclass", bare),
        (24, "r", "W@i.py", "class", "W", "class W(P, A):\n    pass"), (25, "r", "W.run@i.py", "method", "run", bare),
    ]
    tall = [(100 + 2 * i, "t", f"T{i}@t.py", "class", f"T{i}", f"class T{i}(T{i - 1}):\n    pass" if i else "class T0:\n    pass") for i in range(9)]
    rows += tall + [(101, "t", "T0.run@t.py", "method", "run", doc % "T0"), (117, "t", "T8.run@t.py", "method", "run", bare)]
    got = {r["comp_no"]: (r["doc"], r["depth"]) for r in p7.documented(spark.createDataFrame(rows, COMPONENT)).where("depth > 0").collect()}
    assert got == {4: ("Runs base to its end.", 1), 13: ("Runs P to its end.", 2), 20: ("Runs P to its end.", 1), 117: ("Runs T0 to its end.", 8)}


def test_tokenizer_is_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p8.TOKENIZER_DIR + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, "a", " ", "\r\n", "<|endoftext|>", "a" * 5000, " " * 999 + "x", "=-" * 700, "é中🚚" * 90, "The quick brown fox's don't 12345"]
    texts += ["".join(rng.choice(rng.choice(["a", "ab", "the ", "=", "  \n", "é中🚚", "xyz0", "​"])) for _ in range(rng.choice([3, 40, 900]))) for _ in range(60)]
    df = spark.createDataFrame([(i, x, "clash", [0]) for i, x in enumerate(texts)], "doc_id bigint, text string, key string, ids array<int>")
    got = {r["doc_id"]: list(r["ids"]) for r in p8.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert p8.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def brute_leaks(docs, items, least):
    out = set()
    for item, texts in items:
        for t in texts:
            w = [m.group().casefold() for m in p9.normal_words(t or "")[1]]
            want = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
            for doc, body in docs:
                b = [m.group().casefold() for m in p9.normal_words(body or "")[1]]
                if any(tuple(b[i : i + least]) in want for i in range(len(b) - least + 1)):
                    out.add((doc, item))
    return out


def brute_spans(docs, items, least):
    """(document, item) -> (longest, covered): by trying every stretch of words."""
    out = {}
    for item, texts in items:
        have = set()
        for t in texts:
            w = [m.group().casefold() for m in p9.normal_words(t or "")[1]]
            have |= {tuple(w[i:j]) for i in range(len(w)) for j in range(i + least, len(w) + 1)}
        for doc, body in docs:
            b = [m.group().casefold() for m in p9.normal_words(body or "")[1]]
            hits = [(i, j) for i in range(len(b)) for j in range(i + least, len(b) + 1) if tuple(b[i:j]) in have]
            if hits:
                out[doc, item] = (max(j - i for i, j in hits), len({k for i, j in hits for k in range(i, j)}))
    return out


@pytest.mark.parametrize("least", [4, 8])
def test_leaks_against_brute_force(spark, least):
    """The same rows, with true lengths, whatever the size of blocks."""
    rng = random.Random(least)
    voc = [f"w{i}" for i in range(9)]
    items = [(i, [" ".join(rng.choices(voc, k=rng.randrange(0, 40))), rng.choice([None, "", " ".join(rng.choices(voc, k=12))])]) for i in range(20)]
    docs = [(i, " ".join(rng.choice([str.upper, str, lambda x: f"<b>{x}</b>,"])(w) for w in rng.choices(voc, k=rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + i, "some words here " + " ".join((items[i][1][0] or "").split()[:25]) + " and more " + " ".join(items[(i + 1) % 20][1][0].split()[3:20])) for i in range(20)]
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs], "doc_id bigint, text string, item_id int, spans string")
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in items], "id bigint, docstring string, solution string")
    want = brute_spans(docs, items, least)
    assert set(want) == brute_leaks(docs, items, least) and len(want) > 20
    for block in (1, 120, 300_000):
        spans = p9.leaked_spans(d, "doc_id", "text", t, "id", ["docstring", "solution"], least, block)
        assert {(r["doc_id"], r["item_id"]): (r["longest"], r["covered"]) for r in spans.collect()} == want
    left = {r["doc_id"]: r["text"] for r in p9.without_leaks(d, "doc_id", "text", spans, least, 1.0).collect()}
    assert len(left) == len(docs) and left[100] is None
    assert p9.leaked_spans(d.limit(0), "doc_id", "text", t, "id", ["docstring"], least).count() == 0
    assert p9.leaked_spans(d, "doc_id", "text", t.limit(0), "id", ["docstring"], least).count() == 0


def test_leaks_across_long_markup(spark):
    words = [f"word{i}" for i in range(24)]
    tag = '<a href="https://example.org/' + "path/" * 60 + '" title=\'x > y\' hidden>'
    docs = [(1, " ".join(words[:12]) + f" {tag} " + " ".join(words[12:]) + "</a>"), (2, " ".join(words[:12]) + " if a < b and so on " + " ".join(words[12:])), (3, " ".join(words[:19]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = spark.createDataFrame([(7, " ".join(words))], "id bigint, solution string")
    assert [(r["doc_id"], r["item_id"], r["longest"]) for r in p9.leaked_spans(d, "doc_id", "text", t, "id", ["solution"]).collect()] == [(1, 7, 24)]


def test_exact_ranks(spark):
    """Ranks among the rows that count, of the values of all rows; more than half of the rows share a value."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "de"]), rng.choice(["s", "t"]), float(rng.choice([1, 1, 1, 2, rng.randrange(99)])), rng.randrange(2)) for _ in range(3000)]
    got = {(r["lang"], r["stat"], r["value"]): (r["docs"], r["n"], r["below"], r["total"]) for r in p10.exact_ranks(spark.createDataFrame(rows, "lang string, stat string, value double, counts int")).collect()}
    by = defaultdict(list)
    for lang, stat, v, c in rows:
        by[lang, stat].append((v, c))
    assert got == {(*k, x): (sum(y == x for y, _ in v), sum(c for y, c in v if y == x), sum(c for y, c in v if y < x), sum(c for _, c in v)) for k, v in by.items() for x, _ in v}


@pytest.mark.parametrize("heavy", [1000, 0])
def test_scores_against_brute_force(spark, monkeypatch, heavy):
    """The same scores whether common values meet by broadcast or with all others."""
    import numpy as np

    monkeypatch.setattr(p10, "HEAVY_DOCS", heavy)

    rng = np.random.default_rng(8)
    n = 900
    junk = rng.random(n) < 0.3
    cols = {s: np.where(junk, rng.random(n), np.round(rng.random(n) * 0.2, 1)) if p10.TAIL[s] > 0 else np.where(junk, rng.random(n) * 0.3, np.round(0.8 + rng.random(n) * 0.2, 1)) for s in p10.SCORED}
    lang = np.where(rng.random(n) < 0.7, "en", "de")
    rows = [(i, str(lang[i]), 5.0, *[float(cols[s][i]) for s in p10.SCORED]) for i in range(n)]
    stats = spark.createDataFrame(rows, "doc_id bigint, lang string, words double, " + ", ".join(f"{s} double" for s in p10.SCORED))

    def summed(ref):
        out = np.zeros(n)
        for g in ("en", "de"):
            for s in p10.SCORED:
                r = np.sort(cols[s][(lang == g) & ref])
                x = cols[s][lang == g]
                p = (np.searchsorted(r, x, "right") + 1) / (len(r) + 1) if p10.TAIL[s] < 0 else (len(r) - np.searchsorted(r, x, "left") + 1) / (len(r) + 1)
                out[lang == g] -= np.log(np.clip(p, p10.LEAST_TAIL, 1))
        return out

    first = summed(np.ones(n, bool))
    core = np.zeros(n, bool)
    for g in ("en", "de"):
        x = np.sort(first[lang == g])
        core[lang == g] = first[lang == g] <= x[int(np.ceil(len(x) / 2)) - 1] + 1e-12
    want = summed(core)
    got = {r["doc_id"]: r["score"] for r in p10.outlier_scores(stats, "doc_id").collect()}
    assert len(got) == n and np.allclose([got[i] for i in range(n)], want)
    assert want[junk].min() > np.quantile(want[~junk], 0.9)


def test_quality(spark):
    prose = "The reader asks for the page when it is not there, and so we give it what is in the store. " * 4
    table = "\n".join(f"| row_{i} | {i * 7} | ok |" for i in range(40))
    log = "\n".join(f"2024-01-0{i % 9 + 1} 10:00:0{i % 9} INFO job - step {i}" for i in range(40))
    rows = [(1, prose, "en"), (2, table, "en"), (3, prose + "\n\n" + table[:80], "EN "), (4, prose[:90] + "\n\n" + log, None), (5, None, "en"), (6, "  \n", "en"), (7, "", ""), (8, "#$%^ &*() " * 60, "en"), (9, prose * 300, "en"), (9, prose * 300, "en")]
    df = spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "doc_id bigint, text string, lang string, score double, words string")
    stats = {r["doc_id"]: r for r in p10.with_stats(df, "doc_id", "text", "lang").collect()}
    assert stats[5]["words"] is None and stats[6]["words"] is None and stats[3]["lang"] == "en" and stats[4]["lang"] == "und"
    assert all(stats[i]["prose_share"] > 0.7 for i in (1, 3, 9)) and all(stats[i]["prose_share"] < 0.3 for i in (2, 4, 8))
    scores = p10.outlier_scores(p10.with_stats(df, "doc_id", "text", "lang"), "doc_id").collect()
    assert {r["doc_id"] for r in scores} == {1, 2, 3, 4, 8, 9}
    assert p10.outlier_scores(p10.with_stats(df.limit(0), "doc_id", "text", "lang"), "doc_id").count() == 0


def test_quality_without_ordinary_neighbours(spark):
    """A language of logs only, and languages of one document: no neighbour decides what is found."""
    rng = random.Random(6)
    log = lambda n: "\n".join(f"2024-01-0{i % 9 + 1} 10:00:0{i % 9} INFO job{rng.randrange(99)} - step {i * rng.randrange(9)} {'x' * rng.randrange(20)}" for i in range(n))
    prose = "The reader asks for the page when it is not there, and so we give it what is in the store. "
    rows = [(n, log(rng.randrange(3, 90)), "logs") for n in range(60)] + [(100, log(20), "one"), (101, prose * 5, "other"), (102, prose * 9, "logs"), (103, None, "none")]
    stats = p10.with_stats(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    assert sorted(r["doc_id"] for r in p10.found(stats, "doc_id").collect()) == [*range(60), 100]
    assert p10.found(stats.limit(0), "doc_id").count() == 0
