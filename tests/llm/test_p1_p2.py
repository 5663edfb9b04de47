import numpy as np
import pandas as pd
import pytest

from quarrykit.llm import p1_handwritten as p1
from quarrykit.llm import p2_pairs as p2

BODY = "\n\n".join(
    f"def {n}(ctx, limit):\n    {a} = ctx.load('{n} {a}', {k})\n    if {a} is None:\n        raise ValueError('{a}')\n    return {a}.merge({b}, limit={k * 7})"
    for n, a, b, k in [("one", "alpha", "beta", 11), ("two", "gamma", "delta", 23), ("three", "rho", "tau", 37), ("four", "zeta", "eta", 41), ("five", "mu", "nu", 53), ("six", "pi", "xi", 67)]
)
STUBS = "\n\n".join(f"def get_item_{i:03}(x):\n    return _rt.call({i * 977 % 99991}, x)" for i in range(40))


def files(spark, rows):
    schema = "file_no bigint, repo string, file_path string, relative_path string, code string, origin string, tokens int, phrase string"
    return spark.createDataFrame([(n, r, "/x/" + (p or ""), p, c, "clash", 1, "clash") for n, r, p, c in rows], schema)


def test_grammar_tells(spark):
    """What the grammar alone tells, in a corpus too small to learn marks from."""
    rng = np.random.default_rng(1)
    blob = "DATA = b'" + "".join(f"\\x{b:02x}" for b in rng.integers(0, 256, 800)) + "'\n"
    mini = "!function(){" + "".join(f"function {c}(e,f){{return e.m{c}(f)}}" for c in "abcdefghijklmnopqrstuvwxyz") + "}();"
    hand = "\n\n".join(
        f"def {''.join(rng.choice(list('abcdefgh'), 6))}(a, b):\n" + "".join(f"    {x} = {y}" for x, y in zip(rng.permutation(["u", "v", "w", "q"]), rng.permutation(["a + b\n", "[i for i in b]\n", "f(a, k=3)\n", "{'x': a}\n"]))) for _ in range(3))
    words = "WORDS = {\n" + "".join(f'    "{rng.integers(10**9)}": "w{rng.integers(10**9)}",\n' for _ in range(400)) + "}\n"
    rows = [
        (1, "a", "src/x.py", "# This file was produced by tool; do not edit.\n" + hand), (2, "a", "src/autogen_report.py", hand.replace("a + b", "a - b * 2")), (3, "a", "src/s.py", STUBS), (4, "a", "src/b.py", blob), (5, "a", "web/m.js", mini),
        (6, "a", "src/lib/shared.py", BODY.replace("ctx", "env").replace("limit", "cap")), (7, "b", "pkg/shared2.py", "# other head\n" + BODY.replace("ctx", "env").replace("limit", "cap")),
        (8, "b", "vendor/lib-1.2/core.py", "x = 1\n"), (9, "b", "words.py", words), (10, "b", "a.py", None), (11, "b", "b.py", ""),
        (12, "b", "w.py", "# Do not edit the generated index by hand, change this writer instead.\ndef w():\n    return 1\n"), (12, "b", "w.py", "# Do not edit the generated index by hand, change this writer instead.\ndef w():\n    return 1\n"),
        (13, None, None, "z = 3"), (14, "b", "p.min.py", "\n".join(f"def {a}(b,c,d):b=c[d];d=[b for b in c if b>{n}];c=lambda d:d^{n};b+=d(c,{n});" * 4 for n, a in enumerate("fghijklmno"))),
    ]
    got = {r["file_no"]: r["origin"] for r in p1.origins(files(spark, rows)).collect()}
    assert len(got) == 14
    assert got[3] == "generated" and got[4] == got[9] == "data" and got[5] == got[14] == "minified" and got[6] == got[7] == "vendored"
    assert all(got[n] is None for n in (1, 2, 8, 10, 11, 12, 13))
    assert p1.origins(files(spark, [])).count() == 0


def _hand(rng, n=9):
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(60)]
    w = lambda: words[rng.integers(60)]
    forms = ["    {0} = {1}.{2}({3})", "    if {0} is None:\n        raise {1}('{2} {3}')", "    for {0} in {1}:\n        {2}.append({0})", "    {0}, {1} = {2}['{3}'], 7", "    while {0} < 10:\n        {0} += {1}", "    with {0}({1}) as {2}:\n        {3} = {2}.read()"]
    return "\n\n".join(f"def {w()}_{w()}({w()}, {w()}=None):\n" + "\n".join(forms[rng.integers(6)].format(w(), w(), w(), w()) for _ in range(rng.integers(2, 7))) + f"\n    return {w()}" for _ in range(n))


@pytest.mark.parametrize("licence", [0, 30])
def test_marks_are_learned(spark, licence):
    """Notices and names of told files mark files that read like any other, behind a licence of any length; words about them don't."""
    rng = np.random.default_rng(5)
    top = "".join(f"# clause {i} of the terms\n" for i in range(licence))
    rows, n = [], 0
    for i in range(60):  # told by their grammar, half of them with a notice
        rows.append((n := n + 1, f"r{i % 7}", f"src/{i}/s_autogen.py", (f"# Code emitted by tool{i} from x.proto; do not touch.\n" if i % 2 else "") + STUBS.replace("item", f"i{i}")))
    told = n
    for i in range(40):  # hand-written in form, with a notice
        rows.append((n := n + 1, f"r{i % 7}", f"pkg/m{i}.py", top + f"# Code emitted by tool{100 + i} from y.proto; do not touch.\n" + _hand(rng)))
    for i in range(30):  # by the name alone
        rows.append((n := n + 1, f"r{i % 7}", f"pkg/n{i}_autogen.py", _hand(rng)))
    marked = n
    for i in range(40):  # about such files
        rows.append((n := n + 1, f"r{i % 7}", f"pkg/o{i}.py", "# This writer makes code; do not touch what it emitted, change the writer.\n" + _hand(rng)))
    for i in range(500):
        rows.append((n := n + 1, f"r{i % 7}", f"src/{i}/p{i}.py", (top or "# Copyright somebody\n") * (i % 2) + _hand(rng)))
    got = {r["file_no"]: (r["grammar_origin"], r["origin"]) for r in p1.origins(files(spark, rows)).collect()}
    assert all(got[i] == ("generated", "generated") for i in range(1, told + 1))
    assert all(got[i] == (None, "generated") for i in range(told + 1, marked + 1))
    assert all(got[i] == (None, None) for i in range(marked + 1, n + 1))


@pytest.mark.parametrize("edited", [False, True])
def test_copies_between_variants(spark, edited):
    """The first and the last holder of every rule are variants that hold a part of the file each; the copies lie between them."""
    rng = np.random.default_rng(3)
    parts = ["\n".join(f"def f{i}_{k}(x{rng.integers(999)}):\n    y{k} = load(x, 'k{rng.integers(9999)}') + {rng.integers(9999)}\n    return y{k}.merge(z{rng.integers(999)}, w={rng.integers(99)})" for k in range(9)) for i in range(20)]
    whole = "\n\n".join(parts)
    other = "\n\n".join(parts[:9] + ["def ours():\n    return 1"] + parts[10:]) if edited else whole
    rows = [(1, "a", "x.py", "\n\n".join(parts[7:])), (2, "m", "p.py", whole), (3, "n", "q.py", other), (4, "z", "y.py", "\n\n".join(parts[:13])), (5, "m", "again.py", whole), (6, "n", "short.py", "\n\n".join(parts[8:10]))]
    got = {r["file_no"]: r["shared"] for r in p1.copies(p1.features(files(spark, rows))).collect()}
    assert {n for n, share in got.items() if share >= p1.COPIED_SHARE} == {2, 3, 5} and all(got[n] > 0.8 for n in (2, 3, 5))


def test_repair_counts_rules():
    # abab abab: R1=ab, R2=R1R1, sequence R2R2 -> 2 symbols and 2 rules of 2
    seq, owner = np.array([1, 2] * 4 + [5, 6, 7], np.uint64), np.array([0] * 8 + [1] * 3)
    reuse = p1.repair_reuse(seq, owner, 2)
    assert reuse[0] > 1.2 and reuse[1] == 1


def test_blob_bits():
    rng = np.random.default_rng(2)
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    b64 = "".join(np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))[rng.integers(0, 64, 400)])
    words = "".join(np.array(["path", "order", "index", "cache", "token", "value"])[rng.integers(0, 6, 90)])
    bits = p1.blob_bits([code(b64), code(words), code(""), code("aaaa" * 50)])
    assert bits[0] >= p1.INCOMPRESSIBLE and (bits[1:] < p1.INCOMPRESSIBLE).all()
    text, raw = p1.blob_text(["'" + "\\x0f\\xa1" * 20 + "'", "'short'", "'" + "long words with spaces " * 9 + "'"])
    assert raw == 160 and len(text) == 40


MODEL_ROWS = [
    ("en", "the value of this function is returned when the buffer has been read and it is not empty"), ("de", "die funktion gibt den wert zurück sobald der puffer gelesen wurde und er nicht leer ist"),
    ("fr", "la fonction renvoie la valeur dès que le tampon a été lu et il ne faut pas ouvrir"), ("es", "la función devuelve el valor en cuanto el búfer se ha leído por completo y no se debe abrir"), ("zh", "如果找不到缓存系统会使用默认的配置并记录错误"),
    ("python", "    with open(path) as f:\n        lines = f.readlines()[:limit]\n    for x in lines:\n        if x is None:\n            raise ValueError(x)\n    return lines"),
    ("code", "function load(path, limit) {\n  if (!path) { return null; }\n  const x = path.map(v => v.a);\n  for (let i = 0; i < limit; i++) { x.push(i); }\n  return x;\n}"),
] * 20
GOOD = ["    x = load(path)\n    return x", "    return path", "    with open(path) as f:\n        return f.readlines()[:limit]", "It gives back the lines of the file.", "def f(a):\n    return a", "```python\ndef f(a):\n    return a\n```"]


@pytest.fixture(scope="module")
def model():
    return p2.fit_languages(MODEL_ROWS)


@pytest.fixture(scope="module")
def ends(spark):
    rows = [(g,) for g in GOOD for _ in range(40)]
    return p2.count_ends(spark.createDataFrame(rows, "answer string"))


PROMPT = "Write the body of this function.\n\ndef load(path, limit):\n    \"\"\"Read the file at path and give back no more lines than limit allows.\"\"\""
COURTESY = "Thank you for the detailed prompt and for the time that went into the description of what the function is meant to give back in every case. " * 3


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("​", "empty"), ("    pass\n", "empty"), ("```python\n```", "empty"), ("# TODO: implement", "empty"), ("    # your code here\n    pass\n", "empty"),
        ("# TODO: implement\n" * 500, "empty"),
        ("I'm sorry, but I can't help with that.", "refusal"), ("# I won't be able to finish this one, sorry.", "refusal"), ("Leider darf ich diese Funktion nicht schreiben.", "refusal"), ("No can do.", "refusal"), (COURTESY + "But I cannot write this.", "refusal"),
        (PROMPT, "copy"), ("Write the body of this function.", "copy"), ("def load(path, limit):\n    \"\"\"Read the file at path and give back no more lines than limit allows.\"\"\"", "copy"),
        ("function load(path, limit) {\n  if (!path) { return null; }\n  const x = path.map(v => v.a);\n  return x;\n}", "other_language"), ("La función devuelve el valor en cuanto el búfer se ha leído por completo.", "other_language"),
        ("    with open(path) as f:\n        return f.readlines()[:lim", "truncated"), ("    x = load_all(path", "truncated"), ("```python\ndef f(a):\n    return a", "truncated"), ("It gives back the lines of", "truncated"), ("    x = path\n    y =", "truncated"),
        ("    with open(path) as f:\n        return f.readlines()[:limit]", None), ("    # I cannot guarantee the order here\n    return path", None), ("    return path", None), ("It gives back the lines of the file.", None),
    ],
)
def test_defect(model, ends, answer, want):
    assert p2.batch_defects([answer], [PROMPT], model, ends) == [want]


def test_ends_decide(spark, model, ends):
    """The same answers: where unfinished ends are usual, they are likely, and no candidates; the exact check alone finds nothing."""
    cut = "    x = load_all(path"
    usual = p2.count_ends(spark.createDataFrame([(cut,)] * 40, "answer string"))
    assert p2.batch_defects([cut], [PROMPT], model, ends) == ["truncated"] and p2.batch_defects([cut], [PROMPT], model, usual) == [None]
    who, gram, last = p2.end_grams(["a b", "", "f(x", "f(x)"])
    assert who[last].tolist() == [0, 2, 3] and len(set(gram[last].tolist())) == 3
    one = [p2.end_grams([t])[1].tolist() for t in ("a = 'b", "x(1)\ny", "```\nz")]
    both = p2.end_grams(["a = 'b", "x(1)\ny", "```\nz"])[1].tolist()
    assert both == one[0] + one[1] + one[2]


def test_last_grams(spark):
    rng = np.random.default_rng(7)
    parts = ["word ", "x", "(", ")", "'", '"', "\n", "```", " ", "9.5", "return ", "def f(a):\n    ", "…", "é" * 9, "w" * 99, "[", "]", "=", "   "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)]
    who, gram, last = p2.end_grams(texts)
    want = np.full(len(texts), -1)
    want[who[last]] = gram[last]
    assert (p2.last_grams(texts) == want).all()


def test_posteriors_whole_batches(model):
    """A batch gives what its texts give alone, whatever the size of blocks."""
    texts = ["die funktion gibt den wert zurück", "", "the value is returned", "x", "如果找不到缓存系统", "def f(a):\n    return a"]
    got = p2.posteriors(model, texts)
    for t, row in zip(texts, got):
        assert np.allclose(p2.posteriors(model, [t])[0], row, equal_nan=True)
    lang = [p2.LANGUAGES[int(r.argmax())] if not np.isnan(r[0]) else None for r in got]
    assert lang == ["de", None, "en", None, "zh", "python"]


def test_sample_of_texts(spark, monkeypatch):
    """Each text once and whole, the least hashes, however many copies there are."""
    monkeypatch.setattr(p2, "SAMPLE", 40)
    texts = [f"die funktion gibt den wert zurück sobald der puffer {w} gelesen wurde und er nicht leer ist" + " und dann" * n * 10 for n, w in enumerate("abcdefghijklmnopqrstuvwxyz" + "äöüß")]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    assert p2.sample_texts(frame(texts * 3 + texts[:1] * 60 + [None, "short"])) == sorted(texts)
    assert {lang for lang, _ in p2.labelled(texts)} == {"de"}
    monkeypatch.setattr(p2, "SAMPLE", 7)
    assert len(set(p2.sample_texts(frame(texts * 3 + texts[:1] * 60)))) == 7 and p2.sample_texts(frame([])) == []


def test_defects_tables(spark):
    g = spark.createDataFrame(
        [("1", PROMPT, ["    return path", None], "m", "clash"), ("1", PROMPT, ["    return path", None], "m", "clash"), ("2", None, ["", "x = (1,"], None, "c"), ("3", PROMPT, None, "m", "c"), ("4", PROMPT, [], "m", "c"), ("5", PROMPT, ["word " * 60000 + "end."], "m", "c")],
        "task_id string, prompt string, response array<string>, model string, defect string",
    )
    e = spark.createDataFrame([(1, 0, "    return limit", True), (2, 1, None, False)], "task_id int, prediction_id int, generation string, passed boolean")
    got = {(r["src"], r["task_id"], r["answer_no"]): r["defect"] for r in p2.defects(g, e).collect()}
    assert got == {("response", "1", 1): "empty", ("response", "2", 0): "empty", ("response", "2", 1): "truncated", ("generation", "2", 1): "empty"}
    assert p2.defects(g.limit(0), e.limit(0)).count() == 0
