"""Every query on the smallest tables: it runs, and equals its SQL."""

import ast
import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, (np.ndarray, list, dict)):
        return str(v.tolist() if isinstance(v, np.ndarray) else v)
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """Queries without SQL: some rows, and the same ones again. Their values are held against brute force, Python or libraries elsewhere."""
    a, b = (rows(QUERIES[name](spark, sf).toPandas()) for _ in range(2))
    assert a == b and len(a) > 0


def _python_files(duck):
    got = duck.execute("SELECT DISTINCT file_no, repo, relative_path, code FROM source_file WHERE code IS NOT NULL AND relative_path LIKE '%.py'").fetchall()
    for _, repo, path, code in got:
        try:
            yield repo, path, ast.parse(code.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
        except (SyntaxError, ValueError):
            pass


def test_code_tables_against_syntax_trees(spark, sf, duck):
    """Whole tables: definitions with their documentation, imports, and calls of plain names; what a call is resolved to is in the index."""
    comps, imports, plain = set(), Counter(), set()
    for repo, path, tree in _python_files(duck):
        for n in tree.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                comps.add((repo, f"{n.name}@{path}", ast.get_docstring(n)))
            if isinstance(n, ast.ClassDef):
                comps |= {(repo, f"{n.name}.{m.name}@{path}", ast.get_docstring(m)) for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                plain |= {(repo, f"{n.name}@{path}", m.func.id) for m in ast.walk(n) if isinstance(m, ast.Call) and isinstance(m.func, ast.Name)}
        for n in ast.walk(tree):
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                imports.update((repo, path, a.name, a.asname) for a in n.names)
    index = QUERIES["code_index"](spark, sf).toPandas()
    index = index[index.component_type.isin(["function", "class", "method"])]
    assert {(r, i, d if h else None) for r, i, d, h in zip(index.repo, index.id, index.docstring, index.has_docstring)} == comps and len(comps) > 50
    got = QUERIES["code_imports"](spark, sf).toPandas()
    name = np.where(got.kind == "import", got.module.str.removesuffix(".py").str.replace("/", "."), got.name)
    assert Counter(zip(got.repo, got.path, name, got.alias.where(got.alias.notna(), None))) == imports
    graph = QUERIES["call_graph"](spark, sf).toPandas()
    assert plain <= set(zip(graph.repo, graph.caller, graph.chain)) and len(plain) > 50
    known = set(zip(*QUERIES["code_index"](spark, sf).select("repo", "id").toPandas().to_numpy().T))
    assert {(r, c) for r, c in zip(graph.repo, graph.callee) if isinstance(c, str)} <= known


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_in_sql_are_queries():
    assert set(SQL) <= set(QUERIES)
