"""Python source files as tables: components, imports, raw references and calls, from one parse of each file.

A file that Python can't parse gives no rows. Only names in `args.args` count as local parameters, annotated and tuple assignments make
no variable component, and an aliased module keeps its alias as reference: these follow the indexed data's established meaning."""

from __future__ import annotations

import ast
import builtins
import re
import sys
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, spread

COMPONENT_SCHEMA = "repo string, path string, id string, component_type string, clean_name string, parent string, start_line int, end_line int, has_docstring boolean, docstring string, signature string, source_code string, ord int"
REFERENCE_SCHEMA = "repo string, path string, src_id string, name string, module string, alias string, via string, is_star boolean, ord int"
IMPORT_SCHEMA = "repo string, path string, kind string, module string, name string, alias string, level int, statement string, ord int"
NO_DOC = "DOCSTRING"
BUILTIN = frozenset(dir(builtins)) | {"self", "cls"}


@lru_cache(maxsize=2)
def parse(code: str) -> ast.Module | None:
    """The tree of a file, None if Python can't parse it; the readers of one file share it, and must not change it."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(code.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def signature_of(segment: str) -> str:
    """The head of a definition: from def or class to the colon outside brackets, white space squeezed."""
    m = re.search(r"^[ \t]*(?:async\s+def|def|class)\b", segment, re.M)
    if not m:
        return ""
    depth = 0
    for t in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#[^\n]*|[()\[\]{}:]", segment[m.start() :]):
        c = t.group()
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and not depth:
            return " ".join(segment[m.start() : m.start() + t.start()].split()) + ":"
    return " ".join(segment[m.start() :].split("\n")[0].split()).rstrip(":") + ":"


@lru_cache(maxsize=2)
def _nodes(code: str) -> tuple[list[ast.AST], dict[int, tuple[int, int]]]:
    """All nodes of a file that parses, each before those below it, and where the nodes below each one stand."""
    order: list[ast.AST] = []
    place: dict[int, tuple[int, int]] = {}
    stack: list = [parse(code)]
    while stack:
        node = stack.pop()
        if isinstance(node, int):  # all nodes below this place are in
            place[id(order[node])] = (node, len(order))
            continue
        stack.append(len(order))
        order.append(node)
        below = []
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                below.extend(x for x in value if isinstance(x, ast.AST))
            elif isinstance(value, ast.AST):
                below.append(value)
        stack.extend(reversed(below))
    return order, place


def below(code: str, node: ast.AST) -> list[ast.AST]:
    """A node of the file and all nodes below it, in source order; one walk of the file serves all its nodes."""
    order, place = _nodes(code)
    a, b = place[id(node)]
    return order[a:b]


class _Walk(ast.NodeVisitor):
    """Definitions with their nearest enclosing function and class, in source order."""

    def __init__(self) -> None:
        self.found: list[tuple[ast.AST, str, str]] = []
        self.stack: list[ast.AST] = []

    def _define(self, node):
        if isinstance(node, ast.ClassDef):
            if not self.stack:
                self.found.append((node, "class", node.name))
        else:
            outer = self.stack[-1] if self.stack else None
            if outer is None:
                self.found.append((node, "function", node.name))
            elif isinstance(outer, ast.ClassDef):
                if len(self.stack) == 1:
                    self.found.append((node, "method", f"{outer.name}.{node.name}"))
            else:
                self.found.append((node, "inner_function", f"{outer.name}.{node.name}"))
        self.stack.append(node)
        self.generic_visit(node)
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _define


@lru_cache(maxsize=2)
def definitions(code: str) -> tuple[tuple[ast.AST, str, str], ...]:
    """(node, kind, name) of the definitions of a file that parses."""
    walk = _Walk()
    walk.visit(parse(code))
    return tuple(walk.found)


def file_components(repo: str, path: str, code: str) -> list[tuple]:
    tree = parse(code)
    if tree is None:
        return []
    text = code.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    rows = []

    def add(node, kind, name, clean, parent=None):
        start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        source = "\n".join(lines[start - 1 : node.end_lineno])
        doc = ast.get_docstring(node) if kind != "variable" else None
        rows.append((repo, path, f"{name}@{path}", kind, clean, parent, start, node.end_lineno, doc is not None, doc if doc is not None else "" if kind == "variable" else NO_DOC, "" if kind == "variable" else signature_of(source), source, len(rows)))

    for node in tree.body:
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    add(node, "variable", t.id, t.id)
    for node, kind, name in definitions(code):
        parent = f"{name.rpartition('.')[0]}@{path}" if "." in name else None
        add(node, kind, name, node.name, parent)
    return rows


def resolve_relative(path: str, level: int, module: str | None) -> str:
    """The module path of `from ..m import x` in `path`, with slashes."""
    here = path.split("/")[:-1]
    base = here[: len(here) - (level - 1)] if level else []
    return "/".join([*base, *(module.split(".") if module else [])])


def file_imports(repo: str, path: str, code: str) -> list[tuple]:
    tree = parse(code)
    rows: list[tuple] = []
    for node in _nodes(code)[0] if tree else ():
        if isinstance(node, ast.Import):
            for a in node.names:
                rows.append((repo, path, "import", a.name.replace(".", "/") + ".py", None, a.asname, 0, f"import {a.name}" + (f" as {a.asname}" if a.asname else ""), len(rows)))
        elif isinstance(node, ast.ImportFrom):
            module = resolve_relative(path, node.level, node.module)
            for a in node.names:
                said = f"from {'.' * node.level}{node.module or ''} import {a.name}" + (f" as {a.asname}" if a.asname else "")
                rows.append((repo, path, "star" if a.name == "*" else "from", module + ".py", a.name, a.asname, node.level, said, len(rows)))
    return rows


def file_references(repo: str, path: str, code: str) -> list[tuple]:
    """Names that each function, method and class uses and does not define: (module, name) of imports, else the file's own module."""
    tree = parse(code)
    if tree is None:
        return []
    named: dict[str, tuple[str, str]] = {}
    stars: list[str] = []
    for _, _, kind, module, name, alias, *_ in file_imports(repo, path, code):
        if kind == "star":
            stars.append(module)
        elif kind == "from":
            named[alias or name] = (module, name)
        else:
            named[alias or module.removesuffix(".py").split("/")[0]] = (module, "*")
    rows: list[tuple] = []
    for node, kind, own in definitions(code):
        src, mine = f"{own}@{path}", below(code, node)
        local = {a.arg for n in mine if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for a in n.args.args}
        local |= {n.id for n in mine if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        seen = set()
        called = {id(n.func) for n in mine if isinstance(n, ast.Call)}
        bases = {id(b) for b in getattr(node, "bases", [])}
        for n in mine:
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in named and n.value.id not in local:
                module, what = named[n.value.id]
                ref = (module, n.attr if what == "*" else f"{what}.{n.attr}", n.value.id, "attribute")
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id not in local and n.id not in BUILTIN and n.id not in sys.stdlib_module_names:
                module, what = named.get(n.id, (path, n.id))
                if what == "*":
                    continue
                ref = (module, what, n.id, "base" if id(n) in bases else "call" if id(n) in called else "load")
            else:
                continue
            if ref[:2] not in seen and not (ref[0] == path and ref[1] == own):
                seen.add(ref[:2])
                rows.append((repo, path, src, ref[1], ref[0], ref[2], ref[3], False, len(rows)))
        rows.extend((repo, path, src, None, m, None, "star", True, len(rows) + i) for i, m in enumerate(stars))
    return rows


def _table(files: DataFrame, read: Callable, schema: str, repo: str, path: str, code: str, empty: bool = False) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for r, p, c in pdf.itertuples(index=False, name=None) if c or empty for x in read(r, p, c)]
            yield pd.DataFrame(rows, columns=names)

    return spread(files.select(F.col(repo), F.col(path), F.col(code))).mapInPandas(run, schema)


def index_components(files: DataFrame, repo: str = "repo", path: str = "path", code: str = "code") -> DataFrame:
    return _table(files, file_components, COMPONENT_SCHEMA, repo, path, code)


def index_imports(files: DataFrame, repo: str = "repo", path: str = "path", code: str = "code") -> DataFrame:
    return _table(files, file_imports, IMPORT_SCHEMA, repo, path, code)


def index_references(files: DataFrame, repo: str = "repo", path: str = "path", code: str = "code") -> DataFrame:
    return _table(files, file_references, REFERENCE_SCHEMA, repo, path, code)


def skipped_files(files: DataFrame, repo: str = "repo", path: str = "path", code: str = "code") -> DataFrame:
    """(repo, path, reason) of the files that give no rows: null code, or code that Python can't parse."""
    return _table(files, lambda r, p, c: [(r, p, "unparsable" if c else "empty")] if not c or parse(c) is None else [], "repo string, path string, reason string", repo, path, code, True)


def index_files(files: DataFrame, readers: dict[str, tuple[Callable, str]], repo: str = "repo", path: str = "path", code: str = "code") -> dict[str, DataFrame]:
    """Several tables of the files from one parse of each: a table for each reader (its row function and schema).

    The rows of all readers come out of one pass with their table's name, and are written once to the shared folder; each table is a
    selection of them."""
    columns = {k: [f"{k}_{c.strip().split(' ')[0]}" for c in schema.split(",")] for k, (_, schema) in readers.items()}
    every = ["_table", *(c for cs in columns.values() for c in cs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in readers}
            for r, p, c in pdf.itertuples(index=False, name=None):
                for k, (read, _) in readers.items() if c else ():
                    out[k].extend(read(r, p, c))
            for k, rows in out.items():
                if rows:
                    yield pd.DataFrame(rows, columns=columns[k]).assign(_table=k, **{c: None for c in every if c not in columns[k] and c != "_table"})[every]

    schema = ", ".join(["_table string", *(f"{k}_{c.strip()}" for k, (_, s) in readers.items() for c in s.split(","))])
    rows = cut_lineage(spread(files.select(F.col(repo), F.col(path), F.col(code))).mapInPandas(run, schema))
    return {k: rows.where(F.col("_table") == k).select(*[F.col(c).alias(c.removeprefix(f"{k}_")) for c in columns[k]]) for k in readers}


def code_identifiers(code: str | None) -> list[str]:
    """Distinct identifiers of a snippet that parses, in source order; by their form if it does not."""
    tree = parse(code or "")
    if tree is None:
        return list(dict.fromkeys(re.findall(r"[^\W\d]\w*", code or "")))
    out = {}
    for n in ast.walk(tree):
        for name in (getattr(n, "id", None), getattr(n, "attr", None), getattr(n, "name", None) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None, getattr(n, "arg", None) if isinstance(n, (ast.arg, ast.keyword)) else None):
            if isinstance(name, str):
                out[name] = None
    return list(out)


def gold_dependencies(context: str, solution: str, entry_point: str) -> list[str]:
    """Names that the context's top level defines or imports and the solution uses, but for the entry point."""
    tree = parse(context)
    names = []
    for n in tree.body if tree else []:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            names.extend((a.asname or a.name).split(".")[0] for a in n.names)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.append(n.name)
        elif isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name):
            names.append(n.targets[0].id)
    used = set(code_identifiers(solution))
    return [x for x in dict.fromkeys(names) if x in used and x != entry_point]
