"""Call graphs of whole repositories: who calls whom, through imports, classes, inheritance and simple assignments.

Files are parsed where they lie and give two small tables: what each file defines and binds, and the calls of each function as
attribute chains. Chains are resolved by joins on (module, name), so a repository is never one task's work; methods follow the linear
order of base classes. What can't be resolved stays as a wildcard edge with an empty target."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.code_index import below, definitions, file_imports, parse
from quarrykit.operators.hierarchy import class_orders
from quarrykit.runtime import spread

CALL_SCHEMA = "repo string, path string, caller string, chain string, module string, name string, attr string, flavor string, line int"


def file_calls(repo: str, path: str, code: str) -> list[tuple]:
    """Calls of each definition: the module and name that the head of the chain means here, and the attribute after it."""
    tree = parse(code)
    if tree is None:
        return []
    bound: dict[str, tuple[str, str | None]] = {}
    for _, _, kind, module, name, alias, *_ in file_imports(repo, path, code):
        if kind == "from":
            bound[alias or name] = (module, name)
        elif kind == "import":
            bound[alias or module.removesuffix(".py").split("/")[0]] = (module, None)
    found = definitions(code)
    top = {name for _, kind, name in found if kind in ("class", "function")}
    classes = {name for _, kind, name in found if kind == "class"}
    rows = []
    for node, kind, own in found:
        if kind == "class":
            continue
        cls = own.split(".")[0] if kind == "method" else None
        made: dict[str, str] = {}
        mine = below(code, node)
        for n in mine:
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name):
                for t in n.targets:
                    if isinstance(t, ast.Name) and (n.value.func.id in classes or n.value.func.id in bound):
                        made[t.id] = n.value.func.id
        inner = {n.name for n in mine if n is not node and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        for n in mine:
            if not isinstance(n, ast.Call):
                continue
            f, attrs = n.func, []
            while isinstance(f, ast.Attribute):
                attrs.append(f.attr)
                f = f.value
            attrs.reverse()
            super_call = isinstance(f, ast.Call) and isinstance(f.func, ast.Name) and f.func.id == "super"
            head = "super" if super_call else f.id if isinstance(f, ast.Name) else None
            if head is None:
                continue
            chain = ".".join([head, *attrs])
            first = attrs[0] if attrs else None
            where = made.get(head, head)
            if super_call or (head in ("self", "cls") and cls):
                row = (path, cls, first, "super" if super_call else "method")
            elif not attrs and head in inner:
                row = (path, f"{own.rpartition('.')[2]}.{head}", None, "inner_function")
            elif where in bound:
                module, name = bound[where]
                row = (module, name if name is not None else first, first if name is not None else (attrs[1] if len(attrs) > 1 else None), "imported")
            elif where in top:
                row = (path, where, first, "local")
            else:
                row = (None, where, first, "unknown")
            rows.append((repo, path, f"{own}@{path}", chain, *row, n.lineno))
    return rows


def calls(files: DataFrame, repo: str = "repo", path: str = "path", code: str = "code") -> DataFrame:
    names = [c.split(" ")[0] for c in CALL_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for r, p, c in pdf.itertuples(index=False, name=None) if c for x in file_calls(r, p, c)], columns=names)

    return spread(files.select(F.col(repo), F.col(path), F.col(code))).mapInPandas(run, CALL_SCHEMA)


def ancestors(parents: DataFrame) -> DataFrame:
    """(repo, cls_id, up_id, distance): the classes above each class in Python's order (C3). `parents`: repo, cls_id, up_id and, for the order of
    bases, ord; classes without an order inherit nothing, hierarchies may be of any height."""
    w = Window.partitionBy("repo", "cls_id").orderBy("ord", "up_id")
    bases = parents.where("cls_id <> up_id").groupBy("repo", "cls_id", "up_id").agg(F.min("ord").alias("ord")).select("repo", F.col("cls_id").alias("cls"), F.row_number().over(w).alias("ord"), F.col("up_id").alias("up"))
    line = class_orders(bases).select("repo", F.col("cls").alias("cls_id"), F.posexplode("line").alias("distance", "up_id"))
    return line.where("distance > 0").select("repo", "cls_id", "up_id", "distance")


def call_edges(call_rows: DataFrame, components: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(repo, caller, callee, flavor, line): resolved calls; a class called is its `__init__` if it has one; callee null is a wildcard."""
    ids = components.select("repo", "id").dropDuplicates(["repo", "id"])
    direct = F.when(F.col("attr").isNotNull() & F.col("module").isNotNull(), F.concat("name", F.lit("."), "attr", F.lit("@"), "module"))
    plain = F.when(F.col("module").isNotNull() & F.col("name").isNotNull(), F.concat("name", F.lit("@"), "module"))
    x = call_rows.withColumn("call_no", F.xxhash64("repo", "caller", "chain", "line"))
    tries = x.select("repo", "call_no", "flavor", F.posexplode(F.array(direct, F.when(F.col("attr").isNull(), F.concat("name", F.lit(".__init__@"), "module")), F.when(F.col("attr").isNull() | (F.col("flavor") == "imported"), plain))).alias("probe", "id"))
    tries = tries.where("id is not null and not (flavor = 'super' and probe = 0)").select("repo", "call_no", "probe", "id")
    if parents is not None:
        method = x.where("attr is not null and module is not null").select("repo", "call_no", "attr", F.concat("name", F.lit("@"), "module").alias("cls_id")).join(ancestors(parents), ["repo", "cls_id"])
        via = F.concat(F.substring_index("up_id", "@", 1), F.lit("."), "attr", F.lit("@"), F.substring_index("up_id", "@", -1))
        tries = tries.unionByName(method.select("repo", "call_no", (F.col("distance") + 10).alias("probe"), via.alias("id")))
    one = tries.join(ids, ["repo", "id"]).groupBy("call_no").agg(F.min_by("id", F.struct("probe", "id")).alias("callee"))
    return x.join(one, "call_no", "left").select("repo", "caller", "callee", "chain", "flavor", "line").dropDuplicates()
