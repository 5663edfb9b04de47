"""Component and dependency tables: edges, noise, lookups with fallbacks, import resolution, reachability.

Lookups are equi-joins on split keys; a fallback is a priority column and a first-of rule, never a scan of all components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions.text import id_name
from quarrykit.runtime import cut_lineage

KINDS = (("classes", "class"), ("functions", "function"), ("variables", "variable"))


def edges(components: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., kind, dst_id, ord): the ids in a calls or noise struct, in type order and list order."""
    parts = []
    for i, (field, kind) in enumerate(KINDS):
        e = components.select(*keep, F.lit(kind).alias("kind"), F.posexplode(F.col(f"{column}.{field}")).alias("pos", "dst_id"))
        parts.append(e.select(*keep, "kind", "dst_id", (F.lit(i) * 1_000_000 + F.col("pos")).alias("ord")))
    return reduce(DataFrame.unionByName, parts)


def out_degree(column: str) -> Column:
    """Number of outgoing calls, null lists counting 0."""
    return sum((F.coalesce(F.size(F.col(f"{column}.{f}")), F.lit(0)) for f, _ in KINDS[1:]), F.coalesce(F.size(F.col(f"{column}.{KINDS[0][0]}")), F.lit(0)))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: the last by `order`, as a later entry of a mapping overwrites."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_first(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row of each key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def candidates(components: DataFrame, key: list[str], targets: DataFrame) -> DataFrame:
    """(key, kind, dst_id, ord, the targets' columns): outgoing calls, then noise, joined with components; an id that is listed again
    keeps its first place, an unknown id drops out. `targets` has repo and dst_id."""
    both = edges(components, "outgoing_calls", *key).unionByName(edges(components, "noise", *key).withColumn("ord", F.col("ord") + 10_000_000))
    return keep_first(both, [*key, "dst_id"], "ord", "kind").join(targets, ["repo", "dst_id"])


def namespace_probes(namespace: Column, completion_path: Column, kind: Column) -> list[Column]:
    """The component ids that a dotted namespace may mean, in order of preference: a function by its name and the completion's path below the
    project, a method by its class and the module its namespace names, as a file or a package, each also below src/; last the bare name
    with the completion's path. Null where an id can't be formed."""
    parts, path = F.split(namespace, r"\."), F.split(completion_path, "/")
    name = F.element_at(parts, -1)
    below = F.when(F.size(path) >= 3, F.array_join(F.slice(path, 3, F.greatest(F.size(path) - 2, F.lit(1))), "/")).otherwise(F.element_at(path, -1))
    is_method = (kind == "method") & (F.size(parts) > 2)
    method = F.array_join(F.slice(parts, -2, 2), ".")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    at = lambda who, where: F.concat(who, F.lit("@"), where)
    module, package = F.concat(folder, F.lit(".py")), F.concat(folder, F.lit("/__init__.py"))
    src = lambda where: F.concat(F.lit("src/"), where)
    return [
        F.when(is_method, at(method, module)).when(kind == "function", at(name, below)), F.when(is_method, at(method, src(module))).when(kind == "function", at(name, src(below))),
        F.when(is_method, at(method, package)), F.when(is_method, at(method, src(package))), F.when(F.size(path) >= 3, at(name, below)),
    ]


def standalone(*lists: Column) -> Column:
    """Whether a row names no dependency at all: every list is null or empty."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.size(x), F.lit(0)) <= 0 for x in lists])


def noise(components: DataFrame, brought: DataFrame | None = None) -> DataFrame:
    """(repo, id, noise_id): classes and functions that the component neither is, calls nor lies in, of its file and of what the file's
    imports bring in. `brought`, if given, has repo, path, id, as of expand_imports."""
    path = F.substring_index("id", "@", -1)
    one = components.select("repo", "id", "component_type", path.alias("path")).dropDuplicates(["repo", "id"])
    mates = one.where(F.col("component_type").isin("class", "function")).select("repo", "path", F.col("id").alias("noise_id"))
    if brought is not None:
        met = brought.select("repo", "path", F.col("id").alias("noise_id")).join(one.where(F.col("component_type").isin("class", "function")).select("repo", F.col("id").alias("noise_id")), ["repo", "noise_id"], "left_semi")
        mates = mates.unionByName(met.select("repo", "path", "noise_id")).dropDuplicates()
    near = one.join(mates, ["repo", "path"]).where("id <> noise_id").select("repo", "id", "noise_id")
    called = edges(components, "outgoing_calls", "repo", "id").select("repo", "id", F.col("dst_id").alias("noise_id")).dropDuplicates()
    left = near.join(called, ["repo", "id", "noise_id"], "left_anti")
    return left.where(~id_name(F.col("id")).startswith(F.concat(id_name(F.col("noise_id")), F.lit("."))))


def lookup(keys: DataFrame, key: list[str], probes: list[Column], components: DataFrame, id_col: str = "id") -> DataFrame:
    """(key, probe, found id): of the probe ids in order of preference the first that a component has; none drops the key."""
    tries = keys.select(*key, F.posexplode(F.array(*probes)).alias("probe", id_col)).where(F.col(id_col).isNotNull())
    on = [c for c in ("repo",) if c in key] + [id_col]
    met = tries.join(components.select(*on).dropDuplicates(), on)
    return keep_first(met, key, "probe")


def expand_imports(imports: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, path, id, alias) of what import statements bring in. `imports`: repo, path, module, name, alias, is_star, is_module.

    A plain import or a star brings all classes, functions and variables of the module, a named one the component of that name under
    its alias; all by equi-join on the module, where the name stands beside it."""
    c = components.where(F.col("component_type").isin("class", "function", "variable")).select(
        "repo", "id", F.substring_index("id", "@", -1).alias("module"), id_name(F.col("id")).alias("name")).dropDuplicates(["repo", "id"])
    whole = imports.where("is_star or is_module").select("repo", "path", "module").dropDuplicates().join(c, ["repo", "module"]).select("repo", "path", "id", F.col("name").alias("alias"))
    named = imports.where("not is_star and not is_module").select("repo", "path", "module", "name", F.coalesce("alias", "name").alias("alias")).join(c, ["repo", "module", "name"]).select("repo", "path", "id", "alias")
    return whole.unionByName(named).dropDuplicates()


def reexported(missing: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, package, name, id): names imported from a package whose own file does not define them: the first submodule, by path, that does."""
    c = components.select("repo", "id", F.substring_index("id", "@", -1).alias("module"), id_name(F.col("id")).alias("name")).dropDuplicates(["repo", "id"])
    sub = c.withColumn("package", F.regexp_replace("module", r"/[^/]+$", "")).where("package <> module")
    return keep_first(missing.join(sub, ["repo", "package", "name"]), ["repo", "package", "name"], "module", "id").select("repo", "package", "name", "id")


def resolve(raw: DataFrame, components: DataFrame) -> DataFrame:
    """(repo, src_id, ref, id): raw references `name@module` as component ids: exact, else the first id that begins with it.

    The prefix probe joins on (repo, first letters), and compares prefixes only there."""
    c = components.select("repo", "id").dropDuplicates()
    exact = raw.join(c.withColumn("ref", F.col("id")), ["repo", "ref"])
    rest = raw.join(c.select("repo", F.col("id").alias("ref")), ["repo", "ref"], "left_anti")
    head = F.substring_index(F.col("ref"), "@", 1)
    near = rest.withColumn("h", head).join(c.withColumn("h", id_name(F.col("id"))), ["repo", "h"]).where(F.col("id").startswith(F.col("ref")))
    return exact.select("repo", "src_id", "ref", "id").unionByName(keep_first(near, ["repo", "src_id", "ref"], "id").select("repo", "src_id", "ref", "id"))


def containing_class(component_id: Column) -> Column:
    """The class id of a method id `Class.method@path`; null for other ids."""
    name = id_name(component_id)
    return F.when(name.contains("."), F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("@"), F.substring_index(component_id, "@", -1)))


def reachable(edge_table: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(root, node, depth): what each root reaches over (src, dst), at its least depth. Each round extends only nodes met in the round before.

    Rounds end when one meets no new node; `max_depth` is a safety limit, and paths that are longer raise."""
    step = cut_lineage(edge_table.select("src", "dst").dropDuplicates())
    front = cut_lineage(roots.select(F.col("node").alias("root"), "node").dropDuplicates().withColumn("depth", F.lit(0)))
    # what was met stays as it was written, a layer for each round
    layers = [front]
    for depth in range(1, max_depth + 2):
        seen = reduce(DataFrame.unionByName, layers)
        nxt = front.join(step, front.node == step.src).select("root", F.col("dst").alias("node")).dropDuplicates()
        front = cut_lineage(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        layers.append(front)
    raise RuntimeError(f"nodes lie behind more than {max_depth} steps")


def edge_buckets(calls: DataFrame) -> DataFrame:
    """Each (caller, callee) edge with where the callee lies: in_class, in_file or in_object."""
    a, b = id_name(F.col("caller")), id_name(F.col("callee"))
    same_file = F.substring_index("caller", "@", -1) == F.substring_index("callee", "@", -1)
    same_class = same_file & a.contains(".") & (F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)) & b.contains(".")
    return calls.withColumn("bucket", F.when(same_class, "in_class").when(same_file, "in_file").otherwise("in_object"))
