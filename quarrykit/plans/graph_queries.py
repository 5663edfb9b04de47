"""Queries on components, dependencies, training pairs and samples, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import callgraph as CG
from quarrykit.functions import code_index as CI
from quarrykit.functions.text import hidden, id_name, json_string, module_of, safe_label
from quarrykit.operators import dependencies as D
from quarrykit.operators import sampling as S
from quarrykit.runtime import cut_lineage, read_table


def _once(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each (repo, id): the last by comp_no, as a later entry overwrites."""
    c = read_table(spark, sf, "component").where("repo is not null and id is not null")
    return D.keep_last(c, ["repo", "id"], "comp_no")


def _edges(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return D.edges(_once(spark, sf), column, "repo", "id")


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Outgoing calls as edges."""
    return _edges(spark, sf, "outgoing_calls").select("repo", "id", "kind", "dst_id", "ord")


def edges_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Calls out of and targets of each caller file."""
    e = _edges(spark, sf, "outgoing_calls").withColumn("path", F.substring_index("id", "@", -1))
    return e.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("dst_id").alias("targets"), F.md5(F.array_join(F.array_sort(F.collect_set("dst_id")), ",")).alias("targets_md5"))


def edge_outdegree_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and classes of each out-degree."""
    c = _once(spark, sf).where(F.col("component_type").isin("class", "function")).withColumn("degree", D.out_degree("outgoing_calls"))
    return c.groupBy("degree").agg(F.count(F.lit(1)).alias("components"), F.min("id").alias("first_id"))


def random_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """One component of each out-degree, by hash."""
    c = _once(spark, sf).where(F.col("component_type").isin("class", "function")).withColumn("degree", D.out_degree("outgoing_calls")).select("degree", "comp_no")
    return S.pick_one(c, "degree", "comp_no")


def candidate_join_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, then noise, of each component, joined with the components they mean; a repeated id keeps its first place."""
    c = cut_lineage(_once(spark, sf))
    t = c.select("repo", F.col("id").alias("dst_id"), F.col("component_type").alias("dst_type"))
    return D.candidates(c, ["repo", "id"], t).select("repo", "id", "dst_id", "dst_type", "ord")


def noise_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and functions of the same file that a component neither calls nor lies in."""
    return D.noise(_once(spark, sf))


def categorize_components(spark: SparkSession, sf: str) -> DataFrame:
    """Called components of each repository by type, with the sum of their ids' digests; methods and inner functions drop out."""
    c = cut_lineage(_once(spark, sf))
    t = c.where(F.col("component_type").isin("class", "function", "variable")).select("repo", F.col("id").alias("dst_id"), "component_type")
    e = D.edges(c, "outgoing_calls", "repo", "id").select("repo", "dst_id").dropDuplicates().join(t, ["repo", "dst_id"])
    return e.groupBy("repo", "component_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5("dst_id"), 1, 8), 16, 10).cast("bigint")).alias("ids_sum"))


def target_lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair's target as a component: its id as it stands, with the path in normal form, below src/, or without src/."""
    p = read_table(spark, sf, "training_pair").where("repo is not null and target_id is not null").select("pair_no", "repo", "target_id").dropDuplicates(["pair_no"])
    name, path = id_name(F.col("target_id")), F.trim(F.substring_index("target_id", "@", -1))
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/(\\./|/)+", "/"), "^\\./", "")
    probes = [F.col("target_id"), F.concat(name, F.lit("@"), clean), F.concat(name, F.lit("@src/"), clean), F.concat(name, F.lit("@"), F.regexp_replace(clean, "^src/", ""))]
    return D.lookup(p, ["repo", "pair_no"], probes, _once(spark, sf)).select("pair_no", "probe", "id")


def import_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """What star and named imports bring into a file, taking each call's target as an import of its module and name."""
    e = _edges(spark, sf, "outgoing_calls").select("repo", F.substring_index("id", "@", -1).alias("path"), F.substring_index("dst_id", "@", -1).alias("module"), id_name(F.col("dst_id")).alias("name")).dropDuplicates()
    imports = e.withColumn("alias", F.lit(None).cast("string")).withColumn("is_star", F.pmod(F.length("name"), F.lit(3)) == 0).withColumn("is_module", F.lit(False))
    return D.expand_imports(imports, _once(spark, sf))


def init_reexports(spark: SparkSession, sf: str) -> DataFrame:
    """Names looked for in a package folder: the first submodule that defines them."""
    c = _once(spark, sf)
    m = c.where(F.col("component_type").isin("class", "function")).select("repo", F.regexp_replace(F.substring_index("id", "@", -1), r"/[^/]+$", "").alias("package"), id_name(F.col("id")).alias("name"))
    return D.reexported(m.where("package not like '%.py'").dropDuplicates(), c)


def resolve_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Raw references as component ids; those whose path lost its suffix are found by prefix."""
    e = _edges(spark, sf, "outgoing_calls").select("repo", F.col("id").alias("src_id"), F.when(F.pmod(F.length("dst_id"), F.lit(2)) == 0, F.regexp_replace("dst_id", r"\.py$", "")).otherwise(F.col("dst_id")).alias("ref")).dropDuplicates()
    return D.resolve(e, _once(spark, sf))


def method_class_lift(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each method, where it is a component."""
    c = _once(spark, sf)
    m = c.where("component_type = 'method'").select("repo", "id", D.containing_class(F.col("id")).alias("class_id"))
    return m.join(c.where("component_type = 'class'").select("repo", F.col("id").alias("class_id")), ["repo", "class_id"], "left_semi")


def edge_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each repository by where the callee lies."""
    e = _edges(spark, sf, "outgoing_calls").select("repo", F.col("id").alias("caller"), F.col("dst_id").alias("callee"))
    return D.edge_buckets(e).groupBy("repo", "bucket").agg(F.count(F.lit(1)).alias("calls"))


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """What each calling component reaches over calls, however many steps away. Its SQL stops after eight steps, so the two part on deeper graphs."""
    e = _edges(spark, sf, "outgoing_calls").select(F.concat_ws(":", "repo", "id").alias("src"), F.concat_ws(":", "repo", "dst_id").alias("dst"))
    e = cut_lineage(e)
    return D.reachable(e, e.select(F.col("src").alias("node"))).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pair texts: target and context as JSON around a separator, label 1 for a called and 0 for a noise component, as digests."""
    c = cut_lineage(_once(spark, sf))
    ctx = c.select("repo", F.col("id").alias("dst_id"), F.col("component_type").alias("ctype"), F.col("source_code").alias("ccode"), F.col("signature").alias("csig"), F.col("docstring").alias("cdoc"))
    both = D.edges(c, "outgoing_calls", "repo", "id").withColumn("label", F.lit(1)).unionByName(D.edges(c, "noise", "repo", "id").withColumn("label", F.lit(0)))
    t = c.where(F.col("component_type").isin("class", "function")).select("repo", "id", "docstring", "signature")
    x = both.join(t, ["repo", "id"]).join(ctx, ["repo", "dst_id"])
    j = lambda name, desc, sig: F.concat(F.lit('{"name": '), json_string(name), F.lit(', "description": '), json_string(desc), F.lit(', "signature": '), json_string(sig), F.lit("}"))
    c_text = F.when(F.col("ctype") == "variable", F.coalesce("ccode", F.lit(""))).otherwise(j(F.col("dst_id"), F.col("cdoc"), F.col("csig")))
    text = F.concat(j(F.col("id"), F.col("docstring"), F.col("signature")), F.lit("</s>"), c_text)
    return x.select("repo", "id", "dst_id", "label", "ord", F.md5(text).alias("text_md5"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "training_pair").select("pair_no", "label").dropDuplicates(["pair_no"])


def train_split(spark: SparkSession, sf: str) -> DataFrame:
    """80/10/10 by hash order, sizes exact."""
    return S.random_split(_pairs(spark, sf), "pair_no").select("pair_no", "split")


def half_split(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth held out, then halved into validation and test."""
    return S.random_split(_pairs(spark, sf), "pair_no", (("train", 0.8), ("test", 0.1), ("valid", 0.1)), seed=7).select("pair_no", "split")


def downsample(spark: SparkSession, sf: str) -> DataFrame:
    """Class 0 cut to the size of class 1."""
    return S.downsample(_pairs(spark, sf), "label", "pair_no").select("pair_no", "label")


def pack_to_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs packed to 2,048 white-space tokens; the packs depend on how rows lie in parts."""
    p = read_table(spark, sf, "training_pair").dropDuplicates(["pair_no"]).select("pair_no", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("tokens"))
    return S.pack(p, "tokens", "pair_no", 2048)


def standalone_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Components that name some dependency; standalone ones drop out."""
    return _once(spark, sf).where(~D.standalone(*[F.col(f"outgoing_calls.{f}") for f, _ in D.KINDS])).select("comp_no")


def ordered_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Callees of each caller in the order they are listed in, as a digest."""
    e = _edges(spark, sf, "outgoing_calls").groupBy("repo", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "dst_id"))).alias("e"))
    return e.select("repo", "id", F.size("e").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("e", lambda x: x["dst_id"]), ",")).alias("callees_md5"))


def namespace_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and methods looked up by dotted namespace and completion path, with the fallbacks of packages, src/ and the bare name. Those of paths
    without a suffix are packages here, and a third of all paths come without their src/."""
    c = _once(spark, sf).where(F.col("component_type").isin("function", "method"))
    path = F.substring_index("id", "@", -1)
    plain = F.when(F.pmod("comp_no", F.lit(3)) == 0, F.regexp_replace(path, "^src/", "")).otherwise(path)
    module = F.replace(F.regexp_replace(F.regexp_replace(plain, r"\.py$", ""), "/__init__$", ""), F.lit("/"), F.lit("."))
    t = c.select("repo", "comp_no", F.col("component_type").alias("kind"), F.concat(module, F.lit("."), id_name(F.col("id"))).alias("namespace"), F.concat(F.lit("area/"), "repo", F.lit("/"), plain).alias("completion_path"))
    return D.lookup(t, ["repo", "comp_no"], D.namespace_probes(F.col("namespace"), F.col("completion_path"), F.col("kind")), _once(spark, sf)).select("comp_no", "probe", "id")


def noise_of_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Noise of each component, of its own file and of what its file's imports bring in, taking the targets of the file's calls as that."""
    c = _once(spark, sf)
    brought = D.edges(c, "outgoing_calls", "repo", "id").select("repo", F.substring_index("id", "@", -1).alias("path"), F.col("dst_id").alias("id")).dropDuplicates()
    return D.noise(c, brought)


def out_count_check(spark: SparkSession, sf: str) -> DataFrame:
    """Each component's stored out_count beside the number of its calls that are components of the repository."""
    c = cut_lineage(_once(spark, sf))
    known = D.edges(c, "outgoing_calls", "repo", "id").join(c.select("repo", F.col("id").alias("dst_id")), ["repo", "dst_id"], "left_semi").groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n"))
    return c.join(known, ["repo", "id"], "left").select("comp_no", "out_count", F.coalesce("n", F.lit(0)).cast("int").alias("counted"))


def graph_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The call graph as lines of a trivial graph file: nodes, then edges."""
    e = cut_lineage(_edges(spark, sf, "outgoing_calls"))
    nodes = e.select("repo", F.col("id").alias("n")).unionByName(e.select("repo", F.col("dst_id").alias("n"))).dropDuplicates()
    lines = nodes.select("repo", F.concat(safe_label(F.col("n")), F.lit(" "), "n").alias("line"))
    return lines.unionByName(e.select("repo", F.concat(safe_label(F.col("id")), F.lit(" "), safe_label(F.col("dst_id")), F.lit(" "), "kind").alias("line")).dropDuplicates())


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """Modules of each repository's files, hidden folders left out."""
    f = read_table(spark, sf, "source_file").where("relative_path is not null").select("file_no", "repo", "relative_path").dropDuplicates(["file_no"])
    return f.where(~hidden(F.col("relative_path"))).select("file_no", "repo", module_of(F.col("relative_path")).alias("module"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    f = read_table(spark, sf, "source_file").where("code is not null and relative_path like '%.py'").dropDuplicates(["file_no"])
    return f.select("repo", F.col("relative_path").alias("path"), "code")


def code_index(spark: SparkSession, sf: str) -> DataFrame:
    """Components of every Python file, from its syntax tree."""
    return CI.index_components(_files(spark, sf)).drop("source_code")


def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Import statements of every Python file."""
    return CI.index_imports(_files(spark, sf))


def code_references(spark: SparkSession, sf: str) -> DataFrame:
    """Names that functions, methods and classes use beyond their own."""
    return CI.index_references(_files(spark, sf))


def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved calls of every repository, through imports, classes and base classes."""
    t = CI.index_files(_files(spark, sf), {"component": (CI.file_components, CI.COMPONENT_SCHEMA), "reference": (CI.file_references, CI.REFERENCE_SCHEMA), "call": (CG.file_calls, CG.CALL_SCHEMA)})
    comp = t["component"].select("repo", "id", "component_type", "path")
    bases = t["reference"].where("via = 'base'").select("repo", F.col("src_id").alias("cls_id"), F.concat("name", F.lit("@"), "module").alias("up_id"), "ord")
    return CG.call_edges(t["call"], comp, bases.join(comp.select("repo", F.col("id").alias("up_id")), ["repo", "up_id"], "left_semi"))


ONCE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY comp_no DESC) AS rn FROM (SELECT DISTINCT * FROM component) WHERE repo IS NOT NULL AND id IS NOT NULL) WHERE rn = 1)"


def _edge_sql(column: str, name: str, base: int = 0) -> str:
    parts = " UNION ALL ".join(
        f"SELECT repo, id, '{kind}' AS kind, unnest({column}.{field}) AS dst_id, unnest(range(len({column}.{field}))) + {i * 1_000_000 + base} AS ord FROM c" for i, (field, kind) in enumerate(D.KINDS))
    return f"{name} AS ({parts})"


E_SQL = f"{ONCE}, {_edge_sql('outgoing_calls', 'e')}"
N_SQL = f"{E_SQL}, {_edge_sql('noise', 'nz', 0)}"
DEGREE = "coalesce(len(outgoing_calls.classes), 0) + coalesce(len(outgoing_calls.functions), 0) + coalesce(len(outgoing_calls.variables), 0)"
NAME, PATH = "split_part({0}, '@', 1)", "split_part({0}, '@', -1)"
CLEAN = "regexp_replace(regexp_replace(replace(trim(split_part(target_id, '@', -1), ' '), '\\', '/'), '/(\\./|/)+', '/', 'g'), '^\\./', '')"
SPLIT = "SELECT pair_no, CASE WHEN place < floor(total * {a}) THEN '{x}' WHEN place < floor(total * {b}) THEN '{y}' ELSE '{z}' END AS split FROM (SELECT pair_no, row_number() OVER (ORDER BY md5('{s}:' || pair_no), pair_no) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT pair_no FROM training_pair))"
JSON = "'{{\"name\": ' || to_json(coalesce({0}, ''))::VARCHAR || ', \"description\": ' || to_json(coalesce({1}, ''))::VARCHAR || ', \"signature\": ' || to_json(coalesce({2}, ''))::VARCHAR || '}}'"
LABEL = "replace(replace(replace(replace({0}, '.', '__'), '^^^', ''), '*', ''), '-', '')"

def _noise_sql(extra: str) -> str:
    mates = f"SELECT repo, {PATH.format('id')} AS path, id FROM c WHERE component_type IN ('class', 'function')" + extra
    return f"""WITH {E_SQL}, m AS ({mates}) SELECT a.repo, a.id, m.id AS noise_id FROM c a JOIN m ON a.repo = m.repo AND {PATH.format('a.id')} = m.path AND a.id <> m.id
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = a.repo AND e.id = a.id AND e.dst_id = m.id) AND NOT starts_with({NAME.format('a.id')}, {NAME.format('m.id')} || '.')"""


_plain = f"CASE WHEN comp_no % 3 = 0 THEN regexp_replace({PATH.format('id')}, '^src/', '') ELSE {PATH.format('id')} END"
_module = "replace(regexp_replace(regexp_replace(plain, '\\.py$', ''), '/__init__$', ''), '/', '.')"
_below = "CASE WHEN len(cp) >= 3 THEN array_to_string(cp[3:], '/') ELSE cp[-1] END"
NAMESPACE = f"""{ONCE}, a AS (SELECT repo, comp_no, component_type AS kind, {NAME.format('id')} AS nm, {_plain} AS plain FROM c WHERE component_type IN ('function', 'method')),
b AS (SELECT repo, comp_no, kind, string_split({_module} || '.' || nm, '.') AS ns, string_split('area/' || repo || '/' || plain, '/') AS cp FROM a),
d AS (SELECT *, kind = 'method' AND len(ns) > 2 AS ism, array_to_string(ns[-2:], '.') AS meth, array_to_string(ns[:-3], '/') AS folder, ns[-1] AS nm, {_below} AS below FROM b),
t AS (SELECT comp_no, repo, 0 AS probe, CASE WHEN ism THEN meth || '@' || folder || '.py' WHEN kind = 'function' THEN nm || '@' || below END AS id FROM d
UNION ALL SELECT comp_no, repo, 1, CASE WHEN ism THEN meth || '@src/' || folder || '.py' WHEN kind = 'function' THEN nm || '@src/' || below END FROM d
UNION ALL SELECT comp_no, repo, 2, CASE WHEN ism THEN meth || '@' || folder || '/__init__.py' END FROM d UNION ALL SELECT comp_no, repo, 3, CASE WHEN ism THEN meth || '@src/' || folder || '/__init__.py' END FROM d
UNION ALL SELECT comp_no, repo, 4, CASE WHEN len(cp) >= 3 THEN nm || '@' || below END FROM d)"""

SQL = {
    "standalone_filter": f"WITH {ONCE} SELECT comp_no FROM c WHERE {DEGREE} > 0",
    "ordered_callees": f"WITH {E_SQL} SELECT repo, id, count(*) AS n, md5(string_agg(dst_id, ',' ORDER BY ord, dst_id)) AS callees_md5 FROM e GROUP BY 1, 2",
    "namespace_lookup": f"WITH {NAMESPACE} SELECT comp_no, CAST(probe AS INTEGER) AS probe, id FROM (SELECT t.*, row_number() OVER (PARTITION BY comp_no ORDER BY probe) AS r FROM t SEMI JOIN c ON c.repo = t.repo AND c.id = t.id) WHERE r = 1",
    "noise_of_imports": _noise_sql(f" UNION SELECT e.repo, {PATH.format('e.id')}, e.dst_id FROM e SEMI JOIN (SELECT repo, id FROM c WHERE component_type IN ('class', 'function')) k ON k.repo = e.repo AND k.id = e.dst_id"),
    "call_edges": f"WITH {E_SQL} SELECT repo, id, kind, dst_id, ord FROM e",
    "edges_by_file": f"WITH {E_SQL} SELECT repo, {PATH.format('id')} AS path, count(*) AS calls, count(DISTINCT dst_id) AS targets, md5(array_to_string(list_sort(list(DISTINCT dst_id)), ',')) AS targets_md5 FROM e GROUP BY 1, 2",
    "edge_outdegree_groups": f"WITH {ONCE} SELECT {DEGREE} AS degree, count(*) AS components, min(id) AS first_id FROM c WHERE component_type IN ('class', 'function') GROUP BY 1",
    "random_per_group": f"WITH {ONCE} SELECT {DEGREE} AS degree, arg_min(comp_no, md5('0:' || comp_no)) AS comp_no FROM c WHERE component_type IN ('class', 'function') GROUP BY 1",
    "candidate_join_dedup": f"""WITH {ONCE}, {_edge_sql('outgoing_calls', 'e')}, {_edge_sql('noise', 'nz', 10_000_000)},
u AS (SELECT * FROM e UNION ALL SELECT * FROM nz), f AS (SELECT *, row_number() OVER (PARTITION BY repo, id, dst_id ORDER BY ord, kind) AS r FROM u)
SELECT f.repo, f.id, f.dst_id, c.component_type AS dst_type, f.ord FROM f JOIN c ON c.repo = f.repo AND c.id = f.dst_id WHERE f.r = 1""",
    "noise_antijoin": f"""WITH {E_SQL} SELECT a.repo, a.id, b.id AS noise_id FROM c a JOIN c b ON a.repo = b.repo AND {PATH.format('a.id')} = {PATH.format('b.id')} AND a.id <> b.id
WHERE b.component_type IN ('class', 'function') AND NOT EXISTS (SELECT 1 FROM e WHERE e.repo = a.repo AND e.id = a.id AND e.dst_id = b.id) AND NOT starts_with({NAME.format('a.id')}, {NAME.format('b.id')} || '.')""",
    "categorize_components": f"WITH {E_SQL} SELECT d.repo, c.component_type, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(d.dst_id), 1, 8) AS BIGINT)) AS BIGINT) AS ids_sum FROM (SELECT DISTINCT repo, dst_id FROM e) d JOIN c ON c.repo = d.repo AND c.id = d.dst_id WHERE c.component_type IN ('class', 'function', 'variable') GROUP BY 1, 2",
    "target_lookup_fallback": f"""WITH {ONCE}, p AS (SELECT DISTINCT pair_no, repo, target_id, {NAME.format('target_id')} AS name, {CLEAN} AS clean FROM training_pair WHERE repo IS NOT NULL AND target_id IS NOT NULL),
t AS (SELECT pair_no, repo, 0 AS probe, target_id AS id FROM p UNION ALL SELECT pair_no, repo, 1, name || '@' || clean FROM p UNION ALL SELECT pair_no, repo, 2, name || '@src/' || clean FROM p UNION ALL SELECT pair_no, repo, 3, name || '@' || regexp_replace(clean, '^src/', '') FROM p)
SELECT pair_no, CAST(probe AS INTEGER) AS probe, id FROM (SELECT t.*, row_number() OVER (PARTITION BY pair_no ORDER BY probe) AS r FROM t SEMI JOIN c ON c.repo = t.repo AND c.id = t.id) WHERE r = 1""",
    "import_expansion": f"""WITH {E_SQL}, i AS (SELECT DISTINCT repo, {PATH.format('id')} AS path, {PATH.format('dst_id')} AS module, {NAME.format('dst_id')} AS name FROM e),
d AS (SELECT repo, id, {PATH.format('id')} AS module, {NAME.format('id')} AS name FROM c WHERE component_type IN ('class', 'function', 'variable'))
SELECT i.repo, i.path, d.id, d.name AS alias FROM i JOIN d ON i.repo = d.repo AND i.module = d.module WHERE length(i.name) % 3 = 0
UNION SELECT i.repo, i.path, d.id, i.name FROM i JOIN d ON i.repo = d.repo AND i.module = d.module AND i.name = d.name WHERE length(i.name) % 3 <> 0""",
    "init_reexports": f"""WITH {ONCE}, s AS (SELECT repo, id, {PATH.format('id')} AS module, regexp_replace({PATH.format('id')}, '/[^/]+$', '') AS package, {NAME.format('id')} AS name, component_type FROM c),
m AS (SELECT DISTINCT repo, package, name FROM s WHERE component_type IN ('class', 'function') AND package NOT LIKE '%.py')
SELECT repo, package, name, id FROM (SELECT m.repo, m.package, m.name, s.id, row_number() OVER (PARTITION BY m.repo, m.package, m.name ORDER BY s.module, s.id) AS r FROM m JOIN s ON m.repo = s.repo AND m.package = s.package AND m.name = s.name WHERE s.package <> s.module) WHERE r = 1""",
    "resolve_prefix": f"""WITH {E_SQL}, x AS (SELECT DISTINCT repo, id AS src_id, CASE WHEN length(dst_id) % 2 = 0 THEN regexp_replace(dst_id, '\\.py$', '') ELSE dst_id END AS ref FROM e),
y AS (SELECT x.*, c.id, row_number() OVER (PARTITION BY x.repo, x.src_id, x.ref ORDER BY CASE WHEN c.id = x.ref THEN 0 ELSE 1 END, c.id) AS r FROM x JOIN c ON c.repo = x.repo AND {NAME.format('c.id')} = {NAME.format('x.ref')} AND starts_with(c.id, x.ref))
SELECT repo, src_id, ref, id FROM y WHERE r = 1""",
    "method_class_lift": f"WITH {ONCE}, m AS (SELECT repo, id, regexp_replace({NAME.format('id')}, '\\.[^.]*$', '') || '@' || {PATH.format('id')} AS class_id FROM c WHERE component_type = 'method' AND contains({NAME.format('id')}, '.')) SELECT m.* FROM m SEMI JOIN (SELECT repo, id FROM c WHERE component_type = 'class') k ON k.repo = m.repo AND k.id = m.class_id",
    "edge_buckets": f"""WITH {E_SQL} SELECT repo, CASE WHEN {PATH.format('id')} = {PATH.format('dst_id')} AND contains({NAME.format('id')}, '.') AND contains({NAME.format('dst_id')}, '.') AND split_part({NAME.format('id')}, '.', 1) = split_part({NAME.format('dst_id')}, '.', 1) THEN 'in_class'
WHEN {PATH.format('id')} = {PATH.format('dst_id')} THEN 'in_file' ELSE 'in_object' END AS bucket, count(*) AS calls FROM e GROUP BY 1, 2""",
    "reachability": f"""WITH RECURSIVE {E_SQL}, g AS (SELECT DISTINCT repo || ':' || id AS src, repo || ':' || dst_id AS dst FROM e),
r AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM g UNION SELECT r.root, g.dst, r.depth + 1 FROM r JOIN g ON r.node = g.src WHERE r.depth < 8),
m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT root, count(*) AS nodes, max(depth) AS depth FROM m GROUP BY root""",
    "training_pairs": f"""WITH {N_SQL}, u AS (SELECT *, 1 AS label FROM e UNION ALL SELECT *, 0 FROM nz)
SELECT u.repo, u.id, u.dst_id, CAST(u.label AS INTEGER) AS label, u.ord, md5({JSON.format('t.id', 't.docstring', 't.signature')} || '</s>' || CASE WHEN k.component_type = 'variable' THEN coalesce(k.source_code, '') ELSE {JSON.format('k.id', 'k.docstring', 'k.signature')} END) AS text_md5
FROM u JOIN c t ON t.repo = u.repo AND t.id = u.id AND t.component_type IN ('class', 'function') JOIN c k ON k.repo = u.repo AND k.id = u.dst_id""",
    "train_split": SPLIT.format(a=0.8, b=0.9, x="train", y="valid", z="test", s=0),
    "half_split": SPLIT.format(a=0.8, b=0.9, x="train", y="test", z="valid", s=7),
    "downsample": """WITH p AS (SELECT DISTINCT pair_no, label FROM training_pair WHERE label IN (0, 1)), n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || pair_no), pair_no) AS r FROM p) SELECT pair_no, label FROM z, n WHERE label = 1 OR n0 <= n1 OR r <= n1""",
    "out_count_check": f"WITH {E_SQL}, k AS (SELECT e.repo, e.id, count(*) AS n FROM e SEMI JOIN c ON c.repo = e.repo AND c.id = e.dst_id GROUP BY 1, 2) SELECT comp_no, out_count, CAST(coalesce(n, 0) AS INTEGER) AS counted FROM c LEFT JOIN k ON k.repo = c.repo AND k.id = c.id",
    "graph_lines": f"""WITH {E_SQL}, n AS (SELECT repo, id AS n FROM e UNION SELECT repo, dst_id FROM e)
SELECT repo, {LABEL.format('n')} || ' ' || n AS line FROM n UNION ALL SELECT DISTINCT repo, {LABEL.format('id')} || ' ' || {LABEL.format('dst_id')} || ' ' || kind FROM e""",
    "modules": "SELECT DISTINCT file_no, repo, replace(regexp_replace(regexp_replace(relative_path, '\\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM source_file WHERE relative_path IS NOT NULL AND len(list_filter(string_split(relative_path, '/'), lambda p: (starts_with(p, '.') AND p <> '.' AND p <> '..') OR p IN ('myenv', 'venv'))) = 0",
}


#: Columns whose type differs in SQL by default, cast to the query's.
_TYPES = {
    "call_edges": {"ord": "INTEGER"},
    "edge_outdegree_groups": {"degree": "INTEGER"},
    "random_per_group": {"degree": "INTEGER"},
    "candidate_join_dedup": {"ord": "INTEGER"},
    "training_pairs": {"ord": "INTEGER"},
}
for _name, _types in _TYPES.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _types.items())}) FROM ({SQL[_name]})"
