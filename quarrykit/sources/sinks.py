"""Writing tables, JSON lines, graphs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import safe_label


def json_lines(df: DataFrame, path: str, append: bool = False, gzip: bool = False, by: list[str] | None = None) -> None:
    """JSON lines in UTF-8, one folder for each value of `by`."""
    w = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false")
    if gzip:
        w = w.option("compression", "gzip")
    (w.partitionBy(*by) if by else w).json(path)


def graph(components: DataFrame, path: str) -> None:
    """A graph file for each repository: one JSON object of id -> component in a line. A repository's graph is one record, as its readers
    expect; tables of any size belong in parquet."""
    fields = [c for c in components.columns if c != "repo"]
    one = components.select("repo", F.struct("ord" if "ord" in fields else "id", F.concat(F.regexp_extract(F.to_json(F.struct(F.col("id").alias("k"))), r"^\{\"k\":(.*)\}$", 1), F.lit(": "), F.to_json(F.struct(*fields))).alias("entry")).alias("e"))
    text = one.groupBy("repo").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), ", "), F.lit("}")).alias("value"))
    text.write.mode("overwrite").partitionBy("repo").text(path)


def knowledge(imports: DataFrame, brought: DataFrame, path: str) -> None:
    """A file of external knowledge for each repository: JSON lines of relative_path, import_statements and external_entity, the lists of one file each.

    `imports`: repo, path, statement, ord; `brought`: repo, path, id."""
    said = imports.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "statement"))).alias("i")).select("repo", "path", F.transform("i", lambda e: e["statement"]).alias("import_statements"))
    ids = brought.groupBy("repo", "path").agg(F.array_sort(F.collect_set("id")).alias("external_entity"))
    rows = said.join(ids, ["repo", "path"], "full").withColumnRenamed("path", "relative_path")
    json_lines(rows.select("repo", "relative_path", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("import_statements", "external_entity")]), path, by=["repo"])


def windows(df: DataFrame, path: str, window: int, slices: int) -> None:
    """Windows by repository in parquet, with the sizes as columns."""
    df.withColumn("window_size", F.lit(window)).withColumn("slice_size", F.lit(slices)).write.mode("overwrite").partitionBy("repo").parquet(path)


def tgf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a trivial graph file: nodes, a mark, edges; each line with an order that a text sink keeps by sorting."""
    n = nodes.select(F.lit(0).alias("o"), "id", F.concat(safe_label(F.col("id")), F.lit(" "), F.col("id")).alias("line"))
    mark = nodes.sparkSession.createDataFrame([(1, "", "#")], "o int, id string, line string")
    e = edges.select(F.lit(2).alias("o"), F.col("src").alias("id"), F.concat_ws(" ", safe_label(F.col("src")), safe_label(F.col("dst")), "kind").alias("line"))
    return n.unionByName(mark).unionByName(e)


def dot(nodes: DataFrame, edges: DataFrame, name: str = "G") -> DataFrame:
    """Lines of a graphviz file."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", f"digraph {name} {{")], "o int, id string, line string")
    tail = spark.createDataFrame([(3, "", "}")], "o int, id string, line string")
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("o"), "id", F.concat(F.lit("  "), q("id"), F.lit(";")).alias("line"))
    e = edges.select(F.lit(2).alias("o"), F.col("src").alias("id"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(tail)


def yed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')], "o int, id string, line string")
    tail = spark.createDataFrame([(3, "", "</graph></graphml>")], "o int, id string, line string")
    n = nodes.select(F.lit(1).alias("o"), "id", F.concat(F.lit('<node id="'), esc("id"), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("o"), F.col("src").alias("id"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"/>')).alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(tail)


def lines(df: DataFrame, path: str) -> None:
    """The lines of a graph as text, in order over the files."""
    df.orderBy("o", "id", "line").select("line").write.mode("overwrite").text(path)
