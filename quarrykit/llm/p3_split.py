"""Cutting of oversized items into overlapping pieces at natural boundaries, by byte ranges.

An item's UTF-8 bytes are cut into ranges of RANGE bytes. Each range is worked on alone, with a halo of the bytes before and after
it: a range begins at its anchor, the first natural boundary at or after its nominal start, and ends at the anchor of the next
range, which its halo shows as well. So a giant file is never one task's work, and the ranges of one file meet without a gap.
Within its stretch a range picks cuts, and counts the characters between them. A window prefix-sums these counts over the ranges
of an item, which turns the local tables into one table of pieces with offsets in the whole item; texts are cut out by byte
offset afterwards.

A piece holds the characters between two cuts, and before them the last `overlap` characters of the piece before; so pieces
overlap by exactly `overlap` characters and, less the overlaps, give back the whole. Best cuts, in order: before a top-level
definition or after a blank line, at a line end, after a sentence end, at a space; with none of them the cut is hard.

Defined cases: null texts and texts of at most `limit` characters give no pieces; repeated items (same kind and number) give one
set of pieces; sizes and overlaps are in Unicode characters, never inside one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.runtime import parts_for, read_table, shared_path

LIMIT, OVERLAP = 2_000, 200
#: Nominal bytes of a range; halo of characters a worker sees beyond it (an anchor is looked for in half of it).
RANGE = 1 << 18
TOP = re.compile(r"\n(?=(?:async def|def|class|@|function|func|fn|pub|impl|public|private|static|export|interface|struct|enum|#{1,6} )\b|@)|\n[ \t]*\r?\n+")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?;:。！？](?:[\"')\]]*)(?:\s|(?<=[。！？]))")
SPACE = re.compile(r"\s")
KINDS = ("definition", "line", "sentence", "space")


def best_cut(text: str, low: int, high: int) -> tuple[int, str]:
    """The last best cut position p with low < p <= high: text[:p] ends there. Its kind is one of KINDS, `end` or `hard`."""
    if high >= len(text):
        return len(text), "end"
    part = text[low:high]
    for kind, pattern in zip(KINDS, (TOP, LINE, SENTENCE, SPACE)):
        found = 0
        for m in pattern.finditer(part):
            found = m.end()
        if found:
            return low + found, kind
    return high, "hard"


def anchor(text: str, step: int) -> int:
    """Where a range that nominally begins at text[0] really begins: after the first line end of its halo, else space, else at once."""
    part = text[:step]
    for pattern in (LINE, SPACE):
        if m := pattern.search(part):
            return m.end()
    return 0


def cuts(text: str, step: int, at: int = 0) -> list[tuple[int, str]]:
    """Ends of the stretches that `text` is cut into from `at` on, each at most `step` characters."""
    out = []
    while at < len(text):
        end, kind = best_cut(text, at + step // 2, at + step)
        out.append((end, kind))
        at = end
    return out


NAMES = ["item_kind", "item_no", "range_no", "i", "chars", "head", "char_at", "byte_start", "byte_end", "boundary"]
TABLE = "item_kind string, item_no bigint, range_no int, i int, chars bigint, head int, char_at bigint, byte_start bigint, byte_end bigint, boundary string"


def _halos(limit: int, overlap: int) -> tuple[int, int]:
    """Bytes of a range's halo before and behind it."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    return 4 * overlap, 8 * limit


def cut_range(n_bytes: int, k: int, lead: int, data: bytes, limit: int, overlap: int, size: int) -> list[tuple]:
    """The boundary table of range k of an item of n_bytes: (i, chars, head, char_at, byte_start, byte_end, boundary, text) of each piece.
    data are the range's bytes with its halos, `lead` of them before it; char_at counts from the range's first cut, head are the
    characters of the overlap."""
    step = limit - overlap
    own_at = lead
    while k and own_at < len(data) and data[own_at] & 0xC0 == 0x80:  # the rest of a character that the range before began
        own_at += 1
    own_to = min(lead + size, len(data))
    while own_to < len(data) and data[own_to] & 0xC0 == 0x80:
        own_to += 1
    before = data[:own_at].decode("utf-8", "ignore")
    text = data[own_at:own_to].decode("utf-8", "replace")
    first = anchor(text, step) if k else 0
    if (k + 1) * size < n_bytes:
        beyond = data[own_to:].decode("utf-8", "ignore")
        text += beyond[: anchor(beyond, step)]
    text = before + text
    at = len(before) + first
    at_byte = k * size + own_at - lead + len(text[len(before) : at].encode())
    rows, chars = [], 0
    for i, (end, why) in enumerate(cuts(text, step, at)):
        nb = len(text[at:end].encode())
        head = min(overlap, at) if k or i else 0
        rows.append((i, end - at, head, chars, at_byte, at_byte + nb, why, text[at - head : end]))
        chars += end - at
        at, at_byte = end, at_byte + nb
    return rows


def _ranges(items: DataFrame, limit: int, overlap: int, size: int) -> DataFrame:
    """Byte ranges of the oversized items, each with its halos as binary; rows of small items end here, in the JVM."""
    back, halo = _halos(limit, overlap)
    big = items.where(F.length("text") > limit).select("item_kind", "item_no", F.col("text").cast("binary").alias("b"))
    big = big.withColumn("n_bytes", F.octet_length("b"))
    big = big.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / size).cast("int"))).alias("range_no"))
    lead = F.least(F.col("range_no") * size, F.lit(back))
    start = F.col("range_no") * size - lead
    return big.select("item_kind", "item_no", "n_bytes", "range_no", lead.alias("lead"), F.substring(F.col("b"), start + 1, lead + size + halo).alias("data"))


def _local(ranges: DataFrame, limit: int, overlap: int, size: int, with_text: bool) -> DataFrame:
    """The boundary table of each range, and the piece's text if wished; n_bytes is the item's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list = []
            for kind, no, n_bytes, k, lead, data in pdf.itertuples(index=False, name=None):
                rows += [(kind, no, k, *r[: None if with_text else -1], n_bytes) for r in cut_range(n_bytes, k, lead, bytes(data), limit, overlap, size)]
            yield pd.DataFrame(rows, columns=NAMES + ["piece"] * with_text + ["n_bytes"])

    return ranges.mapInPandas(run, TABLE + ", piece string" * with_text + ", n_bytes bigint")


def _stitched(local: DataFrame) -> DataFrame:
    """Of each range of each item the pieces and characters before it. A row for each range, no text; a repeated item adds equal rows,
    which the maxima swallow."""
    by_range = local.groupBy("item_kind", "item_no", "range_no").agg((F.max("i") + 1).cast("bigint").alias("n"), F.max(F.col("char_at") + F.col("chars")).alias("chars"))
    before = Window.partitionBy("item_kind", "item_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return by_range.select(
        "item_kind", "item_no", "range_no", "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pieces_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )


def range_offsets(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The stitched table of the items' ranges."""
    return _stitched(_local(_ranges(items, limit, overlap, size), limit, overlap, size, False))


def _placed(local: DataFrame, size: int) -> DataFrame:
    """Pieces with their places in the whole item. An item of one range, as nearly all are, has nothing before it; the tables of the
    others are stitched, from the written pieces, of which only the numbers are read."""
    out = lambda d, pieces, chars: d.select(
        "item_kind", "item_no", (pieces + F.col("i")).cast("int").alias("piece_no"), (chars + F.col("char_at")).alias("char_start"),
        (chars + F.col("char_at") + F.col("chars")).alias("char_end"), F.col("head").alias("overlap"), "byte_start", "byte_end", "boundary", "piece")
    path = shared_path(local.sparkSession, "pieces")
    local.write.parquet(path)
    written = local.sparkSession.read.schema(local.schema).parquet(path)
    many = written.where(F.col("n_bytes") > size)
    return out(written.where(F.col("n_bytes") <= size), F.lit(0), F.lit(0).cast("bigint")).unionByName(
        out(many.join(_stitched(many), ["item_kind", "item_no", "range_no"]), F.col("pieces_before"), F.col("chars_before")))


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(item_kind, item_no, piece_no, char_start, char_end, overlap, byte_start, byte_end, boundary, piece).

    `items` has item_kind, item_no, text. char_start..char_end and the bytes are the stretch between the piece's cuts; the
    piece's text begins `overlap` characters earlier. Every item is cut once; ranges are dealt anew, so those of one item spread."""
    big = items.where(F.length("text") > limit).dropDuplicates(["item_kind", "item_no"])
    return _placed(_local(_ranges(big, limit, overlap, size), limit, overlap, size, True), size)


def file_pieces(spark: SparkSession, path: str, glob: str = "*", limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The pieces of all files of more than `limit` bytes below a folder, by item_path; columns as of `pieces` besides. No file is ever loaded whole:
    the listing gives lengths alone, and each task reads the bytes of its ranges and their halos."""
    back, halo = _halos(limit, overlap)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = listed.where(F.col("length") > limit).select(F.col("path").alias("item_kind"), F.lit(0).cast("bigint").alias("item_no"), F.col("length").alias("n_bytes"))
    ranges = files.select("*", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / size).cast("int"))).alias("range_no"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            data, leads = [], []
            for name, n_bytes, k in zip(pdf.item_kind, pdf.n_bytes, pdf.range_no):
                lead = min(k * size, back)
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(at) as f:
                    f.seek(k * size - lead)
                    data.append(f.read(min(lead + size + halo, n_bytes - (k * size - lead))))
                leads.append(lead)
            yield pdf.assign(lead=leads, data=data)

    read = ranges.repartition(parts_for(files), "item_kind", "range_no").mapInPandas(run, "item_kind string, item_no bigint, n_bytes bigint, range_no int, lead int, data binary")
    return _placed(_local(read, limit, overlap, size, True), size).withColumnRenamed("item_kind", "item_path").drop("item_no")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read_table(spark, sf_dir, "code_window").select(F.lit("window").alias("item_kind"), F.col("window_no").alias("item_no"), F.col("context").alias("text"))
    c = read_table(spark, sf_dir, "component").select(F.lit("component").alias("item_kind"), F.col("comp_no").alias("item_no"), F.col("source_code").alias("text"))
    return w.unionByName(c)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_items(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which the stitched table has more than one piece."""
    t = range_offsets(_items(spark, sf_dir))
    return t.groupBy("item_kind", "item_no").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("item_kind", "item_no")


SQL = {"p3_found": """SELECT 'window' AS item_kind, window_no AS item_no FROM code_window WHERE length(context) > 2000
UNION SELECT 'component', comp_no FROM component WHERE length(source_code) > 2000"""}
