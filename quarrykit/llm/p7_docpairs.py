"""Functions paired with their documentation, own or inherited.

Each source is read as far as its first statement: decorators, the signature and comments are passed over, and the first
statement is a docstring if it is nothing but a string literal (or literals in a row, in parentheses or not) that Python would
take as `__doc__` - no bytes, no f-string, no part of a larger expression. Sources that Python 3 can't parse further down are read
the same way. Documentation that is blank, a placeholder, a mere "see the base class" tag, or only the function's name again counts as none.

Methods without documentation then inherit in Python's own order. Class components give the hierarchy; in each round the classes whose
bases are all in order already get theirs by merging (C3), from the top down, until no class is left that can. An undocumented
method takes the documentation of the first class of its class's order that documents a method of that name. Functions still undocumented drop out.

Defined cases: null, empty or unparsable sources give no pair; repeated rows count once; component types are compared without case
and outer space. A base is looked up by name in the same file, then in the file its qualifier names, then in the repository if only one
other class there has it; a base that none of these gives, or the class itself, is no base. Classes on a cycle of bases, below one, or whose bases have no
order, inherit nothing. Hierarchies may be of any height."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.hierarchy import class_orders
from quarrykit.operators.skew import lookup
from quarrykit.runtime import cut_lineage, read_table, spread

CALLABLES = ("function", "method", "inner_function")
#: Placeholders, compared in lower case without outer punctuation.
PLACEHOLDERS = frozenset(
    "todo|fixme|xxx|tbd|n/a|na|none|null|pass|docstring|doc|docs|documentation|description|summary|_summary_|_description_|placeholder|undocumented|write me|document me|"
    "fill me in|fill in|describe me|missing|empty|wip|stub|help|add docstring here|todo document this|todo: document this|todo document|todo add docstring|todo: add docstring|"
    "todo write docstring|missing docstring|missing documentation|no docstring|no documentation|no description|description goes here|docstring goes here|"
    "documentation goes here|your docstring here|your code here|add description|add docstring|add documentation|insert docstring here|write docstring here|"
    "to be documented|to be done|to be written|not documented|not documented yet|no docs|needs documentation|lorem ipsum|function|method|this function|this method".split("|")
)
INHERIT = re.compile(r"(?i)^\W*(?:\{?@?inherit_?docs?\}?|see (?:the )?(?:base|super|parent)(?: ?class)?|inherited(?: from .{0,60})?|(?:overrides?|same as) .{0,60}|see :?\w*:?`[^`]*`)\W*$")
CLASS = re.compile(r"^[ \t]*class[ \t]+\w+[ \t]*(?:\[[^\]\n]*\][ \t]*)?\(", re.M)
BASE_STEP = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{},]")
COMMENT = re.compile(r"#[^\n]*")
DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)", re.M)
STEP = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]", re.S)
GAP = re.compile(r"(?:[ \t\f\r\n]|#[^\n]*|\\\r?\n)*")
LITERAL = re.compile(r"([A-Za-z]{0,2})(\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S)
LINE_GAP = re.compile(r"(?:[ \t\f]|\\\r?\n)*")
END = re.compile(r"[ \t\f]*(?:\r|\n|;|#|$)")
NAME_ONLY = re.compile(r"[\W_]+")


def own_doc(source: str | None) -> str | None:
    """What Python would take as `__doc__` of the function that `source` defines; None if it has none."""
    if not source:
        return None
    m = DEF.search(source)
    if not m:
        return None
    at, depth = m.end(), 0
    while True:  # to the colon that ends the signature
        t = STEP.search(source, at)
        if t is None:
            return None
        at, c = t.end(), t.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
    at = GAP.match(source, at).end()
    parens = 0
    while source[at : at + 1] == "(":
        parens += 1
        at = GAP.match(source, at + 1).end()
    parts = []
    while True:
        t = LITERAL.match(source, at)
        if t is None:
            break
        if t.group(1).lower() not in ("", "r", "u"):
            return None
        parts.append(t.group())
        at = (GAP if parens else LINE_GAP).match(source, t.end()).end()
        while parens and source[at : at + 1] == ")":
            parens -= 1
            at = (GAP if parens else LINE_GAP).match(source, at + 1).end()
    if not parts or parens or not END.match(source, at):
        return None
    if len(parts) == 1 and "\\" not in parts[0]:
        body = parts[0].lstrip("rRuU")
        return body[3:-3] if body[:3] in ('"""', "'''") and len(body) >= 6 else body[1:-1]
    try:
        return ast.literal_eval("(" + " ".join(parts) + ")")
    except (SyntaxError, ValueError):
        return None


def is_trivial(doc: str | None, name: str | None) -> bool:
    """No documentation worth keeping: nothing, a placeholder, or the name again."""
    if doc is None:
        return True
    flat = " ".join(doc.split())
    bare = flat.strip(" \t.,:;!?-_*#`'\"<>[](){}=~/\\|…").lower()
    if not any(c.isalnum() for c in bare) or bare in PLACEHOLDERS or " ".join(NAME_ONLY.sub(" ", bare).split()) in PLACEHOLDERS:
        return True
    plain = NAME_ONLY.sub("", flat).lower()
    if name and plain in {NAME_ONLY.sub("", n).lower() for n in (name, name.rpartition(".")[2])}:
        return True
    return False


def _read(components: DataFrame) -> DataFrame:
    """The own documentation of each callable and the bases of each class; texts leave Python only where they are documentation."""
    kind = F.lower(F.trim("component_type"))
    rows = components.select("comp_no", kind.alias("kind"), "clean_name", "source_code").where(kind.isin(*CALLABLES))
    rows = spread(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, state = [], []
            for name, source in zip(pdf.clean_name, pdf.source_code):
                doc = own_doc(source)
                trivial = is_trivial(doc, name)
                inherits = doc is not None and bool(INHERIT.match(doc))
                docs.append(None if trivial or inherits else doc)
                state.append("own" if not trivial and not inherits else "tag" if inherits else "none")
            yield pd.DataFrame({"comp_no": pdf.comp_no, "doc": docs, "doc_state": state})

    return rows.mapInPandas(run, "comp_no bigint, doc string, doc_state string").dropDuplicates(["comp_no"])


def class_bases(source: str | None) -> list[str]:
    """The dotted names of the bases in a class's head, in order; keywords, calls and subscripts are no part of a name."""
    m = CLASS.search(source or "")
    if not m:
        return []
    at, depth, start, parts = m.end(), 1, m.end(), []
    while depth:
        t = BASE_STEP.search(source, at)
        if t is None:
            return []
        c, at = t.group(), t.end()
        depth += (c in "([{") - (c in ")]}")
        if (c == "," and depth == 1) or not depth:
            parts.append(source[start : t.start()])
            start = t.end()
    names = (re.match(r"\s*([^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*)\s*(?:\[.*)?\Z", COMMENT.sub("", p), re.S) for p in parts)
    return [re.sub(r"\s+", "", n.group(1)) for n in names if n]


def _parents(components: DataFrame) -> DataFrame:
    """(repo, cls, ord, up): each class (its id) and its bases in order, as ids."""
    classes = components.where((F.lower(F.trim("component_type")) == "class") & F.col("id").contains("@"))
    ids = F.concat_ws("@", F.substring_index("id", "@", 1), F.substring_index("id", "@", -1))
    classes = classes.select(F.coalesce("repo", F.lit("")).alias("repo"), ids.alias("cls"), "source_code").groupBy("repo", "cls").agg(F.min("source_code").alias("source_code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(repo, cls, i, b) for repo, cls, source in pdf.itertuples(index=False, name=None) for i, b in enumerate(class_bases(source))]
            yield pd.DataFrame(rows, columns=["repo", "cls", "ord", "base"])

    name = lambda c: F.substring_index(F.substring_index(c, "@", 1), ".", -1)
    path = lambda c: F.substring_index(c, "@", -1)
    heads = classes.where(F.col("source_code").contains("(")).mapInPandas(run, "repo string, cls string, ord int, base string")
    wanted = heads.select("repo", "cls", "ord", F.substring_index("base", ".", -1).alias("name"), F.substring_index(F.substring_index("base", ".", -2), ".", 1).alias("module"), F.col("base").contains(".").alias("dotted")).where("name <> 'object'")
    named = classes.select("repo", name(F.col("cls")).alias("name"), F.col("cls").alias("up"), F.regexp_extract(path(F.col("cls")), r"([^/]*?)(?:\.\w+)?$", 1).alias("stem"))
    # a name that very many classes of a repository bear decides by file or module alone; it is counted, never gathered
    counts = named.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("first"), F.max("up").alias("last"))
    w = wanted.join(counts, ["repo", "name"])
    here = w.join(named.select("repo", "name", "up", path(F.col("up")).alias("_p")), (w.repo == named.repo) & (w.name == named.name) & (path(w.cls) == F.col("_p"))).select(w.repo, "cls", "ord", "up", F.lit(0).alias("rank"))
    there = w.where("dotted").join(named, (w.repo == named.repo) & (w.name == named.name) & (w.module == named.stem)).select(w.repo, "cls", "ord", "up", F.lit(1).alias("rank"))
    only = w.where("n <= 2").select("repo", "cls", "ord", F.when((F.col("n") == 1) | (F.col("first") != F.col("cls")) & (F.col("last") == F.col("cls")), F.col("first")).when(F.col("first") == F.col("cls"), F.col("last")).alias("up"), F.lit(2).alias("rank"))
    both = here.unionByName(there).unionByName(only).where("up is not null and up <> cls")
    return both.groupBy("repo", "cls", "ord").agg(F.min_by("up", F.struct("rank", "up")).alias("up"))


def documented(components: DataFrame) -> DataFrame:
    """(comp_no, doc, depth): the documentation of each callable; depth 0 is its own, n that of the n-th class of its class's order.

    Only methods without documentation, whose class has an order, look for others' - as keys without text."""
    read = cut_lineage(_read(components))
    own = read.where("doc_state = 'own'").select("comp_no", "doc", F.lit(0).alias("depth"))
    full = F.substring_index("id", "@", 1)
    ids = components.where((F.lower(F.trim("component_type")) == "method") & F.col("id").contains("@") & full.contains(".")).select(
        "comp_no", F.coalesce("repo", F.lit("")).alias("repo"), F.concat_ws("@", F.regexp_replace(full, r"\.[^.]*$", ""), F.substring_index("id", "@", -1)).alias("cls"), F.substring_index(full, ".", -1).alias("name")).dropDuplicates(["comp_no"])
    orders = cut_lineage(class_orders(_parents(components)))
    if orders.isEmpty():
        return own
    has = ids.join(read.where("doc_state = 'own'").select("comp_no", "doc"), "comp_no").groupBy("repo", F.col("cls").alias("up"), "name").agg(F.min("doc").alias("doc"))
    open_ = ids.join(read.where("doc_state <> 'own'").select("comp_no"), "comp_no")
    asked = lookup(open_, orders, ["repo", "cls"]).select("comp_no", "repo", "name", F.posexplode("line").alias("depth", "up")).where("depth > 0")
    hit = lookup(asked, has, ["repo", "up", "name"]).groupBy("comp_no").agg(F.min_by("doc", "depth").alias("doc"), F.min("depth").alias("depth"))
    return own.unionByName(hit)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(read_table(spark, sf_dir, "component")).where("depth = 0").select("comp_no")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-description pairs, with the depth the description was inherited from."""
    c = read_table(spark, sf_dir, "component")
    code = c.select("comp_no", "repo", "id", "signature", "source_code").dropDuplicates(["comp_no"])
    return documented(c).join(code, "comp_no").select("comp_no", "repo", "id", "signature", F.col("source_code").alias("code"), F.col("doc").alias("description"), "depth")
