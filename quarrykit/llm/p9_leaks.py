"""Passages of held-out evaluation items inside a large corpus, by a generalised suffix automaton.

The normalised items become one automaton over words; separators that no text contains keep items apart. Every document is
streamed through it once: the state after each word is the longest suffix of the words so far that stands in some item, and its
suffix links give, for each item, the longest suffix that stands in that one; so a match of any length is found whatever its start.
Matches of `min_words` words or more are leaked spans; an item's coverage is the share of the document's words that they hold. Corpus rows
are never shuffled but to spread small inputs; the automaton's items are broadcast, and their size is bounded: whole items are dealt
into blocks of at most BLOCK_WORDS words (or one item), and every document is streamed through each block's automaton (a stated query set
against all rows, in blocks). No item lies in two blocks, so the rows are the same whatever the blocks. A worker builds an automaton once.

Normalised words are runs of letters and digits in case-folded, NFKC-normalised text without tags of any length.

Defined cases: null, empty and wordless texts have no matches; items of fewer than `min_words` words can't leak; repeated documents
each count under their own id, repeated (id, text) rows once; very long texts are streamed word by word, never cut."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.runtime import read_table, spread

MIN_WORDS = 20
#: Words of items in one automaton, which bounds the broadcast to some 100 MB in a worker.
BLOCK_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][\w:.\-]*(?:\s+[^\s<>\"'=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>")


def normal_words(text: str) -> tuple[str, list[re.Match]]:
    """The normalised text and its words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return text, list(WORD.finditer(text))


class Automaton:
    """Suffix automaton of a list of word-id sequences; which items hold each state's substrings of `least` words or more."""

    def __init__(self, sequences: list[tuple[int, list[int]]], least: int):
        nxt: list[dict[int, int]] = [{}]
        link, size, last, own = [-1], [0], 0, [-1]
        sep = -2
        for item, words in sequences:
            for c in [*words, sep]:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                own.append(item if c >= 0 else -1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if size[p] + 1 == size[q]:
                        link[cur] = q
                    else:
                        clone = len(nxt)
                        nxt.append(dict(nxt[q]))
                        link.append(link[q])
                        size.append(size[p] + 1)
                        own.append(-1)
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
            sep -= 1
        holders: dict[int, set[int]] = {}
        for state, item in enumerate(own):
            while item >= 0 and size[state] >= least:
                held = holders.setdefault(state, set())
                if item in held:
                    break
                held.add(item)
                state = link[state]
        self.next, self.link, self.size, self.least = nxt, link, size, least
        self.holders = {s: tuple(sorted(h)) for s, h in holders.items()}

    def spans(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, end state) of the matches of at least `least` words, one for each end."""
        nxt, link, size, least = self.next, self.link, self.size, self.least
        out, v, n = [], 0, 0
        for i, c in enumerate(words):
            if c < 0:
                v = n = 0
                continue
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                n = size[v]
                t = nxt[v].get(c)
            if t is None:
                n = 0
                continue
            v, n = t, n + 1
            if n >= least:
                out.append((i + 1 - n, i + 1, v))
        return out

    def items_at(self, state: int, length: int) -> list[tuple[int, int]]:
        """(item, words) of each item that holds the last `least` words or more before `state`, with how many of the last `length` it holds."""
        out, seen = [], set()
        while self.size[state] >= self.least:
            for item in self.holders.get(state, ()):
                if item not in seen:
                    seen.add(item)
                    out.append((item, min(length, self.size[state])))
            state = self.link[state]
            if state < 0:
                break
        return out


def _blocks(items: list[tuple[int, list[list[str]]]], block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Whole items in blocks of at most `block_words` words, or one item: (item, words) of each of their texts."""
    block, n = [], 0
    for item, texts in items:
        size = sum(map(len, texts))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block += [(item, t) for t in texts]
        n += size
    if block:
        yield block


#: The automata that this worker has built, by the number of their broadcast.
_BUILT: dict[int, Automaton] = {}


def leaked_spans(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str], min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item_id, longest, covered, coverage, spans) of each document and each item that it leaks.

    longest: words of the longest match with the item; covered: document words in matches, coverage their share; spans: [first character,
    character after the last] in the normalised text. The items are read by the driver: held-out sets are given, small, and dealt in blocks."""
    spark = docs.sparkSession
    items_read: list[tuple[int, list[list[str]]]] = []
    for r in items.select(item_key, *item_texts).dropDuplicates([item_key]).orderBy(item_key).toLocalIterator():
        texts = [[m.group().casefold() for m in normal_words(r[t] or "")[1]] for t in item_texts]
        if (texts := [t for t in texts if len(t) >= min_words]) and r[item_key] is not None:
            items_read.append((r[item_key], texts))
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, item_id bigint, longest int, covered int, coverage double, spans array<struct<start:int,stop:int>>"
    names = [key, "item_id", "longest", "covered", "coverage", "spans"]
    rows = spread(docs.select(docs[key].alias(key), docs[text].cast("string").alias("text")).where(F.length("text") > 0))
    parts = []
    for number, block in enumerate(_blocks(items_read, block_words)):
        ids: dict[str, int] = {}
        coded = [(item, [ids.setdefault(w, len(ids)) for w in ws]) for item, ws in block]
        shared = spark.sparkContext.broadcast((f"{uuid.uuid4().hex}-{number}", ids, coded))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            name, ids, coded = shared.value
            if name not in _BUILT:
                while len(_BUILT) > 1:
                    _BUILT.pop(next(iter(_BUILT)))
                _BUILT[name] = Automaton(coded, min_words)
            auto = _BUILT[name]
            for pdf in batches:
                out = []
                for doc, body in pdf.itertuples(index=False, name=None):
                    _, found = normal_words(body)
                    if len(found) < min_words:
                        continue
                    per: dict[int, list[list[int]]] = {}
                    longest: dict[int, int] = {}
                    for a, b, state in auto.spans([ids.get(m.group().casefold(), -1) for m in found]):
                        for item, n in auto.items_at(state, b - a):
                            # matches that end at later words and overlap grow into one span; a longer one may swallow earlier spans
                            mine, first = per.setdefault(item, []), b - n
                            while mine and mine[-1][1] >= first:
                                first = min(first, mine.pop()[0])
                            mine.append([first, b])
                            longest[item] = max(longest.get(item, 0), n)
                    for item, mine in per.items():
                        covered = sum(b - a for a, b in mine)
                        out.append((doc, item, longest[item], covered, covered / len(found), [(found[a].start(), found[b - 1].end()) for a, b in mine]))
                yield pd.DataFrame(out, columns=names)

        parts.append(rows.mapInPandas(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key, "item_id"])


def without_leaks(docs: DataFrame, key: str, text: str, spans: DataFrame, max_words: int = MIN_WORDS, max_share: float = 0.5) -> DataFrame:
    """(key, text, removed): the normalised texts without leaked spans of at least `max_words` words; a document of which spans cover
    more than `max_share` of the characters loses its whole text. Only leaking documents are touched; the others keep their text as it is."""
    per = spans.where(F.col("longest") >= max_words).groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    @F.pandas_udf("string")
    def cut(body: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            t, at, kept = normal_words(t)[0], 0, []
            for a, b in sorted((x["start"], x["stop"]) for x in s):
                kept.append(t[at : max(at, a)])
                at = max(at, b)
            left = "".join(kept) + t[at:]
            return "" if len(left) < (1 - max_share) * len(t) else left

        return pd.Series([one(t, s) for t, s in zip(body, spans)])

    joined = docs.select(key, docs[text].alias("text")).join(per, key, "left")
    return joined.select(key, F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")).alias("text"), F.col("spans").isNotNull().alias("removed"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read_table(spark, sf_dir, "repoexec_task").select(F.col("id").cast("bigint").alias("id"), "docstring", "solution")
    return leaked_spans(read_table(spark, sf_dir, "documents"), "doc_id", "text", tasks, "id", ["docstring", "solution"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).where(F.col("longest") >= MIN_WORDS).select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them and the longest match."""
    return _spans(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.max("longest").alias("longest"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each document before and after removal of leaked spans."""
    docs = read_table(spark, sf_dir, "documents")
    c = without_leaks(docs, "doc_id", "text", _spans(spark, sf_dir))
    return c.select("doc_id", F.length("text").alias("chars_left"), "removed")


#: Words of a text for the SQL check: entities decoded, tags out, runs of letters and digits. DuckDB knows no NFKC form, so texts that it changes may differ.
_PLAIN = "{0}"
for _entity, _mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_mark}')"
_WORDS = "regexp_extract_all(lower(regexp_replace(" + _PLAIN + ", '" + TAG.pattern.replace("'", "''").replace("{", "{{").replace("}", "}}") + "', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_SHINGLES = f"unnest(list_transform(range(1, len(w) - {MIN_WORDS - 2}), lambda i: hash(array_to_string(list_slice(w, i, i + {MIN_WORDS - 1}), ' '))))"
SQL = {"p9_found": f"""WITH t AS (SELECT id, {_WORDS.format('docstring')} AS w FROM repoexec_task WHERE docstring IS NOT NULL UNION ALL SELECT id, {_WORDS.format('solution')} FROM repoexec_task WHERE solution IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ts AS (SELECT DISTINCT id, {_SHINGLES} AS s FROM t), ds AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM d)
SELECT DISTINCT doc_id, CAST(id AS INTEGER) AS item_id FROM ds JOIN ts USING (s)"""}
