"""Files that nobody of the project wrote by hand: generated, minified, vendored, or data stored as code.

The grammar decides. Each batch of files is tokenized and a grammar is inferred for every file by rounds of Re-Pair: in a round,
every pair of neighbouring symbols that repeats in its file and is locally the most frequent becomes a rule, in all files of the
batch at once (numpy sorts, no loop over tokens), until no pair repeats. Tokens stand for their kind (keyword, name, number,
string), so that stubs that differ in names only reuse each other's rules. Reuse is tokens per symbol of the grammar; what counts is
its excess over the reuse of hand-written files of that length. A file's literals are a blob if a
Re-Pair grammar over their characters takes no fewer bits than their own alphabet does (escapes are decoded first).

Rules shared across repositories are found by one round of Re-Pair over the whole collection: its symbols are phrases cut by
content (a phrase ends where the hash of a pair of concrete tokens is the least of its neighbourhood, so equal code falls into equal
phrases wherever it stands), and a pair of neighbouring phrases that repeats in the collection is a rule. The share of tokens under
rules common with one file elsewhere tells copies.

Many generated and copied files read like any other code: only what their tools wrote at their head or into their name tells them.
No list of such words stands here. They are learned from the files that the grammar tells: word n-grams of head comments, and parts
of paths, are counted over all files and over those the grammar tells to be generated (or copied); a line or name whose n-grams are as
usual among these as the lines of the told files themselves marks its file too (learning from positive and unlabelled files). Words about such things (a file
that writes generated code, a report on vendors) stand in files the grammar doesn't tell, and so mark nothing.

Defined cases: null code is empty, and a case only by its path; repeated rows count once; files are read whole; a corpus in which the
grammar tells no file has no marks to learn."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, read_table, spread

#: Fixed value: log of the reuse of hand-written files, a square function of the log of their tokens (least squares on sf0.1).
HAND_REUSE = (0.102849, -0.930932, 2.344493)
#: Excess of log reuse from which a file is generated (three times the reuse of hand-written files); tokens it has at least for that.
EXCESS, REUSE_TOKENS = math.log(3), 80
#: Share of tokens under rules shared by repositories from which a file is a copy; tokens in shared rules it has at least.
COPIED_SHARE, COPIED_TOKENS = 0.72, 40
#: Share of a file's solid characters in blobs (or, where its grammar is reused, in literals) from which it is data; characters of blobs it has at least.
DATA_SHARE, DATA_CHARS = 0.6, 300
#: Characters of a literal that may be part of a blob; bits a symbol, of those its alphabet would take, from which it is near-incompressible.
BLOB_LITERAL, INCOMPRESSIBLE = 40, 1.0
#: Mean characters of a line, excess of log reuse, and solid characters from which a file is minified.
MINIFIED_LINE, MINIFIED_EXCESS, MINIFIED_CHARS = 140, 0.3, 400
#: Pairs on both sides that a cut between phrases has the least hash of; tokens of a rule shared by repositories.
WINDOW, RULE_TOKENS = 8, 20
#: Learned marks: files with an n-gram; repositories of told files with a part of a path; share of the told files' own score, and odds against those of all files.
MARK_FILES, MARK_REPOS, MARK_SHARE, MARK_ODDS = 8, 3, {"head": 0.5, "path": 0.3}, 4.0
#: What marks are learned for.
LEARNED = ("generated", "vendored")
#: An n-gram of one in HOT of all files is looked up by broadcast, so that one of a third of all files is not one task's work.
#: Below HOT_FILES files none is.
HOT, HOT_FILES = 1000, 10_000

TOKEN = re.compile(
    r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|#[^\n]*|//[^\n]*|/\*.*?\*/|\d[\w.]*|\w+|[^\w\s]", re.S
)
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try "
    "while with yield self function var let const new this typeof instanceof switch case default export extends static throw catch".split()
)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def repair_reuse(symbols: np.ndarray, owner: np.ndarray, files: int) -> np.ndarray:
    """Tokens per grammar symbol of each file, by rounds of Re-Pair in all files at once, until no pair repeats. `owner` is sorted."""
    size = np.bincount(owner, minlength=files).astype(float)
    rules = np.zeros(files)
    seq, fid = symbols.astype(np.uint64), owner
    frozen_len = np.zeros(files)
    while len(seq) >= 2:
        same = fid[:-1] == fid[1:]
        key = _mix(seq[:-1] * M1 + _mix(seq[1:] + M3))
        tagged = _mix(key + fid[:-1].astype(np.uint64) * M3)
        order = np.argsort(tagged, kind="stable")
        ranked = tagged[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        count = np.empty(len(tagged), np.int64)
        count[order] = np.repeat(np.diff(edge), np.diff(edge))
        count[~same] = 0
        left = np.concatenate([[0], count[:-1]])
        right = np.concatenate([count[1:], [0]])
        take = (count >= 2) & (count >= right) & (count > left)
        # in a run of equal counts every other pair is taken, from the left
        tie = (count >= 2) & (count == left) & ~take
        start = np.maximum.accumulate(np.where(~tie, np.arange(len(tie)), 0))
        take |= tie & ((np.arange(len(tie)) - start) % 2 == 0) & (count >= right)
        take[1:] &= ~take[:-1]
        at = np.flatnonzero(take)
        if not len(at):
            break
        uniq, inverse, times = np.unique(tagged[at], return_inverse=True, return_counts=True)
        at = at[times[inverse] >= 2]
        if not len(at):
            break
        first = np.unique(tagged[at], return_index=True)[1]
        rules += np.bincount(fid[at[first]], minlength=files)
        seq = seq.copy()
        seq[at] = key[at]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, fid = seq[keep], fid[keep]
        changed = np.bincount(fid, minlength=files) > 0
        shrunk = np.zeros(files, bool)
        shrunk[np.unique(fid[np.cumsum(keep)[at] - 1])] = True
        done = changed & ~shrunk  # files without a repeated pair leave
        if done.any():
            frozen_len += np.where(done, np.bincount(fid, minlength=files), 0)
            on = ~done[fid]
            seq, fid = seq[on], fid[on]
    left_over = np.bincount(fid, minlength=files) if len(fid) else np.zeros(files)
    return size / np.maximum(left_over + frozen_len + 2 * rules, 1)


def phrases(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file, hash, tokens) of the rules of the joint grammar: a phrase is cut where a pair's hash is the least within WINDOW
    pairs on both sides, and a rule is a phrase with the next one; tokens are those of its first phrase."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = _mix(tokens.astype(np.uint64) + M1)
    pair = _mix(t + np.concatenate([t[1:], [np.uint64(0)]]) * M1)
    padded = np.pad(pair, WINDOW, constant_values=np.uint64(2**64 - 1))
    least = np.lib.stride_tricks.sliding_window_view(padded, 2 * WINDOW + 1).min(axis=1)
    begin = (pair == least) | np.concatenate([[True], owner[1:] != owner[:-1]])
    at = np.flatnonzero(begin)
    n = np.diff(np.append(at, len(tokens)))
    place = np.arange(len(tokens)) - np.repeat(at, n)
    with np.errstate(over="ignore"):
        weighed = _mix(t + (place.astype(np.uint64) + np.uint64(1)) * M3)
        value = np.add.reduceat(weighed, at)
    # a rule of the joint grammar joins a phrase with the next one: some 30 tokens, which do not meet by chance however many files there are
    joined = _mix(value * M1 + np.concatenate([value[1:], [np.uint64(0)]]))
    inside = np.concatenate([owner[at][1:] == owner[at][:-1], [False]])
    both = n + np.concatenate([n[1:], [0]])
    keep = inside & (both >= RULE_TOKENS)
    return owner[at][keep], joined[keep].view(np.int64), n[keep]

def blob_bits(texts: list[np.ndarray]) -> np.ndarray:
    """Bits a symbol that the Re-Pair grammar of each sequence takes, over those its own alphabet takes; 0 where it has no alphabet."""
    n = np.array([len(t) for t in texts], float)
    if not n.sum():
        return np.zeros(len(texts))
    owner = np.repeat(np.arange(len(texts)), n.astype(np.int64))
    flat = np.concatenate(texts).astype(np.uint64)
    kinds = np.unique(owner.astype(np.uint64) << np.uint64(32) | flat) >> np.uint64(32)
    alphabet = np.bincount(kinds.astype(np.int64), minlength=len(texts)).astype(float)
    grammar = n / np.maximum(repair_reuse(_mix(flat + M1), owner, len(texts)), 1e-9)
    # a grammar's symbols are the alphabet and, at most, a rule for every third of them
    bits = grammar * np.log2(np.maximum(alphabet, 2) + grammar / 3) / (np.maximum(n, 1) * np.log2(np.maximum(alphabet, 2)))
    return np.where(alphabet > 2, bits, 0)


ESCAPE = re.compile(r"\\x([0-9a-fA-F]{2})")
NAME_PART = re.compile(r"[^\W\d_]+|\d+")
HEAD_WORD = re.compile(r"[^\W\d_]+|\d[\d.]*|[^\w\s]")
COMMENT_MARKS = ("#", "//", "/*", "*", "--", ";", "<!--")


def blob_text(tokens: list[str]) -> tuple[str, int]:
    """The contents of the literals that could be blobs - long, nearly without white space - with escapes decoded, and their length as written."""
    out, raw = [], 0
    for t in tokens:
        if len(t) > BLOB_LITERAL and t[0] in "\"'`":
            body = t.strip("\"'`")
            solid = "".join(body.split())
            if len(body) - len(solid) <= 0.05 * len(body):
                raw += len(solid)
                out.append(ESCAPE.sub(lambda m: chr(0xE000 + int(m.group(1), 16)), solid) if "\\x" in solid else solid)
    return "".join(out), raw


def head_lines(code: str) -> list[str]:
    """The comment lines before the first line of code, however many."""
    out = []
    for line in code.split("\n"):
        bare = line.strip()
        if bare and not bare.startswith(COMMENT_MARKS):
            break
        if bare:
            out.append(bare)
    return out


def line_grams(line: str) -> set[int]:
    """Hashes of the word pairs and triples of a line, with its ends; numbers are all alike."""
    words = ["^", *("0" if w[0].isdigit() else w for w in HEAD_WORD.findall(line.lower())), "$"]
    return {xxhash.xxh64_intdigest(" ".join(words[i : i + n])) - (1 << 63) for n in (2, 3) for i in range(len(words) - n + 1)}


def path_grams(path: str) -> set[int]:
    """Hashes of the folders of a path as they are and by their form, of the parts of the file's name, and of its ending."""
    folders = [x for x in path.replace("\\", "/").lower().split("/") if x not in ("", ".", "..")]
    if not folders:
        return set()
    name = folders.pop()
    forms = [re.sub(r"a+", "a", NAME_PART.sub(lambda m: "0" if m.group()[0].isdigit() else "a", x)) for x in folders]
    # a folder that holds a package folder is told from one that holds the file
    parts = [f"{'above' if i + 1 < len(folders) else 'last'} {x}" for i, x in enumerate([*folders])] + [f"form {x}" for x in forms]
    parts += [f"name {x}" for x in re.split(r"[^a-z0-9]+", name)[1:] if x] + [f"end {name.partition('.')[2]}", *(f"pair {a}_{b}" for a, b in zip(re.split(r"[^a-z0-9]+", name)[1:], re.split(r"[^a-z0-9]+", name)[2:]))]
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in parts}


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        concrete: dict[str, int] = {}
        kinds: dict[str, int] = {}
        ids: list[np.ndarray] = []
        rows, blobs, marks = [], [], []
        for code, path in zip(pdf.code, pdf.relative_path):
            code = (code or "").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
            tokens = [t for t in TOKEN.findall(code) if t[0] != "#" and t[:2] not in ("//", "/*")]
            ids.append(np.fromiter((concrete.setdefault(t, len(concrete)) for t in tokens), np.int64, len(tokens)))
            lines = [x for x in code.split("\n") if x.strip()]
            solid = len("".join(code.split()))
            literal = sum(len(t) for t in tokens if t[0] in "\"'`" or t[0].isdigit())
            rows.append((sum(map(len, lines)) / max(len(lines), 1), solid, min(literal, solid)))
            text, raw = blob_text(tokens)
            blobs.append((np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), raw))
            met: set[int] = set()
            seen = [(-1, 1, g) for g in path_grams(path or "")]
            for i, line in enumerate(head_lines(code)):
                grams = line_grams(line)
                seen += [(i, int(g not in met), g) for g in grams]
                met |= grams
            marks.append(seen)
        owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        kind = np.empty(len(concrete), np.uint64)
        stable = np.empty(len(concrete), np.uint64)
        for t, i in concrete.items():
            stable[i] = zlib.crc32(t.encode("utf-8", "replace")) | len(t) << 32
            c = t[0]
            kind[i] = kinds.setdefault(t if t in KEYWORDS or not (c.isalnum() or c in "_\"'`") else "9" if c.isdigit() else "s" if c in "\"'`" else "n", len(kinds))
        by_name = np.fromiter((zlib.crc32(n.encode()) for n in sorted(kinds, key=kinds.get)), np.uint64, len(kinds))
        reuse = repair_reuse(by_name[kind[flat].astype(np.int64)] if len(flat) else np.zeros(0, np.uint64), owner, len(ids))
        who, value, n = phrases(stable[flat] if len(flat) else np.zeros(0, np.uint64), owner)
        cut = np.searchsorted(who, np.arange(len(ids) + 1))
        out = pd.DataFrame(rows, columns=["line", "solid", "literal"])
        out.insert(0, "file_no", pdf.file_no.to_numpy())
        out["repo"], out["relative_path"] = pdf.repo.to_numpy(), pdf.relative_path.to_numpy()
        out["tokens"] = [len(i) for i in ids]
        out["reuse"] = reuse
        out["excess"] = np.log(reuse) - np.polyval(HAND_REUSE, np.log(np.maximum(out.tokens.to_numpy(), REUSE_TOKENS)))
        out["blob"] = np.array([raw for _, raw in blobs], np.int64) * (blob_bits([b for b, _ in blobs]) >= INCOMPRESSIBLE)
        out["phrase"] = [value[a:b] for a, b in zip(cut[:-1], cut[1:])]
        out["phrase_tokens"] = [n[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
        out["mark_line"] = [np.array([i for i, _, _ in m], np.int32) for m in marks]
        out["mark_new"] = [np.array([x for _, x, _ in m], np.int32) for m in marks]
        out["mark"] = [np.array([g for _, _, g in m], np.int64) for m in marks]
        yield out


SCHEMA = (
    "file_no bigint, line double, solid bigint, literal bigint, repo string, relative_path string, tokens bigint, reuse double, excess double, blob bigint, "
    "phrase array<bigint>, phrase_tokens array<int>, mark_line array<int>, mark_new array<int>, mark array<bigint>"
)


def features(files: DataFrame) -> DataFrame:
    """The row of each file: shape, blobs, grammar reuse, its phrases, and the n-grams of its head and path."""
    rows = files.select("file_no", "repo", "relative_path", "code").where(F.col("file_no").isNotNull())
    return spread(rows, "file_no").dropDuplicates(["file_no"]).mapInPandas(_features, SCHEMA)


def copies(feats: DataFrame) -> DataFrame:
    """(file_no, shared): the share of a file's tokens under rules it has in common with one file of another repository, of files
    that the rules cover alike; a helper function that many files hold makes no copy. From COPIED_SHARE the share is that of some
    such partner, below it the greatest among the partners tried; a file that has a partner of COPIED_SHARE always gets one.

    First each rule's first and last holder are tried as partners, so a rule of a third of all files costs no more than any other.
    A file they leave undecided, though other repositories hold rules of enough of its tokens, is then tried exactly (`exact_copies`)."""
    each = feats.select("file_no", F.coalesce("repo", F.lit("")).alias("repo"), "tokens", F.explode(F.arrays_zip("phrase", "phrase_tokens")).alias("p"))
    each = each.select("file_no", "repo", "tokens", F.col("p.phrase").alias("phrase"), F.col("p.phrase_tokens").alias("n"))
    holder = F.struct("repo", "file_no", "tokens")
    rule = each.groupBy("phrase").agg(F.min(holder).alias("a"), F.max(holder).alias("b")).where("a.repo <> b.repo")
    # a file has one or two partners in a rule; with the first of them its tokens count as held elsewhere
    met = each.join(rule, "phrase").select("file_no", "tokens", "n", F.posexplode(F.filter(F.array("a", "b"), lambda h: h["repo"] != F.col("repo"))).alias("nth", "other"))
    held = F.sum(F.when(F.col("nth") == 0, F.col("n")).otherwise(0))
    common = met.groupBy("file_no", F.col("other.file_no").alias("other")).agg(F.sum("n").alias("n"), held.alias("held"), F.first("tokens").alias("tokens"), F.first("other.tokens").alias("other_tokens"))
    share = F.when(F.col("n") >= COPIED_TOKENS, F.col("n") / F.greatest("tokens", "other_tokens"))
    tried = cut_lineage(common.groupBy("file_no").agg(F.max(share).alias("shared"), F.sum("held").alias("held"), F.first("tokens").alias("tokens")))
    left = tried.where((F.coalesce("shared", F.lit(0.0)) < COPIED_SHARE) & (F.col("held") >= COPIED_TOKENS) & (F.col("held") >= COPIED_SHARE * F.col("tokens"))).select("file_no", "held")
    first = tried.where("shared is not null").select("file_no", "shared")
    if left.isEmpty():
        return first
    return first.unionByName(exact_copies(feats, left)).groupBy("file_no").agg(F.max("shared").alias("shared"))


def exact_copies(feats: DataFrame, left: DataFrame) -> DataFrame:
    """(file_no, shared): the greatest share, from COPIED_SHARE, of each file of `left` (file_no, held: its tokens under rules that
    other repositories hold) with one file of another repository.

    Files of equal rules and tokens are one class. A partner holds rules of COPIED_SHARE of the file's tokens, so it holds one of
    the file's rarest rules - those that begin before its held tokens less that share - and they meet in that one for certain."""
    named = feats.select("file_no", F.coalesce("repo", F.lit("")).alias("repo"), "tokens", "phrase", "phrase_tokens", F.xxhash64("phrase", "phrase_tokens", "tokens").alias("k"))
    files = named.join(left, "file_no")
    mine = files.dropDuplicates(["k"]).select("k", "tokens", "held", F.explode(F.arrays_zip("phrase", "phrase_tokens")).alias("p"))
    mine = cut_lineage(mine.groupBy("k", F.col("p.phrase").alias("phrase")).agg(F.sum("p.phrase_tokens").alias("n"), F.first("tokens").alias("tokens"), F.first("held").alias("held")))
    # the holders of these rules, by class: its files, and the first and last repository they lie in
    holders = named.select("k", "repo", "tokens", F.explode(F.array_distinct("phrase")).alias("phrase")).join(mine.select("phrase").dropDuplicates(), "phrase", "left_semi")
    holders = cut_lineage(holders.groupBy(F.col("k").alias("o"), "phrase").agg(F.count(F.lit(1)).alias("files"), F.min("repo").alias("o0"), F.max("repo").alias("o1"), F.first("tokens").alias("other_tokens")))
    rules = holders.groupBy("phrase").agg(F.sum("files").alias("df"), F.min("o0").alias("a"), F.max("o1").alias("b")).where("a <> b").select("phrase", "df")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("df", "phrase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = mine.join(rules, "phrase").withColumn("before", before).where(F.col("before") <= F.col("held") - COPIED_SHARE * F.col("tokens") + 1e-6)
    met = prefix.select("k", "phrase", "held", "tokens").join(holders, "phrase").where(F.col("held") >= COPIED_SHARE * F.col("other_tokens") - 1e-6)
    met = met.groupBy("k", "o").agg(F.first("o0").alias("o0"), F.first("o1").alias("o1"), F.first(F.greatest("tokens", "other_tokens")).alias("longer"))
    common = met.join(mine.select("k", "phrase", "n"), "k").join(holders.select("o", "phrase"), ["o", "phrase"])
    common = common.groupBy("k", "o").agg(F.sum("n").alias("n"), F.first("longer").alias("longer"), F.first("o0").alias("o0"), F.first("o1").alias("o1"))
    share = common.where(F.col("n") >= COPIED_TOKENS).withColumn("shared", F.col("n") / F.col("longer")).where(F.col("shared") >= COPIED_SHARE)
    return files.select("file_no", "repo", "k").join(share, "k").where("o0 <> repo or o1 <> repo").groupBy("file_no").agg(F.max("shared").alias("shared"))


def told(feats: DataFrame) -> DataFrame:
    """The features with what the grammar alone tells: grammar_origin, and shared."""
    f = feats.join(copies(feats), "file_no", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    reused = (F.col("excess") >= EXCESS) & (F.col("tokens") >= REUSE_TOKENS)
    origin = (
        F.when((F.col("blob") >= DATA_CHARS) & (F.col("literal") >= DATA_SHARE * F.col("solid")), "data")
        .when(reused & (F.col("literal") >= DATA_SHARE * F.col("solid")), "data")
        .when((F.col("line") >= MINIFIED_LINE) & (F.col("excess") >= MINIFIED_EXCESS) & (F.col("solid") >= MINIFIED_CHARS), "minified")
        .when(reused, "generated")
        .when(F.col("shared") >= COPIED_SHARE, "vendored")
    )
    return f.withColumn("grammar_origin", origin)


def _surely(told: Column, n: Column) -> Column:
    """The share that told of n files surely have, three standard deviations below (Wilson): a rare name is no mark by chance."""
    p = told / n
    return (p + 4.5 / n - 3 * F.sqrt(p * (1 - p) / n + 2.25 / (n * n))) / (1 + 9 / n)


def _meet(rows: DataFrame, table: DataFrame, hot_from: int | None, how: str) -> DataFrame:
    """Rows with their n-gram's entry of `table`; both hold its number of files, n. N-grams of `hot_from` files or more meet by broadcast: they
    are at most HOT times the n-grams of a file; so none of them is one task's work. None: there is no such n-gram."""
    if hot_from is None:
        return rows.join(table.drop("n"), "g", how)
    hot = F.col("n") >= hot_from
    return rows.where(hot).join(F.broadcast(table.where(hot).drop("n")), "g", how).unionByName(rows.where(~hot).join(table.where(~hot).drop("n"), "g", how))


def learned(f: DataFrame) -> DataFrame:
    """(file_no, mark_generated, mark_vendored, ..): whether the head or path of a file bears marks of files told already.

    `f` has file_no, repo, grammar_origin, mark_line, mark_new, mark. In the first round the told files are the grammar's, and only heads are
    judged; in the second the files with such heads are told too, and paths are judged as well: a notice leads to the folders such files lie in.
    A path never tells others. N-grams are counted before the shuffle, over all files, and a part of a path counts only where files of
    several repositories are told; what comes back to the files is a share for each n-gram. Thresholds are single numbers: the
    scores of the told files themselves."""
    start = f.select("file_no", F.coalesce("repo", F.lit("")).alias("repo"), *[F.coalesce(F.col("grammar_origin") == k, F.lit(False)).cast("int").alias(k) for k in LEARNED])
    each = f.select("file_no", F.explode(F.arrays_zip("mark_line", "mark_new", "mark")).alias("m"))
    each = each.select("file_no", F.col("m.mark_line").alias("at"), F.col("m.mark_new").alias("new"), F.col("m.mark").alias("g"))
    usual = cut_lineage(each.groupBy("g").agg(F.sum("new").alias("n")).where(F.col("n") >= MARK_FILES))
    most = usual.agg(F.max("n")).first()[0] or 0
    hot_from = max(HOT_FILES, -(-f.count() // HOT)) if most >= HOT_FILES else None
    if hot_from is None:
        each = cut_lineage(each.join(usual, "g"))
    else:
        named = each.join(F.broadcast(usual.where(F.col("n") >= hot_from)), "g", "left")
        each = cut_lineage(named.where("n is not null").unionByName(named.where("n is null").drop("n").join(usual.where(F.col("n") < hot_from), "g")))
    known, scores = start, None
    for judge in (("head",), ("head", "path")):
        told = known.where(" or ".join(f"{k} = 1" for k in LEARNED))
        rows = each if "path" in judge else each.where("at >= 0")
        grams = rows.where("new = 1").join(told, "file_no").groupBy("g", "repo").agg(F.first("n").alias("n"), *[F.sum(k).alias(k) for k in LEARNED])
        grams = grams.groupBy("g").agg(F.first("n").alias("n"), *[F.sum(k).alias(f"told_{k}") for k in LEARNED], *[F.count_if(F.col(k) > 0).alias(f"repos_{k}") for k in LEARNED])
        grams = grams if hot_from is None else cut_lineage(grams)
        by_line = _meet(rows, grams, hot_from, "left").groupBy("file_no", "at").agg(
            *[F.avg(F.coalesce(F.col(f"told_{k}") / F.col("n"), F.lit(0.0))).alias(f"head_{k}") for k in LEARNED],
            *[F.max(F.when(F.col(f"repos_{k}") >= MARK_REPOS, _surely(F.col(f"told_{k}"), F.col("n")))).alias(f"path_{k}") for k in LEARNED], F.count(F.lit(1)).alias("grams"))
        in_head = (F.col("at") >= 0) & (F.col("grams") >= 2)
        by_file = by_line.groupBy("file_no").agg(*[F.max(F.when(in_head, F.col(f"head_{k}"))).alias(f"head_{k}") for k in LEARNED], *[F.max(F.when(F.col("at") < 0, F.col(f"path_{k}"))).alias(f"path_{k}") for k in LEARNED])
        scores = cut_lineage(start.select("file_no").join(by_file, "file_no", "left").join(known, "file_no"))
        own = scores.agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in LEARNED], *[F.percentile_approx(F.when(F.col(k) == 1, F.col(f"{p}_{k}")), 0.75, 1000).alias(f"{p}_{k}") for k in LEARNED for p in judge]).first()
        marks = []
        for k in LEARNED:
            odds = MARK_ODDS * (own[k] or 0) / max(1, own["n"] - (own[k] or 0))
            hits = [F.coalesce(F.col(f"{p}_{k}") >= max(odds / (1 + odds), MARK_SHARE[p] * own[f"{p}_{k}"]), F.lit(False)) for p in judge if own[f"{p}_{k}"] is not None]
            marks.append(reduce(lambda a, b: a | b, hits, F.lit(False)).alias(f"mark_{k}"))
        scores = scores.select("file_no", "repo", *LEARNED, *marks, *[f"{p}_{k}" for k in LEARNED for p in ("head", "path")])
        known = scores.select("file_no", "repo", *[F.greatest(F.col(k), F.col(f"mark_{k}").cast("int")).alias(k) for k in LEARNED])
    return scores.drop("repo", *LEARNED)


def origins(files: DataFrame) -> DataFrame:
    """(file_no, repo, relative_path, origin, grammar_origin, reuse, shared, ..): origin is generated, minified, data, vendored, or null
    for hand-written files; grammar_origin is what the grammar tells without learned marks."""
    f = cut_lineage(told(cut_lineage(features(files))).drop("phrase", "phrase_tokens"))
    f = f.drop("mark_line", "mark_new", "mark").join(learned(f), "file_no", "left")
    origin = F.coalesce("grammar_origin", F.when(F.col("mark_generated"), "generated").when(F.col("mark_vendored"), "vendored"))
    return f.select("file_no", "repo", "relative_path", origin.alias("origin"), "grammar_origin", "reuse", "excess", "shared", "blob", "literal", "solid", "line", "tokens",
                    "head_generated", "path_generated", "head_vendored", "path_vendored")


def p1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(read_table(spark, sf_dir, "source_file")).select("file_no", "origin", "grammar_origin", "reuse", "shared")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(read_table(spark, sf_dir, "source_file")).where(F.col("origin").isNotNull()).select("file_no")


def p1_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each repository and origin."""
    o = origins(read_table(spark, sf_dir, "source_file"))
    return o.groupBy("repo", F.coalesce("origin", F.lit("hand-written")).alias("origin")).agg(F.count(F.lit(1)).alias("files"))
