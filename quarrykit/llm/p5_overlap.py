"""Same or near-same records across splits, by the word n-grams of the exact check itself.

Both parts of a record, description and code, are normalised (case, layout, comments, quotes and articles go; local names of code
become one name) and reduced to classes of equal normal form. A class's chunks are its word n-grams, one that ends at every word:
chunks cut apart by content lose pairs of short texts, where one changed word voids a chunk of twelve. Whatever `near_same` accepts
has a Jaccard similarity of n-grams of at least half of SIMILAR, so the classes of such a pair share that part of each one's
n-grams and meet, for certain, in one of each class's rarest n-grams (prefix filter). Their common n-grams are counted there, and a
pair that can't reach the similarity any more is left out before texts are read; the others are checked exactly.

Codes matter only where the descriptions are near-same: the codes of a pair of description classes are checked with each other,
or, if those are more than HOT pairs, meet on n-grams as descriptions do. Both ways are exact. Records follow by joins on class
pairs: a class of very many records costs one row here.

Defined cases: null, blank and placeholder descriptions and null or blank code are no text and overlap with nothing; labels play no
part; repeated rows count once; split names are compared in lower case; a split other than train, valid or test is passed over."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.operators.skew import lookup
from quarrykit.runtime import cut_lineage, read_table, spread

#: Exact check: word n-gram size, least Jaccard similarity, least share of equal words in order.
GRAM = {"description": 3, "code": 4}
SIMILAR = {"description": 0.5, "code": 0.42}
IN_ORDER = {"description": 0.84, "code": 0.8}
#: Words that the rolling hash of chunks spans, and mean words of a chunk.
CHUNK_WINDOW, CHUNK_MEAN = 2, 4
#: Pairs of codes under one pair of descriptions from which they meet on n-grams; results don't hang on it.
HOT = 4096
#: For bounds worked out in floating point: less than any step between fractions of words.
SLACK = 1e-9
PLACEHOLDER = re.compile(r"(?i)\W*(?:docstring|todo|fixme|none|null|n/?a|tbd|xxx)?\W*")
WORD = re.compile(r"\w+")
CODE = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[^\W\d]\w*|\d[\w.]*|[^\w\s]", re.S)
#: Words that normalisation drops from descriptions.
ARTICLES = frozenset("a an the".split())
KEEP = frozenset("def class return if else elif for while in not and or is none true false with as try except finally raise assert del lambda import from yield async await pass break continue len str range list dict set int sorted max min self".split())


def description_words(text: str | None) -> list[str]:
    if text is None or PLACEHOLDER.fullmatch(text.strip()):
        return []
    return [w for w in (x.lower() for x in WORD.findall(text)) if w not in ARTICLES]


def code_words(text: str | None) -> list[str]:
    """Tokens of the code: comments dropped, the words of strings, local names as `v`; names that are called or are attributes stay."""
    if not text or not text.strip():
        return []
    tokens = [t for t in CODE.findall(text) if t[0] != "#"]
    out: list[str] = []
    for i, t in enumerate(tokens):
        c = t[0]
        if c in "\"'":
            out.extend(x.lower() for x in WORD.findall(t) if x.lower() not in ARTICLES)
        elif c.isalpha() or c == "_":
            low = t.lower()
            called = i + 1 < len(tokens) and tokens[i + 1] == "("
            out.append(low if low in KEEP or called or (i and tokens[i - 1] in (".", "class")) else "v")
        elif c not in ",;`":
            out.append(low if (low := t.lower()) else t)
    return out


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def in_order(a: list[str], b: list[str]) -> float:
    """Share of the longer list that a longest common subsequence covers, by bit-parallel dynamic programming."""
    if not a or not b:
        return 0.0
    place: dict[str, int] = {}
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & place.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return (len(a) - bin(v).count("1")) / max(len(a), len(b))


def near_same(a: list[str], b: list[str], part: str) -> bool:
    if a == b:
        return True
    ga, gb = grams(a, GRAM[part]), grams(b, GRAM[part])
    similar = len(ga & gb) / max(1, len(ga | gb))
    if similar >= SIMILAR[part]:
        return True
    return similar >= 0.5 * SIMILAR[part] and in_order(a, b) >= IN_ORDER[part]


def _classes(records: DataFrame) -> DataFrame:
    """(pair_no, split, repo, d, c, and the words): each record with the digests of its two normal forms."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for no, split, repo, desc, code in pdf.itertuples(index=False, name=None):
                d, c = description_words(desc), code_words(code)
                if d and c:
                    dw, cw = " ".join(d), " ".join(c)
                    rows.append((no, split, repo, xxhash.xxh64_intdigest(dw) - (1 << 63), xxhash.xxh64_intdigest(cw) - (1 << 63), dw, cw))
            yield pd.DataFrame(rows, columns=["pair_no", "split", "repo", "d", "c", "dw", "cw"])

    split = F.lower(F.trim("split_name"))
    rows = records.select("pair_no", split.alias("split"), "repo", "description", "code").where(split.isin("train", "valid", "test"))
    return spread(rows).mapInPandas(run, "pair_no bigint, split string, repo string, d bigint, c bigint, dw string, cw string").dropDuplicates(["pair_no"])


def _near(pairs: DataFrame, part: str) -> DataFrame:
    """(e, t) of the pairs (e, t, ew, tw) whose words are near-same."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [near_same(a.split(" "), b.split(" "), part) for a, b in zip(pdf.ew, pdf.tw)]
            yield pdf.loc[ok, ["e", "t"]]

    return pairs.select("e", "t", "ew", "tw").mapInPandas(check, "e bigint, t bigint")


def class_pairs(recs: DataFrame, key: str, words: str, part: str) -> DataFrame:
    """(key of an evaluation class, key of a train class) of each pair of near-same classes across the splits."""
    train = (F.col("split") == "train").cast("int")
    classes = recs.groupBy(key).agg(F.first(words).alias("w"), F.max(train).alias("in_train"), F.min(train).alias("all_train"))
    same = classes.where("in_train = 1 and all_train = 0").select(F.col(key).alias("e"), F.col(key).alias("t"))
    strong, weak = SIMILAR[part], 0.5 * SIMILAR[part]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [w.split(" ") for w in pdf.w]
            got = [list({xxhash.xxh64_intdigest(" ".join(g)) - (1 << 63) for g in grams(w, GRAM[part])}) for w in split]
            yield pd.DataFrame({"k": pdf.k, "w": pdf.w, "in_train": pdf.in_train, "all_train": pdf.all_train, "words": [len(w) for w in split], "size": [len(g) for g in got], "gram": got})

    cutted = cut_lineage(classes.withColumnRenamed(key, "k").select("k", "w", "in_train", "all_train").mapInPandas(
        cut, "k bigint, w string, in_train int, all_train int, words int, size int, gram array<bigint>"))
    each = cutted.select("k", "in_train", "all_train", "words", "size", F.explode("gram").alias("gram"))
    # an n-gram that stands on one side only can't be shared across the splits; it still counts in the size
    freq = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.max("in_train").alias("t"), F.min("all_train").alias("a")).where("df > 1 and t = 1 and a = 0").select("gram", "df")
    of_class = Window.partitionBy("k")
    ranked = each.join(freq, "gram").withColumn("held", F.count(F.lit(1)).over(of_class)).withColumn("place", F.row_number().over(of_class.orderBy("df", "gram")))
    # of the n-grams shared with a near-same class, the rarest is followed by all the others: it stands among the first held - least + 1 of both
    ahead = F.col("held") - F.ceil(weak * F.col("size") - SLACK) + 1
    prefix = ranked.where(F.col("place") <= ahead).withColumn("rest", F.col("held") - ahead)
    facts = F.struct("words", "size", "rest")
    left = prefix.where("all_train = 0").select(F.col("k").alias("e"), "gram", facts.alias("ef"))
    right = prefix.where("in_train = 1").select(F.col("k").alias("t"), "gram", facts.alias("tf"))
    met = left.join(right, "gram").where("e <> t").groupBy("e", "t").agg(F.count(F.lit(1)).alias("n"), F.first("ef").alias("ef"), F.first("tf").alias("tf"))
    # shared n-grams outside both prefixes lie behind one of them; texts of lengths too far apart can't be equal in order
    most = F.col("n") + F.greatest("ef.rest", "tf.rest")
    in_order_too = F.least("ef.words", "tf.words") >= IN_ORDER[part] * F.greatest("ef.words", "tf.words") - SLACK
    least = F.when(in_order_too, weak / (1 + weak)).otherwise(strong / (1 + strong)) * (F.col("ef.size") + F.col("tf.size"))
    met = met.where(most >= least - SLACK).select("e", "t")
    side = cutted.select("k", "w")
    return _near(met.join(side.toDF("e", "ew"), "e").join(side.toDF("t", "tw"), "t"), part).unionByName(same)


def code_pairs(eval_side: DataFrame, train_side: DataFrame, dp: DataFrame) -> DataFrame:
    """(c, c2) of each pair of near-same codes under a pair (d, d2) of descriptions; pairs from hot descriptions may be of others, too."""
    e, t = eval_side.select("d", "c").dropDuplicates(), train_side.select(F.col("d").alias("d2"), F.col("c").alias("c2")).dropDuplicates()
    load = dp.join(e.groupBy("d").agg(F.count(F.lit(1)).alias("ne")), "d").join(t.groupBy("d2").agg(F.count(F.lit(1)).alias("nt")), "d2")
    load = cut_lineage(load.withColumn("hot", F.col("ne") * F.col("nt") > HOT).select("d", "d2", "hot"))
    direct = cut_lineage(load.where("not hot").join(e, "d").join(t, "d2").select("c", "c2").dropDuplicates())
    ew, tw = (side.select("c", "cw").dropDuplicates(["c"]) for side in (eval_side, train_side))
    near = _near(direct.where("c <> c2").join(ew.toDF("c", "ew"), "c").join(tw.toDF("c2", "tw"), "c2").withColumnsRenamed({"c": "e", "c2": "t"}), "code").toDF("c", "c2")
    found = near.unionByName(direct.where("c = c2"))
    hot = load.where("hot")
    if not hot.isEmpty():
        some = eval_side.join(hot.select("d").dropDuplicates(), "d", "left_semi").unionByName(train_side.join(hot.select(F.col("d2").alias("d")).dropDuplicates(), "d", "left_semi"))
        found = found.unionByName(class_pairs(some, "c", "cw", "code").toDF("c", "c2")).dropDuplicates()
    return found


def overlaps(records: DataFrame) -> DataFrame:
    """(eval_no, train_no, split, repo) of each evaluation record and each train record that is the same or near-same in both parts."""
    recs = cut_lineage(_classes(records))
    dp = cut_lineage(class_pairs(recs, "d", "dw", "description")).toDF("d", "d2")
    # codes matter only in records whose description has met one across the splits
    met_d = recs.select("pair_no", "split", "repo", "d", "c", "cw")
    eval_side = met_d.where("split <> 'train'").join(dp.select("d").dropDuplicates(), "d", "left_semi")
    train_side = met_d.where("split = 'train'").join(dp.select(F.col("d2").alias("d")).dropDuplicates(), "d", "left_semi")
    cp = cut_lineage(code_pairs(eval_side, train_side, dp))
    e = eval_side.select("pair_no", "split", "repo", "d", "c").join(dp, "d").join(cp, "c").select(F.col("pair_no").alias("eval_no"), "split", "repo", "d2", "c2")
    t = train_side.select(F.col("pair_no").alias("train_no"), F.col("d").alias("d2"), F.col("c").alias("c2"))
    return e.join(t, ["d2", "c2"]).select("eval_no", "train_no", "split", "repo").dropDuplicates(["eval_no", "train_no"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlaps(read_table(spark, sf_dir, "training_pair"))
    return o.select(F.least("eval_no", "train_no").alias("pair_a"), F.greatest("eval_no", "train_no").alias("pair_b"))


def chunk_ends(words: np.ndarray, owner: np.ndarray, window: int = CHUNK_WINDOW, mean: int = CHUNK_MEAN) -> np.ndarray:
    """Whether a chunk ends behind each word: where the rolling hash of the last `window` words is one in `mean`, and at a text's end. Equal
    words are cut alike wherever they stand, but for the first chunk of a passage."""
    rolled = np.zeros(len(words), np.uint64)
    for back in range(window):
        turned = words << np.uint64(7 * back) | words >> np.uint64(64 - 7 * back) if back else words
        same = np.concatenate([np.zeros(min(back, len(words)), bool), owner[back:] == owner[: len(owner) - back]])
        rolled ^= np.where(same, np.concatenate([np.zeros(min(back, len(words)), np.uint64), turned[: len(words) - back]]), np.uint64(0))
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    return (((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(mean) == 0) | last


def fractions(records: DataFrame) -> DataFrame:
    """(pair_no, split, repo, part, words, shared, fraction) of each evaluation record and part (description, code): the share of its normalised
    words that stand in content-defined chunks which some train record's same part has too.

    Chunks are cut by a rolling hash over words, and met by digest: each digest of the train split counts once, so a chunk of a third of
    all records costs a row, and no pairs come out. Work and shuffle grow with the words alone."""
    recs = cut_lineage(_classes(records))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, column in (("description", "dw"), ("code", "cw")):
                split = [w.split(" ") for w in pdf[column]]
                owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
                words = [w for ws in split for w in ws]
                known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
                hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
                at = np.flatnonzero(chunk_ends(hashes, owner)) + 1
                begin = np.concatenate([[0], at[:-1]]) if len(at) else at
                yield pd.DataFrame({
                    "pair_no": pdf.pair_no.to_numpy()[owner[begin]], "split": pdf.split.to_numpy()[owner[begin]], "repo": pdf.repo.to_numpy()[owner[begin]], "part": part,
                    "digest": [xxhash.xxh64_intdigest(" ".join(words[a:b])) - (1 << 63) for a, b in zip(begin.tolist(), at.tolist())], "n": (at - begin).astype(np.int32)})

    chunks = cut_lineage(recs.mapInPandas(cut, "pair_no bigint, split string, repo string, part string, digest bigint, n int"))
    train = chunks.where("split = 'train'").select("part", "digest").dropDuplicates().withColumn("met", F.lit(1))
    evals = chunks.where("split <> 'train'")
    met = lookup(evals, train, ["part", "digest"], "left")
    g = met.groupBy("pair_no", "split", "repo", "part").agg(F.sum("n").cast("bigint").alias("words"), F.coalesce(F.sum(F.when(F.col("met") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("shared"))
    return g.withColumn("fraction", F.col("shared") / F.col("words"))


def p5_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap fraction of each evaluation record's description and code with the train split."""
    return fractions(read_table(spark, sf_dir, "training_pair"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split and repository the evaluation records, those that overlap, their links, and the mean overlap fractions of both parts."""
    pairs = read_table(spark, sf_dir, "training_pair")
    o = overlaps(pairs).groupBy("split", "repo").agg(F.countDistinct("eval_no").alias("records"), F.count(F.lit(1)).alias("links"))
    by = [F.avg(F.when(F.col("part") == p, F.col("fraction"))).alias(f"{p}_overlap") for p in ("description", "code")]
    f = fractions(pairs).groupBy("split", "repo").agg(F.countDistinct("pair_no").alias("checked"), *by)
    keys = [f.split.eqNullSafe(o.split), f.repo.eqNullSafe(o.repo)]
    return f.join(o, keys[0] & keys[1], "left").select(f.split, f.repo, "checked", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("links", F.lit(0)).alias("links"), "description_overlap", "code_overlap")
