"""Per-document text statistics, and outlier scores from exact ranks within each language.

One pass over the texts gives the counts and shares of each document (no shuffle but the spreading of rows). The scored statistics
then get exact ranks within the document's language: values are counted before any shuffle, the distinct (language, statistic,
value) rows are range-partitioned and sorted, each part sums its counts, and part offsets turn local positions into global ones. A rank
over the number of documents is an empirical cumulative probability; the tail probabilities on the side of junk are combined as the
sum of their negative logarithms (Fisher).

Ranks are taken twice. The first score orders all documents of a language; those up to its median are the language's core. The second
score is that of the tails against the core alone, so that junk lies beyond the core whether it is a tenth or nearly half of the language.
Tails point one way only, so plain prose scores low whatever else its language holds.

The score decides: from CLEAR on a document is found, below POSSIBLE it is not, and only between the two an exact check follows,
whether the larger part of its characters stands outside running prose. As the core of a language that holds junk only is junk,
and that of a language of one document is that document, the same sum over the quantiles of a fixed reference counts for POSSIBLE as well.

Running prose is told by stretches of lines: lines of strict form (table, log, tree, key-value, markup, code, dump) are no prose,
the other lines of a paragraph are judged together by their share of common words of four languages, or for scripts without
spaces by letters and sentence marks.

Defined cases: null, empty and blank texts get null statistics and are no cases; a null or blank language is its own group `und`,
names of languages are compared in lower case; ties share a rank; repeated documents count each; texts are read whole."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, parts_for, read_table, spread

#: Common words.
COMMON = frozenset(
    # English
    "the of and to a in is it that for on as with was be by at from or an are this which you not but have had has were they their all one there so when can will would if "
    "no more out up into do its time than only some could them other then now over also after before because may must should been about until while where what who how each every "
    "both same such these those we our us your he she his her him me my i any most once does did nothing very just too own yet again anything either neither first "
    "last "
    # German
    "der die das und ist nicht ein eine einen einem einer den dem des von zu mit sich auf für im in als auch es an werden aus er hat dass sie nach wird bei noch wie um am sind "
    "über kann wenn wir ich war nur oder aber vor zur bis mehr durch man sein wurde sobald damit obwohl bevor weil sonst schon konnte "
    # French
    "le la les de des du un une et est que qui dans en pour pas sur au aux par plus ne se ce il elle sont avec son sa ses nous vous ils mais ou où si leur été être cette ces "
    "même sans dès avant sinon quand déjà cela faut était "
    # Spanish
    "el los las y es que del se por un una con no su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde "
    "todo nos durante todos uno les ni contra ese eso antes estaba debe así aunque todavía entonces existe puede".split()
)
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
TOKEN = re.compile(r"\S+")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
KANA_MARKS = re.compile(r"[。，、！？；：]")
ENDS = re.compile(r"[.!?…。！？:;,\"'”’)\]]\s*$")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]]*\s*$")
SYMBOL = re.compile(r"[^\w\s]|_")
QUOTE = re.compile(r"^[>\s]*>\s?")
ITEM = re.compile(r"^\s*(?:[-*+•–—‣]|\(?\d{1,4}[.)]|[a-z][.)])\s+")
HEADING = re.compile(r"^\s*(?:#{1,6} |=+ |h[1-6]\. |\*\*[^*]+\*\*$)")
#: Lines of strict form: logs, tables, trees, separated values, key-value, markup and braces, code and traces.
STRICT = re.compile(
    r"^\s*(?:"
    r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b"
    r"|\|.*\|\s*$|\+[-=+]{3,}\+|[│├└┌┬┼╞═─]"
    r"|[\"']?[\w.\-/ ]{1,60}[\"']?\s*[:=]\s*(?:[\[{\"'(]|-?[\d.]+,?\s*$|(?:true|false|null|none|\w+),?\s*$)"
    r"|[\[\](){}<>,;]+\s*$|[\w\"'.]+[,;]?\s*$"
    r"|Traceback \(most|File \"|at [\w.$<>]+\(|(?:async\s+)?(?:def|class)\s+\w+.*[:(]\s*$|(?:def|class)\s+\w+\s*\(|(?:from\s+[\w.]+\s+)?import\s+[\w.]+|@\w+|(?:return|raise|assert|del|yield)\b(?!.*\.$)"
    r"|(?:if|for|while|with|elif|try|except|else|finally)\b.*:\s*$|[\w.\[\]\"', ]+\s[-+*/%]?=\s\S|(?:var|let|const|function|public|private|static)\s|#include|<\/?[a-zA-Z][^>]*>"
    r"|(?:diff --git|@@ |\+\+\+ |--- |index [0-9a-f]{7})|\$ \w|>>> "
    r"|(?:[\w:./\-]+[,;\t]){3,}[\w:./\-]*\s*$|(?:-?[\d.]+(?:e[-+]?\d+)?[\s,;|]+){3,}"
    r")"
)
STATS = ("words", "mean_word_len", "symbol_ratio", "digit_ratio", "line_end_share", "common_share", "prose_share")
#: Which tail of a statistic junk lies in: -1 low, 1 high, 0 both.
TAIL = {"words": 0, "mean_word_len": 0, "symbol_ratio": 1, "digit_ratio": 1, "line_end_share": -1, "common_share": -1, "prose_share": -1}
#: Common words a prose stretch has at least; words below which a stretch follows its neighbour.
COMMON_LEAST, SHORT = 0.2, 4
#: The statistics that are scored, and the least tail probability that counts, so that scores mean the same at every size.
SCORED, LEAST_TAIL = ("symbol_ratio", "digit_ratio", "line_end_share", "common_share", "prose_share"), 0.001
#: Score from which a document is found, and below which it is not; between them the share of prose is looked at.
CLEAR, POSSIBLE = 30.0, 11.0
#: A value that one in HEAVY of all documents has is joined back by broadcast: at most that many values a statistic.
#: Where one in HEAVY is fewer than HEAVY_DOCS documents, all values meet in one join, with the same result.
HEAVY, HEAVY_DOCS = 1000, 1000
#: Fixed reference: each statistic's quantiles over the 6,247 documents of sf0.1 whose prose share is at least 0.5.
QUANTILES = (0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999)
REFERENCE = {
    "words": (2, 13, 20, 150, 444, 1071, 1497), "mean_word_len": (3.687, 4.135, 4.507, 4.765, 5.337, 14.56, 18.0),
    "symbol_ratio": (0.0, 0.004821, 0.01821, 0.02625, 0.05199, 0.08948, 0.3114), "digit_ratio": (0.0, 0.0, 0.0, 0.005924, 0.01495, 0.0532, 0.1981),
    "line_end_share": (0.0, 0.0, 0.125, 0.6, 1.0, 1.0, 1.0), "common_share": (0.0, 0.0, 0.4, 0.4815, 0.5291, 0.5984, 0.6667), "prose_share": (0.7184, 0.731, 0.8144, 1.0, 1.0, 1.0, 1.0),
}


def _is_prose(lines: list[str]) -> bool | None:
    """Whether the lines of a stretch are running prose; None if they are too short to tell."""
    text = " ".join(lines)
    words = WORD.findall(text)
    cjk = len(CJK.findall(text))
    if cjk >= 6:
        return cjk >= 0.25 * sum(c.isalnum() for c in text) and bool(KANA_MARKS.search(text))
    solid = len(text.replace(" ", ""))
    letters = sum(c.isalpha() for c in text)
    if solid >= 10 and letters < 0.5 * solid:
        return False
    if len(words) < SHORT:
        return None
    common = sum(w.lower() in COMMON for w in words) / len(words)
    return common >= COMMON_LEAST and letters >= 0.6 * solid


def prose_chars(text: str) -> tuple[int, int]:
    """(characters in running prose, characters) without white space at line ends and blank lines."""
    total = prose = 0
    fence = False
    last: bool | None = None
    waiting = 0
    block: list[str] = []

    def settle(kind: bool | None, n: int) -> None:
        nonlocal prose, last, waiting
        if kind is None:
            if last is None:
                waiting += n
            elif last:
                prose += n
            return
        if waiting:
            prose += waiting * kind
            waiting = 0
        prose += n * kind
        last = kind

    def flush() -> None:
        if block:
            settle(_is_prose(block), sum(map(len, block)))
            block.clear()

    for raw in text.splitlines():
        line = QUOTE.sub("", raw).rstrip()
        bare = line.strip()
        if not bare:
            flush()
            continue
        total += len(bare)
        if bare.startswith(("```", "~~~")):
            flush()
            fence = not fence
            settle(False, len(bare))
        elif fence:
            settle(False, len(bare))
        elif HEADING.match(bare) and len(bare) < 80:
            flush()
            last_before = last
            last = None
            settle(None, len(bare))
            if last_before is not None and waiting == 0:
                last = last_before
        elif STRICT.match(bare) and not (block and WORD.fullmatch(bare.rstrip(".,;!?")) and block[-1]):
            flush()
            settle(False, len(bare))
        elif raw[:4] in ("    ", "\t") or raw[:1] == "\t":
            flush()
            settle(False if last is False else _is_prose([bare]), len(bare))
        elif ITEM.match(bare):
            flush()
            kind = _is_prose([bare])
            settle(bool(kind) and len(WORD.findall(bare)) >= 8, len(bare))
        else:
            block.append(bare)
    flush()
    return prose, total


def text_stats(text: str | None) -> tuple | None:
    """(words, mean_word_len, symbol_ratio, digit_ratio, line_end_share, common_share, prose_share); None for blank texts."""
    if text is None or not text.strip():
        return None
    text = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    words = WORD.findall(text)
    solid = sum(map(len, TOKEN.findall(text))) or 1
    lines = [x for x in text.splitlines() if x.strip()]
    n = len(words)
    prose, total = prose_chars(text)
    return (
        float(n),
        sum(map(len, words)) / n if n else 0.0,
        len(SYMBOL.findall(text)) / solid,
        sum(c.isdigit() for c in text) / solid,
        sum(bool(SENTENCE_END.search(x)) for x in lines) / len(lines) if lines else 0.0,
        sum(w.lower() in COMMON for w in words) / n if n else 0.0,
        prose / total if total else 0.0,
    )


def with_stats(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, the statistics) of every document."""
    kind = dict(docs.dtypes)[key]
    tag = F.lower(F.trim(F.coalesce(docs[lang], F.lit(""))))
    rows = docs.select(docs[key].alias("key"), F.when(tag == "", F.lit("und")).otherwise(tag).alias("lang"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [text_stats(t) or (None,) * len(STATS) for t in pdf.text]
            yield pd.concat([pdf[["key", "lang"]], pd.DataFrame(got, columns=list(STATS), dtype="float64")], axis=1)

    return spread(rows).mapInPandas(run, f"key {kind}, lang string, " + ", ".join(f"{s} double" for s in STATS)).withColumnRenamed("key", key)


def exact_ranks(long: DataFrame) -> DataFrame:
    """(lang, stat, value, docs, n, below, total) of each distinct value: documents with it, and of those that count (`counts` is 1)
    how many have it, less, and anything.

    `long` has lang, stat, value, counts. Counting precedes the shuffle; parts hold ranges of (lang, stat, value), so a language or value
    of a third of all rows is spread over parts. The offsets table has a row for each part and group in it."""
    counts = long.groupBy("lang", "stat", "value").agg(F.count(F.lit(1)).alias("docs"), F.sum("counts").alias("n"))
    ranged = counts.repartitionByRange(parts_for(counts), "lang", "stat", "value").sortWithinPartitions("lang", "stat", "value")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: dict = {}
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for pdf in batches:
            if len(pdf):
                grouped = pdf.groupby(["lang", "stat"], sort=False).n
                before = pd.Series([run.get(k, 0) for k in zip(pdf.lang, pdf.stat)], index=pdf.index)
                pdf["below_here"] = grouped.cumsum() - pdf.n + before
                for k, s in grouped.sum().items():
                    run[k] = run.get(k, 0) + int(s)
                pdf["part"] = part
                yield pdf

    local = cut_lineage(ranged.mapInPandas(number, "lang string, stat string, value double, docs bigint, n bigint, below_here bigint, part int"))
    sums = local.groupBy("lang", "stat", "part").agg(F.sum("n").alias("in_part"))
    w = Window.partitionBy("lang", "stat")
    offsets = sums.select(
        "lang", "stat", "part", F.sum("in_part").over(w).alias("total"),
        F.coalesce(F.sum("in_part").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return local.join(offsets, ["lang", "stat", "part"]).select("lang", "stat", "value", "docs", "n", (F.col("below_here") + F.col("offset")).alias("below"), "total")


def _summed_tails(long: DataFrame, documents: int) -> DataFrame:
    """(key, lang, score): the sum over the statistics of -ln of the tail probability on the side of junk, among the rows that count."""
    ranks = exact_ranks(long.select("lang", "stat", "value", "counts"))
    low = (F.col("below") + F.col("n") + 1) / (F.col("total") + 1)
    high = (F.col("total") - F.col("below") + 1) / (F.col("total") + 1)
    side = F.create_map(*[x for s in SCORED for x in (F.lit(s), F.lit(TAIL[s]))])[F.col("stat")]
    tail = F.when(side < 0, low).when(side > 0, high).otherwise(2 * F.least(low, high))
    tails = ranks.select("lang", "stat", "value", "docs", (-F.log(F.least(F.lit(1.0), F.greatest(F.lit(LEAST_TAIL), tail)))).alias("s"))
    rows = long.select("key", "lang", "stat", "value")
    if documents < HEAVY * HEAVY_DOCS:  # no value that counts as heavy has so many documents that it were a task's work
        return rows.join(tails, ["lang", "stat", "value"]).groupBy("key", "lang").agg(F.sum("s").alias("score"))
    tails = cut_lineage(tails)
    # values that very many documents share come by broadcast; so no value is one task's work
    heavy = tails.where(F.col("docs") * HEAVY >= documents).select("lang", "stat", "value", F.col("s").alias("heavy"))
    met = rows.join(F.broadcast(heavy), ["lang", "stat", "value"], "left")
    rest = met.where("heavy is null").drop("heavy").join(tails.select("lang", "stat", "value", "s"), ["lang", "stat", "value"])
    both = met.where("heavy is not null").select("key", "lang", F.col("heavy").alias("s")).unionByName(rest.select("key", "lang", "s"))
    return both.groupBy("key", "lang").agg(F.sum("s").alias("score"))


def outlier_scores(stats: DataFrame, key: str) -> DataFrame:
    """(key, lang, score): the outlier score of each document that has statistics, against the core of its language."""
    filled = stats.where(F.col("words").isNotNull()).withColumnRenamed(key, "key")
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in SCORED])
    long = filled.select("key", "lang", F.explode(pairs).alias("p")).select("key", "lang", "p.stat", "p.value")
    documents = filled.count()
    first = cut_lineage(_summed_tails(long.withColumn("counts", F.lit(1)), documents))
    median = first.groupBy("lang").agg(F.percentile_approx("score", 0.5, 10_000).alias("median"))
    core = first.join(F.broadcast(median), "lang").select("key", "lang", (F.col("score") <= F.col("median")).cast("int").alias("counts"))
    return _summed_tails(long.join(core, ["key", "lang"]), documents).withColumnRenamed("key", key)


def reference_score() -> Column:
    """The same sum against the fixed reference, by the outermost quantile a statistic lies beyond."""
    def tail(stat: str) -> Column:
        low = high = F.lit(1.0)
        for q, v in reversed(list(zip(QUANTILES, REFERENCE[stat]))):
            low = F.when(F.col(stat) < v, q).otherwise(low) if q <= 0.5 else low
        for q, v in zip(QUANTILES, REFERENCE[stat]):
            high = F.when(F.col(stat) > v, 1 - q).otherwise(high) if q >= 0.5 else high
        side = TAIL[stat]
        return low if side < 0 else high if side > 0 else F.least(F.lit(1.0), 2 * F.least(low, high))

    return reduce(lambda a, b: a + b, [-F.log(tail(s)) for s in SCORED])


def decided(stats: DataFrame, key: str) -> DataFrame:
    """(key, score, found, by): what each document with statistics is found to be, and whether its score or the exact check decides."""
    scores = outlier_scores(stats, key).groupBy(key).agg(F.max("score").alias("score"))
    rows = stats.where(F.col("words").isNotNull()).join(scores, key)
    possible = F.greatest("score", reference_score()) >= POSSIBLE
    clear = F.col("score") >= CLEAR
    return rows.select(key, "score", (clear | (possible & (F.col("prose_share") < 0.5))).alias("found"), F.when(clear | ~possible, "score").otherwise("check").alias("by")).dropDuplicates([key])


def found(stats: DataFrame, key: str) -> DataFrame:
    """(key) of the documents found not to be running prose."""
    return decided(stats, key).where("found").select(key)


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stats(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_scores(cut_lineage(p10_stats(spark, sf_dir)), "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(cut_lineage(p10_stats(spark, sf_dir)), "doc_id")
