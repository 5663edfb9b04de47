"""Broken prompt-response pairs: each defective answer with its defect.

Two models are trained on the texts themselves and decide, for whole batches at once in numpy.

Languages: naive Bayes over character n-grams, with natural languages, Python, and other code as classes. It is fitted on a sample of
SAMPLE texts (the least hashes) that common words or marks of code label clearly. The natural part of an answer is `other_language` if its posterior
is for another language than the prompt's, the code part if its posterior is for other code.

Endings: n-grams of token kinds, each with the state it stands in - open brackets, open quote, open fence. Of each n-gram is counted, over
all answers, how often it occurs and how often it ends an answer (partial counts in each task, one sum; the table is bounded by the
number of kinds). An answer is a candidate for `truncated` if its last n-gram seldom ends where it occurs, or is rare among all
ends; an exact check follows: code must not parse to its end (or must end in a name that stands nowhere else), prose must lack a sentence end.

Emptiness, refusal and copies are told by forms and comparison. Defects in order of precedence, one for each answer: `empty`,
`refusal`, `copy`, `other_language`, `truncated`.

Defined cases: a null or empty response array gives no rows; a null element or run answer is `empty`; a null prompt can't be copied
and has no language; repeated rows count once; texts are read whole."""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.runtime import cut_lineage, read_table, spread

#: Texts that the naive Bayes model is fitted on at most; buckets of its hashed n-grams; sizes of them.
SAMPLE, BUCKETS, SIZES = 8_000, 1 << 16, (2, 3)
#: Log-odds of the answer's language over the prompt's, per n-gram, from which they differ; letters of prose or code an answer needs for that.
ODDS, CODE_ODDS, LETTERS, CODE_LETTERS = 0.08, 0.1, 12, 40
#: Share of the places of an n-gram that end an answer, and share of all ends it makes, below which it is an unlikely end; times it must have been seen.
END_SHARE, END_RARE, END_SEEN = 0.05, 0.004, 20
#: Characters at a text's end that its last tokens are looked for in first.
TAIL = 64
#: Characters that numpy works on at once; bounds a worker's memory whatever the batch.
BLOCK_CHARS = 1_000_000
#: Common words that mark a language, for the labels of the training sample.
MARKS = {
    "en": frozenset("the of and to is that for on as with was be by at from or an are this which you not but have has they all so when if it we what".split()),
    "de": frozenset("der die das und ist nicht ein eine einen dem den des von zu mit sich auf für als auch es wird werden wenn wir ich nur oder aber vor zur bis damit obwohl bevor weil dass was".split()),
    "fr": frozenset("le la les des du un une et est que qui dans en pour pas sur au par plus ne se ce il elle sont avec nous vous mais ou où si cette dès sans avant quand déjà cela c'est".split()),
    "es": frozenset("el los las y es que del se por un una con no su para al lo como más pero esta entre cuando muy sin sobre también hasta hay donde todo antes así aunque esto si qué".split()),
}
NATURAL_LANGUAGES, CODE_LANGUAGES = ("en", "de", "fr", "es", "zh", "other"), ("python", "code")
LANGUAGES = NATURAL_LANGUAGES + CODE_LANGUAGES
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
OTHER_SCRIPT = re.compile(r"[Ѐ-ӿ؀-ۿऀ-ॿ฀-๿Ͱ-Ͽ֐-׿]")
NATURAL = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
IDENTIFIER = re.compile(r"\b\w*(?:_\w+)+\b|\b\w*[a-z][A-Z]\w*\b|\b\w+\(|`[^`]*`|#FILE:[^\n]*")
FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n`]*$", re.M)
FENCED = re.compile(r"^[ \t]*(?:```|~~~)([^\n`]*)\n(.*?)(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.M | re.S)
CODE_LINE = re.compile(
    r"^(?:\s+\S|(?:async\s+)?def\s|class\s|@\w|import\s|from\s+\S+\s+import|return\b|if\s.*:|for\s.*:|while\s.*:|with\s.*:|try:|else:|elif\s|except\b|#|[\w.\[\]\"', *()]+\s[-+*/%|&]?=\s|\w[\w.]*\(.*\)?$|del\s|assert\s|raise\s|pass$|\)|\]|\}|\"\"\"|''')"
)
QUOTED, PARAGRAPH, WORDS = re.compile(r"^[ \t]*>+ ?", re.M), re.compile(r"\n\s*\n"), re.compile(r"\w+")
BLANK = re.compile(r"[\s​‌‍⁠﻿]+")
#: Answers that hold a place only.
HOLDER = re.compile(
    r"(?i)(?:(?:#|//|--)?\s*(?:todo|fixme|tbd|xxx|n/?a|none|null|your (?:code|answer|solution) (?:goes )?here|(?:add|write|insert|put) your (?:code|answer)(?: here)?|implement(?:ation)?(?: me| here| goes here)?|placeholder|not implemented(?: yet)?|to be (?:done|implemented|completed)|fill (?:me )?in|coming soon|code here|answer here)[\s:.!\-]*(?:implement\w*|this|here|me|it|function|later|the|body|\s)*\.?)"
)
#: The general forms of declining in the first person, of apology with a negation, and of being outside what is allowed.
REFUSAL = re.compile(
    r"(?i)\bi(?:'m| am)? (?:\w+ )?(?:can(?:'|no)?t|can ?not|won't|will not|must not|may not|unable|not (?:able|allowed|permitted|comfortable|going)|do(?:n't| not) feel comfortable|(?:must |have to |need to )?(?:decline|refuse)|would rather not|prefer not)\b"
    r"|\b(?:sorry|apolog\w+|regret\w*|unfortunately|afraid)\b[^\n]{0,90}\b(?:can(?:'|no)?t|cannot|unable|won't|not|outside|beyond|against|irresponsible)\b|\bno can do\b"
    r"|\bas an? (?:ai|assistant|(?:large )?language model)\b[^\n]{0,40}\b(?:not|can(?:'|no)?t|cannot|unable)\b|\b(?:against|outside|beyond|violates) (?:of )?(?:my|what i|the) (?:\w+ )?(?:guidelines|policy|policies|rules|am|can)\b"
    r"|\bich (?:kann|darf|muss|werde|möchte|bin)\b[^\n.]{0,40}\b(?:nicht|ablehnen|außerstande|keine)\b|\b(?:kann|darf|muss) ich\b[^\n.]{0,40}\b(?:nicht|ablehnen)\b|\bleider\b[^\n.]{0,40}\b(?:nicht|keine)\b|\b(?:tut mir leid|leider nicht)\b"
    r"|\bje (?:ne )?(?:peux|puis|pourrai|saurais|suis|dois|refuse)\b[^\n.]{0,30}(?:\bpas\b|refuser|décliner|désolé|navré)|\bje refuse\b|\bdésolée?\b[^\n.]{0,40}\b(?:pas|impossible)\b|\bm'est impossible\b"
    r"|\bno (?:puedo|podré|estoy (?:autorizad|capacitad))|\blo siento\b|\bno me es posible\b|\b(?:debo|tengo que) (?:rechazar|declinar)\b|\bme niego\b|\blament(?:o|ablemente)\b"
    r"|(?:抱歉|对不起|很遗憾)|我(?:无法|不能|不会)"
)
#: Marks of code that is not Python, for the labels of the training sample.
OTHER_CODE = (
    re.compile(r"[{};]\s*$"), re.compile(r"^\s*(?:function\b|var\s|let\s|const\s|public\s|private\s|static\s|fn\s|pub\s|func\s|package\s|impl\s|struct\s|enum\s|interface\s|#include|using\s|namespace\s|template\s*<|int\s+\w+\s*[=(]|void\s|std::|SELECT\s|fun\s|val\s|sub\s|my\s|local\s|echo\s)"),
    re.compile(r":=|=>|->\s*\w+[<>\w]*\s*\{|::|\bnil\b|&&|\|\||!==?|===|\|\w+\||\$\w+|\.(?:unwrap|iter|collect|push|size|map|filter)\("), re.compile(r"^\s*(?:end|fi|done|esac)\s*$"), re.compile(r"^\s*def\s+\w+[!?]?(?:\([^)]*\))?\s*$"),
)
OTHER_ANY = re.compile("|".join(f"(?:{p.pattern})" for p in OTHER_CODE))
OTHER_HEAD = re.compile("|".join(f"(?:{OTHER_CODE[i].pattern})" for i in (1, 3, 4)))
KEYWORDS = tuple("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False".split())


def natural_text(text: str) -> str:
    """The natural-language part: no fenced code, no code lines, no identifiers; if nothing else is left, the contents of docstrings."""
    bare = FENCED.sub("\n", text) if "```" in text or "~~~" in text else text
    lines = [x for x in bare.split("\n") if x.strip() and not CODE_LINE.match(x)]
    if not lines:
        docs = re.findall(r"(\"\"\"|''')(.*?)(?:\1|\Z)", text, re.S)
        lines = [d for _, d in docs]
    return IDENTIFIER.sub(" ", "\n".join(lines))


def marked_language(text: str) -> str | None:
    """The language that common words mark clearly; None if none does."""
    cjk = len(CJK.findall(text))
    words = [w.lower() for w in NATURAL.findall(text)]
    if cjk >= 6 and cjk >= 0.2 * sum(map(len, words)):
        return "zh"
    if len(OTHER_SCRIPT.findall(text)) > 0.5 * max(1, sum(map(len, words))):
        return "other"
    n = {k: sum(w in m for w in words) for k, m in MARKS.items()}
    best, second = sorted(n.values(), reverse=True)[:2]
    if best >= 3 and best >= 1.8 * second and best >= 0.12 * len(words):
        return max(n, key=n.get)
    return None


def code_text(text: str) -> str:
    """The code part: fenced code, else the lines that look like code."""
    m = FENCED.search(text) if "```" in text or "~~~" in text else None
    if m:
        return m.group(2)
    return "\n".join(x for x in text.split("\n") if x.strip() and (CODE_LINE.match(x) or x.rstrip()[-1:] in "{};" or x.strip() == "end"))


def code_label(code: str) -> str | None:
    """`python` if it parses, `code` if its lines bear marks of other languages and it does not; None if neither is clear."""
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return None
    if sum(OTHER_ANY.search(x) is not None for x in lines) >= max(2, 0.4 * len(lines)) and any(OTHER_HEAD.search(x) for x in lines):
        return "code" if code_state(code) != "whole" else None
    return "python" if len(lines) >= 2 and code_state(code) == "whole" else None


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of the list of at most BLOCK_CHARS characters, or one text."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= BLOCK_CHARS):
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every character n-gram of the lower-case texts."""
    flat = [" " + " ".join(t.lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    who, bucket = [], []
    for n in SIZES:
        if len(codes) >= n:
            last = len(codes) - n + 1
            h = np.zeros(last, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + codes[i : last + i] + np.uint64(n)
            inside = owner[:last] == owner[n - 1 :]
            who.append(owner[:last][inside])
            bucket.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)[inside])
    return (np.concatenate(who), np.concatenate(bucket)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_languages(rows: list[tuple[str, str]]) -> np.ndarray:
    """Log probabilities (language, bucket) of a multinomial naive Bayes model with equal priors; -inf for a language without texts."""
    counts = np.full((len(LANGUAGES), BUCKETS), 0.1)
    for i, lang in enumerate(LANGUAGES):
        mine = [t for x, t in rows if x == lang]
        for a, b in _blocks(mine):
            counts[i] += np.bincount(gram_buckets(mine[a:b])[1], minlength=BUCKETS)
    known = np.array([any(x == lang for x, _ in rows) for lang in LANGUAGES])
    return np.where(known[:, None], np.log(counts / counts.sum(axis=1, keepdims=True)), -np.inf).astype(np.float32)


def posteriors(model: np.ndarray, texts: list[str], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Mean log-likelihood of each text's n-grams under each of the languages, nan under others; -inf where the language is out of the question, nan for too few letters."""
    out = np.full((len(texts), len(LANGUAGES)), np.nan, np.float32)
    zh, other = LANGUAGES.index("zh"), LANGUAGES.index("other")
    for a, b in _blocks(texts):
        who, bucket = gram_buckets(texts[a:b])
        n = np.maximum(np.bincount(who, minlength=b - a), 1)
        for i in map(LANGUAGES.index, languages):
            out[a:b, i] = np.bincount(who, model[i][bucket], minlength=b - a) / n
        for k, t in enumerate(texts[a:b], a):
            if t.isascii():
                cjk = foreign = 0
                few = len(t) < 3 * LETTERS and sum(map(str.isalpha, t)) < LETTERS
            else:
                letters = sum(map(str.isalpha, t))
                cjk, foreign = len(CJK.findall(t)) >= 0.2 * letters, len(OTHER_SCRIPT.findall(t)) > 0.5 * letters
                few = letters < LETTERS and len(CJK.findall(t)) < 4
            out[k, other] = 0 if foreign else -np.inf
            if not cjk:
                out[k, zh] = -np.inf
            if few:
                out[k] = np.nan
    return out


DEPTH = np.zeros(128, np.int64)
DEPTH[[40, 91, 123]], DEPTH[[41, 93, 125]] = 1, -1


def _kind_table() -> np.ndarray:
    """The class of each code point below 128: 0 space, 1 line end, 2 word, 3 digit, or the mark itself."""
    t = np.arange(128)
    for c in range(128):
        x = chr(c)
        t[c] = 1 if x == "\n" else 0 if x.isspace() or c < 32 else 2 if x.isalpha() or x == "_" else 3 if x.isdigit() else c
    return t


KIND = _kind_table()
TICKS = re.compile(r"`{3,}")
#: Weights of a word's characters by their place, for telling keywords by a sum.
PLACE_POWER = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(16)], np.uint32)
_sums = {w: sum(ord(c) * int(PLACE_POWER[i]) for i, c in enumerate(w)) % (1 << 32) for w in KEYWORDS}
KEYWORD_HASH = np.array(sorted(_sums.values()), np.uint32)
SENTENCE = {ord(c): ord(".") for c in "。．"} | {ord("！"): ord("!"), ord("？"): ord("?"), ord("…"): ord(".")}


def end_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, whether it ends its text) of every token: the kinds of the last three tokens, and whether a bracket, a quote of
    the line, or a fence is open behind them. Texts end where their white space at the end begins."""
    flat = [t.rstrip().translate(SENTENCE) if not t.isascii() else t.rstrip() for t in texts]
    codes = np.frombuffer("\n".join(flat + [""]).encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    owner = np.repeat(np.arange(len(flat), dtype=np.int32), [len(t) + 1 for t in flat])
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    low = np.minimum(codes, 127)
    kind = np.where(codes < 128, KIND[low], 2)
    bound = np.concatenate([[True], owner[1:] != owner[:-1]])
    start_of = np.flatnonzero(bound)

    def since(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of x from the place `at` up to each place."""
        total = np.cumsum(x, dtype=np.int32)
        return total - total[at] + x[at]

    text_at = np.repeat(start_of, np.diff(np.append(start_of, len(codes))))
    line_start = np.concatenate([[True], (kind[:-1] == 1) | bound[1:]])
    here = np.arange(len(codes), dtype=np.int32)
    line_at = np.maximum.accumulate(np.where(line_start, here, 0))
    depth = since(DEPTH[low], text_at) > 0
    quotes = since(codes == 34, line_at) % 2 | since(codes == 39, line_at) % 2
    run = (codes == 96) & np.concatenate([codes[1:] == 96, [False]]) & np.concatenate([codes[2:] == 96, [False, False]])
    fences = since(run & ~np.concatenate([[False], run[:-1]]), text_at) % 2
    word = (kind == 2) | (kind == 3)
    begins = (kind != 0) & ~(word & np.concatenate([[False], word[:-1]]) & ~bound)
    begins &= ~((kind == 1) & np.concatenate([(owner[1:] != owner[:-1]), [True]]))  # the line end that parts texts is no token
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    stop = np.append(at[1:], len(codes)) - 1
    place = np.minimum(here - np.maximum.accumulate(np.where(begins, here, 0)), len(PLACE_POWER) - 1)
    hashed = np.add.reduceat(np.where(word, codes.view(np.uint32) * PLACE_POWER[place], np.uint32(0)), at, dtype=np.uint32)
    found = np.minimum(np.searchsorted(KEYWORD_HASH, hashed), len(KEYWORDS) - 1)
    k = np.where((kind[at] == 2) & (KEYWORD_HASH[found] == hashed), 200 + found, kind[at]).astype(np.int64)
    who = owner[at]
    # the state behind the token: at its last character that is no space
    last = np.maximum.accumulate(np.where(kind != 0, here, 0))[stop]
    last = np.where((kind[last] == 1) & (codes[last] == 10) & (last > at), last - 1, last)
    state = depth[last].astype(np.int64) | quotes[last] << 1 | fences[last] << 2
    one = np.concatenate([[0], np.where(who[1:] == who[:-1], k[:-1] + 1, 0)])
    two = np.concatenate([[0, 0], np.where(who[2:] == who[:-2], k[:-2] + 1, 0)])[: len(k)]
    gram = ((two * 512 + one) * 512 + k + 1) * 8 + state
    return who, gram, np.concatenate([who[1:] != who[:-1], [True]])


def last_grams(texts: list[str]) -> np.ndarray:
    """The n-gram that ends each text, as end_grams gives it; -1 where there is none. Kinds come from the text's end, the state from the whole text."""
    out = np.full(len(texts), -1)
    flat = [t.rstrip() for t in texts]
    for a, b in _blocks([t[-TAIL:] for t in flat]):
        who, gram, last = end_grams([t[-TAIL:] for t in flat[a:b]])
        tokens = np.bincount(who, minlength=b - a)
        out[a + who[last]] = gram[last] >> 3 << 3
        for k in range(a, b):
            t = flat[k]
            if len(t) > TAIL and tokens[k - a] < 4:
                out[k] = end_grams([t])[1][-1]
            elif out[k] >= 0:
                line = t[t.rfind("\n") + 1 :]
                depth = t.count("(") + t.count("[") + t.count("{") > t.count(")") + t.count("]") + t.count("}")
                out[k] |= depth | (line.count('"') % 2 | line.count("'") % 2) << 1 | ((len(TICKS.findall(t)) % 2) << 2 if "```" in t else 0)
    return out


def unlikely_ends(texts: list[str], ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each text ends in an n-gram that is an unlikely end; `ends` are the n-grams of likely ends and all n-grams seen often, sorted."""
    likely, g = ends[0], last_grams(texts)
    return ~(likely[np.minimum(np.searchsorted(likely, g), len(likely) - 1)] == g) & (g >= 0) if len(likely) else g >= 0


def body_of(answer: str) -> str:
    """The code of an answer: its fenced part, else all of it."""
    m = FENCED.search(answer)
    return m.group(2) if m else FENCE.sub("", answer)


def _parse(code: str) -> SyntaxError | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return e if isinstance(e, SyntaxError) else SyntaxError(str(e))
    return None


@lru_cache(maxsize=16)
def code_state(code: str) -> str:
    """`whole` if Python parses it (as a module or as the body of a function), `open` if it breaks off at its end, else `broken`."""
    code = code.replace("\r\n", "\n").strip("\n").rstrip()
    if not code:
        return "whole"
    flat = textwrap.dedent(code)
    errors = []
    first = code[: len(code) - len(code.lstrip())]
    tries = [flat]
    if first or not flat.lstrip().startswith(("def ", "class ", "@", "import ", "from ", "async ")):
        tries.append("async def f():\n" + textwrap.indent(flat, "    "))
    for t in tries:
        e = _parse(t)
        if e is None:
            return "whole"
        errors.append((t, e))
    for t, e in errors:
        last = t.count("\n") + 1
        if re.search(r"never closed|unterminated|unexpected EOF|EOF in|expected an indented block|expected ':'|was never", str(e.msg)):
            if "expected ':'" not in str(e.msg) or (e.lineno or 0) >= last:
                return "open"
        if (e.lineno or 0) >= last:
            return "open"
        if (e.msg or "").startswith(("expected 'except'",)) and (e.lineno or 0) >= last - 1:
            return "open"
    return "broken"


def squeeze(text: str) -> str:
    """For comparison: no quote marks, fences or white space, lower case."""
    if ">" in text:
        text = QUOTED.sub("", text)
    if "```" in text or "~~~" in text:
        text = FENCE.sub("", text)
    bare = "".join(text.split()).lower()
    return bare if bare.isascii() else BLANK.sub("", bare)


@lru_cache(maxsize=64)
def prompt_parts(prompt: str) -> tuple[str, frozenset[str]]:
    """A prompt squeezed, and its paragraphs and first line squeezed; answers of one prompt come many in a row."""
    return squeeze(prompt), frozenset({squeeze(x) for x in PARAGRAPH.split(prompt)} | {squeeze(prompt.split("\n", 1)[0])})


PLACE_LINES = frozenset(("pass", "...", "…", '""""""', "''''''", '""', "''", "pass;", "-", "return ...", "raise NotImplementedError", "raise NotImplementedError()"))


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks and placeholders, however many."""
    if answer is None:
        return True
    for line in answer.split("\n"):
        bare = line.strip() if line.isascii() else BLANK.sub(" ", line).strip()
        if not bare or bare in PLACE_LINES or not any(map(str.isalnum, bare)) or FENCE.fullmatch(line.rstrip("\r")):
            continue
        if HOLDER.fullmatch(bare.strip("\"' ")) or re.fullmatch(r"raise NotImplementedError\((?:[\"'](?:todo|not implemented)?[\"'])?\)", bare, re.I):
            continue
        return False
    return True


def is_refusal(answer: str) -> bool:
    """Declines somewhere, and holds no code but such as does nothing."""
    for line in answer.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith(("#", "//", '"', "'", "pass", "...", "raise", "def ", "async def", "return None", "```", "~~~")):
            continue
        if CODE_LINE.match(line):
            return False
    return REFUSAL.search(answer) is not None


def is_copy(answer: str, prompt: str | None) -> bool:
    """Repeats the prompt or a whole part of it and adds nothing."""
    if not prompt:
        return False
    a = squeeze(answer)
    p, parts = prompt_parts(prompt)
    if a.endswith(("pass", "...")) and len(a) > 40:
        a = a.removesuffix("pass").removesuffix("...")
    if not a:
        return False
    if a == p:
        return True
    if len(a) >= 12 and a in parts:
        return True
    if a in p:
        return len(a) >= 60 and (p.endswith(a) or p.startswith(a) or bool(re.search(r"\bdef \w+\(", answer)))
    return len(p) >= 40 and a.replace(p, "") in ("", "pass", "...")


def is_truncated(answer: str, prompt: str | None) -> bool:
    """The exact check of a candidate: it breaks off inside a statement, string or sentence."""
    text = answer.rstrip()
    fences = len(FENCE.findall(text))
    if fences and fences % 2 == 0 and not text.endswith(("```", "~~~")):  # prose behind the last fence
        tail = re.split(r"(?m)^[ \t]*(?:```|~~~)[^\n`]*$", text)[-1]
        return not _sentence_ends(tail.rstrip())
    code = body_of(text)
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return False
    if not fences and sum(bool(CODE_LINE.match(x)) for x in lines) < 0.5 * len(lines):
        return not _sentence_ends(text)
    heads = [m.start() for m in re.finditer(r"^(?:async def|def|class|@\w)", code, re.M)]
    state = code_state(code)
    if state == "broken" and heads:
        runs = [h for i, h in enumerate(heads) if not i or "\n\n" in code[heads[i - 1] : h]]
        state = code_state(code[runs[-1] :])
    if state == "open" or fences % 2 == 1:
        return True
    if state != "whole":
        return False
    tail = code.rstrip().split("\n")[-1].strip()
    if tail.startswith(("def ", "@", "if ", "for ")):
        return True
    # a name that is cut stands nowhere else
    name = re.search(r"([^\W\d]\w*)$", tail)
    if name is None or tail.startswith("#") or name.group(1) in KEYWORDS or name.group(1) in ("self", "cls"):
        return False
    return WORDS.findall((prompt or "") + "\n" + code).count(name.group(1)) < 2


def _sentence_ends(text: str) -> bool:
    return bool(re.search(r"[.!?…。！？:;)\]\"'`*»”’]$", text))


def batch_defects(texts: list[str | None], prompts: list[str | None], model: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> list[str | None]:
    """The defect of each answer, or None."""
    out: list[str | None] = [None] * len(texts)
    left = []
    for i, (a, p) in enumerate(zip(texts, prompts)):
        if is_empty(a):
            out[i] = "empty"
        elif is_refusal(a):
            out[i] = "refusal"
        elif is_copy(a, p):
            out[i] = "copy"
        else:
            left.append(i)
    if not left:
        return out
    asked = {p: k for k, p in enumerate(dict.fromkeys(prompts[i] for i in left if prompts[i] is not None))}
    scores = posteriors(model, [natural_text(p) for p in asked], NATURAL_LANGUAGES) if asked else np.zeros((0, len(LANGUAGES)))
    mine = [texts[i] for i in left]
    said = posteriors(model, [natural_text(a) if "```" in a or "~~~" in a or not re.search(r"^\s*(?:def |async def |@)", a) else "" for a in mine], NATURAL_LANGUAGES)
    codes = [code_text(a) for a in mine]
    written = posteriors(model, codes, CODE_LANGUAGES)
    n = len(NATURAL_LANGUAGES)
    python, code = LANGUAGES.index("python"), LANGUAGES.index("code")
    unlikely = unlikely_ends(mine, ends)
    for k, i in enumerate(left):
        p = asked.get(prompts[i])
        if len(codes[k]) >= CODE_LETTERS and np.isfinite(written[k, [python, code]]).all() and written[k, code] - written[k, python] >= CODE_ODDS and code_state(codes[k]) != "whole":
            out[i] = "other_language"
        elif p is not None and not np.isnan(said[k, 0]) and not np.isnan(scores[p, 0]):
            own, want = int(said[k, :n].argmax()), int(scores[p, :n].argmax())
            if own != want and np.isfinite(said[k, own]) and said[k, own] - said[k, want] >= ODDS:
                out[i] = "other_language"
        if out[i] is None and unlikely[k] and is_truncated(texts[i], prompts[i]):
            out[i] = "truncated"
    return out


def answers(generation: DataFrame, runs: DataFrame) -> DataFrame:
    """(task_id, src, answer_no, answer): one row of each answer."""
    r = generation.select(F.col("task_id").cast("string").alias("task_id"), F.posexplode("response").alias("answer_no", "answer"))
    r = r.select("task_id", F.lit("response").alias("src"), "answer_no", "answer").dropDuplicates(["task_id", "answer_no"])
    e = runs.select(F.col("task_id").cast("string").alias("task_id"), F.lit("generation").alias("src"), F.col("prediction_id").cast("int").alias("answer_no"), F.col("generation").alias("answer"))
    return r.unionByName(e.dropDuplicates(["task_id", "answer_no"]))


def count_ends(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are likely ends, and all that were seen often, sorted. Counted in each task first, over all answers; the sum has a row for each n-gram
    of the fixed set of kinds, whatever the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [t for t in pdf.answer if t and t.strip()]
            for a, b in _blocks(rows):
                _, gram, last = end_grams(rows[a:b])
                kinds, of = np.unique(gram, return_inverse=True)
                yield pd.DataFrame({"k": kinds, "seen": np.bincount(of, minlength=len(kinds)), "ended": np.bincount(of[last], minlength=len(kinds))})

    got = texts.select("answer").mapInPandas(run, "k bigint, seen bigint, ended bigint").groupBy("k").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    t = got.where(F.col("seen") >= END_SEEN).toPandas().sort_values("k")
    total = max(1, int(t.ended.sum()))
    likely = t[(t.ended >= END_SHARE * t.seen) & (t.ended >= END_RARE * total)]
    return likely.k.to_numpy(np.int64), t.k.to_numpy(np.int64)


def sample_texts(texts: DataFrame) -> list[str]:
    """At most SAMPLE different texts, by the least hash; `texts` has text. Hashes are counted once each before the least are taken, so copies don't fill the sample."""
    hashed = texts.where(F.length("text") > 20).select("text", F.xxhash64("text").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if least is None:
        return []
    return sorted(r["text"] for r in hashed.where(F.col("h") <= least).dropDuplicates(["h"]).select("text").toLocalIterator())


def labelled(texts: list[str]) -> list[tuple[str, str]]:
    """The natural and the code part of each text that its common words or marks of code label clearly."""
    rows = []
    for t in texts:
        said, code = natural_text(t), code_text(t)
        if (lang := marked_language(said)) is not None:
            rows.append((lang, said))
        if (lang := code_label(code)) is not None:
            rows.append((lang, code))
    return rows


def defects(generation: DataFrame, runs: DataFrame) -> DataFrame:
    """(src, task_id, answer_no, defect) of each defective answer."""
    spark = generation.sparkSession
    prompts = generation.select(F.col("task_id").cast("string").alias("task_id"), "prompt").dropDuplicates(["task_id"])
    # answers of a prompt come together, so that what is worked out for the prompt serves them all; a task of very many answers is
    # dealt out by answer number, sixteen at a time
    a = answers(generation, runs).withColumn("block", F.floor(F.col("answer_no") / 16))
    each = cut_lineage(spread(a.join(prompts, "task_id", "left"), "task_id", "block").sortWithinPartitions("task_id"))
    model = fit_languages(labelled(sample_texts(each.select(F.col("answer").alias("text")).unionByName(prompts.select(F.col("prompt").alias("text"))))))
    shared = spark.sparkContext.broadcast((model, count_ends(each)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, ends = shared.value
        for pdf in batches:
            out = pdf[["src", "task_id", "answer_no"]].assign(defect=batch_defects(list(pdf.answer), list(pdf.prompt), model, ends))
            yield out[out.defect.notna()]

    return each.mapInPandas(run, "src string, task_id string, answer_no int, defect string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(read_table(spark, sf_dir, "generation"), read_table(spark, sf_dir, "execution_result"))


def p2_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each source and defect."""
    return p2_found(spark, sf_dir).groupBy("src", "defect").agg(F.count(F.lit(1)).alias("answers"))
