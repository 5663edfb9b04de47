"""Cleaning of model answers into code, and rendering of code into texts: Arrow-batched where plain expressions don't suffice."""

from __future__ import annotations

import difflib
import re
import textwrap

import pandas as pd
from pyspark.sql import functions as F

FENCE = re.compile(r"```[^\n]*\n(.*?)(?:```|\Z)", re.S)


def fenced(text: str | None, signature: str | None = None, last: bool = False) -> str | None:
    """The fenced code of an answer: the block with the signature if there is one, else the first or last block, else the whole text."""
    if text is None:
        return None
    blocks = FENCE.findall(text)
    if not blocks:
        return text
    if signature:
        flat = " ".join(signature.split())
        for b in blocks:
            if flat in " ".join(b.split()):
                return b
    return blocks[-1] if last else blocks[0]


def beyond_prompt(prompt: str, text: str) -> str:
    """What an answer adds to the prompt it repeats: the text after its longest common block with the prompt's end."""
    if text.startswith(prompt):
        return text[len(prompt) :]
    m = difflib.SequenceMatcher(None, prompt, text, autojunk=False).find_longest_match()
    return text[m.b + m.size :] if m.size >= 0.5 * len(prompt) and m.a + m.size == len(prompt) else text


def clean_body(text: str | None, signature: str | None = None) -> str | None:
    """The function of an answer: fenced block, no main guard, no imports before the definition, no blank lines, dedented to its def."""
    code = fenced(text, signature)
    if code is None:
        return None
    code = re.split(r"^if __name__\s*==", code, maxsplit=1, flags=re.M)[0].expandtabs(4)
    code = textwrap.dedent(code)
    name = re.search(r"def\s+(\w+)", signature or "")
    at = re.search(rf"^[ \t]*(?:async\s+)?def\s+{name.group(1) if name else r'\w+'}\b", code, re.M)
    if at:
        code = textwrap.dedent(code[at.start() :])
    else:
        code = "\n".join(x for x in code.split("\n") if not re.match(r"(?:import|from)\s", x))
    return "\n".join(x.rstrip() for x in code.split("\n") if x.strip())


def body_only(text: str | None, signature: str | None, indent: int = 4) -> str | None:
    """The statements of a function answer without its head and docstring, at `indent` spaces: what is spliced into a file."""
    code = clean_body(text, signature)
    if code is None:
        return None
    if re.match(r"[ \t]*(?:async\s+)?def\b", code):
        depth = 0
        for t in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]", code):
            depth += (t.group() in "([{") - (t.group() in ")]}")
            if t.group() == ":" and depth == 0:
                code = code[t.end() :].lstrip("\n")
                break
    code = textwrap.dedent(code)
    code = re.sub(r"\A\s*[rRuU]?(\"\"\"|''')(?:[^\\]|\\.)*?\1[ \t]*\n?", "", code, flags=re.S)
    return textwrap.indent(textwrap.dedent(code), " " * indent)


def reindent(text: str | None, spaces: int) -> str | None:
    return None if text is None else textwrap.indent(textwrap.dedent(text), " " * spaces)


def first_block(text: str | None) -> str | None:
    """Up to the first line, after the start, that is not indented: a completion's own body."""
    if text is None:
        return None
    lines = text.split("\n")
    for i, x in enumerate(lines[1:], 1):
        if x.strip() and not x[0].isspace():
            return "\n".join(lines[:i]).rstrip()
    return text.rstrip()


def after_return(text: str | None) -> str | None:
    """Up to the end of the last return at the body's own indent."""
    if text is None:
        return None
    lines = text.split("\n")
    last = max((i for i, x in enumerate(lines) if re.match(r"[ \t]{0,4}return\b", x)), default=None)
    return text if last is None else "\n".join(lines[: last + 1])


def balanced(text: str | None) -> str | None:
    """Up to the brace that closes the first one: a completion in a language of braces."""
    if text is None:
        return None
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth <= 0:
            return text[: i + 1]
    return text


def splice(lines: str, start: int, end: int, completion: str) -> str:
    """A file's text with its lines start..end (0-based, end left out) replaced."""
    xs = lines.split("\n")
    return "\n".join([*xs[:start], completion.rstrip("\n"), *xs[end:]])


def render_import(module: str, name: str | None, alias: str | None, level: int = 0) -> str:
    said = f"from {'.' * level}{module} import {name}" if name is not None or level else f"import {module}"
    return said + (f" as {alias}" if alias else "")


def _udf(f, n: int):
    if n == 1:
        @F.pandas_udf("string")
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in a])
    else:
        @F.pandas_udf("string")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b)])
    return run


def fenced_col(text, signature=None):
    return _udf(fenced, 1)(text) if signature is None else _udf(fenced, 2)(text, signature)


def clean_body_col(text, signature):
    return _udf(clean_body, 2)(text, signature)


def body_only_col(text, signature):
    return _udf(body_only, 2)(text, signature)


def first_block_col(text):
    return _udf(first_block, 1)(text)


def after_return_col(text):
    return _udf(after_return, 1)(text)


def balanced_col(text):
    return _udf(balanced, 1)(text)
