"""Text functions as JVM expressions; nothing here starts a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that tokens are split on.
SPACE = r"[ \t\n\f\r]+"


def lines(text: Column) -> Column:
    """The lines of a text; \\r\\n and \\r end lines too, and a last line end makes no empty line. Null gives null, empty text an empty array."""
    flat = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.split(flat, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """White-space tokens, case kept."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.array_join(tokens(text), " ")


def before_stop(text: Column, stops: list[str]) -> Column:
    """The text before the earliest stop string."""
    places = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = F.least(*places, F.lit(2**31 - 1)) if len(places) > 1 else F.coalesce(places[0], F.lit(2**31 - 1))
    return F.when(first == 2**31 - 1, text).otherwise(F.substring(text, F.lit(1), first - 1))


def after_last(text: Column, mark: str) -> Column:
    """The text after the last `mark`, the whole text without one: for chat answers behind [/INST] or </think>."""
    return F.substring_index(text, mark, -1)


def number(text: Column) -> Column:
    """A number with thousands commas as double; null where it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def indented(text: Column, spaces: int) -> Column:
    """Every line that is not blank, moved right."""
    return F.regexp_replace(text, r"(?m)^(?=.*\S)", " " * spaces)


def module_of(path: Column) -> Column:
    """The dotted module of a .py path; a package is its folder."""
    bare = F.regexp_replace(path, r"\.py$", "")
    return F.replace(F.regexp_replace(bare, r"/__init__$", ""), F.lit("/"), F.lit("."))


def safe_label(name: Column) -> Column:
    """A graph label without marks that graph formats reserve."""
    out = name
    for mark in (".", "^^^", "*", "-"):
        out = F.replace(out, F.lit(mark), F.lit("__" if mark == "." else ""))
    return out


def id_name(component_id: Column) -> Column:
    """The name part of `name@path`."""
    return F.substring_index(component_id, "@", 1)


def json_string(value: Column) -> Column:
    """A text as a JSON string, characters beyond ASCII kept."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r"^\{\"v\":(.*)\}$", 1)


def identifiers(text: Column) -> Column:
    """Distinct identifiers of a snippet, by their form."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def wildcard(name: Column, patterns: list[str]) -> Column:
    """Whether a name matches one of the shell patterns."""
    import fnmatch

    return F.lit(False) if not patterns else F.coalesce(*[F.when(name.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"), F.lit(True)) for p in patterns], F.lit(False))


def relationship(candidate: Column, class_name: Column, file_name: Column) -> Column:
    """intra_class, intra_file or cross_file by namespace prefix."""
    return F.when(candidate.startswith(F.concat(class_name, F.lit("."))), "intra_class").when(candidate.startswith(F.concat(file_name, F.lit("."))), "intra_file").otherwise("cross_file")


def hidden(path: Column) -> Column:
    """Whether a folder of the path begins with a dot or is a virtual environment."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & (p != ".") & (p != "..") | p.isin("myenv", "venv"))
