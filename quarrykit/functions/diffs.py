"""Line diffs: parse, apply, verify. A hunk line is `- n text` or `+ n text` with 1-based numbers, or unified format."""

from __future__ import annotations

import re
from dataclasses import dataclass

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class BadDiff(ValueError):
    """The diff does not parse, or does not fit the text."""


@dataclass
class Hunk:
    start: int  # 0-based line of the old text
    old: list[str]
    new: list[str]


def parse(diff: str) -> list[Hunk]:
    """Hunks of a unified diff, file heads passed over."""
    hunks: list[Hunk] = []
    for line in diff.split("\n"):
        if line.startswith(("--- ", "+++ ", "diff ", "index ")):
            continue
        if m := HUNK.match(line):
            n = int(m.group(2) or 1)
            hunks.append(Hunk(int(m.group(1)) - (n > 0), [], []))
        elif not hunks:
            if line.strip():
                raise BadDiff(f"a line before the first hunk: {line[:60]}")
        elif line.startswith("-"):
            hunks[-1].old.append(line[1:])
        elif line.startswith("+"):
            hunks[-1].new.append(line[1:])
        elif line.startswith(" "):
            hunks[-1].old.append(line[1:])
            hunks[-1].new.append(line[1:])
        elif line and not line.startswith("\\"):
            raise BadDiff(f"not a diff line: {line[:60]}")
    return hunks


def apply(text: str, diff: str) -> str:
    """The text after the diff; BadDiff where the old lines do not stand there."""
    lines = text.split("\n")
    shift = 0
    for h in parse(diff):
        at = h.start + shift
        if at < 0 or lines[at : at + len(h.old)] != h.old:
            raise BadDiff(f"hunk at line {h.start + 1} does not fit")
        lines[at : at + len(h.old)] = h.new
        shift += len(h.new) - len(h.old)
    return "\n".join(lines)


def state(text: str | None, diff: str | None) -> str:
    """`applies`, `misfit`, `malformed` or `empty`."""
    if not diff or not diff.strip():
        return "empty"
    try:
        hunks = parse(diff)
    except BadDiff:
        return "malformed"
    if not hunks:
        return "malformed"
    try:
        apply(text or "", diff)
    except BadDiff:
        return "misfit"
    return "applies"
