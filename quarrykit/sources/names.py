"""Names and layouts of the files that runs leave, so that later runs find them."""

from __future__ import annotations

import posixpath


def windows(base: str, repo: str, window: int, slices: int) -> str:
    return posixpath.join(base, "windows", f"{repo}_ws{window}_ss{slices}")


def current_file_windows(base: str, task: str, window: int, slices: int) -> str:
    return posixpath.join(base, "current-files", f"{task}_ws{window}_ss{slices}")


def vectors(base: str, repo: str, encoder: str, window: int, slices: int) -> str:
    return posixpath.join(base, "vectors", encoder, f"{repo}_ws{window}_ss{slices}")


def retrieval(base: str, benchmark: str, retriever: str) -> str:
    return posixpath.join(base, "retrieval", f"{benchmark}_{retriever}")


def prompts(base: str, benchmark: str) -> str:
    return posixpath.join(base, f"{benchmark}_prompt.jsonl")


def processed(base: str, benchmark: str) -> str:
    return posixpath.join(base, f"processed_{benchmark}.jsonl")


def generations(base: str, benchmark: str, rank: int | None = None) -> str:
    return posixpath.join(base, f"{benchmark.lower()}.{'final' if rank is None else f'raw.{rank}'}.generated.jsonl")


def results(base: str, task: int | str) -> str:
    return posixpath.join(base, f"results_{task}.jsonl")
