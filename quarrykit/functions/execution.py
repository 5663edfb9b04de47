"""Opt-in execution of untrusted programs, each in its own process with limits. Off unless QUARRYKIT_ALLOW_EXECUTION=1."""

from __future__ import annotations

import os
import resource
import shutil
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW = "QUARRYKIT_ALLOW_EXECUTION"
SCHEMA = "program_hash bigint, passed boolean, message string, output string"


def allowed() -> bool:
    return os.environ.get(ALLOW) == "1"


def run_program(program: str, timeout: float = 3.0, memory_mb: int = 1024, command: tuple[str, ...] = (sys.executable, "-I", "-S")) -> tuple[bool, str, str]:
    """(passed, message, output) of a program in an empty folder: own process group, CPU, memory, file and process limits, no environment."""
    def limit() -> None:
        os.setsid()
        resource.setrlimit(resource.RLIMIT_CPU, (int(timeout) + 1, int(timeout) + 1))
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "program.py")
        with open(path, "w", encoding="utf-8") as f:
            f.write(program)
        p = subprocess.Popen([*command, path], cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, preexec_fn=limit, env={"PATH": "/usr/bin:/bin"})
        try:
            out, _ = p.communicate(timeout=timeout)
            code = p.returncode
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            return False, "timed out", ""
    text = out[-2048:].decode("utf-8", "replace")
    return (True, "passed", text) if code == 0 else (False, "failed: " + (text.strip().split("\n")[-1] if text.strip() else f"exit {code}"), text)


#: What a guarded program can't call any more, by module.
GUARDED = {
    "os": "kill system putenv remove removedirs rmdir fchdir setuid fork forkpty killpg rename renames truncate replace unlink fchmod fchown chmod chown chroot lchown getcwd chdir".split(),
    "shutil": "rmtree move chown".split(), "subprocess": ["Popen"], "builtins": ["exit", "quit"],
}


def guarded(program: str) -> str:
    """A program behind a preamble that takes destructive calls from it; a second fence beside the limits of its process, not a sandbox by itself."""
    names = "; ".join(f"[setattr(__import__({m!r}), n, None) for n in {calls!r} if hasattr(__import__({m!r}), n)]" for m, calls in GUARDED.items())
    return f"{names}\n{program}"


def answer_of(program: str, symbol: str | None = None, timeout: float = 3.0, memory_mb: int = 1024) -> str | None:
    """What a program works out: the text of a global symbol after it ran, or its output; None if it fails."""
    ok, _, out = run_program(program if symbol is None else f"{program}\nprint(); print({symbol})", timeout, memory_mb)
    return (out.strip() if symbol is None else out.rstrip("\n").rpartition("\n")[2].strip()) if ok else None


def run_suite(folder: str, patches: list[tuple[str, int, int, str]], tests: list[str], timeout: float = 30.0, memory_mb: int = 5120, command: tuple[str, ...] = (sys.executable, "-m", "pytest", "-x", "-q")) -> str:
    """Pass, Error or TimeOut of the tests of a repository with some lines replaced: (file, first line, line after the last, text), from 0.

    The repository is copied to an empty folder, patched and tested there, so the original is never touched and needs no restoring. All tests
    share the time; a patch outside its file or the folder is an Error."""
    def limit() -> None:
        os.setsid()
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))

    with tempfile.TemporaryDirectory() as copy:
        root = os.path.realpath(shutil.copytree(folder, os.path.join(copy, "repo"), symlinks=True))
        for name, start, end, text in patches:
            path = os.path.realpath(os.path.join(root, name))
            if not path.startswith(root + os.sep) or not os.path.isfile(path):
                return "Error"
            with open(path, encoding="utf-8") as f:
                lines = f.read().split("\n")
            if not 0 <= start <= end <= len(lines):
                return "Error"
            with open(path, "w", encoding="utf-8") as f:
                f.write("\n".join([*lines[:start], *text.rstrip("\n").split("\n"), *lines[end:]]))
        left = time.monotonic() + timeout
        for test in tests:
            p = subprocess.Popen([*command, test], cwd=root, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, preexec_fn=limit, env={"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "PYTHONPATH": root})
            try:
                code = p.wait(timeout=max(0.01, left - time.monotonic()))
            except subprocess.TimeoutExpired:
                os.killpg(p.pid, signal.SIGKILL)
                p.wait()
                return "TimeOut"
            if code:
                return "Error"
    return "Pass"


def suites(tasks: DataFrame, folder: str, patches: str, tests: str, timeout: float = 30.0, memory_mb: int = 5120) -> DataFrame:
    """Every task with its status: `folder` holds its repository, `patches` an array of (file, start, stop, text), `tests` the tests' names. Null while execution is not allowed."""
    if not allowed():
        return tasks.withColumn("status", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(folder: pd.Series, patches: pd.Series, tests: pd.Series) -> pd.Series:
        return pd.Series([run_suite(f, [(p["file"], p["start"], p["stop"], p["text"]) for p in (ps if ps is not None else [])], list(ts if ts is not None else []), timeout, memory_mb) for f, ps, ts in zip(folder, patches, tests)])

    return tasks.withColumn("status", run(F.col(folder), F.col(patches), F.col(tests)))


def execute(programs: DataFrame, program: str, timeout: float = 3.0, memory_mb: int = 1024) -> DataFrame:
    """Every row with passed, message and output. Equal programs run once. Rows get null results while execution is not allowed."""
    keyed = programs.withColumn("program_hash", F.xxhash64(program))
    if not allowed():
        return keyed.withColumn("passed", F.lit(None).cast("boolean")).withColumn("message", F.lit("execution is off")).withColumn("output", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [run_program(x or "", timeout, memory_mb) for x in pdf.p]
            yield pd.DataFrame({"program_hash": pdf.program_hash, "passed": [g[0] for g in got], "message": [g[1] for g in got], "output": [g[2] for g in got]})

    one = keyed.select("program_hash", F.col(program).alias("p")).dropDuplicates(["program_hash"])
    return keyed.join(one.mapInPandas(run, SCHEMA), "program_hash")


def spliced_test(check: str, solution: str, completion: str) -> str:
    """A test file with the solution replaced by a completion; the solution must stand in it."""
    if solution not in check:
        raise ValueError("the solution does not stand in the test")
    return check.replace(solution, completion)
