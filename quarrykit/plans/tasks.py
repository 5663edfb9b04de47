"""Benchmark tasks as DataFrame transforms: a registry of prompts, answer clean-up and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import responses as P
from quarrykit.functions import text as T
from quarrykit.operators import metrics as M

#: Chat styles around an instruction.
CHAT = {
    "plain": "{i}", "alpaca": "Below is an instruction that describes a task. Write a response that completes it.\n\n### Instruction:\n{i}\n\n### Response:\n",
    "inst": "[INST] {i} [/INST]", "chatml": "<|im_start|>user\n{i}<|im_end|>\n<|im_start|>assistant\n", "user": "USER: {i}\nASSISTANT:", "question": "Question: {i}\nAnswer:",
    "octo": "Question: {i}\n\nAnswer:", "guanaco": "### Human: {i}\n### Assistant:", "zephyr": "<|user|>\n{i}\n<|assistant|>\n", "fenced": "{i}\n```python\n",
}
FIM = {"psm": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"), "spm": ("<fim_suffix>", "<fim_prefix>", "<fim_middle>")}


def chat(instruction: Column, style: str) -> Column:
    """An instruction in a chat style."""
    before, after = CHAT[style].split("{i}")
    return F.concat(F.lit(before), instruction, F.lit(after))


def infill(prefix: Column, suffix: Column, order: str = "psm") -> Column:
    """A fill-in-the-middle prompt."""
    a, b, c = FIM[order]
    first, second = (prefix, suffix) if order == "psm" else (suffix, prefix)
    return F.concat(F.lit(a), first, F.lit(b), second, F.lit(c))


def few_shot(examples: list[tuple[str, str]], question: Column) -> Column:
    """Solved examples before a question."""
    return F.concat(F.lit("".join(f"{q}\n{a}\n\n" for q, a in examples)), question)


def bug_prompt(code: Column, message: Column, style: str = "comment") -> Column:
    """A prompt to mend code: the message as a comment above it, as an edit pair, or as an instruction."""
    if style == "comment":
        return F.concat(F.lit("# "), message, F.lit("\n"), code)
    if style == "edit":
        return F.concat(F.lit("<commit_before>"), code, F.lit("<commit_msg>"), message, F.lit("<commit_after>"))
    return F.concat(code, F.lit("\n\n"), message, F.lit("\n"))


@dataclass
class Task:
    """One benchmark: how a row becomes a prompt, an answer a program, and outcomes a metric."""

    name: str
    prompt: Callable[[DataFrame], Column]
    stops: list[str] = field(default_factory=list)
    clean: Callable[[Column], Column] | None = None
    metric: Callable[[DataFrame], DataFrame] | None = None

    def prompts(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prompt_text", self.prompt(rows))

    def programs(self, answers: DataFrame, column: str) -> DataFrame:
        text = T.before_stop(F.col(column), self.stops) if self.stops else F.col(column)
        return answers.withColumn("program", self.clean(text) if self.clean else text)

    def score(self, results: DataFrame) -> DataFrame:
        if self.metric is None:
            raise ValueError(f"{self.name} has no metric of its own")
        return self.metric(results)


REGISTRY: dict[str, Task] = {}


def register(task: Task) -> Task:
    if task.name in REGISTRY:
        raise ValueError(f"{task.name} is taken")
    REGISTRY[task.name] = task
    return task


def select(patterns: list[str]) -> list[Task]:
    """Tasks whose names match one of the shell patterns, by name."""
    import fnmatch

    return [REGISTRY[n] for n in sorted(REGISTRY) if any(fnmatch.fnmatch(n, p) for p in patterns)]


#: What programs of a language begin with.
PREAMBLES = {
    "python": "import math\nimport re\nimport sys\nimport copy\nimport datetime\nimport itertools\nimport collections\nimport heapq\nimport functools\nimport hashlib\nimport string\nfrom typing import *\nfrom collections import *\n",
    "cpp": "#include <algorithm>\n#include <cmath>\n#include <map>\n#include <string>\n#include <vector>\nusing namespace std;\n",
    "java": "import java.util.*;\nimport java.lang.*;\n", "rust": "use std::{slice::Iter, cmp::{max, self}, mem::replace, collections::{HashSet, HashMap}};\n", "js": "", "go": "package main\n",
}


def assembled(language: str, prompt: Column, completion: Column, test: Column) -> Column:
    """The program that runs a completion's test: preamble, prompt and completion without what would clash, test.

    C++ completions lose their main, Java ones their main class; of Go all imports of prompt and test are named once, behind the package."""
    if language not in PREAMBLES:
        raise ValueError(f"language must be one of {sorted(PREAMBLES)}")
    prompt, completion, test = (F.coalesce(x, F.lit("")) for x in (prompt, completion, test))
    head = F.lit(PREAMBLES[language])
    if language == "cpp":
        completion = F.regexp_replace(completion, r"(?s)\bint\s+main\s*\([^)]*\)\s*\{.*\z", "")
    elif language == "java":
        completion = F.regexp_replace(completion, r"(?s)\bpublic\s+class\s+Main\s*\{.*\z", "")
    elif language == "go":
        both = F.concat(prompt, F.lit("\n"), test)
        named = F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(F.regexp_extract_all(both, F.lit(r"(?m)^import\s*(\([^)]*\)|\"[^\"]+\")"), F.lit(1)), "\n"), F.lit(r"\"[^\"]+\""), F.lit(0))))
        bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?m)^import\s*(\([^)]*\)|\"[^\"]+\")\n?", ""), r"(?m)^package\s+\w+\n?", "")
        head = F.concat(head, F.when(F.size(named) > 0, F.concat(F.lit("import (\n\t"), F.array_join(named, "\n\t"), F.lit("\n)\n"))).otherwise(""))
        prompt, test = bare(prompt), bare(test)
    return F.concat(head, prompt, completion, F.lit("\n"), test)


def _pass(ks: list[int]) -> Callable[[DataFrame], DataFrame]:
    return lambda r: M.mean_pass_at_k(M.task_totals(r, "task_id", F.col("passed")), ks, True)


def _match(r: DataFrame) -> DataFrame:
    return r.agg(F.avg((F.col("program") == F.col("reference")).cast("double")).alias("exact_match"))


def _bleu(r: DataFrame) -> DataFrame:
    return r.agg(F.avg(100 * M.sentence_bleu(T.tokens(F.lower("reference")), T.tokens(F.lower("program")))).alias("bleu"))


def _vote(r: DataFrame) -> DataFrame:
    v = M.majority(r, "task_id", "answer", "answer_no").join(r.groupBy("task_id").agg(F.first("reference").alias("reference")), "task_id")
    return v.agg(F.avg(M.within_tolerance(F.col("answer"), F.col("reference")).cast("double")).alias("accuracy"))


PYTHON_STOPS = ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\n```"]
for _name, _prompt, _stops, _clean, _metric in [
    ("function-completion", lambda r: F.trim(F.col("prompt")), PYTHON_STOPS, None, _pass([1, 10, 100])),
    ("function-completion-instruct", lambda r: chat(F.col("prompt"), "inst"), [], P.after_return_col, _pass([1])),
    ("described-problem", lambda r: F.concat(F.lit('"""\n'), F.col("prompt"), F.lit('\n"""\n')), ['\n"""', "\nassert"], None, _pass([1, 10])),
    ("competition", lambda r: F.concat(F.lit("\nQUESTION:\n"), F.col("prompt"), F.lit("\n\nANSWER:\n")), ["\nQUESTION", "\n---"], None, _pass([1])),
    ("text-to-code", lambda r: F.concat(F.lit("Instruction:\n"), F.col("prompt"), F.lit("\nAnswer:\n")), ["\n"], None, _bleu),
    ("code-to-text", lambda r: F.concat(F.col("prompt"), F.lit('\n"""Explanation of the code above:\n')), ["\n"], None, _bleu),
    ("program-aided-math", lambda r: F.concat(F.lit("Q: "), F.col("prompt"), F.lit("\n\n# solution in Python:\n\n\n")), ["\n\n\n"], None, _vote),
    ("library-exercise", lambda r: F.col("prompt"), ["</code>", "# SOLUTION END"], None, _match),
    ("polyglot-completion", lambda r: F.trim(F.col("prompt")), ["\nfunc", "\nclass", "\n}"], P.balanced_col, _pass([1, 10, 100])),
    ("repair", lambda r: bug_prompt(F.col("prompt"), F.lit("Fix bugs")), PYTHON_STOPS, P.first_block_col, _pass([1, 10])),
    ("repair-edit", lambda r: bug_prompt(F.col("prompt"), F.lit("Fix bugs"), "edit"), ["<commit_before>"], None, _pass([1, 10])),
    ("repair-parity", lambda r: bug_prompt(F.col("prompt"), F.lit("Fix parity"), "comment"), PYTHON_STOPS, None, _pass([1, 20, 40])),
    ("perturbed-completion", lambda r: F.trim(F.col("prompt")), PYTHON_STOPS, None, lambda r: M.robust_pass(r, "transformation", "task_id", "seed", F.col("passed"))),
    ("explain", lambda r: F.concat(F.col("prompt"), F.lit("\nDescribe what the code does in one sentence.\n")), ["\n\n"], None, None),
    ("synthesize-from-explanation", lambda r: F.concat(F.col("description"), F.lit("\n"), F.col("prompt")), PYTHON_STOPS, P.first_block_col, _pass([1])),
    ("repository-completion", lambda r: F.col("prompt"), PYTHON_STOPS, P.first_block_col, _pass([1, 3, 5])),
]:
    register(Task(_name, _prompt, _stops, _clean, _metric))
