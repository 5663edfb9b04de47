"""Model surfaces: encoders, pair scorers and generators are injected; each worker loads its model once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, MAX_TOKENS = 64, 512


class HashEncoder:
    """A deterministic stand-in for a neural encoder: signed hashed token counts, unit length. It claims no quality."""

    def __init__(self, width: int = WIDTH, max_tokens: int = MAX_TOKENS):
        self.width, self.max_tokens = width, max_tokens

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in (t or "").split()[: self.max_tokens]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.width] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = HashEncoder) -> Column:
    """Embeddings by an encoder that `load` builds once in each worker."""
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(list(model([x or "" for x in b])))

    return run(text)


class LexicalPairScorer:
    """A stand-in for a trained pair classifier: two logits from the share of common words. It claims no quality."""

    def __call__(self, targets: list[str], contexts: list[str]) -> np.ndarray:
        out = np.zeros((len(targets), 2))
        for i, (a, b) in enumerate(zip(targets, contexts)):
            x, y = set((a or "").lower().split()), set((b or "").lower().split())
            share = len(x & y) / max(1, min(len(x), len(y)))
            out[i] = (0.5 - share, share - 0.5)
        return out


def score_pairs(df: DataFrame, target: str, context: str, load: Callable = LexicalPairScorer, least: float = 0.25) -> DataFrame:
    """`df` with probability of class 1 and whether it reaches `least`."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            z = model(list(a), list(b))
            yield pd.Series(1 / (1 + np.exp(z[:, 0] - z[:, 1])))

    out = df.withColumn("probability", run(F.col(target), F.col(context)))
    return out.withColumn("predicted", F.col("probability") >= least)


def generate(prompts: DataFrame, key: str, prompt: str, load: Callable[[], Callable[[str], list[str]]], retries: int = 3) -> DataFrame:
    """(key, prompt, response): answers of an injected generator; after `retries` errors the answer is one empty text."""
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt]):
                answer = [""]
                for _ in range(retries):
                    try:
                        answer = list(model(p or ""))
                        break
                    except Exception:  # noqa: BLE001 - any error of a foreign model means another try
                        continue
                rows.append((k, p, answer))
            yield pd.DataFrame(rows, columns=[key, prompt, "response"])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, {prompt} string, response array<string>")
