"""Places where outside models are plugged in (UD1-UD8, VE19-VE21, SC10-SC32 over the network).

The engine calls a provider from a vectorized pass with a batch of texts; tests use deterministic ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.structure import token_chunks

Embedder = Callable[[list[str]], list[list[float]]]
Answerer = Callable[[list[str]], list[str]]
LONGEST = 1_000_000


def hash_embedder(dim: int = 16) -> Embedder:
    """A deterministic stand-in: numbers from the text's hash."""
    return lambda texts: [[b / 255 - 0.5 for b in hashlib.shake_128(t.encode()).digest(dim)] for t in texts]


def embed(texts: DataFrame, provider: Embedder, key: str, text: str = "text", dim: int = 16, how: str = "mean") -> DataFrame:
    """VE19-VE21, UD3: (key, vec, skipped): each text's chunks embedded and joined by mean, max or sum.

    Null and blank texts give no row; texts over a million characters get a zero vector and ``skipped``."""
    kind = dict(texts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, t in zip(part["k"], part["t"], strict=True):
                if len(t) > LONGEST:
                    out.append((k, [0.0] * dim, True))
                    continue
                try:
                    vectors = provider([t[a:b] for a, b in token_chunks(t)])
                    cols = list(zip(*vectors, strict=True))
                    out.append((k, [sum(c) / len(c) if how == "mean" else max(c) if how == "max" else sum(c) for c in cols], False))
                except Exception:  # noqa: BLE001 a failing model gives a zero vector, as a failed row
                    out.append((k, [0.0] * dim, False))
            yield pd.DataFrame(out, columns=[key, "vec", "skipped"])

    return texts.filter(F.trim(text) != "").select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, vec array<double>, skipped boolean")


def answer(prompts: DataFrame, provider: Answerer, key: str, prompt: str = "prompt") -> DataFrame:
    """UD4, UD6: (key, answer) of a text-to-text model."""
    kind = dict(prompts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part["k"], "answer": provider(list(part["p"]))})

    return prompts.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"`{key}` {kind}, answer string")


def refined(prompts: DataFrame, provider: Answerer, accept: Callable[[str, str], tuple[bool, list[str]]], key: str, prompt: str = "prompt", source: str = "source", rounds: int = 3) -> DataFrame:
    """UD7: (key, answer, attempts, accepted): asked again with what was wrong until accepted or out of rounds."""
    kind = dict(prompts.dtypes)[key]

    def one(p: str, s: str) -> tuple[str, int, bool]:
        text, errors = "", []
        for attempt in range(1, rounds + 1):
            text = provider([p if not errors else p + "\n\nMend: " + "; ".join(errors)])[0]
            ok, errors = accept(text, s)
            if ok:
                return text, attempt, True
        return text, rounds, False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(p, s) for p, s in zip(part["p"], part["s"], strict=True)]
            yield pd.DataFrame({key: part["k"], "answer": [g[0] for g in got], "attempts": [g[1] for g in got], "accepted": [g[2] for g in got]})

    return prompts.select(F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(source).alias("s")).mapInPandas(run, f"`{key}` {kind}, answer string, attempts int, accepted boolean")


def gathered_prompt(papers: DataFrame, instruction: str, most: int = 20) -> DataFrame:
    """UD5, UD8, SR8: one prompt over the first papers of a selection, a fixed number by key."""
    few = papers.orderBy("citation_key").limit(most)
    part = F.concat(F.col("title"), F.lit("\n"), F.coalesce("abstract", F.lit("")))
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_key", part.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("body")).select(F.concat(F.lit(instruction + "\n\n"), F.col("body")).alias("prompt"))


def retrying(provider: Callable[[list[str]], list], attempts: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] | None = None) -> Callable[[list[str]], list]:
    """UD11, SC33: a provider that is called again after a failure, waiting twice as long each time; the last failure is raised."""

    def call(texts: list[str]) -> list:
        import time

        wait = first_wait
        for attempt in range(1, attempts + 1):
            try:
                return provider(texts)
            except Exception:  # noqa: BLE001 whatever an outside service raises
                if attempt == attempts:
                    raise
                (sleep or time.sleep)(wait)
                wait *= 2
        return []

    return call


def model_options(name: str) -> dict:
    """UD10: size in billions of parameters by a model's name, its class, and how much context it is given."""
    import re

    m = re.search(r"(\d+(?:\.\d+)?)\s*b\b", name.lower())
    size = float(m[1]) if m else None
    kind = "unknown" if size is None else "small" if size < 7 else "medium" if size < 20 else "large"
    return {"billions": size, "class": kind, "context_tokens": {"small": 4096, "medium": 8192, "large": 16384}.get(kind, 4096)}
