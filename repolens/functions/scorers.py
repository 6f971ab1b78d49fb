"""Pluggable scorers where the reference calls a model: embeddings, pair scores, text generation. The defaults are deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches

# Fixed value: what is set before a query, never before a document, when it is embedded.
QUERY_PREFIX = "Represent this code snippet for searching relevant passages: "
_TOKEN = re.compile(r"[a-z0-9_]+")


def hashed_vector(text: str | None, size: int = 64) -> np.ndarray:
    """Signed feature hashing of words and their character triples, of unit length (zero for texts without words)."""
    v = np.zeros(size, np.float32)
    for w in _TOKEN.findall((text or "").lower()):
        for g in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
            h = zlib.crc32(g.encode())
            v[h % size] += 1 if h >> 31 else -1
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(texts: DataFrame, cache: DataFrame | None = None, size: int = 64) -> DataFrame:
    """texts(content_hash, content) -> (content_hash, embedding) for distinct hashes: from the cache where it has them, else made."""
    missing = texts.dropDuplicates(["content_hash"])
    if cache is not None:
        missing = missing.join(cache.select("content_hash"), "content_hash", "left_anti")
    made = map_batches(missing.select("content_hash", "content"), lambda h, c: (h, [hashed_vector(x, size).tolist() for x in c]), "content_hash string, embedding array<float>")
    if cache is None:
        return made
    return cache.join(texts.select("content_hash").distinct(), "content_hash", "left_semi").select("content_hash", "embedding").unionByName(made)


def embed_query(query: str, size: int = 64) -> list[float]:
    return hashed_vector(QUERY_PREFIX + query, size).tolist()


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Masked mean of an array of vectors, then unit length; the count is at least 1e-9."""
    zipped = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    size = F.size(vectors[0])
    total = F.aggregate(zipped, F.array_repeat(F.lit(0.0), size), lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q * x["m"]))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    mean = F.transform(total, lambda t: t / count)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, t: a + t * t))
    return F.transform(mean, lambda t: t / F.greatest(norm, F.lit(1e-12)))


def pair_scorer(score: Callable[[str, str], float]):
    """A pair score as an Arrow-batched column function (query, content) -> double; null for all rows of a batch in which it raises."""

    @F.pandas_udf("double")
    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        try:
            return pd.Series([float(score(q, c)) for q, c in zip(query, content, strict=True)], dtype="float64")
        except Exception:  # noqa: BLE001 - whatever a model raises
            return pd.Series([None] * len(query), dtype="float64")

    return run


@dataclass
class Answer:
    content: str
    provider: str
    tokens: int = 0


#: A failed call answers with this at the start of its text.
FAILED = "[error]"


def first_success(prompt: str, providers: Iterable[tuple[str, Callable[[str], str]]]) -> Answer:
    """Answer of the first provider that neither raises nor answers with the failure mark; an error text if all fail."""
    why = "no provider"
    for name, call in providers:
        try:
            text = call(prompt)
        except Exception as e:  # noqa: BLE001 - any failure passes to the next provider
            why = str(e)
            continue
        if not text.startswith(FAILED):
            return Answer(text, name, len(text) // 4)
        why = text
    return Answer(f"{FAILED} all providers failed: {why}", "none")


def first_attempt(attempts: DataFrame, by: str) -> DataFrame:
    """The same over rows (by, attempt, provider, content): the first attempt that didn't fail, null content where all did."""
    ok = F.when(F.col("content").isNotNull() & ~F.startswith("content", F.lit(FAILED)), F.struct("attempt", "provider", "content"))
    return attempts.groupBy(by).agg(F.min(ok).alias("b")).select(by, "b.provider", "b.content")


class Providers:
    """Text generators by name: complete(prompt), chat(messages) and stream(prompt). Answers come from the first provider that succeeds; streams
    from the first alone. A provider is a function of a prompt."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[str], str]] = {"extract": extract}

    def register(self, name: str, call: Callable[[str], str]) -> None:
        self.known[name] = call

    def chain(self, *names: str) -> list[tuple[str, Callable[[str], str]]]:
        missing = [n for n in names if n not in self.known]
        if missing:
            raise KeyError(f"no provider named {missing[0]}; known: {', '.join(sorted(self.known))}")
        return [(n, self.known[n]) for n in names or ("extract",)]

    def complete(self, prompt: str, *names: str) -> Answer:
        return first_success(prompt, self.chain(*names))

    def chat(self, messages: list[tuple[str, str]], *names: str) -> Answer:
        """messages: (role, text), put together as one prompt."""
        return self.complete("\n".join(f"{role}: {text}" for role, text in messages), *names)

    def stream(self, prompt: str, *names: str, words: int = 5) -> Iterable[str]:
        """Pieces of the first provider's answer; a failure is a piece of its own."""
        (name, call), *_ = self.chain(*names)
        text = first_success(prompt, [(name, call)]).content
        parts = text.split(" ")
        for i in range(0, len(parts), words):
            yield " ".join(parts[i : i + words]) + (" " if i + words < len(parts) else "")


def extract(prompt: str, most: int = 3) -> str:
    """The default generator: the prompt's first sentences."""
    return " ".join(re.split(r"(?<=[.!?])\s+", prompt.strip())[:most])


def completed(prompts: DataFrame, key: str, chain: list[tuple[str, Callable[[str], str]]]) -> DataFrame:
    """prompts(key, prompt) -> (key, content, provider, tokens), in Arrow batches on the executors."""
    def batch(keys, texts):
        out = [first_success(t or "", chain) for t in texts]
        return keys, [a.content for a in out], [a.provider for a in out], [a.tokens for a in out]

    return map_batches(prompts.select(key, "prompt"), batch, f"{key} {dict(prompts.dtypes)[key]}, content string, provider string, tokens int")
