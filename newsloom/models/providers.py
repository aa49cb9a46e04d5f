"""Providers behind the model operators, and the one way rows are sent to them.

A provider is any object with the protocol's method; it is pickled to the workers, so it opens connections lazily.
Stubs are deterministic and need no network. ``HttpChatModel`` takes its key from the environment.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.session import cut


class TextModel(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class EntityExtractor(Protocol):
    def entities(self, text: str) -> list[tuple[str, str, int, int]]: ...


class Tokenizer(Protocol):
    def tokens(self, text: str) -> list[str]: ...


@dataclass(frozen=True)
class RetryPolicy:
    """``tries`` attempts; the pause after attempt n is ``first * factor ** n`` seconds, or ``first * (n + 1)`` if ``linear``."""

    tries: int = 3
    first: float = 0.0
    factor: float = 2.0
    linear: bool = False

    def run(self, call):
        for n in range(self.tries):
            try:
                return call(), None
            except Exception as e:  # a provider may raise anything; the row keeps the message
                error = f"{type(e).__name__}: {e}"
                if n + 1 < self.tries and self.first:
                    time.sleep(self.first * ((n + 1) if self.linear else self.factor**n))
        return None, error


#: How often and how patiently each stage asks again, and the temperature it asks with.
RETRIES = {
    "align": RetryPolicy(tries=4, first=1.0), "inject": RetryPolicy(tries=3, first=1.0), "evaluate": RetryPolicy(tries=4, first=1.0),
    "rewrite": RetryPolicy(tries=2, first=0.2, linear=True), "analyze": RetryPolicy(tries=2, first=0.3, linear=True), "fuse": RetryPolicy(tries=1),
}
TEMPERATURES = {"align": 0.0, "inject": 0.0, "evaluate": 0.7, "rewrite": 0.7, "analyze": 0.7, "fuse": 0.7}


def complete(self, system: str, user: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class EntityExtractor(Protocol):
    def entities(self, text: str) -> list[tuple[str, str, int, int]]: ...


class Tokenizer(Protocol):
    def tokens(self, text: str) -> list[str]: ...


@dataclass(frozen=True)
class RetryPolicy:
    """``tries`` attempts with a pause of ``first * factor ** n`` seconds between them."""

    tries: int = 3
    first: float = 0.0
    factor: float = 2.0

    def run(self, call):
        for n in range(self.tries):
            try:
                return call(), None
            except Exception as e:  # a provider may raise anything; the row keeps the message
                error = f"{type(e).__name__}: {e}"
                if n + 1 < self.tries and self.first:
                    time.sleep(self.first * self.factor**n)
        return None, error


def complete(model: TextModel, system: str, user: str, retry: RetryPolicy = RetryPolicy()) -> tuple[str | None, str | None]:
    """(text, error) of one call."""
    return retry.run(lambda: model.complete(system, user))


@dataclass
class StubModel:
    """Offline stand-in: returns the user's text with its white space squeezed, shortened to ``most`` characters if given."""

    most: int | None = None

    def complete(self, system: str, user: str) -> str:
        return re.sub(r"\s+", " ", user).strip()[: self.most]


@dataclass
class HttpChatModel:
    """Chat completion over HTTP. The key comes from the environment variable named in ``key_variable``."""

    base_urls: list[str]
    model: str
    key_variable: str = "CHAT_API_KEY"
    temperature: float = 0.7
    timeout: float = 120.0
    _turn: int = field(default=0, repr=False)

    def complete(self, system: str, user: str) -> str:
        url = self.base_urls[self._turn % len(self.base_urls)]  # round robin over equal servers
        self._turn += 1
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, 'none')}"}
        with urllib.request.urlopen(urllib.request.Request(f"{url}/chat/completions", json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            return response_text(json.loads(r.read()))


def response_text(answer) -> str:
    """The text of a model's answer in any of the usual shapes: text, a content field, choices, generations, or a list of parts."""
    if answer is None:
        return ""
    if isinstance(answer, str):
        return answer
    if isinstance(answer, list):
        return "".join(map(response_text, answer[:1] if answer and isinstance(answer[0], list) else answer))
    get = answer.get if isinstance(answer, dict) else lambda k: getattr(answer, k, None)
    for name in ("content", "text", "message", "output_text"):
        if get(name) is not None:
            return response_text(get(name))
    for name in ("choices", "generations"):
        if get(name):
            return response_text(get(name)[0])
    return str(answer)


@dataclass
class HashEmbedder:
    """Offline stand-in: hashed character trigrams, normalised."""

    size: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for row, t in zip(out, texts):
            for i in range(len(t) - 2):
                h = zlib.crc32(t[i : i + 3].encode())
                row[h % self.size] += 1 if h & 0x80000000 else -1
            n = float(np.sqrt((row * row).sum()))
            if n:
                row /= n
        return out


@dataclass
class PatternEntities:
    """Offline stand-in: numbers, percentages, years and capitalised names by pattern."""

    patterns: tuple[tuple[str, str], ...] = (("PERCENT", r"\d[\d.,]*\s?%"), ("DATE", r"\b(?:19|20)\d\d\b"), ("CARDINAL", r"\d[\d.,]*\d|\d"), ("GPE", r"(?<=\b(?:in|at|of|to) )[A-Z][\w-]+"))

    def entities(self, text: str) -> list[tuple[str, str, int, int]]:
        found, taken = [], set()
        for label, p in self.patterns:
            for m in re.finditer(p, text):
                if not taken & set(range(m.start(), m.end())):
                    taken |= set(range(m.start(), m.end()))
                    found.append((m.group(), label, m.start(), m.end()))
        return sorted(found, key=lambda e: e[2])


@dataclass
class WordTokenizer:
    """Words of any script, Han characters one by one; lower case or exact with punctuation and spaces."""

    exact: bool = False

    def tokens(self, text: str) -> list[str]:
        if self.exact:
            return re.findall(r"[一-鿿]|[^\W一-鿿]+|[^\w]", text)
        return re.findall(r"[一-鿿]|[^\W一-鿿]+", text.lower())


@dataclass
class KeywordTokenizer:
    """Words of any script in lower case; of runs of Han characters every two neighbours, as most words have two."""

    def tokens(self, text: str) -> list[str]:
        out = []
        for run in re.findall(r"[一-鿿]+|[^\W一-鿿]+", text.lower()):
            out += [run[i : i + 2] for i in range(len(run) - 1)] if "一" <= run[0] <= "鿿" and len(run) > 1 else [run]
        return out


def stage_model(kind: str, stage: str, **options) -> TextModel:
    """A provider with the temperature of a stage, where it takes one."""
    made = make_model(kind, **options)
    if hasattr(made, "temperature") and "temperature" not in options:
        made.temperature = TEMPERATURES.get(stage, made.temperature)
    return made


REGISTRY: dict[str, type] = {"stub": StubModel, "http": HttpChatModel}


def make_model(kind: str, **options) -> TextModel:
    """A provider by registry name; an unknown one raises ``ValueError``."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](**options)


def apply_model(df: DataFrame, prompt: str, model: TextModel, system: str = "", out: str = "response", threads: int = 4, retry: RetryPolicy = RetryPolicy()) -> DataFrame:
    """``df`` with ``out`` and ``<out>_error``: each distinct prompt is sent once, and answers are joined back by hash.

    The answers are written to the shared folder, so neither a second use nor a lost executor calls the model again.
    Null prompts aren't sent and aren't joined. A failed call leaves null and the message; other rows go on.
    """
    key = F.sha2(F.col(prompt), 256)
    asked = df.filter(F.col(prompt).isNotNull()).select(key.alias("_key"), F.col(prompt).alias("_prompt")).dropDuplicates(["_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(lambda p: complete(model, system, p, retry), pdf["_prompt"]))
                yield pd.DataFrame({"_key": pdf["_key"], out: [g[0] for g in got], f"{out}_error": [g[1] for g in got]})

    answers = cut(asked.mapInPandas(run, f"_key string, {out} string, {out}_error string"), "answers")
    plain = [f.name for f in df.schema.fields if not hasattr(f.dataType, "fields") and f.dataType.typeName() not in ("map", "array", "variant")]
    keyed = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("none-"), F.xxhash64(*plain).cast("string"))))  # rows without a prompt spread over all tasks
    return keyed.join(answers, "_key", "left").drop("_key")


def embed_column(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``df`` with the embedding of a text column; null for null, and for all rows of a batch that the embedder fails on."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        try:
            vectors = embedder.embed([t if isinstance(t, str) else "" for t in texts])
        except Exception:  # an embedder may raise anything; what needs the vectors has its own fallback
            return pd.Series([None] * len(texts), dtype=object)
        return pd.Series([list(map(float, v)) if isinstance(t, str) else None for t, v in zip(texts, vectors)])

    return df.withColumn(out, run(text))


def entity_rows(df: DataFrame, text: str, extractor: EntityExtractor) -> DataFrame:
    """``df`` exploded to one row for each entity: ``entity struct<text, label, start_char, end_char>``; texts without any give no row."""

    @F.pandas_udf("array<struct<text: string, label: string, start_char: int, end_char: int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("text", "label", "start_char", "end_char"), e)) for e in extractor.entities(t)] if isinstance(t, str) else [] for t in texts])

    return df.withColumn("entity", F.explode(run(text)))
