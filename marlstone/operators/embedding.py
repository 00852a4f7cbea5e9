"""The embedder contract, and embedders."""

from __future__ import annotations

import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import EmbeddingError, InvalidInput


@dataclass(frozen=True)
class EmbeddingSpace:
    fingerprint: str
    dimension: int


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def dimension(self) -> int: ...

    def fingerprint(self) -> str: ...


def space_of(embedder: Embedder) -> EmbeddingSpace:
    return EmbeddingSpace(embedder.fingerprint(), embedder.dimension())


def check_batch(vectors: list[list[float]], expected: int, dimension: int) -> None:
    """EmbeddingError unless there are as many vectors as texts, each of the dimension and finite."""
    if len(vectors) != expected:
        raise EmbeddingError(f"embedder returned {len(vectors)} vectors for {expected} texts")
    for i, v in enumerate(vectors):
        if len(v) != dimension:
            raise EmbeddingError(f"embedding {i} has dimension {len(v)}, expected {dimension}")
        if not all(math.isfinite(x) for x in v):
            raise EmbeddingError(f"embedding {i} contains a non-finite value")


_blank = re.compile(r"[ \t\n\x0b\f\r]+")


class HashEmbedder:
    """Counts of hashed lower-case words, of length 1; a text without words is the first axis."""

    def __init__(self, dimension: int = 256):
        self._dimension = dimension
        self._places: dict[str, int] = {}

    def dimension(self) -> int:
        return self._dimension

    def fingerprint(self) -> str:
        return f"hash-space-v1|dimension={self._dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, places = [], self._places
        if len(places) > 500_000:
            places.clear()
        for t in texts:
            v = [0.0] * self._dimension
            for w in _blank.split(t.lower().replace("ς", "σ")):
                if not w:
                    continue
                if w not in places:
                    places[w] = int(md5(w.encode()).hexdigest()[:15], 16) % self._dimension
                v[places[w]] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            if norm:
                v = [x / norm for x in v]
            else:
                v[0] = 1.0
            out.append(v)
        return out


class NoopEmbedder:
    def dimension(self) -> int:
        return 8

    def fingerprint(self) -> str:
        return "noop-space-v1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * 8 for _ in texts]


@dataclass
class ApiEmbedder:
    """An OpenAI-compatible provider. The key is never shown; requests are cut into batches."""

    endpoint: str
    model: str
    size: int
    api_key: str | None = field(default=None, repr=False)
    timeout: float = 30.0
    batch: int = 256

    def dimension(self) -> int:
        return self.size

    def fingerprint(self) -> str:
        return f"api-space-v1|endpoint={self.endpoint.rstrip('/')}|model={self.model}|dimension={self.size}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            out += self._request(texts[i : i + self.batch])
        return out

    def _request(self, texts: list[str]) -> list[list[float]]:
        if not self.endpoint.startswith(("http://", "https://")):
            raise InvalidInput(f"embedding endpoint is not a URL: {self.endpoint}")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.endpoint.rstrip('/')}/embeddings", body, headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                data = json.load(response)["data"]
        except urllib.error.HTTPError as e:
            said = e.read(4096).decode("utf-8", "replace")
            raise EmbeddingError(f"provider returned {e.code}: {said[:512] + '… (truncated)' if len(said) > 512 else said}") from None
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(f"request failed: {e}") from None
        return in_order(data, len(texts), self.size)


def in_order(data: list[dict], expected: int, dimension: int) -> list[list[float]]:
    """A provider's answers put in the order of the texts; every index must come exactly once."""
    if len(data) != expected:
        raise EmbeddingError(f"provider returned {len(data)} embeddings for {expected} inputs")
    out: list[list[float] | None] = [None] * expected
    for item in data:
        i = item.get("index")
        if not isinstance(i, int) or not 0 <= i < expected:
            raise EmbeddingError(f"provider returned index {i} out of range")
        if out[i] is not None:
            raise EmbeddingError(f"provider returned index {i} twice")
        out[i] = item["embedding"]
    check_batch(out, expected, dimension)
    return out


def embed_table(frame: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """Adds vector ARRAY<FLOAT>; a request is an Arrow batch, an empty batch none. Null texts have null vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t for t in texts if t is not None]
            made = embedder.embed(known) if known else []
            check_batch(made, len(known), embedder.dimension())
            it = iter(made)
            yield pd.Series([None if t is None else next(it) for t in texts], dtype=object)

    return frame.withColumn("vector", run(F.col(text)))
