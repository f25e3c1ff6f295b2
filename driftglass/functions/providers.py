"""Remote embedding services: prices, request batches, requests over HTTP and the distributed call."""

from __future__ import annotations

import functools
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMEOUT_SECONDS, ATTEMPTS = 60.0, 3


@dataclass(frozen=True)
class Service:
    """Limits of one request and the public price in USD per 1,000 tokens, by model."""

    name: str
    max_texts: int
    max_tokens: int | None
    models: dict[str, tuple[float, int]]  # price, dimensions
    url: str = ""
    key_variable: str = ""

    def model(self, name: str) -> tuple[float, int]:
        if name not in self.models:
            raise ValueError(f"{self.name} has no known price for {name!r}")
        return self.models[name]


SERVICES = {
    s.name: s
    for s in (
        Service("openai", 256, None, {"text-embedding-3-small": (0.00002, 1536), "text-embedding-3-large": (0.00013, 3072)}, "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY"),
        Service("cohere", 96, None, {"embed-english-v3.0": (0.0001, 1024), "embed-multilingual-v3.0": (0.0001, 1024), "embed-v4.0": (0.00012, 1536)}, "https://api.cohere.com/v2/embed", "CO_API_KEY"),
        Service("voyage", 1000, 100_000, {"voyage-3.5": (0.00006, 1024), "voyage-3.5-lite": (0.00002, 1024), "voyage-3-large": (0.00018, 1024)}, "https://api.voyageai.com/v1/embeddings", "VOYAGE_API_KEY"),
    )
}


def request_batches(texts: list[str], max_texts: int, max_tokens: int | None = None) -> Iterator[list[str]]:
    """Runs of texts within both limits; a text over the token limit goes alone. A token is four characters."""
    batch: list[str] = []
    tokens = 0
    for t in texts:
        n = len(t) // 4
        if batch and (len(batch) == max_texts or (max_tokens is not None and tokens + n > max_tokens)):
            yield batch
            batch, tokens = [], 0
        batch.append(t)
        tokens += n
    if batch:
        yield batch


def embed_remote(texts: DataFrame, service: Service, model: str, request: Callable[[str, list[str]], list[list[float]]], key: str = "key") -> DataFrame:
    """(key, vector) of texts (key, text): each partition sends its own batches through request(model, texts)."""
    dims = service.model(model)[1]
    kind = texts.schema[key].dataType.simpleString()

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = []
            for batch in request_batches(f["text"].tolist(), service.max_texts, service.max_tokens):
                got = np.asarray(request(model, batch), np.float32)
                if got.shape != (len(batch), dims):
                    raise ValueError(f"{service.name} returned vectors of shape {got.shape}")
                vectors.extend(got)
            yield pd.DataFrame({key: f[key], "vector": vectors})

    return texts.select(key, "text").mapInPandas(call, f"`{key}` {kind}, vector array<float>")


class RequestFailed(RuntimeError):
    """A service refused a request, or could not be reached."""


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float | None = None, method: str = "POST") -> dict | list:
    """The JSON answer to body; busy and failing servers are asked up to ATTEMPTS times."""
    timeout = timeout or float(os.environ.get("DRIFTGLASS_HTTP_TIMEOUT", TIMEOUT_SECONDS))
    data = None if method == "GET" else json.dumps(body).encode()
    for attempt in range(ATTEMPTS):
        try:
            asked = urllib.request.Request(url, data, {"Content-Type": "application/json"} | (headers or {}), method=method)
            with urllib.request.urlopen(asked, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as refused:
            if refused.code not in (429, 500, 502, 503, 504) or attempt == ATTEMPTS - 1:
                raise RequestFailed(f"{url} answered {refused.code}: {refused.read()[:200].decode(errors='replace')}") from refused
        except (urllib.error.URLError, TimeoutError) as lost:
            if attempt == ATTEMPTS - 1:
                raise RequestFailed(f"{url} cannot be reached: {lost}") from lost
        time.sleep(0.5 * 2**attempt)
    raise AssertionError


def request_vectors(service: Service, model: str, texts: list[str], url: str | None = None) -> list[list[float]]:
    """One request; vectors in the order of texts."""
    secret = os.environ.get(service.key_variable)
    if not secret:
        raise RequestFailed(f"{service.name} needs {service.key_variable}")
    headers = {"Authorization": f"Bearer {secret}"}
    if service.name == "cohere":
        got = post_json(url or service.url, {"model": model, "texts": texts, "input_type": "search_document", "embedding_types": ["float"]}, headers)
        return got["embeddings"]["float"]
    got = post_json(url or service.url, {"model": model, "input": texts}, headers)
    return [d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])]


class RemoteEmbedder:
    """A service's model with the interface of the local embedder."""

    def __init__(self, service: str, model: str, dims: int | None = None, url: str | None = None):
        if service not in SERVICES:
            raise ValueError(f"the provider {service!r} is unknown; known are local, {', '.join(SERVICES)}")
        self.service, self.provider, self.model, self.url = SERVICES[service], service, model, url
        self.usd_per_1k, known = self.service.model(model)
        if dims is not None and int(dims) != known:
            raise ValueError(f"{model} gives {known} dimensions, not {dims}")
        self.dims = known

    @property
    def params(self) -> dict:
        return {"dims": self.dims}

    def embed(self, texts: list[str]) -> np.ndarray:
        ask = functools.partial(request_vectors, self.service, self.model, url=self.url)
        out = [np.asarray(ask(b), np.float32) for b in request_batches(texts, self.service.max_texts, self.service.max_tokens)]
        got = np.concatenate(out) if out else np.empty((0, self.dims), np.float32)
        if got.shape != (len(texts), self.dims):
            raise RequestFailed(f"{self.provider} returned vectors of shape {got.shape}")
        size = np.linalg.norm(got, axis=1, keepdims=True)
        return got / np.where(size == 0, 1, size)

    def column(self, text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(self.embed(texts.fillna("").tolist())), dtype=object)

        return embed(text)


def parse_spec(spec: str) -> dict:
    """provider:model or provider:model:dims as the embedding section of a configuration."""
    parts = spec.split(":")
    if len(parts) not in (2, 3) or not all(parts):
        raise ValueError(f"{spec!r} is not provider:model or provider:model:dims")
    provider, model = parts[:2]
    if provider == "local":
        return {"provider": provider, "model": model, "dims": int(parts[2]) if len(parts) == 3 else 256}
    e = RemoteEmbedder(provider, model, int(parts[2]) if len(parts) == 3 else None)
    return {"provider": provider, "model": model, "dims": e.dims, "params": {}}
