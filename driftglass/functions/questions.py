"""Golden questions by a language model: one request per chunk, by the caller's function or an OpenAI-compatible service."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.functions.providers import RequestFailed, post_json

#: USD per 1,000 tokens read and written, by model.
PRICES = {"gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01)}
QUESTION_TOKENS, PROMPT_TOKENS = 40, 60
_PROMPT = "Write one question that the following passage answers. Use your own words, name what it is about, and give the question alone.\n\n"


def ask_service(model: str, text: str, url: str = "https://api.openai.com/v1/chat/completions") -> str:
    secret = os.environ.get("OPENAI_API_KEY")
    if not secret:
        raise RequestFailed("the service needs OPENAI_API_KEY")
    got = post_json(url, {"model": model, "messages": [{"role": "user", "content": _PROMPT + text}]}, {"Authorization": f"Bearer {secret}"})
    return got["choices"][0]["message"]["content"]


def question_cost(chunks: DataFrame, model: str) -> DataFrame:
    """One row (requests, tokens, usd), at four characters a token; ValueError where no price is known."""
    if model not in PRICES:
        raise ValueError(f"no price is known for {model!r}")
    read, written = PRICES[model]
    tokens = F.coalesce(F.sum(F.expr("length(text) div 4") + PROMPT_TOKENS), F.lit(0))
    return chunks.agg(F.count("*").alias("requests"), (tokens + F.count("*") * QUESTION_TOKENS).alias("tokens"), (tokens / 1000 * read + F.count("*") * QUESTION_TOKENS / 1000 * written).alias("usd"))


def ask_questions(chunks: DataFrame, model: str, ask: Callable[[str, str], str] = ask_service) -> DataFrame:
    """chunks (…, text) with question: the model's first line, NULL where it gives none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = [ask(model, t).strip().split("\n")[0].strip() for t in f["text"]]
            yield f.assign(question=[x or None for x in lines])

    return chunks.mapInPandas(call, f"{fields}, question string")
