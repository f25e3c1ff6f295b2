"""Vector expressions, half-precision rounding and the hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.functions.text import ascii_words, packed_words, words_of

#: Texts that are hashed at once, and words whose places a task remembers.
SLICE_ROWS, KNOWN_WORDS = 512, 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def to_half(v: Column) -> Column:
    """Values rounded to half precision, kept as floats (Parquet's FLOAT16 cannot be read by Spark)."""

    @F.pandas_udf("array<float>")
    def halve(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.float32).astype(np.float16).astype(np.float32), na_action="ignore")

    return halve(v)


_WORD = re.compile("[0-9a-z]+")


class HashEmbedder:
    """Signed feature hashing of word n-grams into a unit vector."""

    provider, usd_per_1k = "local", 0.0

    def __init__(self, dims: int = 256, seed: int = 0, ngram=(1, 2), model: str = "hash-v1"):
        self.model, self.dims, self.seed = model, int(dims), int(seed)
        self.ngram = tuple(map(int, ngram))

    @property
    def params(self) -> dict:
        return {"ngram": list(self.ngram), "seed": self.seed, "dims": self.dims}

    def features(self, text: str) -> Counter:
        words = _WORD.findall(text.lower())
        return Counter(" ".join(words[i : i + n]) for n in range(self.ngram[0], self.ngram[1] + 1) for i in range(len(words) - n + 1))

    def embed(self, texts: list[str]) -> np.ndarray:
        salt, dims = "\x1f".join((self.model, str(self.seed), "")).encode(), self.dims

        @lru_cache(maxsize=200_000)
        def place(feature: str) -> tuple[int, int]:
            value = int.from_bytes(hashlib.blake2b(salt + feature.encode(), digest_size=8).digest(), "big")
            return (value >> 1) % dims, 1 if value & 1 else -1

        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for feature, n in self.features(text).items():
                at, sign = place(feature)
                row[at] += sign * n
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    def column(self, text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(self.embed(texts.fillna("").tolist())), dtype=object)

        return embed(text)


def sha_embedding(texts: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, vector): the same hashing with SHA-256 places; single words. Rows with the same key are one text; one without words has no row."""
    kind = texts.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(s, SLICE_ROWS)
                size, words, row = words_of(b.column(1), b.column(2), ascii_only=True)
                words = words.dictionary_encode()
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in words.dictionary.to_pylist():
                    if w not in known:  # an empty string is no word
                        known[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") if w else -1
                value = np.array([known[w] for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
                cell, sign = row * dims + (value >> 1) % dims, np.where(value & 1, 1.0, -1.0)
                m = np.bincount(cell[value >= 0], sign[value >= 0], b.num_rows * dims).reshape(-1, dims)[size > 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dims, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(size > 0)), lists], [key, "m"])

    placed = lambda df: df.select(key, *packed_words(F.col("text"), ascii_words)).mapInArrow(place, f"`{key}` {kind}, m array<double>")
    single, again = ids.apart(texts.select(key, "text"), key)
    rows = placed(single)
    if again is not None:
        cells = placed(again).select(key, F.posexplode("m").alias("at", "v")).groupBy(key, "at").agg(F.sum("v").alias("v"))
        lists = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m"))
        rows = rows.unionByName(lists.select(key, F.transform("m", lambda x: x["v"]).alias("m")))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", F.when(size == 0, F.lit(1.0)).otherwise(size)).select(key, F.transform("m", lambda x: x / F.col("n")).alias("vector"))
