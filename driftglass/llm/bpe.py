"""BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged across, so every such
pair marks a certain cut. Texts are split by the tokenizer's own pattern, pieces are cut at forced
boundaries, the fragments, short and often repeated, are encoded independently of each other and
remembered, and their ids are concatenated. The result equals encoding each piece as a whole.
Decoding concatenates the tokens' bytes; every row is decoded again and compared with its text.

Strings of special tokens are ordinary text. Defined results: a NULL text has NULL ids, count and
check; an empty text has no ids; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 150_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def joinable_pairs(ranks: dict[bytes, int]) -> frozenset[int]:
    """Pairs of neighbouring bytes, first * 256 + second, that some token contains."""
    return frozenset(a << 8 | b for t in ranks for a, b in zip(t, t[1:]))


def merge(fragment: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte-pair merging: the lowest-ranked neighbours first, leftmost among equals."""
    parts = [fragment[i : i + 1] for i in range(len(fragment))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """Encodes and decodes with memos of pieces and fragments."""

    class _Pieces(dict):
        def __init__(self, codec: Codec):
            super().__init__()
            self.codec = codec

        def __missing__(self, piece: str) -> list[int]:
            if len(self) >= MEMO:
                self.clear()
            ids = self[piece] = self.codec.piece(piece.encode("utf-8", "surrogatepass"))
            return ids

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.ranks, self.joinable = ranks, joinable_pairs(ranks)
        self.split = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tokens = {r: t for t, r in ranks.items()}
        self.pieces = Codec._Pieces(self)
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[bytes]:
        """piece cut at every forced boundary."""
        joinable, out, start = self.joinable, [], 0
        for i in range(1, len(piece)):
            if piece[i - 1] << 8 | piece[i] not in joinable:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def piece(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for f in self.cuts(piece):
            ids = self.fragments.get(f)
            if ids is None:
                if len(self.fragments) >= MEMO:
                    self.fragments.clear()
                ids = self.fragments[f] = [self.ranks[f]] if f in self.ranks else self.merge(f)
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "surrogatepass")


def counter(ranks: dict[bytes, int], pattern: str = PATTERN):
    """The number of tokens of a text, counted by the library; the same as of Codec.encode."""
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # a vocabulary has a fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in range(0, len(texts), 500):
                part = texts[s : s + 500]
                ids = [None if t is None else codec.encode(t) for t in part]
                same = [None if i is None else codec.decode(i) == t for i, t in zip(ids, part, strict=True)]
                flat = np.fromiter(chain.from_iterable(i for i in ids if i), np.int32)
                ends = np.cumsum([0] + [len(i or ()) for i in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([i is None for i in ids]))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(s, 500), "n_tokens": pa.array([None if i is None else len(i) for i in ids], pa.int64()), "token_ids": lists, "round_trip": pa.array(same, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array([None if i is None else codec.decode(i) for i in b.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", F.col("token_ids")).mapInArrow(decode, "doc_id bigint, text string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
