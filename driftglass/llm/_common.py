"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 16 << 20
#: Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

U64 = np.uint64
_GOLD, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="driftglass-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/driftglass/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a stored table measured below the limit; otherwise the join shuffles."""
    return F.broadcast(stored) if stored.count() * row_bytes <= limit else stored


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_BLANK_BYTE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n or more powers of _BASE, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate(([U64(1)], np.cumprod(np.full(2 * n, U64(b)))))
    return _powers[0], _powers[1]


def token_hashes(text: str) -> np.ndarray:
    """uint64 hashes of the lower-cased words between ASCII white space.

    A word's hash is the sum of its bytes' random numbers times rising powers, so that the prefix
    sums of a text give the hashes of all its words at once.
    """
    raw = text.lower().encode("utf-8", "replace")
    if len(raw) <= PIECE_BYTES:
        return _piece_hashes(raw)
    out, start = [], 0
    while start < len(raw):
        end = _BLANK_BYTE.search(raw, start + PIECE_BYTES)
        end = end.start() if end else len(raw)
        out.append(_piece_hashes(raw[start:end]))
        start = end
    return np.concatenate(out)


def _piece_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, U64)
    np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * _GOLD)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


#: A random number for each byte.
_BYTES = mix(np.arange(1, 257, dtype=U64) * _GOLD)


def shingle_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n tokens, in order; empty when there are fewer."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out = mix((out + tokens[k : k + m]) * _GOLD + U64(k + 1))
    return out


def tidy() -> None:
    """Give memory that a finished task no longer needs back to the machine; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # not glibc
        return None


_trim = _find_trim()


def released(fn):
    """fn over Arrow batches or a group, tidying up when it is done."""

    @functools.wraps(fn)
    def run(data):
        out = fn(data)
        if not isinstance(out, Iterator):
            tidy()
            return out
        return _drain(out)

    return run


def _drain(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        tidy()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects of few texts live at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one partition as a table; None when there are no rows."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """A numeric column without nulls as numpy."""
    c = table.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.to_numpy(zero_copy_only=False)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def key_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables holding whole groups of a partition sorted by keys; only the last open group is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in last]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and held:
            before = [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys]
            if before != [x[0].item() for x in last]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of edges (a, b) with a, b BIGINT: rows (id, root), root the least id.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edge set stops changing; the number of rounds is logarithmic in the component size.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("least", "u").alias("m"))
        out = both.join(least, "u")
        if large:
            return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        moved = out.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    now = materialise(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), tag)
    state: tuple = ()
    while True:
        now = materialise(star(star(now, True), False), tag)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
