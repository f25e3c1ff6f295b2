"""Statistics of the gate: driver functions for scalars, DataFrame forms for tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(values: list[float], p: float) -> float:
    """Linear interpolation between order statistics; 0 for no values."""
    v = sorted(values)
    if not v:
        return 0.0
    at = p * (len(v) - 1)
    low = math.floor(at)
    return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])


def bootstrap_interval(values: list[float], seed: int = 0, resamples: int = 2000, alpha: float = 0.05) -> tuple[float, float]:
    """Interval of the mean between percentiles, with the standard library's generator."""
    if len(values) < 2:
        return (float(values[0]),) * 2 if values else (0.0, 0.0)
    draw, n = random.Random(seed), len(values)
    means = [math.fsum(sample) / n for sample in (draw.choices(values, k=n) for _ in range(resamples))]
    return percentile(means, alpha / 2), percentile(means, 1 - alpha / 2)


def mcnemar(b: int, c: int) -> float:
    """Two-sided exact p of discordant counts."""
    if min(b, c) < 0:
        raise ValueError("counts cannot be negative")
    n = b + c
    ways = [math.comb(n, k) for k in range(1 + min(c, b))]
    return min(1.0, 2 * sum(ways) / 2**n) if n else 1.0


def false_discovery(p_values: list[float], q: float = 0.05) -> list[bool]:
    """Benjamini-Hochberg step-up flags in input order."""
    m = len(p_values)
    order = sorted(range(m), key=p_values.__getitem__)
    last = max((r for r, i in enumerate(order, 1) if p_values[i] <= r * q / m), default=0)
    chosen = set(order[:last])
    return [i in chosen for i in range(m)]


def near_tie_bound(gaps: list[float]) -> float:
    return percentile([abs(g) for g in gaps], 0.95)


def mcnemar_col(b: Column, c: Column) -> Column:
    """The exact p as an expression: a running sum of binomial terms in logarithms."""
    n, low = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("lg"), F.exp(-n * math.log(2)).alias("s"))
    ratio = lambda i: F.log((n - i + 1) / i)
    step = lambda a, i: F.struct((a["lg"] + ratio(i.cast("double"))).alias("lg"), (a["s"] + F.exp(a["lg"] + ratio(i.cast("double")) - n * math.log(2))).alias("s"))
    terms = F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step, lambda a: a["s"])))


def false_discovery_table(tests: DataFrame, key: str, q: float = 0.05, p: str = "p") -> DataFrame:
    """tests with rejected; the family is the whole table, a few rows per tag."""
    everything = Window.partitionBy()
    ranked = tests.withColumn("_r", F.row_number().over(Window.orderBy(p, key))).withColumn("_m", F.count("*").over(everything))
    last = F.coalesce(F.max(F.when(F.col(p) <= F.col("_r") * q / F.col("_m"), F.col("_r"))).over(everything), F.lit(0))
    return ranked.withColumn("rejected", F.col("_r") <= last).drop("_r", "_m")


#: Values that travel packed in one row, resamples that are drawn in one task, and draws that are hashed at once.
BLOCK_VALUES, RESAMPLES, DRAWS = 1 << 24, 20, 1 << 16
#: Packed values are broadcast only below this size.
BROADCAST_BYTES = 16 << 20


def hash_bootstrap(values: DataFrame, value: str, order: str, seed: int = 0, resamples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """One row (low, high): resampling with hashed indices, the same on any cluster and in any engine.

    Values travel packed, in blocks; draws are hashed and summed where the values are, so no draw is a row.
    """
    n = values.count()
    indexed = values.repartition(1).sortWithinPartitions(order).select(F.col(value).cast("double").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held, size = 0, [], 0
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                held.append(b.column(0))
                size += b.num_rows
            while size >= BLOCK_VALUES or (b is None and size):
                whole = pa.concat_arrays(held)
                part, rest = whole.slice(0, BLOCK_VALUES), whole.slice(BLOCK_VALUES)
                known = part.is_valid().to_numpy(zero_copy_only=False)
                v = part.fill_null(0.0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "vs": pa.array([v.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary())})
                start, held, size = start + len(part), [rest], len(rest)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            for r in batch.to_pylist():
                v, known = np.frombuffer(r["vs"]), np.frombuffer(r["known"], bool)
                whole, drawn = len(v) == n, range(r["g"] * RESAMPLES, min(resamples, (r["g"] + 1) * RESAMPLES))
                total, count = np.zeros(len(drawn)), np.zeros(len(drawn), np.int64)
                for s in range(0, n, DRAWS):
                    places = [b"%d" % j for j in range(s, min(n, s + DRAWS))]
                    for k, b in enumerate(drawn):
                        head = f"{seed}:{b}:".encode()
                        i = np.frombuffer(b"".join([sha(head + j).digest()[:4] for j in places]), ">u4").astype(np.int64) % n
                        if not whole:
                            i = i[(i >= r["start"]) & (i < r["start"] + len(v))] - r["start"]
                        total[k] += v[i].sum()
                        count[k] += np.count_nonzero(known[i])
                yield pa.RecordBatch.from_pydict({"b": pa.array(drawn, pa.int64()), "s": pa.array(total), "c": pa.array(count)})

    blocks, groups = indexed.mapInArrow(pack, "start bigint, vs binary, known binary"), -(-resamples // RESAMPLES)
    if n * 9 <= BROADCAST_BYTES:
        met = values.sparkSession.range(0, groups, 1, max(1, groups)).withColumnRenamed("id", "g").crossJoin(F.broadcast(blocks))
    else:
        met = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))).repartition(groups, "g", "start")
    sums = met.mapInArrow(draw, "b bigint, s double, c bigint").groupBy("b").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    means = sums.select(F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))
