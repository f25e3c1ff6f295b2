"""Best-fit packing of documents into training sequences, with certified bin counts.

Items are hashed into partitions of bounded size and packed there by best-fit decreasing. Dual
feasible functions give a lower bound of the bins any packing of a partition needs; a partition
whose bin count equals its bound is certified. Partitions with a gap release the documents of
their unfilled bins, which meet in fresh partitions and are packed again; a round is kept only
where it saves bins, and the rounds end when no partition has a gap or nothing was saved.

Sizes are the tokens of each whole text under the vocabulary that operator 8 encodes with, so
start_token and n_tokens say which of its token_ids a piece holds. A document longer than
CAPACITY is cut into whole sequences and a rest.

Defined results: rows with a NULL or empty text have nothing to pack and get a NULL bin_id and no
tokens; a NULL doc_id is packed like any other; repeated rows are packed once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm._common import materialise, released, slices
from driftglass.llm.bpe import VOCABULARY, counter, load_ranks

CAPACITY = 2048
#: Items per partition: best fit works on one partition at a time, in memory.
PARTITION_ITEMS = 200_000
_SCHEMA = "part bigint, bin bigint, doc_id bigint, piece bigint, n_tokens int, filled int, bound bigint, bins bigint"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: the fullest bin that still takes it, items by falling size."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # bit r of rooms: some bin has r left
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
        out[i] = b
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions, in whole numbers."""
    if not len(sizes):
        return 0
    x, n = np.unique(sizes.astype(np.int64), return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for e in np.unique(x[x * 2 <= capacity]).tolist():
        big, mid = x > capacity - e, (x >= e) & (x <= capacity - e)
        best = max(best, -(-int(capacity * n[big].sum() + (x * n)[mid].sum()) // capacity))
        k = capacity // e
        over, half = 2 * x > capacity, (x >= e) & (2 * x <= capacity)
        best = max(best, -(-int(((k - (capacity - x[over]) // e) * n[over]).sum() + n[half].sum()) // k))
    best = max(best, int(n[2 * x > capacity].sum()))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        sizes = table.column("n_tokens").to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, sizes).astype(np.int32)[bins]
        n = len(sizes)
        return pa.table({"part": table.column("part"), "bin": pa.array(bins), "doc_id": table.column("doc_id"), "piece": table.column("piece"), "n_tokens": pa.array(sizes.astype(np.int32)), "filled": pa.array(filled), "bound": pa.array(np.full(n, lower_bound(sizes, capacity))), "bins": pa.array(np.full(n, int(bins.max()) + 1))})

    return pack


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, size): the tokens of every text; 0 for NULL."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # a vocabulary has a fixed size

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(ranks.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "size": pa.array([tokens(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64())})

    return docs.select("doc_id", "text").mapInArrow(released(sizes), "doc_id bigint, size bigint")


def pack(docs: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, piece, start_token, n_tokens, certified): the pieces of all documents and their sequences."""
    rows = token_counts(docs, vocabulary)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size - 1) div {capacity}"))).cast("array<bigint>")))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    items = materialise(pieces, "packing-items")
    some = items.where("n_tokens > 0")
    n_parts = max(1, -(-some.count() // partition_items))

    def spread(df: DataFrame, parts: int, salt: int) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", F.lit(salt)), F.lit(parts)).alias("part"), "doc_id", "piece", "n_tokens")

    first = spread(some, n_parts, 0).groupBy("part").applyInArrow(_pack(capacity), _SCHEMA)
    now = materialise(first.withColumn("round", F.lit(0)), "packing-0")
    kept: list[DataFrame] = []
    for r in count(1):
        gap = now.where("bins > bound")
        loose = gap.where(f"filled < {capacity}")
        before, n_loose = loose.select("round", "part", "bin").distinct().count(), loose.count()
        if not before:
            break
        parts = -(-n_loose // partition_items)  # what is left of several partitions meets in one
        again = materialise(spread(loose, parts, r).groupBy("part").applyInArrow(_pack(capacity), _SCHEMA).withColumn("round", F.lit(r)), f"packing-{r}")
        if again.select("part", "bins").distinct().agg(F.sum("bins")).first()[0] >= before:
            break
        kept.append(now.where(f"bins <= bound or filled = {capacity}"))
        now = again
    kept.append(now)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    bin_id = F.col("round").cast("bigint") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    done = out.select(bin_id.alias("bin_id"), "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), "n_tokens", (F.col("bins") == F.col("bound")).alias("certified"))
    empty = items.where("n_tokens = 0").select(F.lit(None).cast("bigint").alias("bin_id"), "doc_id", "piece", F.lit(0).cast("bigint").alias("start_token"), "n_tokens", F.lit(None).cast("boolean").alias("certified"))
    return done.unionByName(empty)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
