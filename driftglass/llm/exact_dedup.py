"""Exact dedup: counting quotient filters merged by sorted remainders, then byte verification.

Every input partition folds the 64-bit fingerprints of its texts into a counting quotient filter:
the top bits of a fingerprint (quotient) address a slot, the rest (remainder) is stored in the
slot's sorted run beside its count. A filter is cut into ranges of quotients; equal ranges of all
partitions meet in one task, which merges them two by two, run by run, and adds the counts of equal
remainders. Quotient and remainder together are the whole fingerprint, so the merge loses nothing.
Only documents whose fingerprint counts above one travel with their text, to be grouped by their
bytes: a text is counted where it is before it is shuffled, and the rows of a group are never
gathered, so a text that a third of all rows have costs no more than others.

Defined results: a NULL text is never a copy; empty texts are copies of each other; a NULL doc_id
takes part, sorts last and is kept only where a group has no other id; repeated rows count as
copies; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm._common import broadcast_if_small, column, materialise, released, whole_partition

#: Ranges of quotients per shuffle partition.
RANGES_PER_PARTITION = 2
#: Bits of a fingerprint that are its quotient; all filters have the same, so that they merge run by run.
QUOTIENT_BITS = 24


class QuotientFilter:
    """A counting quotient filter over one range of 64-bit fingerprints, kept losslessly.

    ``runs`` has the quotients with a run, ``ends`` the slot after each run; ``remainders`` and
    ``counts`` hold the slots in order, remainders rising within a run.
    """

    def __init__(self, qbits: int, runs: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.runs, self.ends, self.remainders, self.counts = qbits, runs, ends, remainders, counts

    @classmethod
    def of(cls, values: np.ndarray, qbits: int) -> QuotientFilter:
        """The filter of sorted fingerprints."""
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))[: len(values)]
        keys, counts = values[starts], np.diff(np.append(starts, len(values)))
        quotients = keys >> np.uint64(64 - qbits)
        last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], True)[: len(keys)])
        return cls(qbits, quotients[last], last + 1, keys & np.uint64((1 << 64 - qbits) - 1), counts.astype(np.uint64))

    def quotients(self) -> np.ndarray:
        """The quotient of each slot."""
        return np.repeat(self.runs, np.diff(self.ends, prepend=0))

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters in one: runs of equal quotients merge by their sorted remainders, whose counts add up where equal."""
        order = [np.searchsorted(np.union1d(self.runs, other.runs), f.quotients()).astype(np.uint64) for f in (self, other)]
        # where runs are dense, (run, remainder) is one number that rises from slot to slot
        shift = np.uint64(64 - self.qbits)
        mine, theirs = ((o << shift) | f.remainders for o, f in zip(order, (self, other), strict=True))
        at = np.searchsorted(mine, theirs)
        same = (at < len(mine)) & (mine[np.minimum(at, max(0, len(mine) - 1))] == theirs) if len(mine) else np.zeros(len(theirs), bool)
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        quotients = np.insert(self.quotients(), at[~same], other.quotients()[~same])
        last = np.flatnonzero(np.append(quotients[1:] != quotients[:-1], True)[: len(quotients)])
        return QuotientFilter(self.qbits, quotients[last], last + 1, np.insert(self.remainders, at[~same], other.remainders[~same]), np.insert(counts, at[~same], other.counts[~same]))

    def fingerprints(self) -> np.ndarray:
        return (self.quotients() << np.uint64(64 - self.qbits)) | self.remainders

    def dump(self) -> bytes:
        base = int(self.runs[0]) if len(self.runs) else 0
        occupied = np.zeros(int(self.runs[-1]) - base + 1 if len(self.runs) else 0, bool)
        occupied[(self.runs - np.uint64(base)).astype(np.int64)] = True
        closes = np.zeros(len(self.remainders), bool)
        closes[self.ends - 1] = True
        most = int(self.counts.max(initial=0))
        small = self.counts.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64)
        head = np.array([self.qbits, base, len(occupied), len(self.remainders), small.itemsize], np.uint64)
        # remainders need 64-q bits; whole bytes of the top that are always zero are left out
        raw = np.ascontiguousarray(self.remainders).view(np.uint8).reshape(-1, 8)[:, : (64 - self.qbits + 7) // 8]
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(closes), raw, small))

    @classmethod
    def load(cls, blob: bytes) -> QuotientFilter:
        qbits, base, span, n, item = (int(x) for x in np.frombuffer(blob, np.uint64, 5))
        at = 40
        occupied = np.unpackbits(np.frombuffer(blob, np.uint8, (span + 7) // 8, at), count=span)
        at += (span + 7) // 8
        closes = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n)
        at += (n + 7) // 8
        width = (64 - qbits + 7) // 8
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        counts = np.frombuffer(blob, np.dtype(f"u{item}"), n, at + n * width)
        return cls(qbits, np.flatnonzero(occupied).astype(np.uint64) + np.uint64(base), np.flatnonzero(closes) + 1, raw.view(np.uint64).ravel(), counts.astype(np.uint64))


def merge(filters: list[QuotientFilter]) -> QuotientFilter:
    """Filters of the same range in one, merged two by two."""
    while len(filters) > 1:
        filters = [a.merge(b[0]) if b else a for a, *b in (filters[i : i + 2] for i in range(0, len(filters), 2))]
    return filters[0]


def repeated_fingerprints(prints: DataFrame, ranges: int, qbits: int = QUOTIENT_BITS) -> DataFrame:
    """Fingerprints (fp BIGINT) that occur more than once in column fp."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not kept:
            return
        values = np.sort(np.concatenate(kept).view(np.uint64))
        cuts = np.searchsorted(values >> np.uint64(32), (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
        parts = [(i, v) for i, v in enumerate(np.split(values, cuts)) if len(v)]
        yield pa.RecordBatch.from_pydict({"range": pa.array([i for i, _ in parts], pa.int32()), "filter": pa.array([QuotientFilter.of(v, qbits).dump() for _, v in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        whole = merge([QuotientFilter.load(b) for b in table.column("filter").to_pylist()])
        return pa.table({"fp": pa.array(whole.fingerprints()[whole.counts > 1].view(np.int64), pa.int64())})

    return prints.mapInArrow(released(build), "range int, filter binary").groupBy("range").applyInArrow(add, "fp bigint")


def exact_copies(docs: DataFrame) -> DataFrame:
    """(fp, keep_id, doc_id, n_copies): a row for each row of a group of two or more equal texts; keep_id is the least id."""
    spark = docs.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = docs.where("text is not null").select(F.xxhash64("text").alias("fp"))
    repeated = materialise(repeated_fingerprints(prints, ranges), "exact-fp")
    repeated = broadcast_if_small(repeated, 24)
    suspects = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("fp")).join(repeated, "fp", "left_semi")
    # grouping by text compares its bytes; the fingerprint only places the group
    groups = suspects.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies"))
    groups = materialise(groups.groupBy("fp").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("n_copies").alias("n_copies")), "exact-groups")
    # a fingerprint of one text stands for its bytes from here on
    one = broadcast_if_small(groups.where("texts = 1").select("fp", "keep_id", "n_copies"), 32)
    copies = suspects.select("doc_id", "fp").join(one, "fp").select("fp", "keep_id", "doc_id", "n_copies")
    several = groups.where("texts > 1").select("fp")
    if not several.count():
        return copies
    clash = suspects.join(several, "fp", "left_semi")
    groups = clash.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return copies.unionByName(clash.join(groups, ["fp", "text"]).select("fp", "keep_id", "doc_id", "n_copies"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts; every other row and column as it was."""
    copies = materialise(exact_copies(docs), "exact-copies")
    fp = F.xxhash64(docs["text"])
    per_id = copies.groupBy("fp", "doc_id", "keep_id").agg(F.count("*").alias("n"))
    gone = per_id.where("not (doc_id <=> keep_id)").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    again = per_id.where("doc_id <=> keep_id and n > 1").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    gone, again = (materialise(x, "exact-ids") for x in (gone, again))
    on = lambda side: docs["doc_id"].eqNullSafe(side["__id"]) & (fp == side["__fp"])
    gone, again = broadcast_if_small(gone, 40), broadcast_if_small(again, 40)
    left = docs.join(gone, on(gone), "left_anti")
    once = left.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, on(again), "left_anti").unionByName(once)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "n_copies")


ORACLE = """
SELECT doc_id, keep_id, n_copies FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS n_copies
  FROM documents WHERE text IS NOT NULL)
WHERE n_copies > 1
"""
