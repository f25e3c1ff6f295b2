"""Quality classifier by compression.

A zstandard dictionary is built from good and one from bad labelled texts. A text is compressed in
blocks under each; the normalised difference (bad - good) / (bad + good) of the sizes says which
dictionary explains it better, and a logistic curve fitted on held-out labelled rows turns it into
a probability of being good. Texts are read whole; blocks keep a dictionary's help independent of
length.

Defined results: a NULL text scores NULL and is not kept; an empty text has difference 0; with one
class missing from the labels every difference is 0 and the score is the share of good labels (0.5
without labels); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows of each class; half of them build the dictionary, half calibrate.
ROWS_PER_CLASS = 3000
DICTIONARY_BYTES, LEVEL, BLOCK = 112_640, 3, 4096
KEEP = 0.5


class Sizes:
    """Compressed sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = []
        for d in (good, bad):
            own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
            own.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False))

    def __call__(self, text: str) -> tuple[int, int]:
        raw = text.encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return tuple(sum(len(c.compress(b)) for b in blocks) for c in self.both)


def difference(good: int, bad: int) -> float:
    return (bad - good) / (bad + good) if bad + good else 0.0


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the raw texts themselves where there are too few to train on."""
    samples = [b for t in texts for raw in [t.encode("utf-8", "replace")] for b in [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] if b]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps; good rows weigh share in all."""
    if len(np.unique(y)) < 2:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return 0.0, float(np.log(p / (1 - p)))
    w = np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y == 0).mean()) / len(y)
    unit = max(float(x.std()), 1e-9)
    x, a, b = x / unit, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, d = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(d * x * x).sum() + 1e-3, (d * x).sum()], [(d * x).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * a, g.sum()])
        a, b = a - 0.7 * step[0], b - 0.7 * step[1]
    return float(a / unit), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> tuple[bytes, bytes, float, float]:
    """Good dictionary, bad dictionary, slope, offset; trained in one task on the bounded sample."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    share = known.agg(F.avg((F.col("good") > 0).cast("double"))).first()[0] or 0.5
    known = known.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(10)))
    ids = None
    for c in (0, 1):
        part = known.where(f"good {'>' if c else '<='} 0").orderBy("h", "doc_id").limit(rows)  # a bounded sample: ROWS_PER_CLASS
        ids = part if ids is None else ids.unionByName(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null").select(F.lit(0).alias("k"), "good", "h", "text")

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(table.column("h").to_pylist(), table.column("good").to_pylist(), table.column("text").to_pylist(), strict=True)))
        made, rest = [], []
        for c in (1, 0):
            own = [t for _, g, t in rows if (g > 0) == bool(c)]
            made.append(dictionary(own[::2]))
            rest += [(t, c) for t in own[1::2]]
        slope, offset = 0.0, 0.0
        y = np.array([c for _, c in rest])
        if all(made) and len(y):
            sizes = Sizes(*made)
            slope, offset = calibrate(np.array([difference(*sizes(t)) for t, _ in rest]), y, share)
        elif len(y):
            slope, offset = calibrate(np.zeros(len(y)), y)
        return pa.table({"good": pa.array([made[0]], pa.binary()), "bad": pa.array([made[1]], pa.binary()), "slope": [slope], "offset": [offset]})

    got = sample.groupBy("k").applyInArrow(train, "good binary, bad binary, slope double, offset double").collect()
    return (bytes(got[0].good), bytes(got[0].bad), got[0].slope, got[0].offset) if got else (b"", b"", 0.0, 0.0)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good_bytes, bad_bytes, score, keep) for every row."""
    good, bad, slope, offset = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad) if good and bad else (lambda t: (0, 0))
        for b in batches:
            got = [None if t is None else sizes(t) for t in b.column(1).to_pylist()]
            p = [None if s is None else round(float(1 / (1 + np.exp(-np.clip(slope * difference(*s) + offset, -30, 30)))), 6) for s in got]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "good_bytes": pa.array([s and s[0] for s in got], pa.int64()), "bad_bytes": pa.array([s and s[1] for s in got], pa.int64()), "score": pa.array(p, pa.float64()), "keep": pa.array([x is not None and x >= KEEP for x in p], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, good_bytes bigint, bad_bytes bigint, score double, keep boolean")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
