"""LM scoring: stupid-backoff scores of every document under the counts of all other documents.

A word is predicted from up to two words before it: by the trigram's count over its context's, else
by ALPHA times the bigram's ratio, else by ALPHA squared times the word's share, else by ALPHA once
more over the corpus size. A document's own occurrences are taken off every count, so copies of
itself do not vouch for it; near the start of a text only the orders that exist are tried.

The join is relational, with columnar rows. Texts are cut into blocks of word codes, shuffled once
by block. Each block explodes its n-grams of all orders, counts them, and sends them, packed by range
of hash, to the count table: one task per range adds the counts of all blocks and returns, per
block, what the other blocks hold of its n-grams. Blocks are joined with these answers and the
scores are summed per document. Packed and sorted, a hash takes about four bytes instead of a
shuffled row; its width grows with the corpus, so that at any size one n-gram in a million shares
its hash. Nothing but the number of words reaches the driver.

Words are lower-cased and split at ASCII white space. Defined results: a NULL text has NULL
results; an empty text has 0 words, score 0 and a NULL mean; repeated rows are documents of their
own; a NULL doc_id is scored; in a corpus of one document every word is unseen; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftglass.llm._common import materialise, mix, released, shingle_hashes, slices, token_hashes, U64

ORDER, ALPHA = 3, 0.4
BLOCK_WORDS, RANGE_GRAMS = 700_000, 2_000_000


def hash_bits(words: int) -> int:
    """Width at which one of 2^20 n-grams of the corpus collides; never narrow."""
    return min(63, max(48, (ORDER * max(words, 1)).bit_length() + 20))


def _squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes, compressed."""
    v = np.ascontiguousarray(values, U64)
    width = max(1, (int(v.max(initial=U64(0))).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view(U64).ravel()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as codes into their sorted word hashes."""
    count = 0

    def block(ids: list, words: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal count
        count += 1
        flat = np.concatenate(words) if words else np.empty(0, U64)
        vocabulary, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small codes for frequent words pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary, codes = vocabulary[order], rank[codes]
        lengths = np.array([len(w) for w in words], np.int64)
        known = np.array([i is not None for i in ids])
        key = xxh3_64_intdigest(b"%d:%d:" % (TaskContext.get().partitionId(), count) + lengths.tobytes()) >> 1
        return pa.RecordBatch.from_pydict({
            "block": pa.array([key], pa.int64()),
            "n_words": pa.array([len(flat)], pa.int64()),
            "n_docs": pa.array([len(ids)], pa.int64()),
            "ids": pa.array([np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes()], pa.binary()),
            "lengths": pa.array([_squeeze(lengths)], pa.binary()),
            "n_vocabulary": pa.array([len(vocabulary)], pa.int64()),
            "vocabulary": pa.array([_squeeze(vocabulary)], pa.binary()),
            "codes": pa.array([_squeeze(codes)], pa.binary()),
        })

    ids: list = []
    words: list[np.ndarray] = []
    size = 0
    for b in slices(batches):
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = token_hashes(text)
            if ids and size + len(w) > BLOCK_WORDS:
                yield block(ids, words)
                ids, words, size = [], [], 0
            ids.append(i)
            words.append(w)
            size += len(w)
    if ids:
        yield block(ids, words)


_BLOCK = "block bigint, n_words bigint, n_docs bigint, ids binary, lengths binary, n_vocabulary bigint, vocabulary binary, codes binary"


def _grams(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Document of each word, position in it, and per order the words that end a gram and the grams."""
    lengths = _expand(row["lengths"], row["n_docs"]).astype(np.int64)
    words = _expand(row["vocabulary"], row["n_vocabulary"])[_expand(row["codes"], row["n_words"]).astype(np.int64)] if row["n_words"] else np.empty(0, U64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends, grams = [], []
    for k in range(1, ORDER + 1):
        end = np.flatnonzero(place >= k - 1)
        h = shingle_hashes(words, k)
        ends.append(end)
        grams.append(mix(h[end - (k - 1)] + U64(k)) >> U64(64 - bits) if len(end) else np.empty(0, U64))
    return doc, place, ends, grams


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(grams)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    return s[at], np.diff(np.append(at, len(s)))


def _cuts(sorted_grams: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range of hashes starts, and the end."""
    which = ((sorted_grams >> U64(bits - 32)) * U64(ranges)) >> U64(32)
    return np.searchsorted(which, np.arange(ranges + 1, dtype=U64))


def _ask(ranges: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, counts = _counted(np.concatenate(_grams(row, bits)[3]))
                cuts = _cuts(keys, ranges, bits)
                out: dict[str, list] = {"range": [], "block": [], "n": [], "grams": [], "counts": []}
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(int(cuts[r]), int(cuts[r + 1]))
                    out["range"].append(r)
                    out["block"].append(row["block"])
                    out["n"].append(part.stop - part.start)
                    out["grams"].append(_squeeze(np.diff(keys[part], prepend=U64(0))) if part.stop - part.start == 1 else int(keys[part][0]).to_bytes(8, "little") + _squeeze(np.diff(keys[part])))
                    out["counts"].append(_squeeze(counts[part]))
                yield pa.RecordBatch.from_pydict({"range": pa.array(out["range"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "grams": pa.array(out["grams"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return ask


def _read_grams(blob: bytes, n: int) -> np.ndarray:
    if n == 1:
        return _expand(blob, 1)
    return np.cumsum(np.concatenate((np.frombuffer(blob[:8], U64), _expand(blob[8:], n - 1))), dtype=U64)


def _add(table: pa.Table) -> pa.Table:
    """The count table of one range of hashes, joined back to the n-grams of each block."""
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    n = table.column("n").to_numpy()
    keys = np.concatenate([_read_grams(g, int(k)) for g, k in zip(table.column("grams").to_pylist(), n, strict=True)])
    counts = np.concatenate([_expand(c, int(k)) for c, k in zip(table.column("counts").to_pylist(), n, strict=True)]).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    at = keys[by]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    total = np.empty(len(keys), np.int64)
    total[by] = np.repeat(np.add.reduceat(counts[by], starts), np.diff(np.append(starts, len(at))))
    others = np.split(total - counts, np.cumsum(n)[:-1])
    return pa.table({"block": table.column("block"), "range": table.column("range"), "others": pa.array([_squeeze(o) for o in others], pa.binary())})


def _score(ranges: int, total: int, bits: int):
    penalty = float(np.log(ALPHA))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n_docs = row["n_docs"]
                ids = np.frombuffer(row["ids"][: 8 * n_docs], np.int64)
                known = np.frombuffer(row["ids"][8 * n_docs :], bool)
                doc, place, ends, grams = _grams(row, bits)
                length = np.bincount(doc, minlength=n_docs)
                flat = np.concatenate(grams)
                keys, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
                del flat, grams
                cuts = _cuts(keys, ranges, bits)
                others, answered = np.zeros(len(keys), np.int64), 0
                for a in row["answers"] or []:
                    part = slice(int(cuts[a["range"]]), int(cuts[a["range"] + 1]))
                    others[part] = _expand(a["others"], part.stop - part.start)
                    answered += part.stop - part.start
                if answered != len(keys):  # a block made again after a loss must be the block that asked
                    raise RuntimeError("the rows of a block changed between two reads of the documents")
                # own occurrences: the grams of one document
                owner = np.concatenate([doc[e] for e in ends]) * np.int64(max(1, len(keys))) + inverse
                _, mine, own = np.unique(owner, return_inverse=True, return_counts=True)
                rest = (others + counts)[inverse] - own[mine]
                del owner, inverse, mine
                c = np.zeros((ORDER + 1, len(doc)), np.int64)
                start = 0
                for k, e in enumerate(ends, 1):
                    c[k, e] = rest[start : start + len(e)]
                    start += len(e)
                outside = np.maximum(total - length, 1)[doc].astype(float)
                most = np.minimum(place + 1, ORDER)
                s = most * penalty - np.log(outside)
                for k in range(1, ORDER + 1):
                    ok = np.flatnonzero(c[k] > 0)
                    below = outside[ok] if k == 1 else c[k - 1, ok - 1]
                    s[ok] = (most[ok] - k) * penalty + np.log(c[k, ok] / below)
                sums = np.bincount(doc, s, n_docs)
                mean = [round(x / n, 6) if n else None for x, n in zip(sums.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": pa.array(length, pa.int64()), "log_score": pa.array(np.round(sums, 4)), "mean_log_score": pa.array(mean, pa.float64())})

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row."""
    texts = docs.where("text is not null").select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(t.encode("utf-8", "replace").split()) for b in slices(batches) for t in b.column(0).to_pylist())], pa.int64())})

    total = texts.select("text").mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    ranges, bits = max(1, -(-total * ORDER // RANGE_GRAMS)), hash_bits(total)
    # both readers of the blocks, the asking and the scoring, share this one exchange
    blocks = texts.mapInArrow(released(_encode), _BLOCK).repartition("block")
    asked = blocks.mapInArrow(released(_ask(ranges, bits)), "range int, block bigint, n bigint, grams binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(released(_add), "block bigint, range int, others binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("range", "others")).alias("answers"))
    joined = blocks.join(answers, "block", "left")
    scored = joined.mapInArrow(released(_score(ranges, total, bits)), "doc_id bigint, n_words bigint, log_score double, mean_log_score double")
    none = docs.where("text is null").select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("n_words", "bigint"), ("log_score", "double"), ("mean_log_score", "double"))))
    return scored.unionByName(none)


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT k, unnest(w) AS w3, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT k, i, w3, lag(w3) OVER v AS w2, lag(w3, 2) OVER v AS w1 FROM t WINDOW v AS (PARTITION BY k ORDER BY i)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY k, w3) AS c1,
    CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY k, w2, w3) END AS c2,
    CASE WHEN w1 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY k, w1, w2, w3) END AS c3,
    greatest(count(*) OVER () - count(*) OVER (PARTITION BY k), 1) AS n, least(i, 3) AS most FROM g),
contexts AS (SELECT *, lag(c1) OVER v AS x1, lag(c2) OVER v AS x2 FROM counted WINDOW v AS (PARTITION BY k ORDER BY i)),
scored AS (
  SELECT k, CASE WHEN c3 > 0 THEN ln(c3 / x2) WHEN c2 > 0 THEN (most - 2) * ln(0.4) + ln(c2 / x1)
    WHEN c1 > 0 THEN (most - 1) * ln(0.4) + ln(c1 / n) ELSE most * ln(0.4) - ln(n) END AS s FROM contexts),
sums AS (SELECT k, count(*) AS n_words, sum(s) AS total FROM scored GROUP BY k)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n_words, 0) END AS n_words,
  CASE WHEN text IS NOT NULL THEN round(coalesce(total, 0), 4) END AS log_score, round(total / n_words, 6) AS mean_log_score
FROM d LEFT JOIN sums USING (k)
"""
