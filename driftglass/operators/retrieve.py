"""Candidate generation for a whole query set at once: dense, sparse, fused, reranked.

Candidate tables are long: (query_id, chunk_id, score, rank), rank from 1.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.functions.text import packed_words, terms, words_of

#: Rows of a block of vectors: bounds the memory of one block product.
BLOCK_ROWS = 2048
#: Blocks of chunks that one task multiplies, tasks there are where blocks allow it, and blocks of queries that a task holds.
TASK_BLOCKS, LEAST_TASKS, HELD_BLOCKS = 64, 64, 32
#: Rows that a task handles or gives at once.
OUT_ROWS = 1 << 17
#: Chunks that are scored at once, and scores that one step adds up.
PART_ROWS, PART_CELLS = 512, 1 << 21
#: Scores by words are whole numbers of so many to 1.
UNITS = 1e12
#: A side is broadcast only below this measured size.
BROADCAST_BYTES = 16 << 20


def depth_for(top_k: int) -> int:
    return max(4 * top_k, 20)


def top(scored: DataFrame, limit: int | None, *order: Column, digits: int | None = None) -> DataFrame:
    """Ranks per query by score, then order; at most limit of them."""
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


class _Passages:
    """Passages, found in texts by four bytes of each that few other passages have."""

    def __init__(self, passages: list[bytes]):
        self.short = [k for k, p in enumerate(passages) if len(p) < 4]
        self.passages = passages
        grams = Counter(p[i : i + 4] for p in passages for i in range(len(p) - 3))
        at = {k: min(range(len(p) - 3), key=lambda i, p=p: grams[p[i : i + 4]]) for k, p in enumerate(passages) if len(p) >= 4}
        key = np.array([int.from_bytes(passages[k][i : i + 4], "little") for k, i in at.items()], np.uint32)
        order = np.argsort(key, kind="stable")
        self.key, self.number, self.place = key[order], np.array([*at], np.int64)[order], np.array([*at.values()], np.int64)[order]
        self.size = np.array([len(p) for p in passages], np.int64)
        ends = lambda cut: np.array([int.from_bytes(cut(p), "little") for p in passages], np.uint32)
        self.head, self.tail = ends(lambda p: p[:4]), ends(lambda p: p[-4:])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return key * np.uint32(2654435769) >> np.uint32(16)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, passage) of the texts that contain passages."""
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        known = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(raw) >= 4 and len(self.key):
            four = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
            at = np.flatnonzero(self.maybe[self._slot(four)])
            low, high = np.searchsorted(self.key, four[at], "left"), np.searchsorted(self.key, four[at], "right")
            k = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
            passage, start = self.number[k], np.repeat(at, high - low) - self.place[k]
            row = np.searchsorted(offsets, start, "right") - 1
            ok = (start >= 0) & (start + self.size[passage] <= offsets[np.minimum(row + 1, len(offsets) - 1)])
            passage, start, row = passage[ok], start[ok], row[ok]
            ok = (four[start] == self.head[passage]) & (four[start + self.size[passage] - 4] == self.tail[passage])
            passage, start, row = passage[ok], start[ok], row[ok]
            ok = np.array([raw[s : s + n].tobytes() == self.passages[p] for s, n, p in zip(start.tolist(), self.size[passage].tolist(), passage.tolist(), strict=True)], bool)
            rows.append(row[ok])
            found.append(passage[ok])
        for p in self.short:
            has = [r for r in known.tolist() if self.passages[p] in raw[offsets[r] : offsets[r + 1]].tobytes()]
            rows.append(np.array(has, np.int64))
            found.append(np.full(len(has), p, np.int64))
        both = np.unique(np.concatenate(rows) * max(1, len(self.passages)) + np.concatenate(found))
        return np.divmod(both, max(1, len(self.passages)))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) of docs (doc_id, text) that contain passages (query_id, passage). Few passages go to the documents, which are read once."""
    if passages.count() * 1000 > BROADCAST_BYTES:
        return docs.join(passages, F.contains("text", "passage")).select("query_id", "doc_id")
    asked = passages.where("passage is not null").select("query_id", "passage").toArrow().combine_chunks()
    query, known = pa.concat_arrays(asked.column(0).chunks) if asked.num_rows else pa.array([], asked.schema.field(0).type), _Passages([p.encode() for p in asked.column(1).to_pylist()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, PART_ROWS):
            row, passage = known.of(b.column(1))
            yield pa.RecordBatch.from_arrays([query.take(pa.array(passage)), b.column(0).take(pa.array(row))], ["query_id", "doc_id"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"query_id {kind(passages, 'query_id')}, doc_id {kind(docs, 'doc_id')}")


# -- dense -----------------------------------------------------------------------------------


def _blocks(vectors: DataFrame, key: str, side: str) -> DataFrame:
    """Vectors gathered into normalised matrices of BLOCK_ROWS rows, each with a number of its own."""
    kind = vectors.schema[key].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            for s in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(s, BLOCK_ROWS)
                rows = part.column(1)
                dims = len(rows[0])
                if pc.any(pc.not_equal(pc.list_value_length(rows), dims)).as_py():
                    raise ValueError(f"vectors of {dims} and other dimensions cannot be compared")
                m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(size == 0, 1, size)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([m.tobytes()], pa.binary()), pa.array([dims], pa.int32())], [f"{side}_block", f"{side}_ids", f"{side}_matrix", f"{side}_dims"])
                number += 1

    return vectors.select(key, "vector").mapInArrow(gather, f"{side}_block bigint, {side}_ids array<{kind}>, {side}_matrix binary, {side}_dims int")


def _met(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every block of queries beside every block of chunks: a task has few blocks of queries and many of chunks."""
    n, dims = queries.count(), queries.where("vector is not null").select(F.size("vector").alias("n")).first()
    q, c = _blocks(queries, "query_id", "q"), _blocks(chunks, "chunk_id", "c")
    if n * 8 * (dims.n if dims else 0) <= BROADCAST_BYTES // 16:
        return c.crossJoin(F.broadcast(q))
    # blocks are made once and read from the shuffle, not made again for each block they meet
    mine, theirs = -(-n // BLOCK_ROWS), -(-chunks.count() // BLOCK_ROWS)
    parts = max(1, -(-theirs // TASK_BLOCKS), min(theirs, LEAST_TASKS // max(1, mine)))
    return c.repartition(parts).crossJoin(q.repartition(max(1, mine)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """(block of queries, their ids, their matrix, ids of chunks, their matrix) of each row."""
    for b in batches:
        get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for k in range(b.num_rows):
            mine, theirs = get["q_dims"][k].as_py(), get["c_dims"][k].as_py()
            if mine != theirs:
                raise ValueError(f"vectors of {mine} and {theirs} dimensions cannot be compared")
            matrix = lambda side: np.frombuffer(get[f"{side}_matrix"][k].as_buffer()).reshape(-1, mine)  # noqa: B023, E731
            yield get["q_block"][k].as_py(), get["q_ids"][k].values, matrix("q"), get["c_ids"][k].values, matrix("c")


def _scored(queries: pa.Array, chunks: pa.Array, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(score), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([queries.slice(s, OUT_ROWS), chunks.slice(s, OUT_ROWS), pa.array(score[s : s + OUT_ROWS])], ["query_id", "chunk_id", "score"])


def _where(score: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(score >= least.astype(np.float32)[:, None]), max(1, score.shape[1]))


def _kinds(queries: DataFrame, chunks: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): exact cosines of all queries (query_id, vector) and chunks (chunk_id, vector).

    Matrices of both sides meet in a cross join of blocks and are multiplied there.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q_ids, mine, c_ids, other in _pairs(batches):
            score = mine @ other.T
            step = max(1, OUT_ROWS // max(1, len(other)))
            for s in range(0, len(mine), step):
                part = score[s : s + step]
                row, col = np.divmod(np.arange(part.size), part.shape[1])
                yield from _scored(q_ids.take(pa.array(row + s)), c_ids.take(pa.array(col)), part.ravel())

    return _met(queries, chunks).mapInArrow(multiply, _kinds(queries, chunks))


class _Best:
    """The depth best candidates of each query, of the chunks seen so far, first in order of tie among equals.

    below holds what no candidate of a query can be under and still come in; score is what candidates are
    ordered by, told what is given of them. Those within near of the last of the best are kept too, where
    scores are rounded later.
    """

    def __init__(self, ids: pa.Array, depth: int, digits: int | None, rounded: bool = False):
        self.ids, self.depth = ids, depth
        self.slack = 1e-9 if digits is None else 1.01 * 10.0**-digits
        self.near = 0.0 if rounded else self.slack
        self.below = np.full(len(ids), -np.inf)
        self.row, self.score, self.told, self.chunk, self.tie = np.empty(0, np.int64), np.empty(0), np.empty(0), None, None
        self.full = 2 * depth * len(ids)

    def add(self, row: np.ndarray, score: np.ndarray, told: np.ndarray, chunk: pa.Array, tie: pa.Array | None = None) -> None:
        if not len(row):
            return
        self.row, self.score, self.told = np.concatenate((self.row, row)), np.concatenate((self.score, score)), np.concatenate((self.told, told))
        self.tie = tie if self.tie is None or tie is None else pa.concat_arrays((self.tie, tie))
        self.chunk = chunk if self.chunk is None else pa.concat_arrays((self.chunk, chunk))
        if len(self.row) > self.full:
            self.prune()
            self.full = max(self.full, 2 * len(self.row))

    def prune(self) -> None:
        if not len(self.row):
            return
        place = np.empty(len(self.row), np.int64)
        place[pc.array_sort_indices(self.chunk if self.tie is None else self.tie, null_placement="at_start").to_numpy()] = np.arange(len(self.row))
        order = np.lexsort((place, -self.score, self.row))
        row, score, at = self.row[order], self.score[order], np.arange(len(order))
        rank = at - np.searchsorted(row, np.arange(len(self.ids)))[row]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (score[1:] != score[:-1])))
        equal = at - np.maximum.accumulate(np.where(new, at, 0))  # place among equals
        least, last = np.full(len(self.ids), -np.inf), rank == self.depth - 1
        least[row[last]] = score[last]
        self.below = np.maximum(self.below, least - self.slack)
        keep = np.sort(order[(rank < self.depth) | ((score >= least[row] - self.near) & (equal < self.depth) & (self.near > 0))])
        self.row, self.score, self.told, self.chunk = self.row[keep], self.score[keep], self.told[keep], self.chunk.take(pa.array(keep))
        self.tie = None if self.tie is None else self.tie.take(pa.array(keep))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.prune()
        if len(self.row):
            yield from _scored(self.ids.take(pa.array(self.row)), self.chunk, self.told)


def _best(queries: DataFrame, chunks: DataFrame, depth: int, digits: int | None, consider, rounded: bool = False) -> DataFrame:
    """The depth best of each query in each task; consider(best, ids, rough, error, exact) adds those of a block that may be among them.

    rough are cosines in single precision, off by error at most; exact gives those of rows and columns.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Best, np.ndarray]] = {}
        for block, q_ids, mine, c_ids, other in _pairs(batches):
            if block not in held:
                if len(held) >= HELD_BLOCKS:
                    yield from held.pop(next(iter(held)))[0].rows()
                held[block] = _Best(q_ids, depth, digits, rounded), mine.astype(np.float32)
            exact = lambda row, col: np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", mine[row[s : s + OUT_ROWS]], other[col[s : s + OUT_ROWS]]) for s in range(0, len(row), OUT_ROWS))])  # noqa: B023, E731
            consider(held[block][0], c_ids, held[block][1] @ other.astype(np.float32).T, (mine.shape[1] + 8) * 1.2e-7, exact)
        for best, _ in held.values():
            yield from best.rows()

    return _met(queries, chunks).mapInArrow(multiply, _kinds(queries, chunks)) if depth > 0 else dense_scores(queries, chunks).limit(0)


def dense_topk(queries: DataFrame, chunks: DataFrame, depth: int | None, digits: int | None = None) -> DataFrame:
    """Exact cosine neighbours, ties by chunk_id. A task keeps depth chunks a query, so a window over them sees few rows."""
    if depth is None:
        return top(dense_scores(queries, chunks), None, F.asc("chunk_id"), digits=digits)

    def consider(best: _Best, ids: pa.Array, rough: np.ndarray, error: float, exact) -> None:
        below = best.below
        if np.isneginf(below).any() and rough.shape[1] > depth:
            below = np.maximum(below, np.partition(rough, -depth, axis=1)[:, -depth] - (best.slack + error))
        row, col = _where(rough, below - error)
        told = exact(row, col)
        if digits is not None:
            told = np.round(told, digits) + 0.0
        best.add(row, told, told, ids.take(pa.array(col)))

    return top(_best(queries, chunks, depth, digits, consider, rounded=True), depth, F.asc("chunk_id"))


def noisy_topk(queries: DataFrame, chunks: DataFrame, depth: int, sigma: float, seed: int, collection: str, digits: int | None = None) -> DataFrame:
    """The depth best by cosine and hash_noise, exactly, ties by chunk_id.

    A deviate is hashed only where it can matter: the first uniform number bounds it, and is itself
    2^-48 or more. What is kept gets its noise from hash_noise.
    """
    simple = {"tinyint", "smallint", "int", "bigint", "string"}
    if not {df.schema[k].dataType.simpleString() for df, k in ((queries, "query_id"), (chunks, "chunk_id"))} <= simple:
        return top(hash_noise(dense_scores(queries, chunks), sigma, seed, collection), depth, F.asc("chunk_id"), digits=digits)
    width = abs(sigma)
    reach = width * np.sqrt(96 * np.log(2))

    def uniform(salt: str, mine: list, theirs: list, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        if not len(row):
            return np.empty(0)
        heads, sha = [":".join((str(seed), collection, salt, *(() if q is None else (str(q),)))).encode() for q in mine], hashlib.sha256
        tails = [b"" if c is None else f":{c}".encode() for c in theirs]
        raw = b"".join([sha(heads[r] + tails[c]).digest()[:6] for r, c in zip(row.tolist(), col.tolist())])
        return (np.frombuffer(raw, np.uint8).reshape(-1, 6) @ (256.0 ** np.arange(5, -1, -1)) + 1) / float(1 << 48)

    def noisy(best: _Best, mine: list, theirs: list, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those that may come in, with their noisy scores."""
        size = width * np.sqrt(-2 * np.log(uniform("u", mine, theirs, row, col)))
        ok = x + size >= best.below[row]
        row, col, x, size = row[ok], col[ok], x[ok], size[ok]
        x = x + np.copysign(size, sigma) * np.cos(2 * np.pi * uniform("v", mine, theirs, row, col))
        ok = x >= best.below[row]
        return row[ok], col[ok], x[ok]

    def consider(best: _Best, ids: pa.Array, rough: np.ndarray, error: float, exact) -> None:
        mine, theirs = best.ids.to_pylist(), ids.to_pylist()
        if np.isneginf(best.below).any() and rough.shape[1] > 4 * depth:  # the nearest show how good the best are at least
            near = np.argpartition(rough, -4 * depth, axis=1)[:, -4 * depth :]
            row, col = np.repeat(np.arange(len(rough)), 4 * depth), near.ravel()
            x = noisy(_Best(best.ids, depth, digits), mine, theirs, exact(row, col), row, col)[2].reshape(len(rough), -1)
            best.below = np.maximum(best.below, np.partition(x, -depth, axis=1)[:, -depth] - 2 * best.slack)
        row, col = _where(rough, best.below - (reach + error))
        for s in range(0, len(row), OUT_ROWS):
            r, c = row[s : s + OUT_ROWS], col[s : s + OUT_ROWS]
            ok = rough[r, c] >= best.below[r] - (reach + error)  # below rises on the way
            r, c, x = noisy(best, mine, theirs, exact(r[ok], c[ok]), r[ok], c[ok])
            best.add(r, x, exact(r, c), ids.take(pa.array(c)))

    return top(hash_noise(_best(queries, chunks, depth, digits, consider), sigma, seed, collection), depth, F.asc("chunk_id"), digits=digits)


def dense_scores_sql(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same scores in built-in expressions; for small sets and cross-checks."""
    from driftglass.functions.vectors import cosine

    return chunks.crossJoin(queries.withColumnRenamed("vector", "query_vector")).select("query_id", "chunk_id", cosine(F.col("query_vector"), F.col("vector")).alias("score"))


def hash_noise(scored: DataFrame, sigma: float, seed: int, collection: str) -> DataFrame:
    """Approximate-serving noise: a normal deviate per (seed, collection, query, chunk), independent of order."""
    def uniform(salt: str) -> Column:
        h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(collection), F.lit(salt), F.col("query_id").cast("string"), F.col("chunk_id").cast("string")), 256)
        return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)

    deviate = F.sqrt(-2 * F.log(uniform("u"))) * F.cos(2 * np.pi * uniform("v"))
    return scored.withColumn("score", F.col("score") + sigma * deviate)


# -- sparse ----------------------------------------------------------------------------------


class Bm25:
    """BM25 over chunks (chunk_id, chunk_seq, text); ties keep the order of chunk_seq."""

    def __init__(self, chunks: DataFrame, k1: float = 1.5, b: float = 0.75):
        self.k1, self.b = k1, b
        self.chunks = chunks.select("chunk_id", "chunk_seq", "text")
        self.tokens = self.tokenised(self.chunks)

    @staticmethod
    def tokenised(chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", "chunk_seq", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("tokens"))

    def corpus(self) -> DataFrame:
        """One row: the number of chunks and their mean length."""
        size = F.size("tokens")
        return self.tokens.agg(F.count("*").alias("n"), F.coalesce(F.when(F.sum(size) == 0, F.lit(1.0)).otherwise(F.avg(size)), F.lit(1.0)).alias("avgdl"))

    def frequencies(self, only: DataFrame | None = None) -> DataFrame:
        """(chunk_id, chunk_seq, dl, term, tf), for the given terms alone where asked."""
        rows = self.tokens.select("chunk_id", "chunk_seq", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        if only is not None:
            rows = rows.join(only, "term", "left_semi")
        return rows.groupBy("chunk_id", "chunk_seq", "dl", "term").agg(F.count("*").alias("tf"))

    @staticmethod
    def document_frequency(tf: DataFrame) -> DataFrame:
        return tf.groupBy("term").agg(F.count("*").alias("df"))

    @staticmethod
    def idf(n: Column, df: Column) -> Column:
        return F.when(df > 0, F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.lit(0.0))

    @staticmethod
    def words(queries: DataFrame) -> DataFrame:
        """(query_id, term, qtf): repeated query words count again."""
        return queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))

    @staticmethod
    def postings(tokens: DataFrame, hinted: DataFrame) -> DataFrame:
        """(chunk_id, chunk_seq, dl, term, tf) of hinted terms, shuffled once, by chunk, so a frequent word is no hot key."""
        rows = tokens.select("chunk_id", "chunk_seq", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(hinted, "term", "left_semi")
        return rows.repartition("chunk_id").groupBy("chunk_id", "chunk_seq", "dl", "term").agg(F.count("*").alias("tf"))

    def summed(self, tf: DataFrame, weights: DataFrame) -> DataFrame:
        """(query_id, chunk_id, chunk_seq, score) of postings and weights (query_id, term, qtf, avgdl, idf); scores add up where postings are."""
        f = F.col("tf")
        part = F.col("idf") * f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl")))
        # whole units of 1e-12 add up exactly, so no order of partial sums can change a score or a tie
        exact = F.sum(F.round(F.col("qtf") * part * UNITS).cast("bigint"))
        grouped = tf.join(weights, "term").groupBy("query_id", "chunk_id", "chunk_seq").agg((exact / F.lit(UNITS)).alias("score"))
        return grouped.where("score > 0")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, chunk_seq, score) of chunks sharing a term; repeated query words count again."""
        words = self.words(queries)
        hint = F.broadcast if words.count() * 64 <= BROADCAST_BYTES else lambda df: df
        tf = self.postings(self.tokens, hint(words.select("term").distinct()))
        weights = words.join(self.document_frequency(tf), "term").crossJoin(F.broadcast(self.corpus()))  # one row
        weights = weights.select("query_id", "term", "qtf", "avgdl", self.idf(F.col("n"), F.col("df")).alias("idf"))
        return self.summed(tf, hint(weights))

    def topk(self, queries: DataFrame, depth: int | None, digits: int | None = None) -> DataFrame:
        scored = self.scores(queries) if depth is None else self.best(queries, depth, digits)
        return top(scored, depth, F.asc("chunk_seq"), digits=digits).select("query_id", "chunk_id", "score", "rank")

    def best(self, queries: DataFrame, depth: int, digits: int | None = None) -> DataFrame:
        """scores of the depth best of each query in each task, and of some more.

        Where the queries' words are few they go to the chunks: a chunk is scored for all queries at once
        and forgotten, so that no task holds a row for each query and chunk. Rows that share their chunk_id
        and chunk_seq meet in a shuffle, as all do where words are many.
        """
        words = self.words(queries)
        if depth <= 0 or words.count() * 64 > BROADCAST_BYTES:
            return self.scores(queries)
        single, again = ids.apart(self.chunks, "chunk_id", "chunk_seq")
        packed = packed_words(F.col("text"), terms)
        known = words.toArrow()
        vocabulary = pc.unique(known.column("term"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, length = np.zeros(len(vocabulary), np.int64), 0, 0
            for b in _parts(batches, PART_ROWS):
                dl, _, term, _ = _found(b.column(0), b.column(1), vocabulary)
                df += np.bincount(term, minlength=len(df))
                n, length = n + b.num_rows, length + int(dl.sum())
            yield pa.RecordBatch.from_pydict({"term": pa.array([*range(len(df)), -1, -2], pa.int64()), "n": pa.array([*df.tolist(), n, length], pa.int64())})

        counted = single.select(*packed).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        sums = {r.term: r.n for r in counted.collect()}
        df = {t: sums.get(k, 0) for k, t in enumerate(vocabulary.to_pylist())}
        n, length = sums.get(-1, 0), sums.get(-2, 0)
        spark = queries.sparkSession
        if again is not None:
            again = self.tokenised(again)
            tf = self.postings(again, F.broadcast(words.select("term").distinct()))
            for r in self.document_frequency(tf).collect():
                df[r.term] += r.df
            more = again.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
            n, length = n + more[0], length + more[1]
        avgdl = length / n if length else 1.0
        rows = [(q, t, f, n, df[t]) for q, t, f in zip(*(known.column(c).to_pylist() for c in ("query_id", "term", "qtf")), strict=True) if df[t]]
        kind = queries.schema["query_id"].dataType.simpleString()
        weights = spark.createDataFrame(rows, f"query_id {kind}, term string, qtf bigint, n bigint, df bigint")
        weights = weights.select("query_id", "term", "qtf", F.lit(avgdl).alias("avgdl"), self.idf(F.col("n"), F.col("df")).alias("idf"))
        mine = _Words(weights.toArrow(), vocabulary, self.k1, self.b, avgdl)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(mine.queries, depth, digits)
            for b in _parts(batches, mine.rows):
                total = mine.units(b.column(2), b.column(3))
                row, col = np.divmod(np.flatnonzero((total > 0) & (total >= best.below * UNITS)), max(1, len(mine.queries)))
                at = pa.array(row)
                value = total[row, col] / UNITS
                best.add(col, value, value, b.column(0).take(at), b.column(1).take(at))
            best.prune()
            for s in range(0, len(best.row), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([x[s : s + OUT_ROWS] for x in (mine.queries.take(pa.array(best.row)), best.chunk, best.tie, pa.array(best.told))], ["query_id", "chunk_id", "chunk_seq", "score"])

        chunk, seq = (self.chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "chunk_seq"))
        scored = single.select("chunk_id", "chunk_seq", *packed).mapInArrow(score, f"query_id {kind}, chunk_id {chunk}, chunk_seq {seq}, score double")
        return scored if again is None else scored.unionByName(self.summed(tf, F.broadcast(weights)))


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _found(texts: pa.Array, tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words of texts, or of lists of tokens, and (row, term, times) of what of the vocabulary is in them."""
    size, words, row = words_of(texts, tokens)
    at = pc.index_in(words, value_set=vocabulary)
    ok = at.is_valid().to_numpy(zero_copy_only=False)
    code, times = np.unique(row[ok] * max(1, len(vocabulary)) + at.drop_null().to_numpy(), return_counts=True)
    return size, *np.divmod(code, max(1, len(vocabulary))), times


class _Words:
    """The words of all queries by their place in the vocabulary, with their weights."""

    def __init__(self, weights: pa.Table, vocabulary: pa.Array, k1: float, b: float, avgdl: float):
        self.vocabulary, self.k1, self.b, self.avgdl = vocabulary, k1, b, avgdl
        get = lambda c: weights.column(c).combine_chunks()
        self.queries = pc.unique(get("query_id"))
        term, query = pc.index_in(get("term"), value_set=vocabulary).to_numpy(), pc.index_in(get("query_id"), value_set=self.queries).to_numpy()
        order = np.lexsort((query, term))
        self.query, idf = query[order].astype(np.int64), get("idf").to_numpy()[order]
        self.times, self.kind = np.unique(get("qtf").to_numpy()[order], return_inverse=True)
        self.size = np.bincount(term, minlength=len(vocabulary))
        self.start = np.cumsum(self.size) - self.size
        self.idf = np.zeros(len(vocabulary))
        self.idf[term[order]] = idf
        self.rows = max(1, min(PART_ROWS, PART_CELLS // max(1, len(self.queries))))
        # sums of whole numbers in double precision are exact below 2^53
        most = np.bincount(self.query, self.times[self.kind] * idf * (k1 + 1) * UNITS + 1, len(self.queries)) if len(idf) else np.zeros(1)
        self.exact = most.max() < 1 << 53

    def units(self, texts: pa.Array, tokens: pa.Array) -> np.ndarray:
        """Scores of each text for each query, in whole units."""
        n = len(self.queries)
        dl, row, term, tf = _found(texts, tokens, self.vocabulary)
        total = np.zeros(len(texts) * n, np.int64)
        cut = np.searchsorted(np.cumsum(self.size[term]), np.arange(PART_CELLS, int(self.size[term].sum()) + PART_CELLS, PART_CELLS))
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(term)], strict=True):
            t, at, f = term[s:e], row[s:e], tf[s:e].astype(np.float64)
            part = self.idf[t] * f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * dl[at] / self.avgdl))
            value = np.floor(self.times[:, None] * part * UNITS + 0.5)
            k = np.repeat(np.arange(len(t)), self.size[t])
            w = np.arange(len(k)) + np.repeat(self.start[t] - (np.cumsum(self.size[t]) - self.size[t]), self.size[t])
            cell, value = at[k] * n + self.query[w], value[self.kind[w], k]
            if self.exact:
                total += np.bincount(cell, value, len(total)).astype(np.int64)
            else:
                np.add.at(total, cell, value.astype(np.int64))
        return total.reshape(len(texts), n)


# -- fusion and reranking ----------------------------------------------------------------------


def first_ranks(ranked: DataFrame) -> DataFrame:
    """A chunk listed twice keeps its first place."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))


def min_max(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("normal", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)))


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = min_max(first_ranks(dense)).select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("normal").alias("dense_normal"))
    s = min_max(first_ranks(sparse)).select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("normal").alias("sparse_normal"))
    return d.join(s, ["query_id", "chunk_id"], "full_outer")


def _fused(scored: DataFrame, digits: int | None) -> DataFrame:
    order = (F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("chunk_id"))
    return top(scored, None, *order, digits=digits).select("query_id", "chunk_id", "score", "rank", "dense_rank", "sparse_rank")


def fuse_weighted(dense: DataFrame, sparse: DataFrame, weight: float, digits: int | None = None) -> DataFrame:
    """weight on the sparse side; a chunk missing from a list scores nothing there."""
    score = (1 - weight) * F.coalesce("dense_normal", F.lit(0.0)) + weight * F.coalesce("sparse_normal", F.lit(0.0))
    return _fused(_both(dense, sparse).withColumn("score", score), digits)


def fuse_reciprocal(dense: DataFrame, sparse: DataFrame, k0: int = 60, digits: int | None = None) -> DataFrame:
    part = lambda c: F.coalesce(1 / (k0 + F.col(c)), F.lit(0.0))
    return _fused(_both(dense, sparse).withColumn("score", part("dense_rank") + part("sparse_rank")), digits)


def fuse(dense: DataFrame, sparse: DataFrame, hybrid: dict | None, digits: int | None = None) -> DataFrame:
    """By a pipeline's hybrid setting; nothing set means the dense list."""
    if not hybrid:
        return dense.select("query_id", "chunk_id", "score", "rank")
    method = hybrid.get("fusion", "weighted")
    if method == "weighted":
        return fuse_weighted(dense, sparse, float(hybrid["bm25_weight"]), digits)
    if method == "rrf":
        return fuse_reciprocal(dense, sparse, int(hybrid.get("k0", 60)), digits)
    raise ValueError(f"fusion {method!r} is unknown")


def sweep_weights(dense: DataFrame, sparse: DataFrame, weights: list[float], digits: int | None = None) -> DataFrame:
    """Fused lists for every weight in one plan: weights cross the joined lists, nothing is retrieved again."""
    grid = dense.sparkSession.createDataFrame([(float(w),) for w in weights], "weight double")
    crossed = _both(dense, sparse).crossJoin(F.broadcast(grid))
    score = (1 - F.col("weight")) * F.coalesce("dense_normal", F.lit(0.0)) + F.col("weight") * F.coalesce("sparse_normal", F.lit(0.0))
    crossed = crossed.withColumn("score", score if digits is None else F.round(score, digits))
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("chunk_id"))
    return crossed.withColumn("rank", F.row_number().over(order)).select("weight", "query_id", "chunk_id", "score", "rank")


def rerank_overlap(fused: DataFrame, queries: DataFrame, chunks: DataFrame, window: int, top_n: int | None = None, digits: int | None = None) -> DataFrame:
    """By the share of query words found in the chunk, earlier places first among equals."""
    mine = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("qt"))
    theirs = chunks.select("chunk_id", F.array_distinct(terms(F.col("text"))).alias("ct"))
    rows = fused.where(F.col("rank") <= window).select("query_id", "chunk_id", F.col("rank").alias("before")).join(mine, "query_id").join(theirs, "chunk_id")
    overlap = F.when(F.size("qt") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("qt", "ct")) / F.greatest(F.size("qt"), F.lit(1)))
    return top(rows.withColumn("score", overlap), top_n or window, F.asc("before"), digits=digits).select("query_id", "chunk_id", "score", "rank")


def run_queries(queries: DataFrame, query_vectors: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, top_k: int = 10, hybrid: dict | None = None, rerank: dict | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, stage, rank, chunk_id, score) for stages dense, sparse, fused, reranked and final, all queries in one plan."""
    depth = depth_for(top_k)
    dense = dense_topk(query_vectors, chunk_vectors, depth, digits)
    sparse = Bm25(chunks).topk(queries, depth, digits)
    fused = fuse(dense, sparse, hybrid, digits)
    stages = {"dense": dense, "sparse": sparse, "fused": fused}
    if rerank:
        stages["reranked"] = rerank_overlap(fused, queries, chunks, top_k, rerank.get("top_n"), digits)
    stages["final"] = stages.get("reranked", fused.where(F.col("rank") <= top_k))
    parts = [df.select("query_id", F.lit(name).alias("stage"), "rank", "chunk_id", "score") for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
