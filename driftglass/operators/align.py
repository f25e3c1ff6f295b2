"""Chunk fates between two chunkings and classes of queries between two evaluations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions.text import packed_words, terms, words_of

INTACT, PART, SPLIT, MERGED, DROPPED, FUZZY = 0.95, 0.15, 0.9, 0.7, 0.5, 0.6
#: Old chunks of a document, and words, that are compared at once.
ROWS, WORDS = 1024, 4096


def union_length(start: Column, end: Column, *by: str, when: Column | None = None) -> Column:
    """The part of [start, end) that no earlier interval of the group covers; summed, the length of the union."""
    earlier = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end if when is None else F.when(when, end)).over(earlier)
    new = F.greatest(F.lit(0), end - F.greatest(start, F.coalesce(reach, start)))
    return new if when is None else F.when(when, new).otherwise(F.lit(0))


def align_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, fate, score, descendants) for every old chunk, by overlapping spans of the same document.

    The join is by document with the overlap as a residual condition; spans of one document are few.
    """
    o = old.select("doc_id", "chunk_id", F.col("span_start").alias("os"), F.col("span_end").alias("oe"))
    n = new.select(F.col("doc_id").alias("nd"), F.col("chunk_id").alias("new_id"), F.col("span_start").alias("ns"), F.col("span_end").alias("ne"))
    met = o.join(n, (F.col("doc_id") == F.col("nd")) & (F.col("os") < F.col("ne")) & (F.col("ns") < F.col("oe")), "left")
    a, b = F.greatest("os", "ns"), F.least("oe", "ne")
    length = (F.col("oe") - F.col("os")).cast("double")
    met = met.select("chunk_id", "os", "oe", "new_id", "ns", a.alias("a"), b.alias("b"), F.when(F.col("oe") > F.col("os"), (b - a) / F.greatest(length, F.lit(1.0))).alias("part"), F.when(F.col("ne") > F.col("ns"), (b - a) / F.greatest((F.col("ne") - F.col("ns")).cast("double"), F.lit(1.0))).alias("cover"))
    met = met.withColumn("all_new", union_length(F.col("a"), F.col("b"), "chunk_id")).withColumn("part_new", union_length(F.col("a"), F.col("b"), "chunk_id", when=F.col("part") >= PART))
    rows = F.struct(F.negative("part").alias("o"), "ns", "new_id", "cover", "part")
    full = F.col("part") >= INTACT
    one = met.groupBy("chunk_id", "os", "oe").agg(
        F.sum("all_new").alias("u"), F.sum("part_new").alias("q"), F.count_if(F.col("part") >= PART).alias("nq"), F.count_if(full).alias("nf"), F.max(F.when(full, F.col("cover"))).alias("full_cover"),
        F.array_sort(F.collect_list(F.when(F.col("new_id").isNotNull(), rows))).alias("found"),
    )
    length = F.greatest((F.col("oe") - F.col("os")).cast("double"), F.lit(1.0))
    combined, qualifying = F.col("u") / length, F.col("q") / length
    best = F.try_element_at("found", F.lit(1))
    fate = (
        F.when((F.size("found") == 0) | (F.col("oe") <= F.col("os")), "dropped")
        .when((F.col("nf") == 1) & (F.col("full_cover") >= INTACT), "intact")
        .when((F.col("nq") >= 2) & (qualifying >= SPLIT), "split")
        .when((best["part"] >= INTACT) & (best["cover"] < MERGED), "merged")
        .when(combined < DROPPED, "dropped")
        .otherwise("boundary-shifted")
    )
    out = one.select("chunk_id", fate.alias("fate"), F.when((F.size("found") == 0) | (F.col("oe") <= F.col("os")), 0.0).otherwise(combined).alias("score"), F.transform("found", lambda x: x["new_id"]).alias("d"))
    return out.select("chunk_id", "fate", "score", F.when(F.col("fate") == "dropped", F.array().cast("array<string>")).otherwise(F.col("d")).alias("descendants"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def _nearest(side: np.ndarray, known: np.ndarray, row: np.ndarray, word: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(old row, row of the new one most like it, similarity) of one document; row and word say which different words a row has.

    Word sets meet as matrices, ROWS old ones and WORDS words at a time.
    """
    old, new = np.flatnonzero((side == 0) & known), np.flatnonzero((side == 1) & known)
    new = new[np.argsort(order[new], kind="stable")]
    size, at = np.bincount(row, minlength=len(side)), np.full(len(side), -1)
    if not len(old) or not len(new):
        return old[:0], new[:0], np.empty(0)
    _, word = np.unique(word, return_inverse=True)
    best, score = [], []
    for s in range(0, len(old), ROWS):
        part = old[s : s + ROWS]
        common = np.zeros((len(part), len(new)), np.float32)
        for t in range(0, int(word.max()) + 1 if len(word) else 0, WORDS):
            m = []
            for rows in (part, new):
                at[:] = -1
                at[rows] = np.arange(len(rows))
                ok = (at[row] >= 0) & (word >= t) & (word < t + WORDS)
                x = np.zeros((len(rows), min(WORDS, int(word.max()) + 1 - t)), np.float32)
                x[at[row[ok]], word[ok] - t] = 1
                m.append(x)
            common += m[0] @ m[1].T
        union = size[part][:, None] + size[new][None] - common.astype(np.float64)
        alike = np.where(union == 0, 1.0, common / np.maximum(union, 1))
        best.append(alike.argmax(axis=1))  # the first of equals
        score.append(alike.max(axis=1))
    return old, new[np.concatenate(best)], np.concatenate(score)


def align_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fates by the best word-set similarity within a document, where spans cannot be compared.

    The chunks of a document come together once and are compared there; pairs of chunks are no rows.
    """
    packed = packed_words(F.col("text"), terms)
    side = lambda df, n, start: df.select("doc_id", F.lit(n).alias("side"), "chunk_id", start.cast("bigint").alias("ns"), *packed)
    both = side(old, 0, F.lit(None)).unionByName(side(new, 1, F.col("span_start"))).repartition("doc_id").sortWithinPartitions("doc_id")

    def compare(doc: pa.Table) -> pa.RecordBatch:
        doc = doc.combine_chunks().to_batches()[0]
        n, texts, tokens = doc.num_rows, doc.column(4), doc.column(5)
        known = (pc.or_(texts.is_valid(), tokens.is_valid())).to_numpy(zero_copy_only=False) & doc.column(0).is_valid().to_numpy(zero_copy_only=False)
        _, words, row = words_of(texts, tokens)
        ok = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        code = words.dictionary_encode()
        row, word = np.divmod(np.unique(row[ok] * (len(code.dictionary) + 1) + code.indices.to_numpy()[ok]), len(code.dictionary) + 1)
        order = np.empty(n, np.int64)  # place of a chunk by its start and id
        places = pc.sort_indices(pa.table({"ns": doc.column(3), "id": doc.column(2)}), sort_keys=[("ns", "ascending"), ("id", "ascending")], null_placement="at_start")
        order[places.to_numpy()] = np.arange(n)
        side = doc.column(1).to_numpy()
        mine, theirs, score = _nearest(side, known, row, word, order)
        every = np.flatnonzero(side == 0)
        to, s = np.full(n, -1), np.full(n, np.nan)
        to[mine], s[mine] = theirs, score
        at = pa.array(to[every], mask=to[every] < 0)
        return pa.RecordBatch.from_arrays([doc.column(2).take(pa.array(every)), doc.column(2).take(at), doc.column(3).take(at), pa.array(s[every], mask=to[every] < 0)], ["chunk_id", "new_id", "ns", "s"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            edge = [0, *pc.run_end_encode(b.column(0)).run_ends.to_pylist()]
            for k, (s, e) in enumerate(zip(edge, edge[1:])):
                if held and (k or held[0].column(0)[0] != b.column(0)[0]):
                    yield compare(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield compare(pa.Table.from_batches(held))

    kind = old.schema["chunk_id"].dataType.simpleString()
    met = both.mapInArrow(meet, f"chunk_id {kind}, new_id {kind}, ns bigint, s double")
    # the first in order of place among the best; nothing in common is no match
    best = met.groupBy("chunk_id").agg(F.min(F.when(F.col("s") > 0, F.struct(F.negative("s").alias("o"), "ns", "new_id", "s"))).alias("b"))
    score = F.coalesce("b.s", F.lit(0.0))
    fate = F.when(score < FUZZY, "dropped").when(score >= INTACT, "intact").otherwise("boundary-shifted")
    return best.select("chunk_id", fate.alias("fate"), score.alias("score"), F.when(score < FUZZY, F.array().cast("array<string>")).otherwise(F.array("b.new_id")).alias("descendants"))


def fate_counts(alignment: DataFrame) -> DataFrame:
    return alignment.groupBy("fate").agg(F.count("*").alias("n"))


def score_gaps(final: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query_id, gap): the signed score distance of the target from place k, places clamped to the list; NULL without target."""
    lists = final.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    at = lambda p: F.element_at("scores", F.greatest(F.lit(1), F.least(p, F.size("scores"))).cast("int"))
    return lists.join(targets, "query_id", "left").select("query_id", F.when(F.col("target_rank").isNotNull(), at(F.col("target_rank")) - at(F.lit(k))).alias("gap"))


def classify(before: DataFrame, after: DataFrame, before_final: DataFrame, after_final: DataFrame, after_targets: DataFrame, metric: str = "recall@5", epsilon: float = 0.0) -> DataFrame:
    """(query_id, before, after, delta, class, stability); before and after are (query_id, metric, value)."""
    from driftglass.operators.metrics import metric_deltas, metric_k

    k = metric_k(metric)
    tops = lambda f, n: f.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias(n))
    rows = metric_deltas(before, after, "query_id").where(F.col("metric") == metric)
    rows = rows.join(tops(before_final, "ta"), "query_id", "left").join(tops(after_final, "tb"), "query_id", "left").join(score_gaps(after_final, after_targets, k), "query_id", "left")
    kind = F.when(F.col("delta") < 0, "regressed").when(F.col("delta") > 0, "improved").when(~F.col("ta").eqNullSafe(F.col("tb")), "changed-top-k").otherwise("unchanged")
    unstable = F.coalesce(F.abs("gap") < epsilon, F.lit(False))  # no target is a clear drop, never a near tie
    return rows.select("query_id", "before", "after", "delta", kind.alias("class"), F.when(unstable, "unstable").otherwise("stable").alias("stability"))
