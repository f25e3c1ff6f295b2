"""Scores of ranked lists against expected sources, all queries and all k in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 5, 10)


def metric_names(k_values=K_VALUES) -> list[str]:
    return [f"{m}@{k}" for k in k_values for m in ("recall", "hit_rate", "ndcg")] + ["mrr"]


def metric_k(metric: str) -> int:
    suffix = metric.partition("@")[2]
    return int(suffix) if suffix.isdigit() else 10


def chunk_paths(sources: DataFrame) -> DataFrame:
    """(chunk_id, paths): the distinct source paths of each chunk, sorted."""
    return sources.groupBy("chunk_id").agg(F.sort_array(F.collect_set("source")).alias("paths"))


def document_ranks(final: DataFrame, sources: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(query_id, source, doc_rank): documents by first appearance.

    sources maps chunk_id to source paths; of several paths an expected one is preferred, else the first.
    """
    # only the chunks that some list has: candidates are few beside the corpus
    paths = chunk_paths(sources.join(final.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    rows = final.select("query_id", "chunk_id", "rank").join(paths, "chunk_id")
    if expected is None:
        rows = rows.withColumn("source", F.col("paths")[0])
    else:
        want = expected.groupBy("query_id").agg(F.collect_set("source").alias("want"))
        rows = rows.join(want, "query_id", "left")
        matched = F.filter("paths", lambda p: F.array_contains("want", p))
        rows = rows.withColumn("source", F.when(F.size(matched) > 0, F.try_element_at(matched, F.lit(1))).otherwise(F.col("paths")[0]))
    first = rows.groupBy("query_id", "source").agg(F.min("rank").alias("at"))
    return first.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "source")).alias("doc_rank"))


def target_ranks(final: DataFrame, sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, target_rank): the best chunk of an expected document."""
    wanted = sources.join(expected, "source").select("query_id", "chunk_id").distinct()
    return final.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("target_rank"))


def evaluate_lists(queries: DataFrame, ranked: DataFrame, expected: DataFrame, k_values=K_VALUES) -> DataFrame:
    """(query_id, metric, value) from document ranks (query_id, source, doc_rank) and expected (query_id, source).

    A query that expects nothing scores 0; a query without results too.
    """
    want = expected.distinct()
    size = want.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    hits = ranked.join(want, ["query_id", "source"]).select("query_id", "doc_rank")
    gain = F.lit(1.0) / F.log2(F.col("doc_rank").cast("double") + 1)
    sums = [F.min("doc_rank").alias("first")]
    for k in k_values:
        inside = F.col("doc_rank") <= k
        sums += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"g{k}")]
    rows = queries.select("query_id").distinct().join(size, "query_id", "left").join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    n = F.coalesce("n_expected", F.lit(0))
    values = []
    for k in k_values:
        found = F.coalesce(f"h{k}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i.cast("double") + 1))
        values += [
            (f"recall@{k}", F.when(n > 0, found / F.greatest(n, F.lit(1))).otherwise(0.0)),
            (f"hit_rate@{k}", F.when(found > 0, 1.0).otherwise(0.0)),
            (f"ndcg@{k}", F.when(n > 0, F.coalesce(f"g{k}", F.lit(0.0)) / ideal).otherwise(0.0)),
        ]
    values.append(("mrr", F.coalesce(1.0 / F.col("first"), F.lit(0.0))))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values))
    return rows.select("query_id", F.inline(pairs))


def aggregate_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("metric").agg(F.avg("value").alias("value"))


def metric_deltas(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, before, after, delta)."""
    on = [*keys, "metric"]
    return before.select(*on, F.col("value").alias("before")).join(after.select(*on, F.col("value").alias("after")), on).withColumn("delta", F.col("after") - F.col("before"))


def tag_deltas(deltas: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, metric, n, delta): per tag, and over all queries under a NULL tag, taken before tags multiply rows."""
    per_tag = deltas.join(tags, "query_id").groupBy("tag", "metric").agg(F.count("*").alias("n"), F.avg("delta").alias("delta"))
    overall = deltas.groupBy("metric").agg(F.count("*").alias("n"), F.avg("delta").alias("delta"))
    return per_tag.unionByName(overall.select(F.lit(None).cast("string").alias("tag"), "metric", "n", "delta"))


def stratify(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n"))
