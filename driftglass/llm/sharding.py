"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; sorting all rows by fractional rank
(rank - 1/2) / n interleaves the sources in proportion, so that every stretch of the order, hence
every shard cut from it, matches the mixture to within one row per source.

Ranks are counted, not sorted, across the cluster: rows fall into many hash buckets per source,
bucket counts are summed up front, and only rows within one bucket are ordered. A hot source is
thus spread over as many tasks as any other. The global order is cut the same way.

Defined results: a NULL source is a source of its own and sorts first; a NULL doc_id hashes as an
empty string and sorts first among equals; repeated rows are ranked one after the other; other
columns (the text too) are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 64, 13
RANK_BUCKETS_BITS, ORDER_BUCKETS = 12, 65536


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, rank_in_source, position, shard) for every row; counts from 1, shards from 0."""
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")
    rows = docs.select("doc_id", "source").withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("h", shuffled)
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - RANK_BUCKETS_BITS))
    counts = rows.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("src")
    counts = counts.select("src", "bucket", F.sum("n").over(by_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"), F.sum("n").over(by_source).alias("total"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", F.asc_nulls_first("doc_id"))
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(counts, ["src", "bucket"])
    ranked = ranked.withColumn("rank_in_source", F.coalesce("ahead", F.lit(0)) + F.col("r"))
    ranked = ranked.withColumn("fraction", (2 * F.col("rank_in_source") - 1).cast("double") / (2 * F.col("total")).cast("double"))
    ranked = ranked.withColumn("slot", F.floor(F.col("fraction") * ORDER_BUCKETS)).select("doc_id", "source", "rank_in_source", "fraction", "slot")
    # the slots are a fixed number of rows, so one task may add them up
    slots = ranked.groupBy("slot").agg(F.count("*").alias("n"))
    slots = slots.select("slot", F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    within = Window.partitionBy("slot").orderBy("fraction", F.asc_nulls_first("source"), "rank_in_source")
    placed = ranked.withColumn("r", F.row_number().over(within)).join(slots, "slot")
    position = F.coalesce("before", F.lit(0)) + F.col("r")
    return placed.select("doc_id", "source", "rank_in_source", position.alias("position"), F.expr(f"((coalesce(before, 0) + r - 1) * {shards}) div rows").alias("shard"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id NULLS FIRST) AS rank_in_source,
    count(*) OVER (PARTITION BY source) AS total FROM documents),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank_in_source - 1)::DOUBLE / (2 * total)::DOUBLE, source NULLS FIRST, rank_in_source) AS position, count(*) OVER () AS n FROM ranked)
SELECT doc_id, source, rank_in_source, position, (position - 1) * {SHARDS} // n AS shard FROM placed
"""
