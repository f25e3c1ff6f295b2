"""Incremental trace mining: an extension, as content-keyed appends are safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.sources.project import Project


def mine_stream(traces: DataFrame, project: Project, dataset_id: str, checkpoint: str):
    """Appends user questions of a stream (query, expected_sources, trace_id) to a dataset; a replayed batch adds nothing."""

    def store(batch: DataFrame, _: int) -> None:
        empty = F.array().cast("array<string>")
        rows = batch.select(F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws(ids.SEPARATOR, "trace_id", "query"), 256), 1, 16)).alias("id"), F.col("query").alias("question"), F.coalesce("expected_sources", empty).alias("expected_sources"), empty.alias("tags"), F.lit("production").alias("origin"), F.col("trace_id").alias("source_trace")).dropDuplicates(["id"])
        known = project.read("cases").where(F.col("dataset_id") == dataset_id).select("id")
        project.append("cases", rows.join(known, "id", "left_anti").withColumn("dataset_id", F.lit(dataset_id)))

    return traces.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
