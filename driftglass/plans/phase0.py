"""Is a served index stable enough to attribute regressions: calibration and divergence from exact search."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.plans import scorecard, workflows
from driftglass.plans.pipeline import Snapshot
from driftglass.sources.adapters import Adapter


def ann_effect(live: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, shared, displaced): the share of the exact first k that live serves among its first k, and how far its ranks are off on average.

    Both are (query_id, chunk_id, rank). A query that live has nothing for shares nothing.
    """
    want = exact.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("exact_rank"))
    got = live.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("live_rank"))
    met = want.join(got, ["query_id", "chunk_id"], "left")
    return met.groupBy("query_id").agg((F.count("live_rank") / F.count("*")).alias("shared"), F.coalesce(F.avg(F.abs(F.col("live_rank") - F.col("exact_rank")).cast("double")), F.lit(0.0)).alias("displaced"))


@dataclass
class Phase0:
    exact: float
    live: float
    epsilon: float
    flake_rate: float
    shared: float
    noise_floor: float

    def stable(self) -> bool:
        return self.noise_floor <= 0.02

    def to_dict(self) -> dict:
        return asdict(self) | {"stable": self.stable()}


def validate(project, s: Snapshot, cases: DataFrame, adapter: Adapter, runs: int = 3, metric: str = "recall@5", k: int = 10) -> Phase0:
    """Figures of one serving setting against exact replay of the same snapshot."""
    exact = workflows.evaluate(project, s, cases)
    live = workflows.evaluate(project, s, cases, adapter=adapter)
    record = workflows.calibrate(project, s, cases, adapter, runs, metric=metric)
    dense = lambda ev: ev.candidates.where("stage = 'dense'")
    shared = ann_effect(dense(live), dense(exact), k).agg(F.avg("shared")).first()[0]
    rates = list(record["per_query_flip_rate"].values())
    floor = scorecard.noise_rate(scorecard.reruns(project, s, cases, runs, metric, adapter), cases.count())
    return Phase0(exact.aggregate()[metric], live.aggregate()[metric], record["epsilon"], sum(rates) / len(rates) if rates else 0.0, float(shared or 0.0), floor)
