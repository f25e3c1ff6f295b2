"""Serving-noise calibration and the release gate."""

from __future__ import annotations

import operator
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.functions import stats
from driftglass.operators.metrics import metric_k

_RULE = re.compile(r"\s*([\w@]+)\s*(<=|>=|<|>)\s*(-?\d+(?:[.]\d+)?)\s*")
_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class NotCalibrated(Exception):
    """A statistical gate was asked for without a calibration."""


@dataclass
class Verdict:
    passed: bool
    mode: str
    reasons: list[str] = field(default_factory=list)
    significant_regression: bool = False
    unstable: list[str] = field(default_factory=list)
    details: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


def parse_rule(rule: str) -> tuple[str, str, float]:
    """A threshold like recall@5<0.85 as (metric, comparison, number)."""
    m = _RULE.fullmatch(rule or "")
    if not m:
        raise ValueError(f"cannot read the rule {rule!r}")
    return m[1], m[2], float(m[3])


def run_pairs(runs: DataFrame) -> DataFrame:
    """runs (run, query_id, gap, hit) met with themselves: each pair of runs of a query once."""
    a = runs.select("query_id", F.col("run").alias("i"), F.col("gap").alias("ga"), F.col("hit").alias("ha"))
    b = runs.select("query_id", F.col("run").alias("j"), F.col("gap").alias("gb"), F.col("hit").alias("hb"))
    return a.join(b, "query_id").where("i < j")


def epsilon(pairs: DataFrame) -> DataFrame:
    """One row (epsilon): the 95th percentile of how much gaps move between runs; 0 without pairs."""
    return pairs.agg(F.coalesce(F.percentile(F.abs(F.col("ga") - F.col("gb")), 0.95), F.lit(0.0)).alias("epsilon"))


def flip_rates(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, flip_rate): the share of run pairs that disagree on the hit."""
    rates = pairs.groupBy("query_id").agg(F.avg((~F.col("ha").eqNullSafe(F.col("hb"))).cast("double")).alias("flip_rate"))
    return queries.select("query_id").join(rates, "query_id", "left").select("query_id", F.coalesce("flip_rate", F.lit(0.0)).alias("flip_rate"))


def metric_noise(run_metrics: DataFrame) -> DataFrame:
    """(metric, std): population deviation over runs of (run, metric, value)."""
    return run_metrics.groupBy("metric").agg(F.stddev_pop("value").alias("std"))


def calibrate(run_evals: DataFrame, run_gaps: DataFrame, queries: DataFrame, metric: str = "recall@5") -> dict:
    """Noise record from runs: run_evals (run, query_id, metric, value), run_gaps (run, query_id, gap)."""
    hits = run_evals.where(F.col("metric") == f"hit_rate@{metric_k(metric)}").select("run", "query_id", (F.col("value") > 0).alias("hit"))
    pairs = run_pairs(hits.join(run_gaps, ["run", "query_id"], "left"))
    noise = metric_noise(run_evals.groupBy("run", "metric").agg(F.avg("value").alias("value")))
    return {
        "epsilon": epsilon(pairs).first()[0],
        "per_metric_std": {r.metric: r["std"] for r in noise.collect()},
        "per_query_flip_rate": {r.query_id: r.flip_rate for r in flip_rates(pairs, queries).collect()},
    }


def flips(classed: DataFrame) -> DataFrame:
    """One row (b, c) of hits lost and won; classed has hit_before and hit_after."""
    return classed.agg(F.count_if(F.col("hit_before") & ~F.col("hit_after")).alias("b"), F.count_if(~F.col("hit_before") & F.col("hit_after")).alias("c"))


def tag_flips(classed: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, b, c, p, rejected) over stable queries, corrected as one family."""
    counted = classed.where("stability = 'stable'").join(tags, "query_id").groupBy("tag")
    counted = counted.agg(F.count_if(F.col("hit_before") & ~F.col("hit_after")).alias("b"), F.count_if(~F.col("hit_before") & F.col("hit_after")).alias("c"))
    return stats.false_discovery_table(counted.withColumn("p", stats.mcnemar_col(F.col("b"), F.col("c"))), "tag")


def threshold_gate(after: DataFrame, rule: str) -> Verdict:
    """Fails where the mean of the metric over (query_id, metric, value) meets the rule."""
    metric, compare, limit = parse_rule(rule)
    value = after.where(F.col("metric") == metric).agg(F.coalesce(F.avg("value"), F.lit(0.0))).first()[0]
    met = _COMPARE[compare](value, limit)
    reasons = [f"{metric} is {value:.4f}, which is {compare} {limit}"] if met else []
    return Verdict(not met, "raw", reasons, met, [], {"metric": metric, "op": compare, "threshold": limit, "after_value": value, "condition_met": met})


def statistical_gate(classed: DataFrame, calibration: dict | None, tags: DataFrame | None = None, metric: str = "recall@5", q: float = 0.05, seed: int = 0) -> Verdict:
    """The verdict over classed (query_id, delta, hit_before, hit_after, stability).

    Near ties feed no signal. The gate fails where the interval of the mean delta lies below zero, or
    where more hits were lost than won with a significant exact test, overall or in a tag.
    """
    if calibration is None:
        raise NotCalibrated("calibrate the snapshot before gating on statistics")
    rows = classed.select("query_id", "delta", "hit_before", "hit_after", "stability").orderBy("query_id").collect()  # a golden set, not a corpus
    stable = [r for r in rows if r.stability == "stable"]
    low, high = stats.bootstrap_interval([r.delta for r in stable], seed=seed)
    b = sum(r.hit_before and not r.hit_after for r in stable)
    c = sum(r.hit_after and not r.hit_before for r in stable)
    tests = [("overall", stats.mcnemar(b, c), b, c)]
    rejected = [tests[0][1] <= q]
    if tags is not None:
        per_tag = [(r.tag, stats.mcnemar(r.b, r.c), r.b, r.c) for r in tag_flips(classed, tags).orderBy("tag").collect()]
        tests += per_tag
        rejected += stats.false_discovery([p for _, p, _, _ in per_tag], q)
    worse = [(t, x) for t, x in zip(tests, rejected, strict=True) if x and t[2] > t[3]]
    reasons = []
    if high < 0:
        reasons.append(f"{metric} fell on stable queries: the interval ends at {high:.4f}, over {len(stable)} queries")
    reasons += [f"hits were lost {'overall' if n == 0 else f'under {name}'}: {lost} lost, {won} won, p={p:.4f}" for n, (name, p, lost, won) in ((0 if t[0] == "overall" else 1, t) for t, _ in worse)]
    unstable = sorted(str(r.query_id) for r in rows if r.stability == "unstable")
    details = {"ci": [low, high], "p_overall": tests[0][1], "b": b, "c": c, "per_tag": {t[0]: t[1] for t in tests[1:]}, "rejected": {t[0]: x for t, x in zip(tests, rejected, strict=True)}, "n_stable": len(stable), "n_unstable": len(unstable)}
    return Verdict(not reasons, "statistical", reasons, high < 0, unstable, details)
