"""Where a regressed query lost its target, and which single revert brings it back."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass import ids

STAGE_FACTORS = {
    "index": ("chunk", "corpus", "embed", "index", "parse"),
    "dense": ("chunk", "corpus", "embed", "index", "parse"),
    "sparse": ("chunk", "corpus", "parse"),
    "fused": ("chunk", "corpus", "embed", "parse", "retrieve"),
    "rerank": ("chunk", "corpus", "rerank"),
    "ann": ("index",),
}
STAGE_ORDER = ("parse", "chunk", "embed", "index", "retrieve", "rerank")
PAIRS = (("embed", "chunk"), ("retrieve", "chunk"))
FAR, DRIFT = 10**9, 2


def tracers(final: DataFrame, sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, tracer): the best-ranked chunk of an expected document before the change."""
    wanted = sources.join(expected, "source").select("query_id", "chunk_id").distinct()
    return final.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("tracer"))


def descendants(found: DataFrame, alignment: DataFrame) -> DataFrame:
    """(query_id, tracer, fate, resolved, chunk_id): all descendants of a split tracer, the first of any other, itself without any."""
    rows = found.join(alignment.select(F.col("chunk_id").alias("tracer"), "fate", "descendants"), "tracer", "left")
    none = F.col("descendants").isNull() | (F.size("descendants") == 0)
    rows = rows.withColumn("resolved", F.when(none, F.col("tracer")).otherwise(F.try_element_at("descendants", F.lit(1))))
    follow = F.when((F.col("fate") == "split") & ~none, F.col("descendants")).otherwise(F.array("resolved"))
    return rows.select("query_id", "tracer", "fate", "resolved", F.explode(follow).alias("chunk_id"))


def best_ranks(candidates: DataFrame, wanted: DataFrame, suffix: str, stages=("dense", "sparse", "fused", "reranked")) -> DataFrame:
    """(query_id, <stage>_<suffix>): the best rank of any wanted chunk per stage, NULL where none appears."""
    met = candidates.join(wanted.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
    return met.groupBy("query_id").agg(*(F.min(F.when(F.col("stage") == s, F.col("rank"))).alias(f"{s}_{suffix}") for s in stages))


def funnel(before: DataFrame, after: DataFrame, found: DataFrame, alignment: DataFrame, chunks_after: DataFrame, shadow: DataFrame | None = None, live_dense: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """One row per traced query with its ranks before and after in every stage.

    before and after are candidate tables with stages; shadow holds exact dense ranks without a depth
    limit, live_dense the served ones.
    """
    down = descendants(found, alignment)
    rows = down.select("query_id", "tracer", "fate", "resolved").distinct()
    rows = rows.join(chunks_after.select(F.col("chunk_id").alias("resolved"), F.lit(True).alias("in_index")).distinct(), "resolved", "left")
    rows = rows.join(best_ranks(before, found.select("query_id", F.col("tracer").alias("chunk_id")), "before"), "query_id", "left").join(best_ranks(after, down, "after"), "query_id", "left")
    rows = rows.join(best_ranks(shadow.withColumn("stage", F.lit("shadow")), down, "after", ("shadow",)), "query_id", "left") if shadow is not None else rows.withColumn("shadow_after", F.lit(None).cast("int"))
    rows = rows.withColumn("in_index", F.coalesce("in_index", F.lit(False))).withColumn("in_candidates", F.coalesce(F.col("fused_after") <= top_k, F.lit(False)))
    if live_dense is None:
        return rows.withColumn("ann", F.lit(False))
    size = live_dense.groupBy("query_id").agg(F.count("*").alias("served"))
    live = rows.join(best_ranks(live_dense.withColumn("stage", F.lit("live")), down, "after", ("live",)), "query_id", "left").join(size, "query_id", "left")
    far = F.when(F.col("live_after").isNull(), F.col("shadow_after") <= F.coalesce("served", F.lit(0))).otherwise(F.abs(F.col("live_after") - F.col("shadow_after")) > DRIFT)
    return live.withColumn("ann", F.coalesce(far, F.lit(False))).drop("served")


def failing_stage(top_k: int) -> Column:
    """The first stage where the target left the top, else the stage that degraded most."""
    inside = lambda c: F.coalesce(F.col(c) <= top_k, F.lit(False))
    lost = lambda s: inside(f"{s}_before") & ~inside(f"{s}_after")
    worse = lambda s: F.coalesce(F.col(f"{s}_after"), F.lit(FAR)) - F.coalesce(F.col(f"{s}_before"), F.lit(FAR))
    crossed = inside("fused_before") & (~F.col("in_candidates") | (F.col("reranked_after") > top_k))
    most = F.greatest(*(worse(s) for s in ("dense", "sparse", "fused")))
    return (
        F.when(~F.col("in_index"), "index").when(lost("dense"), "dense").when(lost("sparse"), "sparse").when(lost("fused"), "fused")
        .when(F.coalesce(crossed, F.lit(False)), "rerank").when(F.col("ann") & inside("shadow_after"), "ann")
        .when(worse("dense") == most, "dense").when(worse("sparse") == most, "sparse").otherwise("fused")
    )


def implicated(stages: DataFrame, changed: list[str]) -> DataFrame:
    """stages (…, stage) joined with the changed factors that can explain the stage."""
    rows = [(s, f) for s, fs in STAGE_FACTORS.items() for f in fs if f in set(changed)]
    table = stages.sparkSession.createDataFrame(rows, "stage string, factor string")
    return stages.join(F.broadcast(table), "stage")


# -- counterfactual arms -----------------------------------------------------------------------


def build_arms(factors: list[str], mode: str = "auto", only: list[str] | None = None) -> list[dict[str, str]]:
    """Assignments factor -> A or B: the whole lattice for three factors or fewer, else one at a time and known pairs."""
    names = sorted(factors)
    free = [f for f in names if only is None or f in only]
    base = dict.fromkeys(names, "B")
    at_a = lambda chosen: base | dict.fromkeys(chosen, "A")
    if mode == "full" or len(names) <= 3:
        made = [at_a(c) for n in range(len(free) + 1) for c in combinations(free, n)]
    else:
        made = [base, *(at_a([f]) for f in free), *(at_a(p) for p in PAIRS if set(p) <= set(free)), at_a(free)]
    return list({ids.arm_key(a): a for a in made}.values())


def arm_table(spark, arms: list[dict[str, str]]) -> DataFrame:
    return spark.createDataFrame([(ids.arm_key(a), f, s) for a in arms for f, s in sorted(a.items())], "arm_id string, factor string, side string")


def single_reverts(arms: DataFrame) -> DataFrame:
    """(arm_id, factor) of the arms in which one factor alone is at A."""
    return arms.groupBy("arm_id").agg(F.count_if(F.col("side") == "A").alias("n"), F.max(F.when(F.col("side") == "A", F.col("factor"))).alias("factor")).where("n = 1").select("arm_id", "factor")


def confirm(regressed: DataFrame, arm_evals: DataFrame, reverts: DataFrame, suspects: DataFrame, rule: str = "rank1", top_k: int = 5) -> DataFrame:
    """(query_id, factor, status, arm_id, recovered_rank).

    regressed (query_id, before_rank, before_value); arm_evals (arm_id, query_id, target_rank, value);
    suspects (query_id, factor) from the funnel. A cause is verified where the arm reverting it alone
    brings the rank back and the metric to no less than before; other suspects stay hypotheses.
    """
    if rule not in ("rank1", "topk"):
        raise ValueError(f"recovery rule {rule!r} is unknown")
    rows = regressed.join(arm_evals, "query_id").join(F.broadcast(reverts), "arm_id")
    bound = F.lit(top_k) if rule == "topk" else F.coalesce(F.col("before_rank") + 1, F.lit(top_k))
    back = (F.col("target_rank") <= bound) & F.coalesce(F.col("value") >= F.col("before_value"), F.lit(True))
    verified = rows.where(back).select("query_id", "factor", F.lit("verified").alias("status"), "arm_id", F.col("target_rank").alias("recovered_rank"))
    open_ = suspects.join(regressed, "query_id", "left_semi").join(verified, ["query_id", "factor"], "left_anti").distinct()
    return verified.unionByName(open_.select("query_id", "factor", F.lit("hypothesis").alias("status"), F.lit(None).cast("string").alias("arm_id"), F.lit(None).cast("int").alias("recovered_rank")))


def fidelity(causes: DataFrame, regressed: DataFrame, arm_evals: DataFrame, rule: str = "rank1", top_k: int = 5) -> DataFrame:
    """One row (fidelity): the share of verified causes that their arm supports when looked up again; 1 without causes."""
    rows = causes.where("status = 'verified'").join(regressed, "query_id").join(arm_evals, ["arm_id", "query_id"], "left")
    bound = F.lit(top_k) if rule == "topk" else F.coalesce(F.col("before_rank") + 1, F.lit(top_k))
    ok = F.coalesce((F.col("target_rank") <= bound) & F.coalesce(F.col("value") >= F.col("before_value"), F.lit(True)), F.lit(False))
    return rows.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("fidelity"))


def shapley(players: list[str], value: Callable[[frozenset], float]) -> dict[str, float]:
    """Exact Shapley values over all coalitions."""
    n = len(players)
    out = {}
    for p in players:
        rest = [q for q in players if q != p]
        out[p] = sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (value(frozenset(s) | {p}) - value(frozenset(s))) for k in range(n) for s in combinations(rest, k))
    return out


def shapley_table(lattice: DataFrame, n: int) -> DataFrame:
    """(player, value) from a lattice (mask, v) with bit p set where player p takes part."""
    a, b = lattice.select(F.col("mask").alias("m"), F.col("v").alias("low")), lattice.select(F.col("mask").alias("mw"), F.col("v").alias("high"))
    players = lattice.sparkSession.range(n).select(F.col("id").cast("int").alias("player"))
    bit = F.expr("shiftleft(1, player)")
    rows = a.crossJoin(F.broadcast(players)).where(F.expr("(m & shiftleft(1, player)) = 0")).join(b, F.col("mw") == F.col("m") + bit)
    size = F.bit_count("m")
    weight = F.factorial(size).cast("double") * F.factorial(F.lit(n - 1) - size).cast("double") / float(factorial(n))
    return rows.groupBy("player").agg(F.sum(weight * (F.col("high") - F.col("low"))).alias("value"))
