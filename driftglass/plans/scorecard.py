"""Acceptance figures of attribution over scenarios whose cause is known."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.operators import align, attribution, golden
from driftglass.plans import pipeline as pl
from driftglass.plans import report, workflows
from driftglass.sources import scan

#: Each figure's bound, and whether it is a floor.
BOUNDS = (("fidelity", 0.995, True), ("stage_accuracy", 0.80, True), ("coverage", 0.70, True), ("narrative_violations", 0, False), ("noise_floor", 0.02, False))


@dataclass
class Scores:
    fidelity: float
    stage_accuracy: float
    coverage: float
    narrative_violations: int
    noise_floor: float
    regressed: int = 0

    def failures(self) -> list[str]:
        return [f"{n} is {getattr(self, n):.4g}, the bound is {b}" for n, b, floor in BOUNDS if (getattr(self, n) < b if floor else getattr(self, n) > b)]

    def passes(self) -> bool:
        return not self.failures()

    def to_dict(self) -> dict:
        return asdict(self) | {"passed": self.passes()}


def noise(reruns: DataFrame, n_cases: int) -> DataFrame:
    """One row (noise): the worst rerun's share of stable regressions; reruns (run, class, stability, …) of an unchanged snapshot."""
    rows = reruns.groupBy("run").agg(F.count_if((F.col("class") == "regressed") & (F.col("stability") == "stable")).alias("n"))
    return rows.agg((F.coalesce(F.max("n"), F.lit(0)) / F.lit(max(n_cases, 1))).alias("noise"))


def noise_rate(reruns: DataFrame, n_cases: int) -> float:
    return float(noise(reruns, n_cases).first().noise)


def reruns(project, s: pl.Snapshot, cases: DataFrame, runs: int = 2, metric: str = "recall@5", adapter=None) -> DataFrame:
    """Classes of an unchanged snapshot's further runs against its first; an adapter serves them where given."""
    first = workflows.evaluate(project, s, cases, adapter=adapter)
    out = None
    for i in range(1, runs + 1):
        if adapter is not None and adapter.capabilities().supports_rebuild:
            adapter.rebuild(pl.collection_name(s.root, s.pipeline), i)
        ev = workflows.evaluate(project, s, cases, adapter=adapter)
        rows = align.classify(first.per_query, ev.per_query, first.final(), ev.final(), ev.targets, metric, 0.0).select("query_id", "class", "stability", F.lit(i).alias("run"))
        out = rows if out is None else out.unionByName(rows)
    return out


def score_scenario(project, diff: workflows.Diff, cases: DataFrame, cause: str, metric: str = "recall@5", top_k: int = 5, runs: int = 1) -> Scores:
    """Figures of one diff whose only true cause is known; arms and snapshots are run again for fidelity and noise."""
    funnels, causes = workflows.attribute(project, diff, cases, metric=metric, top_k=top_k)
    found = [r.asDict() for r in causes.collect()]
    stable = diff.queries.where("class = 'regressed' and stability = 'stable'")
    regressed = stable.select("query_id", F.col("before").alias("before_value")).join(diff.before.targets.select("query_id", F.col("target_rank").alias("before_rank")), "query_id", "left")
    verified_arms = {c["arm_id"] for c in found if c["status"] == "verified"}
    arms = [a for a in attribution.build_arms(sorted(diff.config)) if ids.arm_key(a) in verified_arms]
    fidelity = 1.0
    if arms:
        again = workflows.run_arms(project, diff.before.snapshot, diff.after.snapshot, cases, arms, metric)
        fidelity = float(attribution.fidelity(causes, regressed, again, top_k=top_k).first().fidelity)
    asked = {r.query_id for r in stable.select("query_id").collect()}
    verified = {c["query_id"] for c in found if c["status"] == "verified" and c["factor"] == cause}
    rows = [f.asDict() for f in funnels.collect() if f.query_id in asked]
    right = [cause in attribution.STAGE_FACTORS[f["stage"]] for f in rows]
    fates = {r.chunk_id: r.asDict() for r in diff.alignment.collect()}
    bad = 0
    for f in rows:
        mine, fate = [c for c in found if c["query_id"] == f["query_id"]], fates.get(f["tracer"])
        bad += len(report.audit(report.narrative(f, fate, mine), f, fate, mine))
    floor = noise_rate(reruns(project, diff.after.snapshot, cases, runs, metric), cases.count())
    return Scores(fidelity, sum(right) / len(right) if right else 1.0, len(verified & asked) / len(asked) if asked else 1.0, bad, floor, len(asked))


_HEAD = "The {0} service handles every {1} request before the {2} review closes. "
_TOPICS = [(f"topic{i}", f"signal{i}", f"audit{i}") for i in range(12)]


def _corpus() -> dict[str, str]:
    """Documents with two sections each, whose second names what a question asks for."""
    out = {}
    for i, (a, b, c) in enumerate(_TOPICS):
        body = "".join(_HEAD.format(a, b, c) + f"Step {k} of {a} keeps {b} in order while the team of {c} waits. " for k in range(3))
        out[f"area{i % 3}/{a}.md"] = f"# Guide to {a}\n\n{body}\n\n## Limits of {b}\n\nThe limit of {b} under {a} is {i + 7} units, and {c} confirms the {b} limit each quarter.\n"
    return out


def _documents(spark, corpus: dict[str, str]) -> DataFrame:
    return scan.table(spark.createDataFrame(sorted(corpus.items()), "source_path string, text string"))


def _questions(spark) -> DataFrame:
    rows = [(f"q_{i:03d}", f"what is the limit of {b} under {a} that {c} confirms", [f"area{i % 3}/{a}.md"], [f"area{i % 3}"], "generated", None) for i, (a, b, c) in enumerate(_TOPICS)]
    return spark.createDataFrame(rows, golden.CASE)


def _crowd(corpus: dict[str, str]) -> dict[str, str]:
    """The corpus with documents that repeat what the questions of the first topics ask."""
    return corpus | {f"zcopy/{a}-{k}.md": f"What is the limit of {b} under {a} that {c} confirms? The limit of {b} under {a} that {c} confirms, draft {k}.\n" for a, b, c in _TOPICS[:6] for k in range(6)}


_BASE = {"chunker": {"tool": "markdown_heading", "params": {"max_tokens": 60, "overlap": 0}}, "retrieve": {"top_k": 10, "hybrid": {"bm25_weight": 0.6}}}
#: Cause, the configuration after the change, and whether distractors join the corpus.
SCENARIOS = {
    "chunker": ("chunk", _BASE | {"chunker": {"tool": "fixed_token", "params": {"max_tokens": 2, "overlap": 0}}}, False),
    "embedding": ("embed", _BASE | {"embedding": {"dims": 2}, "retrieve": {"top_k": 10, "hybrid": {"bm25_weight": 0.05}}}, False),
    "weights": ("retrieve", _BASE | {"retrieve": {"top_k": 10, "hybrid": {"bm25_weight": 0.0}}}, False),
    "corpus": ("corpus", _BASE, True),
}


def run_scenarios(project, names=tuple(SCENARIOS), metric: str = "recall@1") -> dict[str, Scores]:
    """Each scenario changes one thing of the same corpus; scores per scenario."""
    spark, cases = project.spark, _questions(project.spark)
    out = {}
    for name in names:
        cause, after, crowded = SCENARIOS[name]
        before = _BASE | ({"embedding": {"dims": 256}, "retrieve": after["retrieve"]} if cause == "embed" else {})
        a = workflows.ingest(project, _documents(spark, _corpus()), pl.build(before)).snapshot
        b = workflows.ingest(project, _documents(spark, _crowd(_corpus()) if crowded else _corpus()), pl.build(after)).snapshot
        d = workflows.diff(project, workflows.evaluate(project, a, cases), workflows.evaluate(project, b, cases), f"scenario-{name}", metric)
        out[name] = score_scenario(project, d, cases, cause, metric, top_k=1)
    return out


def overall(scores: dict[str, Scores]) -> Scores:
    """Means weighted by regressed queries; violations add up and noise is the worst."""
    n = sum(s.regressed for s in scores.values())
    mean = lambda f: sum(getattr(s, f) * s.regressed for s in scores.values()) / n if n else 1.0
    return Scores(mean("fidelity"), mean("stage_accuracy"), mean("coverage"), sum(s.narrative_violations for s in scores.values()), max((s.noise_floor for s in scores.values()), default=0.0), n)
