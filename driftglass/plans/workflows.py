"""Composed work: ingest, evaluate, diff, attribute, calibrate, gate, compare, sweep, drift."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.functions import text
from driftglass.functions.providers import RemoteEmbedder
from driftglass.functions.vectors import HashEmbedder, to_half
from driftglass.operators import align, attribution, gating, metrics, retrieve
from driftglass.plans import pipeline as pl
from driftglass.plans.pipeline import Pipeline, Snapshot
from driftglass.sources.adapters import Adapter
from driftglass.sources.project import Project


class CostRefused(Exception):
    """A billed step would cost more than was allowed."""


def provider_of(stage: pl.Stage) -> HashEmbedder | RemoteEmbedder:
    p = stage.params
    if p["provider"] != "local":
        return RemoteEmbedder(p["provider"], p["model"], p["dims"])
    return HashEmbedder(p["dims"], p.get("seed", 0), tuple(p.get("ngram", (1, 2))), p["model"])


def model_key(e) -> str:
    return f"{e.provider}_{e.model}_{e.dims}_{ids.params_key(e.params)}"


def keyed(chunks: DataFrame, e) -> DataFrame:
    return chunks.withColumn("key", ids.vector_key_col(F.col("text_hash"), e.provider, e.model, e.dims, ids.params_key(e.params)))


@dataclass
class Ingested:
    snapshot: Snapshot
    embed_calls: int
    new_chunks: int
    reused_chunks: int


def ensure_chunks(project: Project, docs: DataFrame, root: str, p: Pipeline) -> tuple[str, int]:
    """The chunk set of docs (doc_id, text) under p: its key and the number of chunks written now."""
    chunk = p.stage("chunk")
    key = pl.chunkset_key(root, p.stage("parse"), chunk)
    if project.has_chunks(key):
        return key, 0
    made = text.chunk(docs.dropDuplicates(["doc_id"]), chunk.tool, chunk.params)
    project.append("chunks", made.withColumn("chunkset_key", F.lit(key)))
    return key, project.chunks(key).count() if project.has_chunks(key) else 0


def ensure_vectors(project: Project, chunks: DataFrame, e: HashEmbedder) -> int:
    """Embeds what is missing, each text once; the number of texts embedded."""
    stored = project.read("embeddings").where(F.col("model_key") == model_key(e))
    missing = keyed(chunks, e).groupBy("key").agg(F.first("text").alias("text")).join(stored.select("key"), "key", "left_anti")
    before = stored.count()
    project.append("embeddings", missing.select(F.lit(model_key(e)).alias("model_key"), "key", F.lit(e.dims).alias("dims"), to_half(e.column(F.col("text"))).alias("vector")))
    return project.read("embeddings").where(F.col("model_key") == model_key(e)).count() - before


def ingest(project: Project, scanned: DataFrame, p: Pipeline, adapter: Adapter | None = None, parent: str | None = None) -> Ingested:
    """A snapshot of scanned (source_path, doc_id, raw); an identical one costs no embedding."""
    p.validate()
    parse = p.stage("parse")
    docs = scanned.select("doc_id", "source_path", F.lit(pl.parse_key(parse)).alias("parse_ph"), text.parse(F.col("raw"), parse.tool).alias("parsed_text"))
    project.add_documents(docs)
    root = scanned.agg(ids.corpus_root_col(F.col("source_path"), F.col("doc_id"))).first()[0]
    project.record_corpus(root, scanned.select("source_path", "doc_id"))
    return _snapshot(project, root, p, adapter, parent)


def _snapshot(project: Project, root: str, p: Pipeline, adapter: Adapter | None = None, parent: str | None = None) -> Ingested:
    docs = project.documents_of(root, pl.parse_key(p.stage("parse")))
    key, new = ensure_chunks(project, docs.select("doc_id", F.col("parsed_text").alias("text")), root, p)
    e = provider_of(p.stage("embed"))
    chunks = project.chunks(key) if project.has_chunks(key) else project.read("chunks").limit(0)
    n = chunks.count()
    calls = ensure_vectors(project, chunks, e)
    s = Snapshot(p, docs.count(), n, root, {"chunks_uri": f"chunks/{key}", "embeddings_uri": f"embeddings/{model_key(e)}"}, parent)
    if adapter is not None:
        name = pl.collection_name(root, p)
        adapter.ensure(name, e.dims)
        payload = docs.groupBy("doc_id").agg(F.min("source_path").alias("source_path"))
        rows = project.vectors(keyed(chunks, e), model_key(e)).join(payload, "doc_id")
        adapter.upsert(name, rows.select(F.col("chunk_id").alias("id"), "vector", F.to_json(F.struct("doc_id", "source_path", "ordinal")).alias("payload"), F.lit(0).alias("pos")))
    return Ingested(project.commit(s), calls, new, n - new)


@dataclass
class Evaluation:
    snapshot: Snapshot
    candidates: DataFrame
    per_query: DataFrame
    targets: DataFrame
    sources: DataFrame

    def final(self) -> DataFrame:
        return self.candidates.where("stage = 'final'")

    def aggregate(self) -> dict[str, float]:
        return {r.metric: r.value for r in metrics.aggregate_metrics(self.per_query).collect()}


RERANKERS = ("overlap",)


def question_vectors(project: Project, queries: DataFrame, e) -> DataFrame:
    """(query_id, vector) of queries (query_id, text), each distinct text embedded once per model and kept in the project."""
    key = ids.vector_key_col(F.sha2("text", 256), e.provider, e.model, e.dims, ids.params_key(e.params))
    asked = queries.withColumn("key", key)
    stored = project.read("query_embeddings").select("key")
    new = asked.groupBy("key").agg(F.first("text").alias("text")).join(stored, "key", "left_anti")
    if new.head(1):
        project.append("query_embeddings", new.select("key", F.lit(e.dims).alias("dims"), e.column(F.col("text")).alias("vector")))
    vectors = project.read("query_embeddings").groupBy("key").agg(F.first("vector").alias("vector"))
    return asked.join(vectors, "key").select("query_id", "vector")


def expected_sources(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("id").alias("query_id"), F.explode("expected_sources").alias("source"))


def snapshot_chunks(project: Project, s: Snapshot) -> DataFrame:
    key = s.artifacts["chunks_uri"].rpartition("/")[2]
    return project.chunks(key) if project.has_chunks(key) else project.read("chunks").limit(0)


def evaluate(project: Project, s: Snapshot, cases: DataFrame, k_values=metrics.K_VALUES, adapter: Adapter | None = None, digits: int | None = None) -> Evaluation:
    """All cases in one plan: exact replay, or live against adapter."""
    e = provider_of(s.pipeline.stage("embed"))
    chunks = snapshot_chunks(project, s)
    vectors = project.vectors(keyed(chunks, e), model_key(e)).select("chunk_id", "vector")
    queries = cases.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    query_vectors = question_vectors(project, queries, e)
    setting = s.pipeline.stage("retrieve").params
    rerank = s.pipeline.stage("rerank")
    ordered = chunks.select("chunk_id", F.struct("doc_id", "ordinal").alias("chunk_seq"), "text")
    top_k = int(setting.get("top_k", 10))
    if rerank is not None and rerank.tool not in RERANKERS:
        raise ValueError(f"the reranker {rerank.tool!r} is unknown; known are {', '.join(RERANKERS)}")
    if adapter is None:
        runs = retrieve.run_queries(queries, query_vectors, ordered, vectors, top_k, setting.get("hybrid"), rerank and rerank.params, digits)
    else:
        depth = retrieve.depth_for(top_k)
        name = pl.collection_name(s.root, s.pipeline)
        if s.chunk_count and not adapter.count(name):
            warnings.warn(f"the collection {name} is empty; ingest this snapshot with the adapter first", stacklevel=2)
        dense = adapter.query(name, query_vectors, depth)
        sparse = retrieve.Bm25(ordered).topk(queries, depth, digits)
        fused = retrieve.fuse(dense, sparse, setting.get("hybrid"), digits)
        final = retrieve.rerank_overlap(fused, queries, ordered, top_k, rerank.params.get("top_n"), digits) if rerank else fused.where(F.col("rank") <= top_k)
        stage = lambda df, n: df.select("query_id", F.lit(n).alias("stage"), "rank", "chunk_id", "score")
        runs = stage(dense, "dense").unionByName(stage(sparse, "sparse")).unionByName(stage(fused, "fused")).unionByName(stage(final, "final"))
    runs = runs.persist()
    paths = project.read("corpus_states").where(F.col("root") == s.root).select("doc_id", F.col("source_path").alias("source"))
    sources = chunks.select("chunk_id", "doc_id").join(paths, "doc_id").select("chunk_id", "source")
    want = expected_sources(cases)
    final = runs.where("stage = 'final'")
    per_query = metrics.evaluate_lists(queries, metrics.document_ranks(final, sources, want), want, k_values)
    return Evaluation(s, runs, per_query.persist(), metrics.target_ranks(final, sources, want), sources)


def save_evaluation(project: Project, ev: Evaluation, dataset_id: str, mode: str = "replay", adapter: str = "none", k_values=metrics.K_VALUES) -> str:
    run = ids.run_key(ev.snapshot.snapshot_id, dataset_id, mode, adapter, k_values)
    tag = lambda df: df.withColumn("run_id", F.lit(run)).withColumn("snapshot_id", F.lit(ev.snapshot.snapshot_id))
    project.replace_partition("evals", tag(ev.per_query))
    project.replace_partition("candidates", tag(ev.candidates))
    project.save("eval", run, {"snapshot_id": ev.snapshot.snapshot_id, "dataset_id": dataset_id, "mode": mode, "aggregate": ev.aggregate()})
    return run


@dataclass
class Diff:
    diff_id: str
    config: dict[str, dict]
    deltas: dict[str, float]
    queries: DataFrame
    alignment: DataFrame
    before: Evaluation
    after: Evaluation
    details: dict = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        return {f"{r['class']}/{r.stability}": r.n for r in self.queries.groupBy("class", "stability").agg(F.count("*").alias("n")).collect()}


def diff(project: Project, before: Evaluation, after: Evaluation, dataset_id: str, metric: str = "recall@5", epsilon: float = 0.0) -> Diff:
    """Config, metric deltas, query classes and, where parse, chunks or corpus changed, chunk fates."""
    a, b = before.snapshot, after.snapshot
    config = a.pipeline.changed(b.pipeline)
    if a.root != b.root:
        config["corpus"] = {"before": a.root, "after": b.root}
    deltas = metrics.metric_deltas(metrics.aggregate_metrics(before.per_query), metrics.aggregate_metrics(after.per_query))
    rows = align.classify(before.per_query, after.per_query, before.final(), after.final(), after.targets, metric, epsilon)
    hit = lambda ev, n: ev.per_query.where(F.col("metric") == f"hit_rate@{metrics.metric_k(metric)}").select("query_id", (F.col("value") > 0).alias(n))
    rows = rows.join(hit(before, "hit_before"), "query_id").join(hit(after, "hit_after"), "query_id").persist()
    old, new = snapshot_chunks(project, a), snapshot_chunks(project, b)
    if "parse" in config:
        fates = align.align_words(old, new)
    elif {"chunk", "corpus"} & set(config):
        fates = align.align_spans(old, new)
    else:
        fates = project.spark.createDataFrame([], "chunk_id string, fate string, score double, descendants array<string>")
    return Diff(ids.diff_key(a.snapshot_id, b.snapshot_id, dataset_id), config, {r.metric: r.delta for r in deltas.collect()}, rows, fates.persist(), before, after)


def funnels(project: Project, d: Diff, cases: DataFrame, top_k: int = 5, live_dense: DataFrame | None = None) -> DataFrame:
    """A funnel with its failing stage for every regressed query; live_dense are the ranks an index served."""
    regressed = d.queries.where(F.col("class") == "regressed").select("query_id")
    found = attribution.tracers(d.before.final().join(regressed, "query_id", "left_semi"), d.before.sources, expected_sources(cases))
    s = d.after.snapshot
    e = provider_of(s.pipeline.stage("embed"))
    chunks = snapshot_chunks(project, s)
    vectors = project.vectors(keyed(chunks, e), model_key(e)).select("chunk_id", "vector")
    asked = cases.select(F.col("id").alias("query_id"), "question").join(found.select("query_id"), "query_id", "left_semi")
    shadow = retrieve.dense_topk(asked.select("query_id", e.column(F.col("question")).alias("vector")), vectors, None)
    rows = attribution.funnel(d.before.candidates, d.after.candidates, found, d.alignment, chunks, shadow, live_dense, top_k=int(s.pipeline.stage("retrieve").params.get("top_k", 10)))
    return rows.withColumn("stage", attribution.failing_stage(top_k))


def run_arms(project: Project, a: Snapshot, b: Snapshot, cases: DataFrame, arms: list[dict[str, str]], metric: str = "recall@5") -> DataFrame:
    """(arm_id, query_id, target_rank, value); chunk sets and vectors known already are used again.

    Each arm is written when it is evaluated, so that a plan holds one arm and a lost run costs one.
    """
    where = f"arms/{ids.digest(a.snapshot_id, b.snapshot_id, metric, uuid.uuid4().hex)}"
    for arm in arms:
        p = pl.compose(a, b, arm)
        root = (a if arm.get("corpus") == "A" else b).root
        if not project.read("docs").where(F.col("parse_ph") == pl.parse_key(p.stage("parse"))).head(1):
            raise KeyError("the arm's parse was never ingested")
        s = _snapshot_uncommitted(project, root, p)
        ev = evaluate(project, s, cases)
        value = ev.per_query.where(F.col("metric") == metric).select("query_id", "value")
        rows = value.join(ev.targets, "query_id", "left").select(F.lit(ids.arm_key(arm)).alias("arm_id"), "query_id", "target_rank", "value")
        rows.write.mode("append").parquet(project.path(where))
    return project.spark.read.schema(rows.schema).parquet(project.path(where))


def _snapshot_uncommitted(project: Project, root: str, p: Pipeline) -> Snapshot:
    docs = project.documents_of(root, pl.parse_key(p.stage("parse")))
    key, _ = ensure_chunks(project, docs.select("doc_id", F.col("parsed_text").alias("text")), root, p)
    e = provider_of(p.stage("embed"))
    ensure_vectors(project, project.chunks(key), e)
    return Snapshot(p, docs.count(), project.chunks(key).count(), root, {"chunks_uri": f"chunks/{key}", "embeddings_uri": f"embeddings/{model_key(e)}"})


def attribute(project: Project, d: Diff, cases: DataFrame, mode: str = "auto", rule: str = "rank1", top_k: int = 5, metric: str = "recall@5") -> tuple[DataFrame, DataFrame]:
    """(funnels, causes) of the stable regressed queries."""
    rows = funnels(project, d, cases, top_k)
    factors = sorted(d.config)
    arms = attribution.build_arms(factors, mode)
    evals = run_arms(project, d.before.snapshot, d.after.snapshot, cases, arms, metric)
    table = attribution.arm_table(project.spark, arms)
    stable = d.queries.where((F.col("class") == "regressed") & (F.col("stability") == "stable"))
    before = stable.select("query_id", F.col("before").alias("before_value")).join(d.before.targets.select("query_id", F.col("target_rank").alias("before_rank")), "query_id", "left")
    suspects = attribution.implicated(rows.select("query_id", "stage"), factors).select("query_id", "factor")
    return rows, attribution.confirm(before, evals, attribution.single_reverts(table), suspects, rule, top_k)


def calibrate(project: Project, s: Snapshot, cases: DataFrame, adapter: Adapter, runs: int = 3, seed: int = 0, metric: str = "recall@5") -> dict:
    """Serving noise over repeated live runs, saved under the snapshot."""
    k = metrics.metric_k(metric)
    evals = gaps = None
    for i in range(runs):
        if adapter.capabilities().supports_rebuild:
            adapter.rebuild(pl.collection_name(s.root, s.pipeline), seed + i)
        ev = evaluate(project, s, cases, tuple(sorted({*metrics.K_VALUES, k})), adapter)
        one = ev.per_query.withColumn("run", F.lit(i))
        gap = align.score_gaps(ev.final(), ev.targets, k).withColumn("run", F.lit(i))
        evals, gaps = (one, gap) if evals is None else (evals.unionByName(one), gaps.unionByName(gap))
    record = gating.calibrate(evals, gaps, cases.select(F.col("id").alias("query_id")), metric) | {"snapshot_id": s.snapshot_id, "n_runs": runs}
    project.save("calibration", s.snapshot_id, record)
    return record


def gate(d: Diff, calibration: dict | None, cases: DataFrame | None = None, rule: str | None = None, metric: str = "recall@5", q: float = 0.05, seed: int = 0) -> gating.Verdict:
    if rule is not None:
        return gating.threshold_gate(d.after.per_query, rule)
    tags = cases.select(F.col("id").alias("query_id"), F.explode("tags").alias("tag")) if cases is not None else None
    return gating.statistical_gate(d.queries, calibration, tags, metric, q, seed)


def sweep(project: Project, s: Snapshot, cases: DataFrame, weights: list[float], digits: int | None = None) -> DataFrame:
    """(weight, metric, value): every fusion weight from one retrieval."""
    ev = evaluate(project, s, cases, digits=digits)
    lists = retrieve.sweep_weights(ev.candidates.where("stage = 'dense'"), ev.candidates.where("stage = 'sparse'"), weights, digits)
    top_k = int(s.pipeline.stage("retrieve").params.get("top_k", 10))
    both = lambda: F.concat_ws("\x1f", F.col("weight").cast("string"), "query_id")
    final = lists.where(F.col("rank") <= top_k).select(both().alias("query_id"), "chunk_id", "rank", "score")
    grid = project.spark.createDataFrame([(float(w),) for w in weights], "weight double")
    want = expected_sources(cases).crossJoin(F.broadcast(grid)).select(both().alias("query_id"), "source")
    asked = cases.select(F.col("id").alias("query_id")).crossJoin(F.broadcast(grid)).select(both().alias("query_id"))
    per = metrics.evaluate_lists(asked, metrics.document_ranks(final, ev.sources, want), want)
    return per.groupBy(F.split_part("query_id", F.lit("\x1f"), F.lit(1)).cast("double").alias("weight"), "metric").agg(F.avg("value").alias("value"))


def best_weights(swept: DataFrame) -> DataFrame:
    """(metric, weight, value): the best weight of each metric, the smaller among equals."""
    best = swept.groupBy("metric").agg(F.max_by(F.struct("weight", "value"), F.struct("value", F.negative("weight").alias("w"))).alias("b"))
    return best.select("metric", "b.weight", "b.value")


def distractors(d: Diff, traced: DataFrame) -> DataFrame:
    """(query_id, distractor): the best of the first three results after the change that is not the tracer."""
    rows = d.after.final().where("rank <= 3").join(traced.select("query_id", "tracer"), "query_id").where("chunk_id <> tracer")
    return rows.groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("distractor"))


def unembedded(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, text) of wanted, each key once, that stored (key) lacks."""
    return wanted.groupBy("key").agg(F.first("text").alias("text")).join(stored.select("key"), "key", "left_anti")


def cost_of(texts: DataFrame, usd_per_1k: float = 0.0, local: bool = True) -> DataFrame:
    """One row (texts, tokens, usd, seconds): what embedding texts would cost, at four characters a token."""
    tokens = F.coalesce(F.sum(F.expr("length(text) div 4")), F.lit(0))
    return texts.agg(F.count("*").alias("texts"), tokens.alias("tokens"), (tokens / 1000 * usd_per_1k).alias("usd"), (tokens / (200_000 if local else 5_000)).alias("seconds"))


def embedding_cost(project: Project, scanned: DataFrame, p: Pipeline, usd_per_1k: float | None = None) -> dict:
    """Tokens, dollars and seconds that an ingest would spend, without writing anything; the price is the provider's unless given."""
    parse, chunk, e = p.stage("parse"), p.stage("chunk"), provider_of(p.stage("embed"))
    docs = scanned.select("doc_id", text.parse(F.col("raw"), parse.tool).alias("text")).dropDuplicates(["doc_id"])
    chunks = keyed(text.chunk(docs, chunk.tool, chunk.params), e)
    stored = project.read("embeddings").where(F.col("model_key") == model_key(e)).select("key")
    return cost_of(unembedded(chunks, stored), e.usd_per_1k if usd_per_1k is None else usd_per_1k, e.provider == "local").first().asDict()


def allow_cost(usd: float, max_cost: float | None, yes: bool) -> None:
    if usd and not yes and (max_cost is None or usd > max_cost):
        raise CostRefused(f"this would cost ${usd:.2f}; allow it or raise the limit")
