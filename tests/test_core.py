"""Hand-computed values, metamorphic checks and end-to-end runs of the retrieval engine."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from driftglass import ids, queries
from driftglass.functions import stats, text, vectors
from driftglass.operators import align, attribution, gating, golden, metrics, retrieve
from driftglass.plans import pipeline as pl
from driftglass.plans import report, workflows
from driftglass.sources import adapters, scan, tables
from driftglass.sources.project import Project

SF = "/root/testdata/sf0.001"


# -- identities and pipeline


def test_driver_and_column_identities_agree(spark):
    df = spark.createDataFrame([("a/b.md", "Ünï \"x\"\t", 3, 9), ("c.txt", "", 0, 0)], "path string, text string, s bigint, e bigint")
    rows = df.select("path", "text", ids.text_key_col(F.col("text")).alias("t"), ids.chunk_key_col(F.col("path"), F.col("s"), F.col("e"), F.col("text")).alias("c"), "s", "e").collect()
    for r in rows:
        assert r.t == ids.text_key(r.text) and r.c == ids.chunk_key(r.path, r.s, r.e, r.text)
    root = df.agg(ids.corpus_root_col(F.col("path"), F.col("text")).alias("r")).first().r
    assert root == ids.corpus_root([(r.path, r.text) for r in rows])


def test_pipeline_defaults_and_validation():
    p = pl.build()
    assert [s.id for s in p.stages] == ["parse", "chunk", "embed", "index", "retrieve"]
    assert p.changed(pl.build({"retrieve": {"hybrid": None}})).keys() == {"retrieve"}
    with pytest.raises(ValueError):
        pl.Pipeline((pl.Stage("a", "x", inputs=("b",)), pl.Stage("b", "x", inputs=("a",)))).validate()
    with pytest.raises(ValueError):
        pl.Pipeline((pl.Stage("a", "x", inputs=("z",)),)).validate()
    with pytest.raises(KeyError):
        p.replace(pl.Stage("rerank", "overlap"))
    s = pl.Snapshot(p, 1, 2, "mr_x", {"b": "2", "a": "1"})
    assert pl.Snapshot.from_dict(s.to_dict()).snapshot_id == s.snapshot_id == pl.Snapshot(p, 1, 2, "mr_x", {"a": "1", "b": "2"}, parent="y").snapshot_id


# -- text


def test_parsers(spark):
    raw = "# *Title*  \r\nplain __bold__ and ***deep _nested_***\t\rsnake_case_word\n"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(text.parse(F.col("raw"))).first()[0] == "# *Title*\nplain __bold__ and ***deep _nested_***\nsnake_case_word\n"
    assert df.select(text.parse(F.col("raw"), "markdown-v2")).first()[0] == "Title\nplain bold and deep nested\nsnake_case_word\n"
    with pytest.raises(ValueError):
        text.parse(F.col("raw"), "pdf")


@given(st.integers(0, 40), st.integers(1, 9), st.integers(0, 8))
@settings(max_examples=120, deadline=None)
def test_windows_match_the_loop(n, size, overlap):
    if overlap >= size:
        return
    tokens, want, i = [(k * 2, k * 2 + 1) for k in range(n)], [], 0
    while tokens:
        j = min(i + size, n)
        want.append((tokens[i][0], tokens[j - 1][1]))
        if j >= n:
            break
        i += size - overlap
    assert text._windows(tokens, size, overlap) == want


def test_chunkers():
    body = "intro words here\n# One\na b c\n## Two\nd e"
    spans = text.heading_spans(body, 3)
    assert [body[a:b] for a, b in spans] == ["intro words here", "# One\na", "b c", "## Two\nd", "e"]
    prose = "One. Two!? Three\n\nFour v1.2 five."
    assert [prose[a:b] for a, b in text.sentence_spans(prose, 1)] == ["One.", "Two!?", "Three", "Four v1.2 five."]
    for bad in ({"max_tokens": 0}, {"max_tokens": 5, "overlap": 5}):
        with pytest.raises(ValueError):
            text.check_chunker("fixed_token", bad)


def test_hash_embedder_is_signed_and_unit():
    e = vectors.HashEmbedder(64)
    v = e.embed(["alpha beta alpha", "", "ALPHA beta, alpha!"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and np.allclose(v[0], v[2])


# -- retrieval


def ranked(spark, lists):
    return spark.createDataFrame([(q, c, float(s), i + 1) for q, rows in lists.items() for i, (c, s) in enumerate(rows)], "query_id string, chunk_id string, score double, rank int")


def order(df):
    return [(r.chunk_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]


def test_fusion_hand_values(spark):
    d, s = ranked(spark, {"q": [("a", 0.9), ("b", 0.5), ("c", 0.1)]}), ranked(spark, {"q": [("b", 2), ("c", 1)]})
    assert order(retrieve.fuse_weighted(d, s, 0.5)) == [("b", 0.75), ("a", 0.5), ("c", 0.0)]
    d, s = ranked(spark, {"q": [("a", 10), ("b", 4)]}), ranked(spark, {"q": [("z", 7), ("b", 3)]})
    assert order(retrieve.fuse_weighted(d, s, 0.25)) == [("a", 0.75), ("z", 0.25), ("b", 0.0)]
    flat = ranked(spark, {"q": [("a", 1), ("b", 1)]})
    assert order(retrieve.fuse_weighted(flat, flat, 0.3)) == [("a", 1.0), ("b", 1.0)]
    d, s = ranked(spark, {"q": [("a", 3), ("b", 2), ("c", 1)]}), ranked(spark, {"q": [("b", 9), ("d", 8)]})
    assert order(retrieve.fuse_reciprocal(d, s)) == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("d", round(1 / 62, 9)), ("c", round(1 / 63, 9))]
    assert [c for c, _ in order(retrieve.fuse(d, s, {"fusion": "weighted", "bm25_weight": 0.0}))][:3] == ["a", "b", "c"]
    assert order(retrieve.fuse(d, s, None)) == [("a", 3.0), ("b", 2.0), ("c", 1.0)]
    with pytest.raises(ValueError):
        retrieve.fuse(d, s, {"fusion": "other"})
    with pytest.raises(KeyError):
        retrieve.fuse(d, s, {"fusion": "weighted"})


def test_bm25_hand_values(spark):
    chunks = spark.createDataFrame([("d1", 1, "the cat sat"), ("d2", 2, "cat dog cat"), ("d3", 3, "dog bird")], "chunk_id string, chunk_seq int, text string")
    q = spark.createDataFrame([("q", "cat dog dog")], "query_id string, text string")
    idf, avg = math.log(1.5 / 2.5 + 1), 8 / 3
    part = lambda f, dl: idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
    got = {r.chunk_id: r.score for r in retrieve.Bm25(chunks).scores(q).collect()}
    want = {"d1": part(1, 3), "d2": part(2, 3) + 2 * part(1, 3), "d3": 2 * part(1, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_paths_agree_and_reject_mixed_dimensions(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", [rng.uniform(-1, 1) for _ in range(8)]) for i in range(40)] + [("zero", [0.0] * 8), ("none", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    qs = chunks.limit(5).withColumnRenamed("chunk_id", "query_id")
    a = {(r.query_id, r.chunk_id): round(r.score, 6) for r in retrieve.dense_topk(qs, chunks, 10, 9).collect()}
    scored = retrieve.top(retrieve.dense_scores_sql(qs, chunks.where("vector is not null")), 10, F.asc("chunk_id"), digits=9)
    assert a == {(r.query_id, r.chunk_id): round(r.score, 6) for r in scored.collect()}
    with pytest.raises(Exception, match="dimensions"):
        retrieve.dense_topk(qs, spark.createDataFrame([("x", [1.0])], "chunk_id string, vector array<float>"), 3).collect()


def test_rerank_is_stable(spark):
    fused = ranked(spark, {"q": [("a", 3), ("b", 2), ("c", 1)]})
    chunks = spark.createDataFrame([("a", "x"), ("b", "red blue"), ("c", "blue red")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "Red blue")], "query_id string, text string")
    assert order(retrieve.rerank_overlap(fused, q, chunks, 3)) == [("b", 1.0), ("c", 1.0), ("a", 0.0)]
    assert [c for c, _ in order(retrieve.rerank_overlap(fused, spark.createDataFrame([("q", "?!")], "query_id string, text string"), chunks, 3))] == ["a", "b", "c"]


def test_metrics_hand_values(spark):
    lists = spark.createDataFrame([("q", "x", 1), ("q", "e1", 2), ("q", "y", 3), ("q", "e2", 6)], "query_id string, source string, doc_rank int")
    want = spark.createDataFrame([("q", "e1"), ("q", "e2")], "query_id string, source string")
    qs = spark.createDataFrame([("q",), ("none",)], "query_id string")
    m = {(r.query_id, r.metric): r.value for r in metrics.evaluate_lists(qs, lists, want).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert m["q", "recall@5"] == 0.5 and m["q", "recall@10"] == 1.0 and m["q", "hit_rate@1"] == 0.0 and m["q", "mrr"] == 0.5
    assert abs(m["q", "ndcg@5"] - (1 / math.log2(3)) / ideal) < 1e-12 and abs(m["q", "ndcg@10"] - (1 / math.log2(3) + 1 / math.log2(7)) / ideal) < 1e-12
    assert all(v == 0 for (q, _), v in m.items() if q == "none")


# -- alignment and attribution


def span(spark, rows):
    return spark.createDataFrame([(d, f"{n}", s, e, "x" * (e - s)) for n, d, s, e in rows], "doc_id string, chunk_id string, span_start bigint, span_end bigint, text string")


def test_fates_at_the_thresholds(spark):
    old = span(spark, [("a", "d1", 0, 100), ("b", "d2", 0, 100), ("c", "d3", 0, 100), ("d", "d4", 0, 100), ("e", "d5", 0, 100), ("f", "d6", 0, 0), ("g", "d7", 0, 100)])
    new = span(spark, [("A", "d1", 5, 100), ("B", "d2", 6, 100), ("C1", "d3", 0, 50), ("C2", "d3", 50, 100), ("D", "d4", 0, 300), ("E", "d5", 0, 40), ("F", "d6", 0, 9)])
    got = {r.chunk_id: (r.fate, round(r.score, 6), r.descendants) for r in align.align_spans(old, new).collect()}
    assert got == {"a": ("intact", 0.95, ["A"]), "b": ("boundary-shifted", 0.94, ["B"]), "c": ("split", 1.0, ["C1", "C2"]), "d": ("merged", 1.0, ["D"]), "e": ("dropped", 0.4, []), "f": ("dropped", 0.0, []), "g": ("dropped", 0.0, [])}


def test_word_alignment(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_id string, span_start bigint, span_end bigint, text string")
    got = {r.chunk_id: (r.fate, round(r.score, 6), r.descendants) for r in align.align_words(make([("d", "a", 0, 9, "one two three"), ("d", "b", 9, 12, "zzz"), ("x", "c", 0, 1, "q")]), make([("d", "n1", 0, 5, "three two one"), ("d", "n2", 5, 9, "one two three")])).collect()}
    assert got == {"a": ("intact", 1.0, ["n1"]), "b": ("dropped", 0.0, []), "c": ("dropped", 0.0, [])}


def test_arms():
    assert len(attribution.build_arms(["chunk", "embed", "parse"])) == 8
    four = attribution.build_arms(["chunk", "embed", "parse", "retrieve"])
    assert len(four) == 1 + 4 + 2 + 1
    assert len(attribution.build_arms(["chunk", "embed", "parse", "retrieve"], "full")) == 16
    assert [a for a in attribution.build_arms(["chunk", "embed"], only=["chunk"])] == [{"chunk": "B", "embed": "B"}, {"chunk": "A", "embed": "B"}]


def test_shapley_hand_values(spark):
    v = {frozenset(): 0, frozenset("a"): 1, frozenset("b"): 1, frozenset("ab"): 4}
    assert attribution.shapley(["a", "b"], v.__getitem__) == {"a": 2, "b": 2}
    got = attribution.shapley_table(spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)], "mask int, v double"), 2)
    assert {r.player: r.value for r in got.collect()} == {0: 1.0, 1: 2.0}


def test_failing_stages(spark):
    base = dict(dense_before=1, dense_after=1, sparse_before=1, sparse_after=1, fused_before=1, fused_after=1, reranked_after=None, shadow_after=1, in_index=True, in_candidates=True, ann=False)
    cases = [(dict(in_index=False), "index"), (dict(dense_after=9), "dense"), (dict(sparse_after=None), "sparse"), (dict(fused_after=6), "fused"), (dict(in_candidates=False), "rerank"), (dict(reranked_after=7), "rerank"), (dict(ann=True, dense_before=9), "ann"), (dict(sparse_before=7, sparse_after=9, dense_before=6), "sparse")]
    rows = [tuple((base | c).values()) for c, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in base.items()))
    assert [r[0] for r in df.select(attribution.failing_stage(5)).collect()] == [w for _, w in cases]


def test_confirmation_needs_rank_and_metric(spark):
    regressed = spark.createDataFrame([("q", 1, 1.0)], "query_id string, before_rank int, before_value double")
    evals = spark.createDataFrame([("a1", "q", 2, 1.0), ("a2", "q", 2, 0.5), ("a3", "q", 3, 1.0)], "arm_id string, query_id string, target_rank int, value double")
    reverts = spark.createDataFrame([("a1", "chunk"), ("a2", "embed"), ("a3", "parse")], "arm_id string, factor string")
    suspects = spark.createDataFrame([("q", "chunk"), ("q", "embed")], "query_id string, factor string")
    got = {(r.factor, r.status) for r in attribution.confirm(regressed, evals, reverts, suspects).collect()}
    assert got == {("chunk", "verified"), ("embed", "hypothesis")}
    assert {r.factor for r in attribution.confirm(regressed, evals, reverts, suspects, "topk").where("status = 'verified'").collect()} == {"chunk", "parse"}


# -- statistics


def test_statistics_hand_values(spark):
    assert stats.mcnemar(5, 0) == 0.0625 and stats.mcnemar(8, 2) == 0.109375 and stats.mcnemar(0, 0) == 1 and stats.mcnemar(20, 0) == 2 * 0.5**20
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    assert stats.false_discovery(p) == [True] * 4 + [False] * 11 and stats.false_discovery([0.04, 0.049]) == [True, True] and stats.false_discovery([]) == []
    assert abs(stats.near_tie_bound([1, 2, 3, 4]) - 3.85) < 1e-12 and abs(stats.near_tie_bound([i / 20 for i in range(21)]) - 0.95) < 1e-12
    assert stats.bootstrap_interval([]) == (0, 0) and stats.bootstrap_interval([2]) == (2, 2)
    df = spark.createDataFrame([(5, 0), (8, 2), (0, 0), (20, 0), (3, 3), (300, 250)], "b int, c int")
    for r in df.select("b", "c", stats.mcnemar_col(F.col("b"), F.col("c")).alias("p")).collect():
        assert abs(r.p - stats.mcnemar(r.b, r.c)) < 1e-9
    table = stats.false_discovery_table(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "k int, p double"), "k")
    assert sorted(r.k for r in table.where("rejected").collect()) == [0, 1, 2, 3]


def classed(spark, rows):
    return spark.createDataFrame(rows, "query_id string, delta double, hit_before boolean, hit_after boolean, stability string")


def test_gate(spark):
    down = [(f"q{i}", -1.0, True, False, "stable") for i in range(8)] + [(f"n{i}", -1.0, True, False, "unstable") for i in range(5)]
    v = gating.statistical_gate(classed(spark, down), {"epsilon": 0.1})
    assert not v.passed and v.details["b"] == 8 and v.details["n_unstable"] == 5 and len(v.reasons) == 2
    ties = [(f"q{i}", -1.0, True, False, "unstable") for i in range(4)] + [(f"s{i}", 0.0, True, True, "stable") for i in range(16)]
    assert gating.statistical_gate(classed(spark, ties), {"epsilon": 0.1}).passed
    tags = spark.createDataFrame([(f"q{i}", "hot") for i in range(8)], "query_id string, tag string")
    assert "hits were lost under hot" in " ".join(gating.statistical_gate(classed(spark, down), {}, tags).reasons)
    with pytest.raises(gating.NotCalibrated):
        gating.statistical_gate(classed(spark, down), None)
    for rule in ("recall@5=1", "recall@5<0.5<1", ""):
        with pytest.raises(ValueError):
            gating.parse_rule(rule)
    after = spark.createDataFrame([("q", "recall@5", 0.5), ("r", "recall@5", 1.0)], "query_id string, metric string, value double")
    assert not gating.threshold_gate(after, "recall@5 < 0.8").passed and gating.threshold_gate(after, "recall@5<=0.7").passed


# -- golden sets and store


def test_import_and_mining(spark, tmp_path):
    (tmp_path / "foreign.jsonl").write_text('{"question": "q1", "reference_contexts": ["a", "b"]}\n\n{"question": "q2", "reference_contexts": [], "ground_truth": "c"}\n{"input": "q3", "context": ["d"], "id": "own"}\n')
    got = [(r.id, r.question, r.expected_sources) for r in golden.import_file(spark, str(tmp_path / "foreign.jsonl")).orderBy("id").collect()]
    assert got == [("own", "q3", ["d"]), ("q_001", "q1", ["a", "b"]), ("q_002", "q2", ["c"])]
    (tmp_path / "native.json").write_text('{"dataset_id": "g-v1",\n "cases": [{"id": "x", "question": "why", "expected_sources": ["s"], "tags": ["t"], "origin": "hand", "source_trace": null}]}')
    assert [tuple(r)[:4] for r in golden.import_file(spark, str(tmp_path / "native.json")).collect()] == [("x", "why", ["s"], ["t"])]
    (tmp_path / "bad.jsonl").write_text('{"prompt": "no"}\n')
    with pytest.raises(Exception, match="unknown record"):
        golden.import_file(spark, str(tmp_path / "bad.jsonl")).collect()
    assert golden.bump("golden-v1") == "golden-v2" and golden.bump("plain") == "plain-v2"


def test_store_rules(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2)], "id string, v int, pos int")
    assert sorted(map(tuple, tables.upsert(old, new, "id", "pos").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    with pytest.raises(KeyError, match="1 keys"):
        tables.require_all(old.select(F.col("id").alias("key")), spark.createDataFrame([("a",)], "key string"))
    assert tables.resolve(["snap_ab1", "snap_cd2"], "cd") == "snap_cd2" == tables.resolve(["snap_ab1", "snap_cd2"], "latest")
    with pytest.raises(ValueError):
        tables.resolve(["snap_ab1", "snap_ab2"], "ab")


# -- end to end

CORPUS = {
    "ops/alpha.md": "# Widget\n\nThe widget ledger rotates every night. Operators restart the quokka relay when it stalls.\n\n## Limits\n\nAt most nine widgets run at once.\n",
    "ops/beta.md": "# Gateway\n\nThe gateway checks each token against the mirror. When the mirror is stale the gateway refuses.\n\n## Retries\n\nClients retry with growing pauses.\n",
    "hr/gamma.txt": "Storage\n\nBackups are kept for ninety days in the vault.\n\nRestores need two approvals from the vault team.\n",
    "hr/copy.txt": "Storage\n\nBackups are kept for ninety days in the vault.\n\nRestores need two approvals from the vault team.\n",
}
CASES = [("q1", "When do operators restart the quokka relay?", ["ops/alpha.md"], ["ops"]), ("q2", "How long are backups kept in the vault?", ["hr/copy.txt"], ["hr"]), ("q3", "When does the gateway refuse?", ["ops/beta.md"], ["ops"])]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus with space")
    for name, body in CORPUS.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    (root / "ops" / "skip.pdf").write_text("no")
    project = Project(spark, str(tmp_path_factory.mktemp("project")))
    cases = spark.createDataFrame([(i, q, s, t, "hand", None) for i, q, s, t in CASES], golden.CASE)
    return project, scan.directory(spark, str(root)), cases


def test_scan(world):
    _, scanned, _ = world
    assert sorted(r.source_path for r in scanned.collect()) == sorted(CORPUS)


def test_ingest_is_memoised_and_evaluates(world):
    project, scanned, cases = world
    p = pl.build({"chunker": {"tool": "markdown_heading", "params": {"max_tokens": 40, "overlap": 0}}})
    first = workflows.ingest(project, scanned, p)
    assert first.embed_calls == first.new_chunks == first.snapshot.chunk_count and first.snapshot.doc_count == 4
    again = workflows.ingest(project, scanned, p)
    assert (again.embed_calls, again.new_chunks) == (0, 0) and again.snapshot.snapshot_id == first.snapshot.snapshot_id
    ev = workflows.evaluate(project, first.snapshot, cases)
    assert ev.aggregate()["recall@5"] == 1.0
    adapter = adapters.LocalAdapter(project)
    workflows.ingest(project, scanned, p, adapter)
    live = workflows.evaluate(project, first.snapshot, cases, adapter=adapter)
    assert live.aggregate() == ev.aggregate()
    workflows.save_evaluation(project, ev, "golden-v1")
    record = workflows.calibrate(project, first.snapshot, cases, adapter, runs=2)
    assert record["epsilon"] == 0.0 and set(record["per_query_flip_rate"].values()) == {0.0}
    swept = workflows.sweep(project, first.snapshot, cases, [0.0, 0.5, 1.0])
    assert swept.count() == 30 and workflows.best_weights(swept).count() == 10


def test_diff_attributes_a_cause(world):
    project, scanned, cases = world
    a = workflows.ingest(project, scanned, pl.build({"chunker": {"tool": "markdown_heading", "params": {"max_tokens": 40, "overlap": 0}}})).snapshot
    b = workflows.ingest(project, scanned, pl.build({"chunker": {"tool": "fixed_token", "params": {"max_tokens": 3, "overlap": 0}}, "retrieve": {"top_k": 10, "hybrid": None}})).snapshot
    before, after = workflows.evaluate(project, a, cases), workflows.evaluate(project, b, cases)
    d = workflows.diff(project, before, after, "golden-v1", "recall@1")
    assert set(d.config) == {"chunk", "retrieve"} and d.alignment.count() == a.chunk_count
    funnels, causes = workflows.attribute(project, d, cases, metric="recall@1")
    found = [r.asDict() for r in causes.collect()]
    fates = {r.chunk_id: r.asDict() for r in d.alignment.collect()}
    for f in funnels.collect():
        mine = [c for c in found if c["query_id"] == f.query_id]
        story = report.narrative(f.asDict(), fates.get(f.tracer), mine)
        assert story and report.audit(story, f.asDict(), fates.get(f.tracer), mine) == []
        assert report.audit(story + " arm_123456", f.asDict(), fates.get(f.tracer), mine) == ["arm arm_123456"]
    verdict = workflows.gate(d, {"epsilon": 0.0}, cases, metric="recall@1")
    assert "Retrieval diff" in report.diff_markdown(d, verdict, True, found) and report.diff_json(d, verdict, found)


def test_gc_keeps_pinned_and_newest(world):
    project, scanned, _ = world
    made = [workflows.ingest(project, scanned, pl.build({"chunker": {"tool": "fixed_token", "params": {"max_tokens": n, "overlap": 0}}})).snapshot for n in (5, 6, 7)]
    project.pin(made[0].snapshot_id)
    project.gc(keep=1)
    left = {s.snapshot_id for s in project.snapshots()}
    assert {made[0].snapshot_id, made[2].snapshot_id} == left
    assert project.chunks(made[0].artifacts["chunks_uri"].split("/")[1]).count() == made[0].chunk_count
    with pytest.raises(KeyError):
        project.chunks(made[1].artifacts["chunks_uri"].split("/")[1])


def test_generated_cases_name_their_source(world, spark):
    docs = spark.createDataFrame([(f"c{i}", f"d{i}", f"dir{i % 2}/d{i}.md", t) for i, t in enumerate(CORPUS.values())], "chunk_id string, doc_id string, source string, text string")
    cases = golden.generate(docs, 3).collect()
    assert len(cases) == 3 and {c.tags[1] for c in cases} == {"exact-term", "paraphrase"} and all(c.expected_sources for c in cases)


# -- the driver's contract


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 10


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["p6_fixed_token_chunks", "j2_bm25_top20", "h6_weighted_fusion", "h7_case_metrics", "h9_align_spans", "a24_false_discovery"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name]).df()[got.columns]
    key = lambda rows: sorted(tuple(round(float(x), 5) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)
    assert key(got.collect()) == key(want.itertuples(index=False))


def test_bootstrap_draws_are_no_rows(spark, monkeypatch, capsys):
    known = [None if k == 4 else float(k * k % 7) for k in range(23)]
    values = spark.createDataFrame(list(enumerate(known)), "k int, v double").repartition(3)
    drawn = [[known[int(hashlib.sha256(f"0:{b}:{j}".encode()).hexdigest()[:8], 16) % 23] for j in range(23)] for b in range(50)]
    means = [math.fsum(v for v in d if v is not None) / sum(v is not None for v in d) for d in drawn]
    want = [stats.percentile(means, p) for p in (0.025, 0.975)]
    packed = stats.hash_bootstrap(values, "v", "k", resamples=50)
    assert list(packed.first()) == pytest.approx(want)
    packed.explain()
    assert "Generate" not in capsys.readouterr().out  # no row for a draw
    monkeypatch.setattr(stats, "BLOCK_VALUES", 7)
    assert list(stats.hash_bootstrap(values, "v", "k", resamples=50).first()) == pytest.approx(want)
    monkeypatch.setattr(stats, "BROADCAST_BYTES", 0)
    assert list(stats.hash_bootstrap(values, "v", "k", resamples=50).first()) == pytest.approx(want)
    assert list(stats.hash_bootstrap(values.limit(0), "v", "k", resamples=50).first()) == [None, None]


def test_noise_is_hashed_only_where_it_can_matter(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(150)] + [(150, [0.0] * 8)] * 30
    chunks = spark.createDataFrame([(k if v[0] else k + n, v) for n, (k, v) in enumerate(rows)], "chunk_id bigint, vector array<double>").repartition(3)
    qs = chunks.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    rank = lambda df: {(r.query_id, r.chunk_id): (r["rank"], r.score) for r in df.collect()}
    for sigma in (0.05, -0.4, 0.0):
        want = retrieve.top(retrieve.hash_noise(retrieve.dense_scores(qs, chunks), sigma, 7, "c"), 3, F.asc("chunk_id"), digits=6)
        assert rank(retrieve.noisy_topk(qs, chunks, 3, sigma, 7, "c", 6)) == rank(want)


def test_tasks_keep_few_neighbours_of_a_query(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"c{k:03d}", rng.integers(-1, 2, 4).astype(float).tolist()) for k in range(300)] + [("none", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>").repartition(2)
    qs = chunks.withColumnRenamed("chunk_id", "query_id")
    want = retrieve.top(retrieve.dense_scores_sql(qs.where("vector is not null"), chunks.where("vector is not null")), 5, F.asc("chunk_id"), digits=6)
    pairs = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in df.collect()}
    for name, value in (("BLOCK_ROWS", 32), ("TASK_BLOCKS", 4), ("LEAST_TASKS", 1), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(retrieve, name, value)
    assert pairs(retrieve.dense_topk(qs, chunks, 5, 6)) == pairs(want)
    monkeypatch.setattr(retrieve, "top", lambda scored, *_, **__: scored)
    assert retrieve.dense_topk(qs, chunks, 5, 6).count() <= 300 * 5 * 3  # 3 parts of chunks, though there are 10 blocks of them and many ties


MIXED = ["Ça va, naïve Œuvre 42!", "один два ДВА Σοφός ΣΟΦΟΣ", "\u0130stanbul \u212a9 x", "", None, "one Two two three", "three_two-one ½ ²x", "two " * 30, "ſtraße ŉ ab12 12ab"]


def _mixed(spark):
    rows = [(k, k * 7 % 31, MIXED[k % len(MIXED)] and MIXED[k % len(MIXED)] + f" w{k % 5}") for k in range(40)] + [(3, 21, "two two other"), (3, 21, "two two other"), (3, 21, "two one"), (5, 4, "one")]
    return spark.createDataFrame(rows, "chunk_id bigint, chunk_seq int, text string").repartition(3)


def test_tasks_keep_few_chunks_of_a_query_by_words(spark, monkeypatch):
    chunks = _mixed(spark)
    qs = spark.createDataFrame([("a", "two Two one"), ("b", "ДВА σοφός œuvre"), ("c", "i\u0307stanbul k9 9 ½ ²x straße ſtraße"), ("d", None), ("e", "w1 w2 none")], "query_id string, text string")
    index = retrieve.Bm25(chunks)
    want = retrieve.top(index.scores(qs), 4, F.asc("chunk_seq"), digits=6)
    got = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in df.collect()}
    assert got(index.topk(qs, 4, 6)) == got(want)
    monkeypatch.setattr(retrieve, "PART_ROWS", 2)
    monkeypatch.setattr(retrieve, "PART_CELLS", 8)
    assert got(index.topk(qs, 4, 6)) == got(want)
    big = retrieve.Bm25(spark.range(3000).selectExpr("id chunk_id", "id chunk_seq", "concat('word ', id % 7) text"))
    monkeypatch.setattr(retrieve, "PART_ROWS", 512)
    monkeypatch.setattr(retrieve, "top", lambda scored, *_, **__: scored.withColumn("rank", F.lit(1)))
    assert big.topk(spark.createDataFrame([("q", "word 3")], "query_id string, text string"), 5, 6).count() <= 200  # not 3000


def test_places_of_words_of_any_script(spark):
    rows = vectors.sha_embedding(_mixed(spark), "chunk_id", 8)
    got = {r.chunk_id: list(r.vector) for r in rows.collect()}
    want = {}
    for r in _mixed(spark).select("chunk_id", text.ascii_words(F.col("text")).alias("w")).collect():
        for w in r.w or ():
            v = int(hashlib.sha256(w.encode()).hexdigest()[:8], 16)
            want.setdefault(r.chunk_id, [0] * 8)[(v >> 1) % 8] += 1 if v & 1 else -1
    assert got == {k: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for k, v in want.items()}


def test_passages_are_found_by_few_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcdefgh abcd"), (2, "xxabcdefg"), (3, None), (4, ""), (5, "über abc über abcdefgh"), (6, "habcdefg")], "doc_id bigint, text string").repartition(2)
    asked = spark.createDataFrame([(1, "abcdefgh"), (2, "über"), (3, "abc"), (4, ""), (5, None), (6, "abcd"), (7, "habcdefgx"), (8, "abcdefgh")], "query_id int, passage string")
    want = sorted(map(tuple, docs.join(asked, F.contains("text", "passage")).select("query_id", "doc_id").collect()))
    assert sorted(map(tuple, retrieve.containing(docs, asked).collect())) == want
    assert retrieve.containing(docs, asked.limit(0)).count() == 0
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, retrieve.containing(docs, asked).collect())) == want


def test_chunks_are_given_few_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "x yy"), (5, "p q r")], "doc_id int, text string").coalesce(1)
    monkeypatch.setattr(text, "CHUNK_ROWS", 2)
    got = [(r.doc_id, r.ordinal, r.text) for r in text.chunk(docs, "fixed_token", {"max_tokens": 2, "overlap": 1}).collect()]
    assert got == [(1, k, f"{x} {y}") for k, (x, y) in enumerate(zip("abcdef", "bcdefg"))] + [(4, 0, "x yy"), (5, 0, "p q"), (5, 1, "q r")]


def test_chunk_pairs_are_no_rows(spark, monkeypatch, capsys):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["one", "два", "Three", "œuf", "4", "-"]) for _ in range(rng.randrange(5)))
    make = lambda tag: spark.createDataFrame([(k % 5 if k % 11 else None, f"{tag}{k}", rng.randrange(3), say()) for k in range(60)], "doc_id int, chunk_id string, span_start bigint, text string").repartition(2)
    old, new = make("o").where("coalesce(doc_id, 0) <> 4"), make("n").where("coalesce(doc_id, 0) <> 3")
    words = F.array_distinct(text.terms(F.col("text")))
    met = old.select("doc_id", "chunk_id", words.alias("a")).join(new.select("doc_id", F.col("chunk_id").alias("n"), "span_start", words.alias("b")), "doc_id", "left").select("chunk_id", "n", "span_start", F.when(F.col("n").isNotNull(), align.jaccard(F.col("a"), F.col("b"))).alias("s"))
    want = {}
    for r in met.collect():
        want[r.chunk_id] = min(want.get(r.chunk_id, (0, 0, "")), (-r.s, r.span_start, r.n) if r.s else (0, 0, ""))
    for rows, n in ((1024, 4096), (2, 2)):
        monkeypatch.setattr(align, "ROWS", rows)
        monkeypatch.setattr(align, "WORDS", n)
        out = align.align_words(old, new)
        assert {r.chunk_id: (r.score, r.descendants) for r in out.collect()} == {k: (-s, [n] if -s >= 0.6 else []) for k, (s, _, n) in want.items()}
    out.explain()
    assert "Join" not in capsys.readouterr().out
