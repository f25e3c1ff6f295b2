"""Configuration, providers, recorder, command line, streaming and reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass import cli
from driftglass.functions import providers
from driftglass.operators import golden
from driftglass.plans import report
from driftglass.plans.recorder import Recorder
from driftglass.sources import adapters, config
from driftglass.sources.project import Project
from driftglass.streaming.mine import mine_stream


def test_config_round_trip():
    text = "# a comment\nname: demo\nindex:\n  adapter: local\n  deep:\n    flag: true\n    list: [1, 2.5, x]\ngate:\n  q: 0.05\nempty: null\n"
    got = config.loads(text)
    assert got == {"name": "demo", "index": {"adapter": "local", "deep": {"flag": True, "list": [1, 2.5, "x"]}}, "gate": {"q": 0.05}, "empty": None}
    assert config.loads(config.dumps(got)) == got
    assert config.embedding_spec("openai:text-embedding-3-small:512") == {"provider": "openai", "model": "text-embedding-3-small", "dims": 512}
    with pytest.raises(ValueError):
        config.loads("no colon here")


def test_request_batches():
    assert [len(b) for b in providers.request_batches(["x" * 40] * 7, 3)] == [3, 3, 1]
    assert [len(b) for b in providers.request_batches(["x" * 40] * 3 + ["y" * 4000] + ["x"], 100, 25)] == [2, 1, 1, 1]
    with pytest.raises(ValueError):
        providers.SERVICES["openai"].model("unheard-of")


def test_remote_embedding_goes_through_the_request(spark):
    service = providers.Service("fake", 2, None, {"m": (0.1, 3)})
    df = spark.createDataFrame([(i, "t" * i) for i in range(5)], "key int, text string")
    got = providers.embed_remote(df, service, "m", lambda model, texts: [[float(len(t)), 0.0, 1.0] for t in texts])
    assert {r.key: r.vector[0] for r in got.collect()} == {i: float(i) for i in range(5)}


def test_recorder_makes_a_snapshot(spark, tmp_path):
    project = Project(spark, str(tmp_path / "p"))
    rec = Recorder(project)
    docs = spark.createDataFrame([("a.txt", "alpha beta", "alpha beta"), ("b.txt", "gamma", "gamma")], "source_path string, raw string, parsed_text string")
    with rec.stage("parse", "foreign-parse", "3"):
        rec.log_documents(docs)
    with rec.stage("chunk", "foreign-chunk", params={"n": 1}):
        chunks = rec.log_chunks(rec.documents.select("doc_id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).cast("bigint").alias("span_start"), F.length("parsed_text").cast("bigint").alias("span_end"), F.col("parsed_text").alias("text")))
    rec.log_embeddings(chunks.select("chunk_id", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("vector")), "own", "m", 2)
    rec.log_retrieval(chunks.select(F.lit("q").alias("query_id"), F.lit("final").alias("stage"), F.lit(1).alias("rank"), "chunk_id", F.lit(0.5).alias("score")))
    s = rec.commit()
    assert (s.doc_count, s.chunk_count) == (2, 2) and project.snapshot().snapshot_id == s.snapshot_id
    assert project.read("embeddings").count() == 2 and project.read("candidates").count() == 2
    with pytest.raises(ValueError):
        with rec.stage("chunk", "foreign-chunk", params={"n": 2}):
            pass
    assert rec.commit().snapshot_id == s.snapshot_id and project.read("embeddings").count() == 2


def test_command_line(spark, tmp_path, capsys):
    docs, home = tmp_path / "docs", str(tmp_path / "home")
    docs.mkdir()
    for i, t in enumerate(["Foxes sleep in the warm den below the old mill.", "Owls watch the quiet mill from the tall pine at night.", "Badgers dig long tunnels near the slow river bend."]):
        (docs / f"d{i}.md").write_text(f"# Note {i}\n\n{t} They return when the season turns cold again.\n")
    run = lambda *a: cli.main(["--project", home, *a], spark)
    assert run("init", "--source", str(docs)) == 0 and run("init") == 2
    assert run("ingest", "--adapter", "local") == 0
    assert "3 documents" in capsys.readouterr().out
    assert run("dataset", "generate", "--n", "3") == 0 and run("dataset", "show", "--name", "golden") == 0
    assert run("eval", "golden-v1") == 0 and run("eval", "golden-v1", "--fail-if", "recall@5<1.1") == 1
    assert run("calibrate", "golden-v1", "--runs", "2") == 0
    assert run("ingest", "--chunker", "fixed_token", "--chunk-params", json.dumps({"max_tokens": 4, "overlap": 0})) == 0
    ids = [s.snapshot_id for s in Project(spark, home).snapshots()]
    capsys.readouterr()
    assert run("diff", ids[0], ids[1], "--dataset", "golden-v1", "--format", "md") == 0
    assert "## Retrieval diff" in capsys.readouterr().out
    assert run("snapshot", "pin", ids[0][5:12]) == 0 and run("gc", "--keep", "0") == 0
    assert [s.snapshot_id for s in Project(spark, home).snapshots()] == ids[:1]


def test_streamed_mining_is_idempotent(spark, tmp_path):
    project = Project(spark, str(tmp_path / "p"))
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("why", ["a"], "t1"), ("how", None, "t2"), ("why", ["a"], "t1")], "query string, expected_sources array<string>, trace_id string")
    rows.write.mode("append").parquet(source)
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        mine_stream(stream, project, "mined-v1", str(tmp_path / f"cp{n}")).awaitTermination()
    assert project.cases("mined").count() == 2


def test_adapters(spark, tmp_path):
    a = adapters.LocalAdapter(Project(spark, str(tmp_path / "p")))
    a.ensure("c", 2)
    rows = lambda r: spark.createDataFrame(r, "id string, vector array<float>, payload string, pos int")
    assert a.count("c") == 0
    a.upsert("c", rows([("x", [1.0, 0.0], "{}", 0), ("y", [0.0, 1.0], "{}", 1), ("x", [0.0, 2.0], "{}", 2)]))
    a.upsert("c", rows([("z", [1.0, 1.0], "{}", 0)]))
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<float>")
    assert [(r.chunk_id, round(r.score, 6)) for r in a.query("c", q, 3).orderBy("rank").collect()] == [("x", 1.0), ("y", 1.0), ("z", round(float(np.sqrt(0.5)), 6))]
    assert a.query("c", q, 0).count() == 0
    with pytest.raises(ValueError):
        a.upsert("c", rows([("w", [1.0], "{}", 0)]))
    noisy = adapters.LocalAdapter(a.project, noise=0.5, seed=1)
    one, again = ([r.score for r in noisy.query("c", q, 3).orderBy("rank").collect()] for _ in range(2))
    noisy.rebuild("c", 2)
    assert one == again != [r.score for r in noisy.query("c", q, 3).orderBy("rank").collect()]
    a.drop("c")
    a.drop("c")
    assert a.count("c") == 0
    with pytest.raises(KeyError):
        a.query("c", q, 1)
    with pytest.raises(RuntimeError):
        adapters.adapter_for("qdrant", a.project).count("c")
    with pytest.raises(ValueError):
        adapters.PgVectorSql("a; drop", 2)
    assert "1 - (embedding" in adapters.PgVectorSql("t", 2).query() and adapters.point_id("a") == adapters.point_id("a")


def test_curation_rejects_unknown_ids(spark):
    cases = spark.createDataFrame([("a", "q", ["s"], [], "hand", None)], golden.CASE)
    none = spark.createDataFrame([], "id string, question string, expected_sources array<string>, tags array<string>")
    with pytest.raises(ValueError):
        golden.curate(cases, none, reject=["zz"])
    with pytest.raises(ValueError):
        golden.curate(cases, none, accept=["a"], reject=["a"])
    assert golden.curate(cases, none, reject=["a"]).count() == 0


def test_pages_are_escaped():
    assert "<script>" not in report.page("t", "<script>")


def test_services_answer_over_http(spark, monkeypatch):
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], len(body["input"])))
            if len(seen) == 1:  # a busy server is asked again
                self.send_error(503)
                return
            data = [{"index": i, "embedding": [float(len(t)), 1.0] + [0.0] * 1534} for i, t in enumerate(body["input"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data[::-1]}).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = providers.RemoteEmbedder("openai", "text-embedding-3-small", url=f"http://127.0.0.1:{server.server_port}")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(providers.RequestFailed):
        e.embed(["a"])
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    got = e.embed([""] * 255 + ["abc"] * 3)
    assert got.shape == (258, 1536) and np.allclose(got[-1][:2], np.array([3, 1]) / np.sqrt(10)) and [n for _, n in seen] == [256, 256, 2] and seen[0][0] == "Bearer k"
    server.shutdown()
    assert e.usd_per_1k == 0.00002 and providers.parse_spec("voyage:voyage-3.5") == {"provider": "voyage", "model": "voyage-3.5", "dims": 1024, "params": {}}
    assert providers.parse_spec("local:hash-v1:64")["dims"] == 64
    for bad in ("local", "nobody:x", "openai:x", "openai:text-embedding-3-small:7", "a:b:c:d"):
        with pytest.raises(ValueError):
            providers.parse_spec(bad)


def test_one_comment_is_kept_up_to_date():
    pages, sent = {1: [{"id": 5, "body": "hi"}], 2: [{"id": 9, "body": comment.MARK + " old"}], 3: []}, []

    def send(url, body, headers, method="POST"):
        if method == "GET":
            return pages[int(url.rpartition("=")[2])]
        sent.append((method, url, body["body"]))
        return {"id": 77}

    assert comment.upsert_comment("o/r", 3, "new", "t", send=send) == "9" and sent[-1][0] == "PATCH" and sent[-1][1].endswith("/issues/comments/9")
    pages[2] = []
    assert comment.upsert_comment("o/r", 3, "new", "t", send=send) == "77" and sent[-1] == ("POST", "https://api.github.com/repos/o/r/issues/3/comments", comment.MARK + "\nnew")


def test_questions_by_a_model(spark):
    chunks = spark.createDataFrame([("c1", "d1", "ops/a.md", 1, "x" * 40), ("c2", "d2", "b.md", 2, "y")], "chunk_id string, doc_id string, source string, pick int, text string")
    cases = golden.from_questions(questions.ask_questions(chunks, "m", lambda model, t: "Why x?\nmore" if t[0] == "x" else " ")).collect()
    assert [(c.id, c.question, c.expected_sources, c.tags, c.source_trace) for c in cases] == [("q_001", "Why x?", ["ops/a.md"], ["ops"], "c1")]
    cost = questions.question_cost(chunks, "gpt-4o").first()
    assert (cost.requests, cost.tokens) == (2, 10 + 2 * 60 + 2 * 40) and abs(cost.usd - (130 / 1000 * 0.0025 + 80 / 1000 * 0.01)) < 1e-12
    with pytest.raises(ValueError):
        questions.question_cost(chunks, "nothing")


def test_served_against_exact(spark):
    rows = lambda r: spark.createDataFrame(r, "query_id string, chunk_id string, rank int")
    exact = rows([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("p", "a", 1)])
    got = {r.query_id: (r.shared, r.displaced) for r in phase0.ann_effect(rows([("q", "b", 1), ("q", "a", 2)]), exact, 2).collect()}
    assert got == {"q": (1.0, 1.0), "p": (0.0, 0.0)}


def test_edits_of_curation_are_checked(spark):
    cases = spark.createDataFrame([("a", "q", ["s"], [], "hand", None)], golden.CASE)
    edits = lambda i: spark.createDataFrame([(i, "new", None, None)], "id string, question string, expected_sources array<string>, tags array<string>")
    with pytest.raises(ValueError):
        golden.curate(cases, edits("zz"))
    with pytest.raises(ValueError):
        golden.curate(cases, edits("a"), reject=["a"])
    assert golden.curate(cases, edits("a")).first().question == "new"


def test_caches_logged_runs_and_prefixes(spark, tmp_path):
    project = Project(spark, str(tmp_path / "p"))
    queries = spark.createDataFrame([("q1", "same words"), ("q2", "same words"), ("q3", "other")], "query_id string, text string")
    e = HashEmbedder(16)
    for _ in range(2):
        got = {r.query_id: r.vector for r in workflows.question_vectors(project, queries, e).collect()}
        assert project.read("query_embeddings").count() == 2 and got["q1"] == got["q2"] and np.allclose(got["q3"], e.embed(["other"])[0])
    assert workflows.question_vectors(project, queries, HashEmbedder(8)).count() == 3 and project.read("query_embeddings").count() == 4
    project.replace_partition("candidates", spark.createDataFrame([("r1", "q", "final", 1, "c", 0.5)], "run_id string, query_id string, stage string, rank int, chunk_id string, score double"))
    assert [tuple(r) for r in project.logged("r1").collect()] == [("q", "final", 1, "c", 0.5)]
    with pytest.raises(KeyError):
        project.logged("r2")
    project.record_corpus("mr_ab1", spark.createDataFrame([("a.md", "d")], "source_path string, doc_id string"))
    project.record_corpus("mr_ab2", spark.createDataFrame([("a.md", "d")], "source_path string, doc_id string"))
    assert project.root_of("mr_ab1") == "mr_ab1"
    with pytest.raises(ValueError):
        project.root_of("mr_a")
    with pytest.raises(KeyError):
        project.root_of("mr_x")


def test_scenarios_find_their_cause(spark, tmp_path):
    scores = scorecard.run_scenarios(Project(spark, str(tmp_path / "p")), ("weights", "corpus"))
    assert all(s.regressed for s in scores.values())
    whole = scorecard.overall(scores)
    assert whole.fidelity == 1.0 and whole.noise_floor == 0.0 and whole.narrative_violations == 0 and whole.coverage >= 0.7
    assert not scorecard.Scores(0.9, 1, 1, 0, 0).passes() and scorecard.Scores(0.9, 1, 1, 0, 0.5).failures() == ["fidelity is 0.9, the bound is 0.995", "noise_floor is 0.5, the bound is 0.02"]
