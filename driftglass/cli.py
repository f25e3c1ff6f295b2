"""Command line: python -m driftglass <command> --project DIR ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from driftglass.functions import questions
from driftglass.functions.providers import RequestFailed, parse_spec
from driftglass.operators import golden, metrics
from driftglass.plans import phase0, report, scorecard, workflows
from driftglass.plans import pipeline as pl
from driftglass.sources import adapters, scan
from driftglass.sources.project import Project

GRID = tuple(i / 10 for i in range(11))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftglass")
    top.add_argument("--project", default=".driftglass")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        p = sub.add_parser(name)
        for flags, options in args:
            p.add_argument(*flags, **options)

    o = lambda *flags, **kw: (flags, kw)
    yes, limit = o("--yes", action="store_true"), o("--max-cost", type=float)
    data, snap = o("dataset"), o("--snapshot", default="latest")
    command("init", o("--name", default=""), o("--dsn"), o("--adapter", default="local"), o("--source", default="docs"), o("--force", action="store_true"))
    command("ingest", o("path", nargs="?"), o("--chunker"), o("--chunk-params", default="{}"), o("--dims", type=int), o("--embedding"), o("--adapter"), yes, limit)
    command("snapshot", o("action", choices=["list", "show", "pin", "unpin"]), o("ref", nargs="?", default="latest"))
    command("dataset", o("action", choices=["generate", "import", "mine", "list", "show", "curate"]), o("--name", default="golden"), o("--from", dest="source"), o("--n", type=int, default=100), o("--seed", type=int, default=0), o("--reject", nargs="*"), o("--accept", nargs="*"), o("--edit-file"), o("--llm"), snap, yes, limit)
    command("eval", data, snap, o("--live", action="store_true"), o("--fail-if"), o("--gate"), o("-k", default="1,5,10"))
    command("calibrate", data, snap, o("--runs", type=int, default=3), o("--noise", type=float, default=0.0))
    command("diff", o("a"), o("b"), o("--dataset", required=True), o("--attribute", choices=["fast", "deep"], default="fast"), o("--arms", choices=["auto", "full"], default="auto"), o("--format", choices=["table", "md", "json", "html"], default="table"))
    command("compare-chunkers", data, o("path"), o("--from", dest="old", required=True), o("--to", dest="new", required=True), yes, limit)
    command("compare-embeddings", data, o("path"), o("--from", dest="old", required=True), o("--to", dest="new", required=True), yes, limit)
    command("attribute", o("a"), o("b"), o("--dataset", required=True), o("--arms", choices=["auto", "full"], default="auto"), o("--rule", choices=["rank1", "topk"], default="rank1"))
    command("report", o("a"), o("b"), o("--dataset", required=True), o("--format", choices=["md", "html", "json"], default="html"), o("-o", "--output", default="report.html"))
    command("scorecard", o("--scenario", action="append", choices=list(scorecard.SCENARIOS)))
    command("phase0", data, snap, o("--runs", type=int, default=3), o("--noise", type=float, default=0.0))
    command("sweep", data, snap, o("--grid", default=",".join(map(str, GRID))))
    command("drift", data, o("--against", required=True), snap)
    command("ci", data, o("path"), o("--base", default="latest"), o("-o", "--output", default="retrieval-report.md"))
    command("gc", o("--keep", type=int, default=5))
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("driftglass").getOrCreate()
    project = Project(spark, str(Path(args.project).absolute()))
    try:
        return COMMANDS[args.command.replace("-", "_")](project, args)
    except (KeyError, ValueError, FileNotFoundError, RequestFailed, workflows.CostRefused) as wrong:
        print(f"driftglass: {wrong.args[0] if wrong.args else wrong}", file=sys.stderr)
        return 2


def config(project: Project) -> dict:
    return project.load("meta", "config") or {}


def _init(project, a) -> int:
    if config(project) and not a.force:
        print("this project exists; --force starts it anew", file=sys.stderr)
        return 2
    index = {"adapter": a.adapter} | ({"dsn": a.dsn} if a.dsn else {})
    project.save("meta", "config", {"index": index, "source": a.source} | ({"name": a.name} if a.name else {}))
    return 0


def _pipeline(project, chunker=None, params=None, dims=None, spec=None) -> pl.Pipeline:
    c = {k: v for k, v in config(project).items() if k not in ("source", "name")}
    if chunker:
        c["chunker"] = {"tool": chunker, "params": params or {}}
    if dims:
        c["embedding"] = {"dims": dims, "params": pl.DEFAULTS["embedding"]["params"]}
    if spec:
        section = parse_spec(spec)
        c["embedding"] = ({"params": pl.DEFAULTS["embedding"]["params"]} if section["provider"] == "local" else {}) | section
    return pl.build(c)


def _ingest(project, a) -> int:
    p = _pipeline(project, a.chunker, json.loads(a.chunk_params), a.dims, a.embedding)
    scanned = scan.directory(project.spark, a.path or config(project).get("source", "docs"))
    workflows.allow_cost(workflows.embedding_cost(project, scanned, p)["usd"], a.max_cost, a.yes)
    known = project.snapshots()
    adapter = adapters.adapter_for(a.adapter, project) if a.adapter else None
    done = workflows.ingest(project, scanned, p, adapter, known[-1].snapshot_id if known else None)
    s = done.snapshot
    print(f"{s.snapshot_id}: {s.doc_count} documents, {s.chunk_count} chunks, {done.embed_calls} embedded, {done.reused_chunks} reused")
    return 0


def _snapshot(project, a) -> int:
    if a.action == "list":
        print(report.table([(s.snapshot_id, s.doc_count, s.chunk_count, s.parent or "") for s in project.snapshots()], ("snapshot", "documents", "chunks", "parent")))
    elif a.action == "show":
        print(json.dumps(project.snapshot(a.ref).to_dict(), indent=2, sort_keys=True))
    else:
        project.pin(project.snapshot(a.ref).snapshot_id, a.action == "pin")
    return 0


def _dataset(project, a) -> int:
    spark = project.spark
    if a.action == "list":
        print("\n".join(sorted(r[0] for r in project.read("cases").select("dataset_id").distinct().collect())))
        return 0
    if a.action == "show":
        print(report.table([(c.id, c.question, ",".join(c.expected_sources)) for c in project.cases(a.name).orderBy("id").collect()], ("id", "question", "expected")))
        return 0
    versions = [r[0] for r in project.read("cases").select("dataset_id").distinct().collect() if r[0].rpartition("-v")[0] == a.name]
    target = golden.bump(max(versions, key=lambda v: int(v.rpartition("-v")[2]))) if versions else f"{a.name}-v1"
    if a.action == "generate":
        s = project.snapshot(a.snapshot)
        paths = project.read("corpus_states").where(f"root = '{s.root}'").groupBy("doc_id").agg({"source_path": "max"}).withColumnRenamed("max(source_path)", "source")
        chunks = workflows.snapshot_chunks(project, s).join(paths, "doc_id").select("chunk_id", "doc_id", "source", "text")
        if a.llm:
            picked = golden.round_robin(chunks.select("doc_id", "chunk_id"), a.n, a.seed).select("chunk_id", "pick").join(chunks, "chunk_id")
            workflows.allow_cost(questions.question_cost(picked, a.llm).first().usd, a.max_cost, a.yes)
            cases = golden.from_questions(questions.ask_questions(picked, a.llm))
        else:
            cases = golden.generate(chunks, a.n, a.seed)
    elif a.action == "import":
        cases = golden.import_file(spark, a.source)
    elif a.action == "mine":
        cases = golden.mine_traces(golden.numbered(golden.read_lines(spark, a.source)))
    else:
        edits = spark.read.schema("id string, question string, expected_sources array<string>, tags array<string>").json(a.edit_file) if a.edit_file else spark.createDataFrame([], "id string, question string, expected_sources array<string>, tags array<string>")
        cases = golden.curate(project.cases(a.name).drop("dataset_id"), edits, a.accept, a.reject)
    project.save_cases(target, cases)
    print(f"{target}: {project.cases(target).count()} cases")
    return 0


def _eval(project, a) -> int:
    s, cases = project.snapshot(a.snapshot), project.cases(a.dataset).drop("dataset_id")
    k_values = tuple(int(k) for k in a.k.split(","))
    ev = workflows.evaluate(project, s, cases, k_values, adapters.LocalAdapter(project) if a.live else None)
    workflows.save_evaluation(project, ev, a.dataset, "live" if a.live else "replay", "local" if a.live else "none", k_values)
    print(report.table(sorted(ev.aggregate().items()), ("metric", "value")))
    if rule := a.fail_if or a.gate:
        from driftglass.operators.gating import threshold_gate

        verdict = threshold_gate(ev.per_query, rule)
        print("\n".join(verdict.reasons))
        return int(not verdict.passed)
    return 0


def _calibrate(project, a) -> int:
    record = workflows.calibrate(project, project.snapshot(a.snapshot), project.cases(a.dataset).drop("dataset_id"), adapters.LocalAdapter(project, a.noise), a.runs)
    print(f"epsilon {record['epsilon']:.6f} over {a.runs} runs")
    return 0


def _compared(project, a: str, b: str, dataset: str):
    cases = project.cases(dataset).drop("dataset_id")
    before, after = (workflows.evaluate(project, project.snapshot(x), cases) for x in (a, b))
    calibration = project.load("calibration", before.snapshot.snapshot_id)
    return cases, workflows.diff(project, before, after, dataset, epsilon=(calibration or {}).get("epsilon", 0.0)), calibration


def _diff(project, a) -> int:
    cases, d, calibration = _compared(project, a.a, a.b, a.dataset)
    causes = [r.asDict() for r in workflows.attribute(project, d, cases, a.arms)[1].collect()] if a.attribute == "deep" else []
    project.save("diff", d.diff_id, {"config": sorted(d.config), "deltas": d.deltas, "counts": d.counts()})
    if causes:
        project.save("attribution", d.diff_id, {"causes": causes})
    text = report.diff_markdown(d, None, calibration is not None, causes)
    print({"json": lambda: report.diff_json(d, None, causes), "md": lambda: text, "html": lambda: report.page(d.diff_id, text), "table": lambda: report.table(sorted(d.deltas.items()), ("metric", "change"))}[a.format]())
    return 0


def _compare(project, a, build) -> int:
    scanned, cases = scan.directory(project.spark, a.path), project.cases(a.dataset).drop("dataset_id")
    plans = [build(x) for x in (a.old, a.new)]
    usd = sum(workflows.embedding_cost(project, scanned, p)["usd"] for p in plans)
    workflows.allow_cost(usd, a.max_cost, a.yes)
    sides = [workflows.ingest(project, scanned, p).snapshot for p in plans]
    before, after = (workflows.evaluate(project, s, cases) for s in sides)
    d = workflows.diff(project, before, after, a.dataset)
    tags = cases.selectExpr("id as query_id", "explode(tags) as tag")
    deltas = metrics.tag_deltas(metrics.metric_deltas(before.per_query, after.per_query, "query_id"), tags).orderBy("tag", "metric").collect()
    print(report.table([(r.tag or "(all)", r.metric, r.n, r.delta) for r in deltas], ("tag", "metric", "queries", "change")))
    print(report.comparison(d, a.old, a.new, usd))
    from driftglass.operators.align import fate_counts

    print(report.table([tuple(r) for r in fate_counts(d.alignment).orderBy("fate").collect()], ("fate", "chunks")))
    return 0


def _compare_chunkers(project, a) -> int:
    return _compare(project, a, lambda x: _pipeline(project, json.loads(x)["tool"], json.loads(x).get("params")))


def _compare_embeddings(project, a) -> int:
    return _compare(project, a, lambda x: _pipeline(project, spec=x))


def _attribute(project, a) -> int:
    cases, d, _ = _compared(project, a.a, a.b, a.dataset)
    funnels, causes = workflows.attribute(project, d, cases, a.arms, a.rule)
    found = sorted((r.asDict() for r in causes.collect()), key=lambda c: (str(c["query_id"]), c["factor"]))
    project.save("attribution", d.diff_id, {"causes": found})
    fates = {r.chunk_id: r.asDict() for r in d.alignment.collect()}
    for f in sorted((r.asDict() for r in funnels.collect()), key=lambda f: str(f["query_id"])):
        print(f"{f['query_id']}: {report.narrative(f, fates.get(f['tracer']), [c for c in found if c['query_id'] == f['query_id']])}")
    return 0


def _report(project, a) -> int:
    _, d, calibration = _compared(project, a.a, a.b, a.dataset)
    causes = (project.load("attribution", d.diff_id) or {}).get("causes", [])
    made = {"md": lambda: report.diff_markdown(d, None, calibration is not None, causes), "html": lambda: report.query_page(d, causes), "json": lambda: report.diff_json(d, None, causes)}
    Path(a.output).write_text(made[a.format]())
    print(a.output)
    return 0


def _scorecard(project, a) -> int:
    scores = scorecard.run_scenarios(project, tuple(a.scenario or scorecard.SCENARIOS))
    rows = [(n, s.fidelity, s.stage_accuracy, s.coverage, s.narrative_violations, s.noise_floor, s.regressed) for n, s in [*scores.items(), ("overall", scorecard.overall(scores))]]
    print(report.table(rows, ("scenario", "fidelity", "stage accuracy", "coverage", "violations", "noise", "regressed")))
    wrong = scorecard.overall(scores).failures()
    print("\n".join(wrong) or "passed")
    return int(bool(wrong))


def _phase0(project, a) -> int:
    s = project.snapshot(a.snapshot)
    found = phase0.validate(project, s, project.cases(a.dataset).drop("dataset_id"), adapters.LocalAdapter(project, a.noise), a.runs)
    project.save("phase0", s.snapshot_id, found.to_dict())
    print(json.dumps(found.to_dict(), indent=2, sort_keys=True))
    return int(not found.stable())


def _sweep(project, a) -> int:
    swept = workflows.sweep(project, project.snapshot(a.snapshot), project.cases(a.dataset).drop("dataset_id"), [float(w) for w in a.grid.split(",")])
    print(report.table([tuple(r) for r in workflows.best_weights(swept).orderBy("metric").collect()], ("metric", "weight", "value")))
    return 0


def _drift(project, a) -> int:
    cases, d, _ = _compared(project, a.against, a.snapshot, a.dataset)
    traced = workflows.funnels(project, d, cases)
    rows = traced.join(workflows.distractors(d, traced), "query_id", "left").select("query_id", "tracer", "stage", "distractor").orderBy("query_id").collect()
    print(report.table([tuple(r) for r in rows], ("query", "tracer", "stage", "distractor")))
    return 0


def _ci(project, a) -> int:
    base = project.snapshot(a.base)
    new = workflows.ingest(project, scan.directory(project.spark, a.path), _pipeline(project), parent=base.snapshot_id).snapshot
    cases, d, calibration = _compared(project, base.snapshot_id, new.snapshot_id, a.dataset)
    verdict = workflows.gate(d, calibration, cases) if calibration else None
    Path(a.output).write_text(report.diff_markdown(d, verdict, calibration is not None))
    if verdict is not None:
        project.save("gate", d.diff_id, verdict.to_dict())
    return int(verdict is not None and not verdict.passed)


def _gc(project, a) -> int:
    print("\n".join(project.gc(a.keep)))
    return 0


COMMANDS = {n[1:]: f for n, f in list(globals().items()) if n in {"_init", "_ingest", "_snapshot", "_dataset", "_eval", "_calibrate", "_diff", "_compare_chunkers", "_compare_embeddings", "_sweep", "_drift", "_ci", "_gc", "_attribute", "_report", "_scorecard", "_phase0"}}
