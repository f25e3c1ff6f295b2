"""The versioned pipeline: stages, their DAG, snapshots of a corpus under it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from driftglass import ids

DEFAULTS = dict(
    parser=dict(tool="text-v1"),
    chunker=dict(tool="markdown_heading", params=dict(max_tokens=800, overlap=120)),
    embedding=dict(provider="local", model="hash-v1", dims=256, params=dict(seed=0, ngram=[1, 2])),
    index=dict(adapter="local"),
    retrieve=dict(top_k=10, hybrid=dict(sparse="bm25", fusion="weighted", bm25_weight=0.45)),
)


@dataclass(frozen=True)
class Stage:
    id: str
    tool: str
    version: str = "1"
    params: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self) | {"inputs": list(self.inputs)}

    @property
    def params_key(self) -> str:
        return ids.params_key(self.params)


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]

    def stage(self, name: str) -> Stage | None:
        return next((s for s in self.stages if s.id == name), None)

    def replace(self, stage: Stage) -> Pipeline:
        if self.stage(stage.id) is None:
            raise KeyError(stage.id)
        return Pipeline(tuple(stage if s.id == stage.id else s for s in self.stages))

    def validate(self) -> None:
        """ValueError on repeated ids, unknown inputs or a cycle."""
        known = [s.id for s in self.stages]
        if len(set(known)) < len(known):
            raise ValueError("stage ids repeat")
        open_ = {s.id: set(s.inputs) for s in self.stages}
        if unknown := {i for inputs in open_.values() for i in inputs} - set(known):
            raise ValueError(f"inputs {sorted(unknown)} are no stages")
        while ready := [i for i, inputs in open_.items() if not inputs]:
            for i in ready:
                del open_[i]
            for inputs in open_.values():
                inputs.difference_update(ready)
        if open_:
            raise ValueError(f"stages {sorted(open_)} form a cycle")

    def changed(self, other: Pipeline) -> dict[str, dict]:
        """Stages that differ, are new or are gone: name -> before and after."""
        names = dict.fromkeys([s.id for s in self.stages] + [s.id for s in other.stages])
        pairs = {n: (self.stage(n), other.stage(n)) for n in names}
        return {n: {"before": a and a.to_dict(), "after": b and b.to_dict()} for n, (a, b) in pairs.items() if a != b}

    def to_list(self) -> list[dict]:
        return [s.to_dict() for s in self.stages]

    @classmethod
    def from_list(cls, stages: list[dict]) -> Pipeline:
        return cls(tuple(Stage(**(s | {"inputs": tuple(s["inputs"])})) for s in stages))


def build(config: dict | None = None) -> Pipeline:
    """Six stages at most from a configuration whose sections lie over the defaults."""
    config = config or {}
    part = {k: v | (config.get(k) or {}) for k, v in DEFAULTS.items()}
    embed = part["embedding"]
    retrieve = {"top_k": int(part["retrieve"].get("top_k", 10))}
    if part["retrieve"].get("hybrid") is not None:
        retrieve["hybrid"] = dict(part["retrieve"]["hybrid"])
    stages = [
        Stage("parse", part["parser"]["tool"]),
        Stage("chunk", part["chunker"]["tool"], params=dict(part["chunker"].get("params") or {}), inputs=("parse",)),
        Stage("embed", embed["provider"], params={k: int(embed[k]) if k == "dims" else embed[k] for k in ("model", "provider", "dims")} | (embed.get("params") or {}), inputs=("chunk",)),
        Stage("index", part["index"]["adapter"], params={name: v for name, v in part["index"].items() if v is not None and name != "adapter"}, inputs=("embed",)),
        Stage("retrieve", "retrieve", params=retrieve, inputs=("index",)),
    ]
    if rerank := config.get("rerank"):
        stages.append(Stage("rerank", rerank.get("tool", "overlap"), params={"top_n": int(rerank.get("top_n", 10))} | (rerank.get("params") or {}), inputs=("retrieve",)))
    out = Pipeline(tuple(stages))
    out.validate()
    return out


def parse_key(stage: Stage) -> str:
    return ids.params_key({"tool": stage.tool, "version": stage.version, "params": stage.params})


def chunkset_key(root: str, parse: Stage, chunk: Stage) -> str:
    """The parser's tool is part of the key: the same chunker over another parse is another set."""
    return ids.digest(root, parse.tool, parse.params_key, chunk.tool, chunk.params_key)


def collection_name(root: str, pipeline: Pipeline, namespace: str | None = None) -> str:
    """Serving collections do not depend on how they are queried."""
    parts = [ids.canonical(pipeline.stage(s).to_dict()) for s in ("parse", "chunk", "embed", "index")]
    return "col_" + ids.digest(*([namespace] if namespace else []), root, *parts)


@dataclass(frozen=True)
class Snapshot:
    pipeline: Pipeline
    doc_count: int
    chunk_count: int
    root: str
    artifacts: dict[str, str]
    parent: str | None = None

    def core(self) -> dict:
        corpus = {"root": self.root, "doc_count": self.doc_count, "chunk_count": self.chunk_count}
        return {"artifacts": self.artifacts, "corpus": corpus, "pipeline": self.pipeline.to_list()}

    @property
    def snapshot_id(self) -> str:
        return ids.snapshot_key(self.core())

    def to_dict(self) -> dict:
        return self.core() | {"snapshot_id": self.snapshot_id, "parent": self.parent}

    @classmethod
    def from_dict(cls, d: dict) -> Snapshot:
        c = d["corpus"]
        return cls(Pipeline.from_list(d["pipeline"]), c["doc_count"], c["chunk_count"], c["root"], d["artifacts"], d.get("parent"))

    def with_pipeline(self, pipeline: Pipeline) -> Snapshot:
        return replace(self, pipeline=pipeline)


def compose(a: Snapshot, b: Snapshot, assignment: dict[str, str], order=("parse", "chunk", "embed", "index", "retrieve", "rerank")) -> Pipeline:
    """An arm's pipeline: assigned stages from the side named, all others from b; stages missing there are left out."""
    stages = []
    for name in order:
        side = a if assignment.get(name) == "A" else b
        if (s := side.pipeline.stage(name)) is not None:
            stages.append(s)
    known = {s.id for s in stages}
    return Pipeline(tuple(replace(s, inputs=tuple(i for i in s.inputs if i in known)) for s in stages))
