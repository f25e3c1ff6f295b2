"""A project on disk: Parquet tables for bulk artifacts, JSON lines for the few small records.

Tables are append-only and keyed by content, so a writer that dies leaves nothing half visible
(Spark's commit protocol) and a repeated write adds no rows. One writer at a time is assumed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.plans.pipeline import Snapshot
from driftglass.sources import tables

SCHEMAS = {
    "docs": "doc_id string, source_path string, parse_ph string, parsed_text string",
    "corpus_states": "root string, source_path string, doc_id string",
    "chunks": "chunkset_key string, doc_id string, ordinal bigint, span_start bigint, span_end bigint, text string, text_hash string, chunk_id string",
    "embeddings": "model_key string, key string, dims int, vector array<float>",
    "query_embeddings": "key string, dims int, vector array<float>",
    "records": "kind string, key string, seq bigint, body string",
    "cases": "dataset_id string, id string, question string, expected_sources array<string>, tags array<string>, origin string, source_trace string",
    "evals": "run_id string, snapshot_id string, query_id string, metric string, value double",
    "candidates": "run_id string, query_id string, stage string, rank int, chunk_id string, score double",
    "collections": "collection string, id string, vector array<float>, payload string",
}
PARTITIONED = {"docs": "parse_ph", "corpus_states": "root", "chunks": "chunkset_key", "embeddings": "model_key", "records": "kind", "cases": "dataset_id", "evals": "run_id", "candidates": "run_id", "collections": "collection"}


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        """A table by its declared schema; empty before its first write."""
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        w = rows.select(*columns).write.mode("append")
        (w.partitionBy(PARTITIONED[name]) if name in PARTITIONED else w).parquet(self.path(name))

    def replace_partition(self, name: str, rows: DataFrame) -> None:
        columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITIONED[name]).parquet(self.path(name))

    def drop_partition(self, name: str, value: str) -> None:
        self.drop_path(f"{self.path(name)}/{PARTITIONED[name]}={value}")

    def drop_path(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # -- documents, chunks, vectors

    def add_documents(self, docs: DataFrame) -> None:
        keys = ["doc_id", "source_path", "parse_ph"]
        self.append("docs", docs.dropDuplicates(keys).join(self.read("docs").select(*keys), keys, "left_anti"))

    def record_corpus(self, root: str, pairs: DataFrame) -> None:
        if not self.read("corpus_states").where(F.col("root") == root).head(1):
            self.append("corpus_states", pairs.select(F.lit(root).alias("root"), "source_path", "doc_id"))

    def documents_of(self, root: str, parse_ph: str) -> DataFrame:
        states = self.read("corpus_states").where(F.col("root") == root).select("source_path", "doc_id")
        return states.join(self.read("docs").where(F.col("parse_ph") == parse_ph), ["source_path", "doc_id"])

    def chunks(self, key: str) -> DataFrame:
        if not self.has_chunks(key):
            raise KeyError(f"no chunk set {key}")
        return self.read("chunks").where(F.col("chunkset_key") == key)

    def has_chunks(self, key: str) -> bool:
        return self.exists(f"chunks/chunkset_key={key}")

    def vectors(self, keyed: DataFrame, model_key: str) -> DataFrame:
        """keyed with vector; KeyError where vectors are missing."""
        stored = self.read("embeddings").where(F.col("model_key") == model_key).select("key", "vector")
        tables.require_all(keyed, stored)
        return keyed.join(stored, "key")

    # -- small records

    def _records(self, kind: str) -> DataFrame:
        return self.read("records").where(F.col("kind") == kind)

    def save(self, kind: str, key: str, body: dict) -> None:
        """A new version of a record; the latest is the one that is read."""
        seq = (self._records(kind).agg(F.max("seq")).first()[0] or 0) + 1
        self.append("records", self.spark.createDataFrame([(kind, key, seq, ids.canonical(body))], SCHEMAS["records"]))

    def load(self, kind: str, key: str) -> dict | None:
        row = self._records(kind).where(F.col("key") == key).orderBy(F.desc("seq")).head(1)
        return json.loads(row[0].body) if row else None

    def list(self, kind: str) -> list[tuple[str, dict]]:
        """(key, latest body) in order of first save."""
        rows = self._records(kind).groupBy("key").agg(F.min("seq").alias("first"), F.max_by("body", "seq").alias("body")).orderBy("first").collect()
        return [(r.key, json.loads(r.body)) for r in rows]

    # -- snapshots

    def commit(self, snapshot: Snapshot) -> Snapshot:
        """Idempotent: a snapshot known already keeps its first parent."""
        snapshot.pipeline.validate()
        known = self.load("snapshot", snapshot.snapshot_id)
        if known is not None:
            return Snapshot.from_dict(known)
        self.save("snapshot", snapshot.snapshot_id, snapshot.to_dict())
        return snapshot

    def snapshots(self) -> list[Snapshot]:
        return [Snapshot.from_dict(b) for _, b in self.list("snapshot") if not b.get("dropped")]

    def snapshot(self, ref: str = "latest") -> Snapshot:
        found = {s.snapshot_id: s for s in self.snapshots()}
        return found[tables.resolve(list(found), ref)]

    def pin(self, snapshot_id: str, on: bool = True) -> None:
        pinned = set((self.load("meta", "pinned") or {"ids": []})["ids"])
        self.save("meta", "pinned", {"ids": sorted(pinned | {snapshot_id} if on else pinned - {snapshot_id})})

    def pinned(self) -> list[str]:
        return (self.load("meta", "pinned") or {"ids": []})["ids"]

    def gc(self, keep: int = 5) -> list[str]:
        """Drops snapshots beyond the newest keep and the pinned, and chunk sets and vectors that no other uses; metadata first."""
        all_ = self.snapshots()
        spared = {s.snapshot_id for s in all_[len(all_) - keep :]} | set(self.pinned())
        gone = [s for s in all_ if s.snapshot_id not in spared]
        used = {u for s in all_ if s.snapshot_id in spared for u in s.artifacts.values()}
        for s in gone:
            self.save("snapshot", s.snapshot_id, s.to_dict() | {"dropped": True})
        victims = sorted({u for s in gone for u in s.artifacts.values()} - used)
        for u in victims:
            name, _, value = u.partition("/")
            self.drop_partition(name, value)
        return victims

    # -- logged runs

    def logged(self, run_id: str) -> DataFrame:
        """(query_id, stage, rank, chunk_id, score) as a run recorded them; KeyError where none did."""
        rows = self.read("candidates").where(F.col("run_id") == run_id)
        if not rows.head(1):
            raise KeyError(f"no run {run_id}")
        return rows.select("query_id", "stage", "rank", "chunk_id", "score")

    def root_of(self, prefix: str) -> str:
        """The one corpus root that begins with prefix."""
        roots = [r.root for r in self.read("corpus_states").select("root").distinct().collect()]
        found = [r for r in roots if r == prefix] or [r for r in roots if r.startswith(prefix)]
        if len(found) != 1:
            raise (ValueError if found else KeyError)(f"the root {prefix!r} fits {len(found)} corpora")
        return found[0]

    # -- golden sets

    def save_cases(self, dataset_id: str, cases: DataFrame) -> None:
        self.replace_partition("cases", cases.withColumn("dataset_id", F.lit(dataset_id)))

    def cases(self, name: str) -> DataFrame:
        """A dataset by id, else the newest version of a name."""
        rows = self.read("cases")
        known = [r[0] for r in rows.select("dataset_id").distinct().collect()]
        if name not in known:
            versions = [(int(d.rpartition("-v")[2]), d) for d in known if d.rpartition("-v")[0] == name]
            if not versions:
                raise KeyError(f"no dataset {name}")
            name = max(versions)[1]
        return rows.where(F.col("dataset_id") == name)
