"""Serving adapters: where a snapshot's vectors are put to be queried live."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.operators import retrieve
from driftglass.sources import tables
from driftglass.sources.project import Project


@dataclass(frozen=True)
class Capability:
    exact: bool = False
    supports_rebuild: bool = False


class Adapter(ABC):
    @abstractmethod
    def capabilities(self) -> Capability: ...

    @abstractmethod
    def ensure(self, collection: str, dims: int) -> None: ...

    @abstractmethod
    def upsert(self, collection: str, rows: DataFrame) -> None:
        """rows (id, vector, payload, pos): known ids are replaced, the last by pos wins."""

    @abstractmethod
    def query(self, collection: str, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) for queries (query_id, vector)."""

    @abstractmethod
    def count(self, collection: str) -> int: ...

    @abstractmethod
    def drop(self, collection: str) -> None: ...

    def rebuild(self, collection: str, seed: int) -> None:
        """Index again; exact adapters have nothing to do."""

    def close(self) -> None:
        pass


class LocalAdapter(Adapter):
    """Exact search over a Parquet collection; noise above 0 imitates an approximate index, seeded per rebuild."""

    def __init__(self, project: Project, noise: float = 0.0, seed: int = 0):
        self.project, self.noise, self.seed, self.dims = project, noise, seed, {}

    def capabilities(self) -> Capability:
        return Capability(exact=self.noise == 0, supports_rebuild=True)

    def ensure(self, collection: str, dims: int) -> None:
        self.dims[collection] = dims

    def _rows(self, collection: str) -> DataFrame:
        return self.project.read("collections").where(F.col("collection") == collection)

    def upsert(self, collection: str, rows: DataFrame) -> None:
        dims = self.dims.get(collection)
        if dims is not None and rows.where(F.size("vector") != dims).head(1):
            raise ValueError(f"collection {collection} takes vectors of {dims} dimensions")
        merged = tables.upsert(self._rows(collection).select("id", "vector", "payload"), rows, "id", "pos")
        # the partition is read and rewritten, so the merged rows are written aside first
        aside = f"{self.project.path('collections_aside')}/{uuid.uuid4().hex}"
        merged.withColumn("collection", F.lit(collection)).write.parquet(aside)
        self.project.replace_partition("collections", self.project.spark.read.parquet(aside))
        self.project.drop_path(aside)

    def query(self, collection: str, queries: DataFrame, top_k: int) -> DataFrame:
        if not self.count(collection):
            raise KeyError(f"no collection {collection}")
        chunks = self._rows(collection).select(F.col("id").alias("chunk_id"), "vector")
        if top_k <= 0 or not self.noise:
            return retrieve.dense_topk(queries, chunks, max(top_k, 1)).where(F.lit(top_k > 0))
        return retrieve.noisy_topk(queries, chunks, top_k, self.noise, self.seed, collection)

    def count(self, collection: str) -> int:
        return self._rows(collection).count()

    def drop(self, collection: str) -> None:
        self.project.drop_partition("collections", collection)

    def rebuild(self, collection: str, seed: int) -> None:
        self.seed = seed


def point_id(chunk_id: str) -> str:
    """A UUID for stores that take no free ids."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, chunk_id))


class ServerAdapter(Adapter):
    """An adapter whose client library or server is not part of this environment; it fails when first used."""

    def __init__(self, kind: str, **options):
        self.kind, self.options = kind, options

    def _absent(self, *_, **__):
        raise RuntimeError(f"the {self.kind} client is not installed here")

    capabilities = ensure = upsert = query = count = drop = _absent


class PgVectorSql:
    """The statements of a pgvector collection, for a connection of the caller's."""

    def __init__(self, table: str, dims: int, lists: int = 100):
        if not table.isidentifier():
            raise ValueError(f"{table!r} cannot name a table")
        self.table, self.dims, self.lists = table, dims, lists

    def create(self) -> list[str]:
        return [
            "CREATE EXTENSION IF NOT EXISTS vector",
            f"CREATE TABLE IF NOT EXISTS {self.table} (id text PRIMARY KEY, embedding vector({self.dims}), payload jsonb)",
            f"CREATE INDEX IF NOT EXISTS {self.table}_ivf ON {self.table} USING ivfflat (embedding vector_cosine_ops) WITH (lists = {self.lists})",
        ]

    def upsert(self) -> str:
        return f"INSERT INTO {self.table} (id, embedding, payload) VALUES (%s, %s, %s) ON CONFLICT (id) DO UPDATE SET embedding = EXCLUDED.embedding, payload = EXCLUDED.payload"

    def query(self) -> str:
        return f"SELECT id, 1 - (embedding <=> %s) AS score FROM {self.table} ORDER BY embedding <=> %s LIMIT %s"

    def reindex(self) -> str:
        return f"REINDEX INDEX {self.table}_ivf"


def adapter_for(kind: str, project: Project, **options) -> Adapter:
    return LocalAdapter(project, **options) if kind == "local" else ServerAdapter(kind, **options)
