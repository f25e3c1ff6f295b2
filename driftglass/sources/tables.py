"""Set operations of the content-addressed store: lookups, anti-join inserts, upserts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(keys: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(stored, key)


def missing(keys: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys that stored lacks."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(stored.select(key), key, "left_anti")


def require_all(keys: DataFrame, stored: DataFrame, key: str = "key") -> None:
    """KeyError naming how many keys are missing and the first of them."""
    n, first = missing(keys, stored, key).agg(F.count("*"), F.min(key)).first()
    if n:
        raise KeyError(f"{n} keys are missing, the first is {first}")


def insert_or_ignore(stored: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows to append: new keys only, the first by order of each."""
    rest = [c for c in rows.columns if c not in keys]
    new = rows.join(stored.select(*keys), keys, "left_anti")
    return new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def distinct_documents(rows: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path, n_paths): each content once, under its first path."""
    return rows.groupBy(key).agg(F.min(path).alias(path), F.count("*").alias("n_paths"))


def newest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the largest seq of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def upsert(stored: DataFrame, batch: DataFrame, key: str, position: str) -> DataFrame:
    """stored with batch laid over it; within the batch the last by position wins."""
    last = newest(batch, [key], position).drop(position)
    return stored.join(last, key, "left_anti").unionByName(last.select(*stored.columns))


def payload_paths(paths: DataFrame) -> DataFrame:
    """(doc_id, source_path): the first path of each document."""
    return paths.groupBy("doc_id").agg(F.min("source_path").alias("source_path"))


def kept_snapshots(snapshots: DataFrame, keep: int, pinned: list[str]) -> DataFrame:
    """Snapshot ids that retention spares: the newest keep and the pinned ones."""
    last = snapshots.orderBy(F.desc("seq")).limit(keep).select("snapshot_id")
    if not pinned:
        return last
    return last.unionByName(snapshots.where(F.col("snapshot_id").isin(*pinned)).select("snapshot_id")).distinct()


def gc_victims(snapshots: DataFrame, artifacts: DataFrame, keep: int, pinned: list[str]) -> DataFrame:
    """(uri) of artifacts that no kept snapshot uses; artifacts is (snapshot_id, uri)."""
    spared = artifacts.join(kept_snapshots(snapshots, keep, pinned), "snapshot_id", "left_semi").select("uri")
    return artifacts.select("uri").distinct().join(spared, "uri", "left_anti")


def resolve(snapshot_ids: list[str], ref: str) -> str:
    """latest, a whole id, or a prefix (snap_ may be left out) that fits one id; ids are in order of commit."""
    if ref == "latest":
        if not snapshot_ids:
            raise KeyError("there are no snapshots")
        return snapshot_ids[-1]
    found = [i for i in snapshot_ids if ref == i] or [i for i in snapshot_ids if i.startswith(ref) or i.startswith("snap_" + ref)]
    if len(set(found)) != 1:
        raise (ValueError if found else KeyError)(f"snapshot {ref!r} fits {len(set(found))} ids")
    return found[0]
