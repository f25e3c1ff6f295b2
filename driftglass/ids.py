"""Content-addressed identities: Column builders and their driver twins."""

from __future__ import annotations

import functools
import hashlib
import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
DIGITS = 16


def digest(*parts: str | bytes) -> str:
    """Leading hex digits of SHA-256 over the separated parts."""
    raw = SEPARATOR.encode().join(p if isinstance(p, bytes) else p.encode("utf-8") for p in parts)
    return hashlib.sha256(raw).hexdigest()[:DIGITS]


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def doc_key(raw: bytes) -> str:
    return "doc_" + digest(raw)


def text_key(text: str) -> str:
    return "tx_" + digest(text)


def chunk_key(doc: str, start: int, end: int, text: str) -> str:
    return "ch_" + digest(doc, str(start), str(end), text)


def params_key(params: dict) -> str:
    return "ph_" + digest(canonical(params))


def vector_key(text_hash: str, provider: str, model: str, dims: int, params: str) -> str:
    return "emb_" + digest(text_hash, provider, model, str(dims), params)


def corpus_root(pairs: list[tuple[str, str]]) -> str:
    """Root over (source path, document id) pairs."""
    return "mr_" + digest(canonical(sorted([list(p) for p in pairs])))


def snapshot_key(core: dict) -> str:
    return "snap_" + digest(canonical(core))


def arm_key(assignment: dict[str, str]) -> str:
    return "arm_" + digest(canonical(dict(sorted(assignment.items()))))


def run_key(snapshot: str, dataset: str, mode: str, adapter: str, k_values) -> str:
    return "ev_" + digest(snapshot, dataset, mode, adapter, str(tuple(k_values)))


def diff_key(a: str, b: str, dataset: str) -> str:
    return "diff_" + digest(a, b, dataset)


def _hashed(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(column, 256), 1, DIGITS))


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def doc_key_col(content: Column) -> Column:
    return _hashed("doc_", content)


def text_key_col(text: Column) -> Column:
    return _hashed("tx_", text)


def chunk_key_col(doc: Column, start: Column, end: Column, text: Column) -> Column:
    return _hashed("ch_", _joined(doc, start, end, text))


def vector_key_col(text_hash: Column, provider: str, model: str, dims: int, params: str) -> Column:
    return _hashed("emb_", _joined(text_hash, provider, model, str(dims), params))


def corpus_root_col(path: Column, doc: Column) -> Column:
    """Aggregate twin of corpus_root; escapes of control characters are lower-cased as in the driver's JSON."""
    body = F.to_json(F.array_sort(F.collect_list(F.array(path, doc))))
    for code in (*range(8), 11, *range(14, 32)):
        if any(c in "abcdef" for c in f"{code:x}"):
            body = F.replace(body, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return _hashed("mr_", body)


def apart(df: DataFrame, *keys: str, row_bytes: int = 64, limit: int = 16 << 20) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys no other row has, and the rest; None where there is no rest. Only keys are shuffled to tell."""
    again = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    n = again.count()
    if not n:
        return df, None
    again = F.broadcast(again) if n * row_bytes <= limit else again
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")
