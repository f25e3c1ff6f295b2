"""Document fingerprints: a Merkle tree of paragraphs, sections and the document.

Paragraphs are lines. A section starts at a heading, after a blank line, or after a paragraph whose
hash starts with a zero digit (one in sixteen): cuts depend on content, so an insertion shifts no
later section. A section hashes its paragraphs' hashes, the root its sections'. Equal roots mean
equal texts; where roots differ, only differing sections need to be opened to find the edit.

Defined results: a NULL text has a NULL tree; an empty text is one empty paragraph; repeated rows
repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

SHOWN = 16  # hex digits of a node that the lists show


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tree(text: str) -> tuple[str, list[str], list[list[str]]]:
    """Root, section hashes, and the paragraph hashes of each section."""
    sections: list[list[str]] = []
    opens = True
    for p in text.split("\n"):
        h = _sha(p)
        if opens or p.startswith("#"):
            sections.append([])
        sections[-1].append(h)
        opens = not p.strip(" ") or h[0] == "0"
    nodes = [_sha("".join(s)) for s in sections]
    return _sha("".join(nodes)), nodes, sections


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("root", "n_sections", "n_paragraphs", "sections", "paragraphs")}
        for text in b.column(1).to_pylist():
            if text is None:
                for v in out.values():
                    v.append(None)
                continue
            root, nodes, leaves = tree(text)
            out["root"].append(root)
            out["n_sections"].append(len(nodes))
            out["n_paragraphs"].append(sum(map(len, leaves)))
            out["sections"].append(",".join(n[:SHOWN] for n in nodes))
            out["paragraphs"].append(";".join(",".join(p[:SHOWN] for p in s) for s in leaves))
        kinds = {"n_sections": pa.int64(), "n_paragraphs": pa.int64()}
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, n_sections, n_paragraphs, sections, paragraphs); paragraphs are grouped by section."""
    return docs.select("doc_id", "text").mapInArrow(_trees, "doc_id bigint, root string, n_sections bigint, n_paragraphs bigint, sections string, paragraphs string")


def edits(old: str, new: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, old start, old end, new start, new end) in paragraphs; old and new are paragraphs columns of trees."""
    a, b = old.split(";"), new.split(";")
    starts_a, starts_b = [0], [0]
    for parts, starts in ((a, starts_a), (b, starts_b)):
        for s in parts:
            starts.append(starts[-1] + s.count(",") + 1)
    out = []
    for kind, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        x, y = ",".join(a[i1:i2]).split(",") if i2 > i1 else [], ",".join(b[j1:j2]).split(",") if j2 > j1 else []
        for k, p1, p2, q1, q2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if k != "equal":
                out.append((k, starts_a[i1] + p1, starts_a[i1] + p2, starts_b[j1] + q1, starts_b[j1] + q2))
    return out


def locate_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, kind, old_start, old_end, new_start, new_end) where two tables of trees differ; equal roots are never opened."""
    a = old.selectExpr("doc_id", "root as old_root", "paragraphs as old")
    b = new.selectExpr("doc_id", "root as new_root", "paragraphs as new")
    changed = a.join(b, "doc_id").where("old_root <> new_root").select("doc_id", "old", "new")

    def open_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            rows = [(i, *e) for i, x, y in zip(*(c.to_pylist() for c in r.columns), strict=True) for e in edits(x, y)]
            names = ("doc_id", "kind", "old_start", "old_end", "new_start", "new_end")
            yield pa.RecordBatch.from_pydict({n: pa.array([row[k] for row in rows], pa.string() if n == "kind" else pa.int64()) for k, n in enumerate(names)})

    return changed.mapInArrow(open_branches, "doc_id bigint, kind string, old_start bigint, old_end bigint, new_start bigint, new_end bigint")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH lines AS (
  SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS p FROM documents),
leaves AS (
  SELECT k, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS i FROM lines WHERE text IS NOT NULL),
hashed AS (SELECT k, i, line, sha256(line) AS h FROM leaves),
opened AS (
  SELECT *, (i = 1 OR line LIKE '#%' OR trim(lag(line) OVER w, ' ') = '' OR lag(h) OVER w LIKE '0%')::INT AS opens
  FROM hashed WINDOW w AS (PARTITION BY k ORDER BY i)),
placed AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY i) AS s FROM opened),
sections AS (
  SELECT k, s, sha256(string_agg(h, '' ORDER BY i)) AS node, count(*) AS n, string_agg(substr(h, 1, 16), ',' ORDER BY i) AS shown
  FROM placed GROUP BY k, s),
trees AS (
  SELECT k, sha256(string_agg(node, '' ORDER BY s)) AS root, count(*) AS n_sections, sum(n)::BIGINT AS n_paragraphs,
    string_agg(substr(node, 1, 16), ',' ORDER BY s) AS sections, string_agg(shown, ';' ORDER BY s) AS paragraphs
  FROM sections GROUP BY k)
SELECT doc_id, root, n_sections, n_paragraphs, sections, paragraphs FROM lines LEFT JOIN trees USING (k)
"""
