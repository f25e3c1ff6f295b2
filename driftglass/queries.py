"""Registered queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.functions import stats, text, vectors
from driftglass.operators import align, attribution, gating, golden, metrics, retrieve
from driftglass.plans import scorecard, workflows
from driftglass.sources import tables as store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x{85}\p{Z}]"
DIGITS = 6


class Tables:
    """The test tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.kept = spark, sf_dir, {}

    def keep(self, name, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several branches of one plan read, computed once."""
        if name not in self.kept:
            self.kept[name] = make().persist()
        return self.kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r(c, digits: int = DIGITS):
    return F.round(c, digits)


SQL_PATH = "source || '/' || doc_id::VARCHAR"
PATHED = f"paths AS (SELECT *, {SQL_PATH} AS path, 'doc_' || substr(sha256(text), 1, 16) AS doc_key FROM documents)"


def pathed(t: Tables) -> DataFrame:
    return t.documents.withColumn("path", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).withColumn("doc_key", ids.doc_key_col(F.col("text")))


# -- text ---------------------------------------------------------------------------------------

SQL_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query("p1_parse_text", f"""
SELECT doc_id, sha256(array_to_string(list_transform(string_split(replace(replace(replace(text, chr(10), '  ' || chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda l: regexp_replace(l, '{WS}+$', '')), chr(10))) AS parsed FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(text.parse_text(F.replace("text", F.lit("\n"), F.lit("  \r\n"))), 256).alias("parsed"))


@query("p2_parse_markdown")
def _(t):
    marked = F.concat(F.lit("## **"), F.replace("text", F.lit("\n"), F.lit("**\n# __x__ ")), F.lit("\n"))
    return t.documents.select("doc_id", text.parse_markdown(marked).alias("parsed"))


@query("p3_terms", f"SELECT doc_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS joined FROM (SELECT doc_id, {SQL_TERMS.format('text')} AS w FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.terms(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("joined"))


@query("p4_ascii_words", "SELECT doc_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS joined FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.ascii_words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("joined"))


def sql_tokens(source: str) -> str:
    """CTE tok over source (doc_id, text): tokens i from 0 with spans, headings and sections."""
    return f"""
m AS (SELECT doc_id, text, regexp_extract_all(text, '{WS}*{NOT_WS}+') AS a FROM {source}),
x AS (SELECT doc_id, text, unnest(a) AS g, unnest(range(len(a))) AS i FROM m),
y AS (SELECT doc_id, text, i, g, regexp_replace(g, '^{WS}+', '') AS tok, (sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM x),
z AS (SELECT doc_id, text, i, tok, e - length(tok) AS s, e, substr(g, 1, length(g) - length(tok)) AS gap, substr(text, e + 1, 1) AS nx FROM y),
h AS (SELECT *, (regexp_full_match(tok, '#{{1,6}}') AND (s = 0 OR gap LIKE '%' || chr(10)) AND nx IN (' ', chr(9), chr(10), ''))::INT AS hd FROM z),
tok AS (SELECT *, sum(hd) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h)"""


def sql_chunks(name: str, size: int, overlap: int, by_section: bool = False, tok: str = "tok") -> str:
    """CTEs ending in name (doc_id, ordinal, span_start, span_end, text, chunk_id)."""
    sec = "sec" if by_section else "0"
    step = size - overlap
    return f"""
{name}_i AS (SELECT doc_id, text, {sec} AS sec, s, e, row_number() OVER (PARTITION BY doc_id, {sec} ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY doc_id, {sec}) AS n FROM {tok}),
{name}_k AS (SELECT *, unnest(range(greatest(0, (j - {size} + {step}) // {step}), least(j // {step}, CASE WHEN n <= {size} THEN 0 ELSE (n - {size} + {step} - 1) // {step} END) + 1)) AS c FROM {name}_i),
{name}_w AS (SELECT doc_id, sec, c, min(s) AS span_start, max(e) AS span_end, any_value(text) AS whole FROM {name}_k GROUP BY ALL),
{name} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, c) - 1 AS ordinal, span_start, span_end, substr(whole, span_start + 1, span_end - span_start) AS text,
  'ch_' || substr(sha256(concat_ws(chr(31), doc_id::VARCHAR, span_start::VARCHAR, span_end::VARCHAR, substr(whole, span_start + 1, span_end - span_start))), 1, 16) AS chunk_id FROM {name}_w)"""


@query("p5_token_spans", f"WITH {sql_tokens('documents')} SELECT doc_id, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM tok GROUP BY doc_id")
def _(t):
    return text.chunk(t.documents, "fixed_token", {"max_tokens": 1, "overlap": 0}).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("span_start").alias("starts"), F.sum("span_end").alias("ends"))


@query("p6_fixed_token_chunks", f"WITH {sql_tokens('documents')}, {sql_chunks('c', 64, 8)} SELECT doc_id, ordinal, span_start, span_end, chunk_id FROM c")
def _(t):
    return text.chunk(t.documents, "fixed_token", {"max_tokens": 64, "overlap": 8}).select("doc_id", "ordinal", "span_start", "span_end", "chunk_id")


@query("p7_heading_chunks", f"WITH headed AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS text FROM documents), {sql_tokens('headed')}, {sql_chunks('c', 48, 0, True)} SELECT doc_id, ordinal, span_start, span_end, chunk_id FROM c")
def _(t):
    headed = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))
    return text.chunk(headed, "markdown_heading", {"max_tokens": 48, "overlap": 0}).select("doc_id", "ordinal", "span_start", "span_end", "chunk_id")


@query("p8_sentence_chunks")
def _(t):
    return text.chunk(t.documents, "sentence", {"max_sentences": 3}).select("doc_id", "ordinal", "span_start", "span_end", "chunk_id")


@query("p11_distinct_documents", f"WITH {PATHED} SELECT doc_key, min(path) AS path, count(*) AS n_paths FROM paths GROUP BY doc_key")
def _(t):
    return store.distinct_documents(pathed(t), "doc_key", "path")


@query("p12_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", r(F.aggregate(vectors.l2_normalise(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("p17_cost_estimate", "SELECT sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) / 1000 * 0.02, 6) AS usd, round(sum(length(text) // 4) / 5000, 6) AS seconds FROM (SELECT DISTINCT text FROM documents)")
def _(t):
    return workflows.cost_of(t.documents.select("text").distinct(), 0.02, local=False).select("tokens", r("usd").alias("usd"), r("seconds").alias("seconds"))


@query("p19_top_directory", f"WITH {PATHED} SELECT doc_id, split_part(path, '/', 1) AS tag FROM paths")
def _(t):
    return pathed(t).select("doc_id", golden.top_directory(F.col("path")).alias("tag"))


@query("p20_collapse", f"SELECT conv_id, turn, trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) AS question FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.collapse(F.col("text")).alias("question"))


@query("x1_identities", f"WITH {PATHED} SELECT path, doc_key, 'tx_' || substr(sha256(text), 1, 16) AS text_key, 'emb_' || substr(sha256(concat_ws(chr(31), 'tx_' || substr(sha256(text), 1, 16), 'local', 'hash-v1', '256', 'ph_0')), 1, 16) AS vector_key FROM paths")
def _(t):
    key = ids.text_key_col(F.col("text"))
    return pathed(t).select("path", "doc_key", key.alias("text_key"), ids.vector_key_col(key, "local", "hash-v1", 256, "ph_0").alias("vector_key"))


@query("x2_corpus_root", f"WITH {PATHED} SELECT 'mr_' || substr(sha256('[' || string_agg('[\"' || path || '\",\"' || doc_key || '\"]', ',' ORDER BY path, doc_key) || ']'), 1, 16) AS root FROM paths")
def _(t):
    return pathed(t).agg(ids.corpus_root_col(F.col("path"), F.col("doc_key")).alias("root"))


@query("x31_sentences", f"SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{WS}', ' ', 'g')) <> '')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("bigint").alias("n"))


# -- embedding and store ------------------------------------------------------------------------


@query("h3_hash_embedding")
def _(t):
    return t.documents.select("doc_id", vectors.to_half(vectors.HashEmbedder().column(F.col("text"))).alias("vector"))


@query("h3_sha_embedding", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
v AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS v FROM w),
s AS (SELECT doc_id, (v // 2) % 32 AS place, sum(CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END) AS x FROM v GROUP BY ALL)
SELECT doc_id, place, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS n FROM s) WHERE x <> 0""")
def _(t):
    rows = vectors.sha_embedding(t.documents, "doc_id", 32).select("doc_id", F.posexplode("vector").alias("place", "x"))
    return rows.where("x <> 0").select("doc_id", F.col("place").cast("bigint").alias("place"), (r("x") + F.lit(0.0)).alias("x"))


@query("s3_vector_lookup", "SELECT d.doc_id, e.label, len(e.embedding) AS dims FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def _(t):
    return store.lookup(t.documents.select(F.col("doc_id").alias("key")), t.embeddings.withColumnRenamed("vec_id", "key")).select(F.col("key").alias("doc_id"), "label", F.size("embedding").cast("bigint").alias("dims"))


@query("s4_missing_vectors", "SELECT count(*) AS n, min(doc_id) AS first FROM documents d WHERE NOT EXISTS (FROM embeddings e WHERE e.vec_id = d.doc_id)")
def _(t):
    return store.missing(t.documents.select(F.col("doc_id").alias("key")), t.embeddings.withColumnRenamed("vec_id", "key")).agg(F.count("*").alias("n"), F.min("key").alias("first"))


@query("s5_documents_of_corpus", "SELECT source, lang, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def _(t):
    return store.newest(t.documents, ["source", "lang"], "doc_id").select("source", "lang", "doc_id", "n_chars")


@query("k1_insert_or_ignore", f"WITH {PATHED} SELECT doc_key, path, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY doc_id) AS k FROM paths WHERE doc_key NOT IN (SELECT doc_key FROM paths WHERE doc_id % 3 = 0)) WHERE k = 1")
def _(t):
    p = pathed(t).select("doc_key", "path", "doc_id")
    return store.insert_or_ignore(p.where("doc_id % 3 = 0"), p, ["doc_key"], "doc_id")


@query("k4_missing_keys", "SELECT DISTINCT label FROM embeddings WHERE label NOT IN (SELECT quality FROM labels WHERE quality IS NOT NULL)")
def _(t):
    return store.missing(t.embeddings.select(F.col("label").alias("key")), t.labels.select(F.col("quality").alias("key"))).select(F.col("key").alias("label"))


@query("k10_gc_victims", """
WITH snap AS (SELECT source, max(doc_id) AS seq FROM documents GROUP BY source),
kept AS (SELECT source FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS k FROM snap) WHERE k <= 5 UNION SELECT 'src3'),
uris AS (SELECT DISTINCT source, substr(sha256(text), 1, 2) AS uri FROM documents)
SELECT uri FROM uris WHERE source NOT IN (FROM kept) EXCEPT SELECT uri FROM uris WHERE source IN (FROM kept)""")
def _(t):
    snaps = t.documents.groupBy(F.col("source").alias("snapshot_id")).agg(F.max("doc_id").alias("seq"))
    uris = t.documents.select(F.col("source").alias("snapshot_id"), F.substring(F.sha2("text", 256), 1, 2).alias("uri")).distinct()
    return store.gc_victims(snaps, uris, keep=5, pinned=["src3"])


@query("c7_upsert", """
SELECT vec_id AS id, label FROM (SELECT vec_id, label + 100 AS label FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 3)""")
def _(t):
    old = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return store.upsert(old, old.where("label < 3").select("id", (F.col("label") + 100).alias("label"), F.lit(1).alias("pos")), "id", "pos")


@query("c10_payload", f"WITH {PATHED} SELECT doc_key, min(path) AS source_path FROM paths GROUP BY doc_key")
def _(t):
    return store.payload_paths(pathed(t).select(F.col("doc_key").alias("doc_id"), F.col("path").alias("source_path"))).select(F.col("doc_id").alias("doc_key"), "source_path")


@query("s9_foreign_records", f"SELECT format('q_{{:03d}}', row_number() OVER (ORDER BY item_id)) AS id, text AS question, len([text]) AS n_sources FROM benchmark")
def _(t):
    lines = t.benchmark.select(F.row_number().over(Window.orderBy("item_id")).alias("n"), F.to_json(F.struct(F.col("text").alias("question"), F.array("text").alias("reference_contexts"))).alias("value"))
    return golden.map_records(golden.numbered(lines)).select("id", "question", F.size("expected_sources").cast("bigint").alias("n_sources"))


@query("s10_mine_traces", "SELECT format('q_{:03d}', row_number() OVER (ORDER BY conv_id, turn)) AS id, text AS question, conv_id::VARCHAR AS source_trace FROM conversations WHERE role = 'user'")
def _(t):
    users = t.conversations.where("role = 'user'").select(F.row_number().over(Window.orderBy("conv_id", "turn")).alias("n"), F.to_json(F.struct(F.col("text").alias("query"), F.col("conv_id").cast("string").alias("trace_id"))).alias("value"))
    return golden.mine_traces(golden.numbered(users)).select("id", "question", "source_trace")


@query("a13_stratify", "SELECT lang AS tag, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    return metrics.stratify(t.documents.select(F.col("lang").alias("tag")))


@query("a31_corpus_counts", f"WITH {sql_tokens('documents')}, {sql_chunks('c', 64, 8)} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM c) AS chunks")
def _(t):
    return t.documents.agg(F.count("*").alias("docs")).crossJoin(text.chunk(t.documents, "fixed_token", {"max_tokens": 64, "overlap": 8}).agg(F.count("*").alias("chunks")))


# -- retrieval ----------------------------------------------------------------------------------


def knn(t: Tables, depth: int | None = 20) -> DataFrame:
    v = t.embeddings
    return retrieve.dense_topk(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), depth, DIGITS)


SQL_COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0"
SQL_KNN = f"""
knn AS (SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {SQL_COSINE} AS score FROM embeddings a, embeddings b)) WHERE rank <= 20)"""


@query("j1_exact_knn", f"WITH {SQL_KNN} SELECT * FROM knn")
def _(t):
    return knn(t).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("c2_noisy_knn", """
WITH s AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a, embeddings b),
u AS (SELECT q, c, x, (('0x' || substr(sha256(concat_ws(':', '7', 'vectors', 'u', q::VARCHAR, c::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0 AS u,
  (('0x' || substr(sha256(concat_ws(':', '7', 'vectors', 'v', q::VARCHAR, c::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0 AS v FROM s),
n AS (SELECT q, c, round(x + 0.05 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) AS score FROM u)
SELECT q AS query_id, c AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM n) WHERE rank <= 10""")
def _(t):
    v = t.embeddings
    q, c = (v.select(F.col("vec_id").alias(k), F.col("embedding").alias("vector")) for k in ("query_id", "chunk_id"))
    return retrieve.noisy_topk(q, c, 10, 0.05, 7, "vectors", DIGITS).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), "text")


def bm25(t: Tables, k1: float = 1.5, b: float = 0.75, depth: int = 20) -> DataFrame:
    return t.keep(("bm25", k1, b, depth), lambda: retrieve.Bm25(corpus(t), k1, b).topk(questions(t), depth, DIGITS))


def sql_bm25(name: str, k1: float = 1.5, b: float = 0.75, depth: int = 20, base: bool = True) -> str:
    head = f"""
dt AS (SELECT doc_id, {SQL_TERMS.format('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT item_id, unnest({SQL_TERMS.format('text')}) AS term FROM benchmark),""" if base else ""
    return f"""{head}
{name}_s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * {k1 + 1} / (f + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {depth})"""


@query("j2_bm25_top20", f"WITH {sql_bm25('s')} SELECT * FROM s")
def bm25_top20(t):
    return bm25(t).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("a2_document_frequency", f"WITH t AS (SELECT doc_id, unnest({SQL_TERMS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term")
def _(t):
    tf = retrieve.Bm25(corpus(t)).frequencies()
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("a3_corpus_lengths", f"SELECT count(*) AS n, round(sum(len({SQL_TERMS.format('text')})) / count(*), 6) AS avgdl FROM documents")
def _(t):
    return retrieve.Bm25(corpus(t)).corpus().select("n", r("avgdl").alias("avgdl"))


# dense side: cosines of hash-embedded passages and documents; sparse side: BM25 of the same texts
VECTOR_DIMS = 64
SQL_DENSE = f"""
ew AS (SELECT 'c' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
ev AS (SELECT side, id, (v // 2) % {VECTOR_DIMS} AS place, sum(CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT side, id, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS v FROM ew) GROUP BY ALL),
en AS (SELECT side, id, CASE WHEN sum(x * x) = 0 THEN 1 ELSE sqrt(sum(x * x)) END AS n FROM ev GROUP BY ALL),
ed AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.x * c.x) AS dot FROM ev q JOIN ev c USING (place) WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL),
es AS (SELECT q.id AS query_id, c.id AS chunk_id, round(coalesce(dot, 0) / (q.n * c.n), 6) + 0.0 AS score FROM en q JOIN en c ON q.side = 'q' AND c.side = 'c' LEFT JOIN ed ON ed.query_id = q.id AND ed.chunk_id = c.id),
d AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM es) WHERE rank <= 20)"""
SQL_SIDES = f"{SQL_DENSE}, {sql_bm25('s')}"


def sql_joined(dense: str, sparse: str, name: str) -> str:
    """Both lists in one table with their ranks and min-max scores."""
    normal = lambda x, side: f"{name}{x} AS (SELECT query_id, chunk_id, rank AS {x}r, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS {x}v FROM {side} WINDOW w AS (PARTITION BY query_id))"
    return f"""
{normal('d', dense)},
{normal('s', sparse)},
{name} AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, dr, dv, sr, sv FROM {name}d x FULL JOIN {name}s y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id)"""


SQL_NORMAL = sql_joined("d", "s", "b")


def sql_fused(score: str, name: str = "f", joined: str = "b") -> str:
    return f"{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, chunk_id) AS rank FROM (SELECT *, round({score}, 6) AS score FROM {joined}))"


def sql_reranked(fused: str, name: str, window: int) -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM (
  SELECT query_id, chunk_id, rank AS before, round(len(list_intersect(list_distinct({SQL_TERMS.format('q.text')}), list_distinct({SQL_TERMS.format('d2.text')}))) / greatest(len(list_distinct({SQL_TERMS.format('q.text')})), 1), 6) AS score
  FROM {fused} JOIN benchmark q ON q.item_id = query_id JOIN documents d2 ON d2.doc_id = chunk_id WHERE rank <= {window}))"""


WEIGHTED = "0.55 * coalesce(dv, 0) + 0.45 * coalesce(sv, 0)"


def embedded(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(query_id, vector) and (chunk_id, vector) of the passages and the documents."""
    q = vectors.sha_embedding(questions(t), "query_id", VECTOR_DIMS)
    return q, vectors.sha_embedding(corpus(t), "chunk_id", VECTOR_DIMS)


def dense(t: Tables) -> DataFrame:
    return t.keep("dense", lambda: retrieve.dense_topk(*embedded(t), 20, DIGITS))


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return dense(t), bm25(t)


@query("h5_run_query", f"""
WITH {SQL_SIDES}, {SQL_NORMAL}, {sql_fused(WEIGHTED)}, {sql_reranked('f', 'o', 5)}
{' UNION ALL '.join(f"SELECT query_id, '{stage}' AS stage, rank, chunk_id, score FROM {x}" for stage, x in (('dense', 'd'), ('sparse', 's'), ('fused', 'f'), ('reranked', 'o'), ('final', 'o')))}""")
def _(t):
    q, c = embedded(t)
    lists = retrieve.run_queries(questions(t), q, corpus(t), c, 5, {"bm25_weight": 0.45}, {"top_n": 5}, DIGITS)
    return lists.select("query_id", "stage", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score")


@query("h6_weighted_fusion", f"WITH {SQL_SIDES}, {SQL_NORMAL}, {sql_fused(WEIGHTED)} SELECT * FROM f")
def _(t):
    return retrieve.fuse_weighted(*sides(t), 0.45, DIGITS).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("w4_reciprocal_fusion", f"WITH {SQL_SIDES}, {SQL_NORMAL}, {sql_fused('coalesce(1 / (60 + dr), 0) + coalesce(1 / (60 + sr), 0)')} SELECT * FROM f")
def _(t):
    return retrieve.fuse_reciprocal(*sides(t), 60, DIGITS).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("w5_overlap_rerank", f"WITH {SQL_SIDES}, {SQL_NORMAL}, {sql_fused(WEIGHTED)}, {sql_reranked('f', 'o', 10)} SELECT query_id, chunk_id, score, rank FROM o")
def _(t):
    fused = retrieve.fuse_weighted(*sides(t), 0.45, DIGITS)
    return retrieve.rerank_overlap(fused, questions(t), corpus(t), 10, digits=DIGITS).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("h25_weight_sweep", f"""
WITH {SQL_SIDES}, {SQL_NORMAL}, g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight),
x AS (SELECT weight, query_id, chunk_id, dr, sr, round((1 - weight) * coalesce(dv, 0) + weight * coalesce(sv, 0), 6) AS score FROM b, g)
SELECT * FROM (SELECT weight, query_id, chunk_id, score, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, chunk_id) AS rank FROM x) WHERE rank <= 10""")
def _(t):
    return retrieve.sweep_weights(*sides(t), [0.0, 0.25, 0.5, 0.75, 1.0], DIGITS).where("rank <= 10").withColumn("rank", F.col("rank").cast("bigint"))


# -- evaluation ---------------------------------------------------------------------------------


def expected(t: Tables) -> DataFrame:
    """(query_id, source): documents that contain the passage. Passages are few; documents are read once."""
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = t.documents.select("doc_id", "text")
    return t.keep("expected", lambda: retrieve.containing(docs, passages).select("query_id", F.col("doc_id").cast("string").alias("source")))


SQL_EXPECTED = "ex AS (SELECT item_id AS query_id, doc_id FROM benchmark b2 JOIN documents d2 ON contains(d2.text, b2.text))"


def sources(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("source"))


def evaluated(t: Tables, final: DataFrame) -> DataFrame:
    want = expected(t)
    return metrics.evaluate_lists(questions(t), metrics.document_ranks(final, sources(t), want), want)


def sql_evaluated(lists: str, name: str = "m") -> str:
    per_k = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in metrics.K_VALUES)
    ideal = lambda k: f"list_sum(list_transform(range(1, least(e, {k}) + 1), lambda i: 1 / log2(i + 1)))"
    rows = " UNION ALL ".join(
        f"SELECT query_id, 'recall@{k}' AS metric, CASE WHEN e > 0 THEN coalesce(h{k}, 0) / e ELSE 0 END AS value FROM {name}_j UNION ALL SELECT query_id, 'hit_rate@{k}', CASE WHEN h{k} > 0 THEN 1.0 ELSE 0 END FROM {name}_j UNION ALL SELECT query_id, 'ndcg@{k}', CASE WHEN e > 0 THEN coalesce(g{k}, 0) / {ideal(k)} ELSE 0 END FROM {name}_j"
        for k in metrics.K_VALUES
    )
    return f"""
{name}_h AS (SELECT l.query_id, min(rank) AS first, {per_k} FROM {lists} l JOIN ex ON ex.query_id = l.query_id AND ex.doc_id = l.chunk_id GROUP BY 1),
{name}_j AS (SELECT q.item_id AS query_id, coalesce(e, 0) AS e, h.* EXCLUDE (query_id) FROM benchmark q LEFT JOIN (SELECT query_id, count(*) AS e FROM ex GROUP BY 1) c ON c.query_id = q.item_id LEFT JOIN {name}_h h ON h.query_id = q.item_id),
{name} AS ({rows} UNION ALL SELECT query_id, 'mrr', coalesce(1 / first, 0) FROM {name}_j)"""


@query("h7_case_metrics", f"WITH {sql_bm25('s')}, {SQL_EXPECTED}, {sql_evaluated('s')} SELECT query_id, metric, round(value, 6) AS value FROM m")
def case_metrics(t):
    return evaluated(t, bm25(t)).withColumn("value", r("value"))


@query("h8_evaluate", f"WITH {sql_bm25('s')}, {SQL_EXPECTED}, {sql_evaluated('s')} SELECT metric, round(avg(value), 6) AS value FROM m GROUP BY metric")
def evaluate(t):
    return metrics.aggregate_metrics(evaluated(t, bm25(t))).withColumn("value", r("value"))


@query("j5_expected_documents", f"WITH {SQL_EXPECTED} SELECT query_id, doc_id::VARCHAR AS source FROM ex")
def _(t):
    return expected(t)


@query("w7_target_ranks", f"WITH {sql_bm25('s')}, {SQL_EXPECTED} SELECT s.query_id, min(rank) AS target_rank FROM s JOIN ex ON ex.query_id = s.query_id AND ex.doc_id = s.chunk_id GROUP BY 1")
def _(t):
    return metrics.target_ranks(bm25(t), sources(t), expected(t)).withColumn("target_rank", F.col("target_rank").cast("bigint"))


SQL_BOTH = f"{SQL_SIDES}, {SQL_EXPECTED}, {sql_evaluated('d', 'ma')}, {sql_evaluated('s', 'mb')}"


@query("j9_metric_deltas", f"WITH {SQL_BOTH} SELECT metric, round(avg(ma.value), 6) AS before, round(avg(mb.value), 6) AS after, round(avg(mb.value) - avg(ma.value), 6) + 0.0 AS delta FROM ma JOIN mb USING (query_id, metric) GROUP BY metric")
def _(t):
    a, b = (metrics.aggregate_metrics(evaluated(t, x)) for x in sides(t))
    return metrics.metric_deltas(a, b).select("metric", r("before").alias("before"), r("after").alias("after"), (r("delta") + F.lit(0.0)).alias("delta"))


SQL_TAGS = "tags AS (SELECT DISTINCT query_id, lang AS tag FROM ex JOIN documents USING (doc_id))"


def tags(t: Tables) -> DataFrame:
    return expected(t).join(t.documents.select(F.col("doc_id").cast("string").alias("source"), F.col("lang").alias("tag")), "source").select("query_id", "tag").distinct()


@query("a14_tag_deltas", f"""
WITH {SQL_BOTH}, {SQL_TAGS}, dl AS (SELECT query_id, metric, mb.value - ma.value AS delta FROM ma JOIN mb USING (query_id, metric))
SELECT tag, metric, count(*) AS n, round(avg(delta), 6) + 0.0 AS delta FROM dl JOIN tags USING (query_id) GROUP BY tag, metric
UNION ALL SELECT NULL, metric, count(*), round(avg(delta), 6) + 0.0 FROM dl GROUP BY metric""")
def _(t):
    a, b = (evaluated(t, x) for x in sides(t))
    return metrics.tag_deltas(metrics.metric_deltas(a, b, "query_id"), tags(t)).withColumn("delta", r("delta") + F.lit(0.0))


SQL_CLASSED = f"""
tg AS (SELECT s.query_id, min(rank) AS target_rank FROM s JOIN ex ON ex.query_id = s.query_id AND ex.doc_id = s.chunk_id GROUP BY 1),
ls AS (SELECT query_id, list(score ORDER BY rank) AS v FROM s GROUP BY 1),
gp AS (SELECT query_id, v[greatest(1, least(target_rank, len(v)))] - v[greatest(1, least(5, len(v)))] AS gap FROM ls JOIN tg USING (query_id)),
ta AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) AS a FROM d WHERE rank <= 5 GROUP BY 1), tb AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) AS b FROM s WHERE rank <= 5 GROUP BY 1),
cl AS (SELECT ma.query_id, ma.value AS before, mb.value AS after, mb.value - ma.value AS delta,
  CASE WHEN mb.value < ma.value THEN 'regressed' WHEN mb.value > ma.value THEN 'improved' WHEN a IS DISTINCT FROM b THEN 'changed-top-k' ELSE 'unchanged' END AS class,
  CASE WHEN coalesce(abs(gap) < 0.5, false) THEN 'unstable' ELSE 'stable' END AS stability
  FROM ma JOIN mb USING (query_id, metric) LEFT JOIN ta USING (query_id) LEFT JOIN tb USING (query_id) LEFT JOIN gp USING (query_id) WHERE metric = 'recall@5'),
fl AS (SELECT cl.*, x.value > 0 AS hit_before, y.value > 0 AS hit_after FROM cl JOIN ma x ON x.query_id = cl.query_id AND x.metric = 'hit_rate@5' JOIN mb y ON y.query_id = cl.query_id AND y.metric = 'hit_rate@5')"""


def classed(t: Tables) -> DataFrame:
    """Query classes between the two rankings, with hits on both sides."""
    before, after = sides(t)
    want = expected(t)
    a, b = evaluated(t, before), evaluated(t, after)
    rows = align.classify(a, b, before, after, metrics.target_ranks(after, sources(t), want), "recall@5", 0.5)
    hit = lambda m, n: m.where("metric = 'hit_rate@5'").select("query_id", (F.col("value") > 0).alias(n))
    return rows.join(hit(a, "hit_before"), "query_id").join(hit(b, "hit_after"), "query_id")


@query("h11_classify", f"WITH {SQL_BOTH}, {SQL_CLASSED} SELECT query_id, round(before, 6) AS before, round(after, 6) AS after, class, stability FROM cl")
def _(t):
    return classed(t).select("query_id", r("before").alias("before"), r("after").alias("after"), "class", "stability")


@query("a20_flips", f"WITH {SQL_BOTH}, {SQL_CLASSED} SELECT count(*) FILTER (hit_before AND NOT hit_after) AS b, count(*) FILTER (NOT hit_before AND hit_after) AS c FROM fl WHERE stability = 'stable'")
def _(t):
    return gating.flips(classed(t).where("stability = 'stable'"))


@query("a21_tag_flips", f"WITH {SQL_BOTH}, {SQL_CLASSED}, {SQL_TAGS} SELECT tag, count(*) FILTER (hit_before AND NOT hit_after) AS b, count(*) FILTER (NOT hit_before AND hit_after) AS c FROM fl JOIN tags USING (query_id) WHERE stability = 'stable' GROUP BY tag")
def _(t):
    return gating.tag_flips(classed(t), tags(t)).select("tag", "b", "c")


# -- chunk alignment ----------------------------------------------------------------------------

SQL_TWO_CHUNKINGS = f"{sql_tokens('documents')}, {sql_chunks('old', 64, 0)}, {sql_chunks('nw', 48, 8)}"
SQL_ALIGNED = """
mt AS (SELECT o.chunk_id, o.span_start AS os, o.span_end AS oe, n.chunk_id AS new_id, n.span_start AS ns, greatest(o.span_start, n.span_start) AS a, least(o.span_end, n.span_end) AS b, n.span_end - n.span_start AS nl
  FROM old o LEFT JOIN nw n ON o.doc_id = n.doc_id AND o.span_start < n.span_end AND n.span_start < o.span_end),
mo AS (SELECT *, (b - a) / (oe - os) AS part, (b - a) / nl AS cover FROM mt),
mw AS (SELECT *, greatest(0, b - greatest(a, coalesce(max(b) OVER w, a))) AS un, CASE WHEN part >= 0.15 THEN greatest(0, b - greatest(a, coalesce(max(CASE WHEN part >= 0.15 THEN b END) OVER w, a))) ELSE 0 END AS uq
  FROM mo WINDOW w AS (PARTITION BY chunk_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ag AS (SELECT chunk_id, sum(un) / any_value(oe - os) AS cb, sum(uq) / any_value(oe - os) AS cq, count(*) FILTER (part >= 0.15) AS nq, count(*) FILTER (part >= 0.95) AS nf, max(cover) FILTER (part >= 0.95) AS fc,
  arg_min(part, (-part, ns, new_id)) AS dp, arg_min(cover, (-part, ns, new_id)) AS dc, count(new_id) AS found FROM mw GROUP BY chunk_id),
fate AS (SELECT chunk_id, CASE WHEN found = 0 THEN 'dropped' WHEN nf = 1 AND fc >= 0.95 THEN 'intact' WHEN nq >= 2 AND cq >= 0.9 THEN 'split' WHEN dp >= 0.95 AND dc < 0.7 THEN 'merged' WHEN cb < 0.5 THEN 'dropped' ELSE 'boundary-shifted' END AS fate,
  CASE WHEN found = 0 THEN 0 ELSE cb END AS score, found FROM ag)"""


def two_chunkings(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tuple(text.chunk(t.documents, "fixed_token", {"max_tokens": s, "overlap": o}) for s, o in ((64, 0), (48, 8)))


@query("h9_align_spans", f"WITH {SQL_TWO_CHUNKINGS}, {SQL_ALIGNED} SELECT chunk_id, fate, round(score, 6) AS score, CASE WHEN fate = 'dropped' THEN 0 ELSE found END AS n FROM fate")
def _(t):
    return align.align_spans(*two_chunkings(t)).select("chunk_id", "fate", r("score").alias("score"), F.size("descendants").cast("bigint").alias("n"))


@query("a12_fate_counts", f"WITH {SQL_TWO_CHUNKINGS}, {SQL_ALIGNED} SELECT fate, count(*) AS n FROM fate GROUP BY fate")
def _(t):
    return align.fate_counts(align.align_spans(*two_chunkings(t)))


@query("h10_align_words", f"""
WITH {SQL_TWO_CHUNKINGS},
ow AS (SELECT doc_id, chunk_id, list_distinct({SQL_TERMS.format('text')}) AS w FROM old), nww AS (SELECT doc_id, chunk_id, span_start, list_distinct({SQL_TERMS.format('text')}) AS w FROM nw),
sc AS (SELECT ow.chunk_id, nww.chunk_id AS new_id, span_start, len(list_intersect(ow.w, nww.w)) AS i, len(ow.w) + len(nww.w) AS s FROM ow LEFT JOIN nww USING (doc_id)),
jc AS (SELECT chunk_id, new_id, span_start, CASE WHEN s - i = 0 THEN 1 ELSE i / (s - i) END AS j FROM sc),
bs AS (SELECT chunk_id, new_id, j FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY j DESC NULLS LAST, span_start, new_id) AS k FROM jc) WHERE k = 1)
SELECT chunk_id, CASE WHEN coalesce(j, 0) < 0.6 THEN 'dropped' WHEN j >= 0.95 THEN 'intact' ELSE 'boundary-shifted' END AS fate, round(coalesce(j, 0), 6) AS score, CASE WHEN coalesce(j, 0) >= 0.6 THEN new_id END AS descendant FROM bs""")
def _(t):
    return align.align_words(*two_chunkings(t)).select("chunk_id", "fate", r("score").alias("score"), F.try_element_at("descendants", F.lit(1)).alias("descendant"))


@query("j4_chunk_paths", f"WITH {PATHED} SELECT doc_key, array_to_string(list(DISTINCT path ORDER BY path), ',') AS paths FROM paths GROUP BY doc_key")
def _(t):
    paths = metrics.chunk_paths(pathed(t).select(F.col("doc_key").alias("chunk_id"), F.col("path").alias("source")))
    return paths.select(F.col("chunk_id").alias("doc_key"), F.array_join("paths", ",").alias("paths"))


# -- statistics ---------------------------------------------------------------------------------


def event_runs(t: Tables) -> DataFrame:
    """Events as runs: the event type is the run, the user the query, the mean value the gap."""
    e = t.events.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("query_id"))
    return e.agg(F.round(F.avg("value"), 6).alias("gap"), (F.count("*") % 2 == 1).alias("hit"))


SQL_RUNS = "runs AS (SELECT event_type AS run, user_id AS query_id, round(avg(value), 6) AS gap, count(*) % 2 = 1 AS hit FROM events GROUP BY 1, 2), pr AS (SELECT a.query_id, a.gap AS ga, b.gap AS gb, a.hit AS ha, b.hit AS hb FROM runs a JOIN runs b ON a.query_id = b.query_id AND a.run < b.run)"


@query("a18_epsilon", f"WITH {SQL_RUNS} SELECT round(quantile_cont(abs(ga - gb), 0.95), 4) AS epsilon FROM pr")
def _(t):
    return gating.epsilon(gating.run_pairs(event_runs(t))).select(r("epsilon", 4).alias("epsilon"))


@query("a19_flip_rates", f"WITH {SQL_RUNS} SELECT query_id, round(avg((ha IS DISTINCT FROM hb)::INT), 6) AS flip_rate FROM (SELECT DISTINCT user_id AS query_id FROM events) LEFT JOIN pr USING (query_id) GROUP BY query_id HAVING count(ga) > 0 UNION ALL SELECT user_id, 0 FROM events WHERE user_id NOT IN (SELECT query_id FROM pr) GROUP BY 1")
def _(t):
    return gating.flip_rates(gating.run_pairs(event_runs(t)), t.events.select(F.col("user_id").alias("query_id")).distinct()).withColumn("flip_rate", r("flip_rate"))


@query("a17_metric_noise", "SELECT event_type AS metric, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def _(t):
    return gating.metric_noise(t.events.select(F.col("event_type").alias("metric"), "value")).select("metric", r("std").alias("std"))


@query("a22_hash_bootstrap", """
WITH v AS (SELECT quality::DOUBLE - toxic AS v, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels),
d AS (SELECT b, j, ('0x' || substr(sha256(concat_ws(':', '0', b::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT % (SELECT max(n) FROM v) AS i FROM range(2000) x(b), range((SELECT max(n) FROM v)) y(j)),
m AS (SELECT b, avg(v) AS m FROM d JOIN v USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(t):
    values = t.labels.select("doc_id", (F.col("quality").cast("double") - F.col("toxic")).alias("v"))
    return stats.hash_bootstrap(values, "v", "doc_id").select(r("low").alias("low"), r("high").alias("high"))


SQL_TESTS = """
ct AS (SELECT user_id, count(*) FILTER (event_type < 'd') AS b, count(*) FILTER (event_type >= 'd') AS c FROM events GROUP BY user_id),
pp AS (SELECT user_id, b, c, CASE WHEN b + c = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM ct)"""


def tests(t: Tables) -> DataFrame:
    e = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") < "d").alias("b"), F.count_if(F.col("event_type") >= "d").alias("c"))
    return e.withColumn("p", r(stats.mcnemar_col(F.col("b"), F.col("c"))))


@query("a23_mcnemar", f"WITH {SQL_TESTS} SELECT user_id, b, c, round(p, 6) AS p FROM pp")
def _(t):
    return tests(t)


@query("a24_false_discovery", f"WITH {SQL_TESTS}, rk AS (SELECT user_id, round(p, 6) AS p, row_number() OVER (ORDER BY round(p, 6), user_id) AS k, count(*) OVER () AS m FROM pp) SELECT user_id, p, k <= coalesce((SELECT max(k) FROM rk WHERE p <= k * 0.05 / m), 0) AS rejected FROM rk")
def _(t):
    return stats.false_discovery_table(tests(t), "user_id").select("user_id", "p", "rejected")


@query("a26_shapley", """
WITH l AS (SELECT x.m AS mask, count(*)::DOUBLE AS v FROM range(8) x(m), documents d WHERE (((length(d.text) % 8)::BIGINT & x.m) = (length(d.text) % 8)::BIGINT) GROUP BY 1)
SELECT p::INT AS player, round(sum([1/3, 1/6, 1/3][bit_count(a.mask)::INT + 1] * (b.v - a.v)), 6) AS value FROM range(3) q(p), l a, l b WHERE (a.mask & (1 << p)) = 0 AND b.mask = a.mask + (1 << p) GROUP BY p""")
def _(t):
    kinds = t.documents.select((F.length("text") % 8).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    masks = t.spark.range(8).select(F.col("id").cast("int").alias("mask"))
    lattice = masks.join(kinds, F.expr("(k & mask) = k")).groupBy("mask").agg(F.sum("n").cast("double").alias("v"))
    return attribution.shapley_table(lattice, 3).withColumn("value", r("value"))


@query("u6_factor_lattice", "SELECT x.m AS mask, count(*) FILTER ((x.m & (1 << f)) > 0) AS at_a FROM range(8) x(m), range(3) y(f) GROUP BY 1")
def _(t):
    arms = attribution.build_arms(["chunk", "embed", "parse"])
    table = attribution.arm_table(t.spark, arms)
    bit = F.when(F.col("factor") == "chunk", 1).when(F.col("factor") == "embed", 2).otherwise(4)
    return table.groupBy("arm_id").agg(F.sum(F.when(F.col("side") == "A", bit).otherwise(0)).cast("bigint").alias("mask"), F.count_if(F.col("side") == "A").alias("at_a")).select("mask", "at_a")


# -- attribution --------------------------------------------------------------------------------


@query("w11_tracers", f"WITH {SQL_SIDES}, {SQL_EXPECTED} SELECT d.query_id, arg_min(d.chunk_id, rank) AS tracer FROM d JOIN ex ON ex.query_id = d.query_id AND ex.doc_id = d.chunk_id GROUP BY 1")
def _(t):
    return attribution.tracers(sides(t)[0], sources(t), expected(t))


#: Before: fused by weight .45 and reranked; after: another BM25, weight .9. A chunk's number says what became of it.
SQL_FUNNEL = f"""{SQL_SIDES}, {SQL_EXPECTED}, {SQL_NORMAL}, {sql_fused(WEIGHTED)}, {sql_reranked('f', 'o', 10)},
{sql_bm25('s2', 0.4, 0.0, base=False)}, {sql_joined('d', 's2', 'b2')}, {sql_fused('0.1 * coalesce(dv, 0) + 0.9 * coalesce(sv, 0)', 'f2', 'b2')}, {sql_reranked('f2', 'o2', 10)},
tr AS (SELECT d.query_id, arg_min(d.chunk_id, rank) AS tracer FROM d JOIN ex ON ex.query_id = d.query_id AND ex.doc_id = d.chunk_id GROUP BY 1),
fo AS (SELECT query_id, tracer, unnest(CASE WHEN tracer % 4 = 1 THEN [tracer, tracer + 4] ELSE [tracer] END) AS chunk_id FROM tr),
x AS (SELECT tr.query_id, tracer, CASE tracer % 4 WHEN 1 THEN 'split' WHEN 3 THEN 'dropped' ELSE 'intact' END AS fate, tracer % 5 <> 0 AS in_index,
  {', '.join(f"(SELECT min(rank) FROM {y} y WHERE y.query_id = tr.query_id AND y.chunk_id = tracer) AS {n}_before, (SELECT min(rank) FROM {z} z JOIN fo ON z.query_id = fo.query_id AND z.chunk_id = fo.chunk_id WHERE fo.query_id = tr.query_id) AS {n}_after" for n, y, z in (('dense', 'd', 'd'), ('sparse', 's', 's2'), ('fused', 'f', 'f2'), ('reranked', 'o', 'o2')))} FROM tr),
wd AS (SELECT *, {', '.join(f"coalesce({n}_after, 1000000000) - coalesce({n}_before, 1000000000) AS {n}_worse, coalesce({n}_before <= 5, false) AND NOT coalesce({n}_after <= 5, false) AS {n}_lost" for n in ('dense', 'sparse', 'fused'))} FROM x),
fn AS (SELECT query_id, tracer, fate, in_index, dense_before, dense_after, sparse_before, sparse_after, fused_before, fused_after, reranked_after,
  CASE WHEN NOT in_index THEN 'index' WHEN dense_lost THEN 'dense' WHEN sparse_lost THEN 'sparse' WHEN fused_lost THEN 'fused' WHEN coalesce(fused_before <= 5 AND reranked_after > 5, false) THEN 'rerank'
    WHEN dense_worse >= greatest(sparse_worse, fused_worse) THEN 'dense' WHEN sparse_worse >= fused_worse THEN 'sparse' ELSE 'fused' END AS stage FROM wd)"""


def funnel(t: Tables) -> DataFrame:
    q, c = embedded(t)
    d, s = sides(t)
    before = retrieve.fuse_weighted(d, s, 0.45, DIGITS)
    again = bm25(t, 0.4, 0.0)
    after = retrieve.fuse_weighted(d, again, 0.9, DIGITS)
    reranked = lambda x: retrieve.rerank_overlap(x, questions(t), corpus(t), 10, digits=DIGITS)

    def staged(*lists: DataFrame) -> DataFrame:
        parts = [x.select("query_id", F.lit(n).alias("stage"), "rank", "chunk_id") for n, x in zip(("dense", "sparse", "fused", "reranked"), lists, strict=True)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    kind = F.col("chunk_id") % 4
    fate = F.when(kind == 1, "split").when(kind == 3, "dropped").otherwise("intact")
    to = F.when(kind == 1, F.array("chunk_id", F.col("chunk_id") + 4)).when(kind == 3, F.array().cast("array<bigint>")).otherwise(F.array("chunk_id"))
    alignment = corpus(t).select("chunk_id", fate.alias("fate"), to.alias("descendants"))
    rows = attribution.funnel(staged(d, s, before, reranked(before)), staged(d, again, after, reranked(after)), attribution.tracers(d, sources(t), expected(t)), alignment, corpus(t).where("chunk_id % 5 <> 0"), top_k=5)
    return rows.withColumn("stage", attribution.failing_stage(5))


@query("h13_funnel", f"WITH {SQL_FUNNEL} SELECT * FROM fn")
def _(t):
    ranks = ("dense_before", "dense_after", "sparse_before", "sparse_after", "fused_before", "fused_after", "reranked_after")
    return funnel(t).select("query_id", "tracer", "fate", "in_index", *(F.col(c).cast("bigint").alias(c) for c in ranks), "stage")


SQL_CAUSES = ", ".join(f"('{stage}', '{f}')" for stage, fs in attribution.STAGE_FACTORS.items() for f in fs)


@query("h15_implicated_factors", f"WITH {SQL_FUNNEL} SELECT query_id, stage, factor FROM fn JOIN (VALUES {SQL_CAUSES}) c(stage, factor) USING (stage) WHERE factor IN ('chunk', 'embed', 'retrieve')")
def _(t):
    return attribution.implicated(funnel(t).select("query_id", "stage"), ["chunk", "embed", "retrieve"]).select("query_id", "stage", "factor")


# -- golden sets --------------------------------------------------------------------------------


@query("w15_rarest_phrase", f"""
WITH t AS (SELECT item_id AS id, {SQL_TERMS.format('text')} AS w FROM benchmark),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SQL_TERMS.format('text')}) AS term FROM documents) GROUP BY term),
g AS (SELECT id, size, i, w[i + 1 : i + size] AS gram FROM (SELECT id, w, size, unnest(range(len(w) - size + 1)) AS i FROM t, (SELECT unnest([2, 3, 4]) AS size) WHERE len(w) >= size)),
s AS (SELECT id, size, i, array_to_string(gram, ' ') AS phrase, sum(1 / df / size) AS score FROM (SELECT id, size, i, gram, unnest(gram) AS term FROM g) JOIN df USING (term) GROUP BY id, size, i, gram)
SELECT id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, size, i) AS k FROM s) WHERE k = 1""")
def _(t):
    frequency = retrieve.Bm25.document_frequency(retrieve.Bm25(corpus(t)).frequencies())
    return golden.rarest_ngram(t.benchmark.select(F.col("item_id").alias("id"), "text"), frequency)


@query("w13_round_robin", f"""
WITH {sql_tokens('documents')}, {sql_chunks('c', 64, 8)},
p AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(concat_ws(':', '0', chunk_id)), chunk_id) AS depth FROM c)
SELECT doc_id, chunk_id, depth, row_number() OVER (ORDER BY depth, sha256(concat_ws(':', '0', doc_id::VARCHAR)), doc_id) AS pick FROM p ORDER BY pick LIMIT 100""")
def _(t):
    chunks = text.chunk(t.documents, "fixed_token", {"max_tokens": 64, "overlap": 8}).select("doc_id", "chunk_id")
    return golden.round_robin(chunks, 100).select("doc_id", "chunk_id", F.col("depth").cast("bigint").alias("depth"), F.col("pick").cast("bigint").alias("pick"))


@query("h23_generate_golden")
def _(t):
    chunks = text.chunk(t.documents, "fixed_token", {"max_tokens": 64, "overlap": 8}).join(pathed(t).select("doc_id", F.col("path").alias("source")), "doc_id")
    return golden.generate(chunks.select("chunk_id", "doc_id", "source", "text"), 50)


@query("p16_curate", "SELECT item_id::VARCHAR AS id, CASE WHEN length(text) > 200 THEN 'Why? ' || text ELSE text END AS question FROM benchmark")
def _(t):
    empty = F.array().cast("array<string>")
    cases = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), empty.alias("expected_sources"), empty.alias("tags"))
    edits = t.benchmark.where("length(text) > 200").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("Why? "), "text").alias("question"), F.lit(None).cast("array<string>").alias("expected_sources"), F.lit(None).cast("array<string>").alias("tags"))
    return golden.curate(cases, edits).select("id", "question")


# -- the remaining operators of the store, funnel, arms and sweeps ---------------------------------


@query("s7_document_by_source", "SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def _(t):
    return store.newest(t.documents.select("source", "doc_id", "lang"), ["source"], "doc_id").select("source", "doc_id", "lang")


@query("j17_text_by_key", f"WITH {PATHED}, t AS (SELECT doc_key, min(text) AS text FROM paths GROUP BY doc_key) SELECT DISTINCT doc_key, t.text FROM paths p JOIN t USING (doc_key) WHERE p.doc_id % 2 = 0")
def _(t):
    stored = pathed(t).select(F.col("doc_key").alias("key"), "text", "doc_id")
    wanted = pathed(t).where("doc_id % 2 = 0").select(F.col("doc_key").alias("key")).distinct()
    return store.lookup(wanted, store.newest(stored, ["key"], "doc_id")).select(F.col("key").alias("doc_key"), "text")


@query("a32_min_max", f"WITH {sql_bm25('s')} SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS normal FROM s WINDOW w AS (PARTITION BY query_id)")
def _(t):
    return retrieve.min_max(bm25(t)).select("query_id", "chunk_id", r("normal").alias("normal"))


@query("a4_inverse_frequency", f"""
WITH t AS (SELECT DISTINCT doc_id, unnest({SQL_TERMS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t, n GROUP BY term, n""")
def _(t):
    index = retrieve.Bm25(corpus(t))
    df = index.document_frequency(index.frequencies()).crossJoin(F.broadcast(index.corpus()))
    return df.select("term", r(index.idf(F.col("n"), F.col("df"))).alias("idf"))


@query("a15_union_length", f"""
WITH {sql_tokens('documents')}, {sql_chunks('c', 48, 8)},
u AS (SELECT doc_id, greatest(0, span_end - greatest(span_start, coalesce(max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), span_start))) AS x FROM c)
SELECT doc_id, sum(x)::BIGINT AS covered FROM u GROUP BY doc_id""")
def _(t):
    chunks = text.chunk(t.documents, "fixed_token", {"max_tokens": 48, "overlap": 8})
    parts = chunks.select("doc_id", align.union_length(F.col("span_start"), F.col("span_end"), "doc_id").alias("x"))
    return parts.groupBy("doc_id").agg(F.sum("x").alias("covered"))


@query("w9_score_gaps", f"WITH {SQL_BOTH}, {SQL_CLASSED} SELECT query_id, round(gap, 6) AS gap FROM gp")
def _(t):
    final = bm25(t)
    gaps = align.score_gaps(final, metrics.target_ranks(final, sources(t), expected(t)), 5)
    return gaps.where("gap is not null").select("query_id", r("gap").alias("gap"))


@query("w10_full_ranks", f"WITH {sql_bm25('s', depth=1 << 40)}, {SQL_EXPECTED} SELECT s.query_id, chunk_id, rank FROM s JOIN ex ON ex.query_id = s.query_id AND ex.doc_id = s.chunk_id")
def _(t):
    ranked = retrieve.Bm25(corpus(t)).topk(questions(t), None, DIGITS)
    want = expected(t).select("query_id", F.col("source").cast("bigint").alias("chunk_id"))
    return ranked.join(want, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query("j11_descendants", f"""
WITH {SQL_TWO_CHUNKINGS}, {SQL_ALIGNED},
ds AS (SELECT chunk_id, list(new_id ORDER BY -part, ns, new_id) AS d FROM mo WHERE new_id IS NOT NULL GROUP BY chunk_id),
fw AS (SELECT f.chunk_id, fate, CASE WHEN fate = 'dropped' OR d IS NULL THEN [f.chunk_id] WHEN fate = 'split' THEN d ELSE d[1:1] END AS follow FROM fate f LEFT JOIN ds USING (chunk_id))
SELECT chunk_id AS query_id, fate, unnest(follow) AS chunk_id FROM fw""")
def _(t):
    old, new = two_chunkings(t)
    found = old.select(F.col("chunk_id").alias("query_id"), F.col("chunk_id").alias("tracer"))
    return attribution.descendants(found, align.align_spans(old, new)).select("query_id", "fate", "chunk_id")


SQL_ARMS = f"""
{SQL_NORMAL}, {sql_fused(WEIGHTED)}, {sql_fused('coalesce(1 / (60 + dr), 0) + coalesce(1 / (60 + sr), 0)', 'rf')}, {sql_evaluated('f', 'mf')}, {sql_evaluated('rf', 'mr')},
{', '.join(f"t_{x} AS (SELECT {x}.query_id, min(rank) AS target_rank FROM {x} JOIN ex ON ex.query_id = {x}.query_id AND ex.doc_id = {x}.chunk_id GROUP BY 1)" for x in ('d', 's', 'f', 'rf'))},
rg AS (SELECT ma.query_id, target_rank AS before_rank, value AS before_value FROM ma LEFT JOIN t_d USING (query_id) WHERE metric = 'recall@5'),
ae AS (SELECT 'arm_s' AS arm_id, 'retrieve' AS factor, mb.query_id, target_rank, value FROM mb LEFT JOIN t_s USING (query_id) WHERE metric = 'recall@5' UNION ALL SELECT 'arm_f', 'embed', mf.query_id, target_rank, value FROM mf LEFT JOIN t_f USING (query_id) WHERE metric = 'recall@5'),
cs AS (SELECT query_id, arm_id, factor, target_rank, coalesce(target_rank <= coalesce(before_rank + 1, 5), false) AND value >= before_value AS ok FROM rg JOIN ae USING (query_id))"""


def arm_inputs(t: Tables):
    """Regressed queries, the evaluations of two arms, what each arm reverts, and suspects."""
    before, after = sides(t)
    want = expected(t)
    recall = lambda x: evaluated(t, x).where("metric = 'recall@5'").select("query_id", "value")
    rank = lambda x: metrics.target_ranks(x, sources(t), want)
    regressed = recall(before).withColumnRenamed("value", "before_value").join(rank(before).withColumnRenamed("target_rank", "before_rank"), "query_id", "left")
    arm = lambda x, name: recall(x).join(rank(x), "query_id", "left").withColumn("arm_id", F.lit(name))
    evals = arm(after, "arm_s").unionByName(arm(retrieve.fuse_weighted(before, after, 0.45, DIGITS), "arm_f"))
    reverts = t.spark.createDataFrame([("arm_s", "retrieve"), ("arm_f", "embed")], "arm_id string, factor string")
    suspects = regressed.select("query_id", F.explode(F.array(F.lit("retrieve"), F.lit("embed"))).alias("factor"))
    again = arm(after, "arm_s").unionByName(arm(retrieve.fuse_reciprocal(before, after, 60, DIGITS), "arm_f"))
    return regressed, evals, reverts, suspects, again


@query("h20_confirm", f"WITH {SQL_BOTH}, {SQL_ARMS} SELECT query_id, factor, CASE WHEN ok THEN 'verified' ELSE 'hypothesis' END AS status, CASE WHEN ok THEN target_rank END AS recovered_rank FROM cs")
def _(t):
    return attribution.confirm(*arm_inputs(t)[:4]).select("query_id", "factor", "status", F.col("recovered_rank").cast("bigint").alias("recovered_rank"))


@query("a27_fidelity", f"""WITH {SQL_BOTH}, {SQL_ARMS},
ag AS (SELECT 'arm_s' AS arm_id, mb.query_id, target_rank AS r2, value AS v2 FROM mb LEFT JOIN t_s USING (query_id) WHERE metric = 'recall@5' UNION ALL SELECT 'arm_f', mr.query_id, target_rank, value FROM mr LEFT JOIN t_rf USING (query_id) WHERE metric = 'recall@5')
SELECT round(coalesce(avg((coalesce(r2 <= coalesce(before_rank + 1, 5), false) AND v2 >= before_value)::INT), 1), 6) AS fidelity FROM cs JOIN rg USING (query_id) JOIN ag USING (arm_id, query_id) WHERE ok""")
def _(t):
    """Causes confirmed by one run of the arms, held against another run, in which one arm fuses by reciprocal ranks."""
    regressed, evals, reverts, suspects, again = arm_inputs(t)
    return attribution.fidelity(attribution.confirm(regressed, evals, reverts, suspects), regressed, again).select(r("fidelity").alias("fidelity"))


@query("h18_plan_arms", f"""
WITH {SQL_TWO_CHUNKINGS}, w AS (SELECT DISTINCT text FROM (SELECT text FROM old UNION ALL SELECT text FROM nw)), k AS (SELECT DISTINCT text FROM old WHERE ordinal = 0)
SELECT count(*) AS texts, sum(length(text) // 4)::BIGINT AS tokens FROM w WHERE text NOT IN (FROM k)""")
def _(t):
    old, new = two_chunkings(t)
    wanted = old.select(F.col("text_hash").alias("key"), "text").unionByName(new.select(F.col("text_hash").alias("key"), "text"))
    return workflows.cost_of(workflows.unembedded(wanted, old.where("ordinal = 0").select(F.col("text_hash").alias("key")))).select("texts", "tokens")


@query("w16_distinctive_sentence", f"""
WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({SQL_TERMS.format('text')}) AS term FROM documents) GROUP BY term),
p AS (SELECT item_id AS id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{WS}', ' ', 'g')) <> '') AS a FROM benchmark),
s AS (SELECT id, unnest(a) AS sentence, unnest(range(len(a))) AS i FROM p),
w AS (SELECT id, i, sentence, len({SQL_TERMS.format('sentence')}) >= 6 AS long, unnest(list_distinct({SQL_TERMS.format('sentence')})) AS term FROM s),
c AS (SELECT id, i, sentence, long, sum(coalesce(1 / df, 0)) AS score FROM w LEFT JOIN df USING (term) GROUP BY ALL)
SELECT id, trim(sentence) AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY long DESC, round(score, 9) DESC, i) AS k FROM c) WHERE k = 1""")
def _(t):
    frequency = retrieve.Bm25.document_frequency(retrieve.Bm25(corpus(t)).frequencies())
    return golden.distinctive_sentence(t.benchmark.select(F.col("item_id").alias("id"), "text"), frequency)


@query("w18_best_weight", f"""
WITH {SQL_SIDES}, {SQL_NORMAL}, {SQL_EXPECTED}, g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight),
x AS (SELECT weight, query_id, chunk_id, dr, sr, round((1 - weight) * coalesce(dv, 0) + weight * coalesce(sv, 0), 6) AS score FROM b, g),
rk AS (SELECT weight, query_id, chunk_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, chunk_id) AS rank FROM x),
rr AS (SELECT weight, rk.query_id, 1 / min(rank) AS v FROM rk JOIN ex ON ex.query_id = rk.query_id AND ex.doc_id = rk.chunk_id GROUP BY 1, 2),
mn AS (SELECT g.weight, round(coalesce(sum(v), 0) / (SELECT count(*) FROM benchmark), 6) AS mrr FROM g LEFT JOIN rr USING (weight) GROUP BY 1)
SELECT weight, mrr FROM mn ORDER BY mrr DESC, weight LIMIT 1""")
def _(t):
    lists = retrieve.sweep_weights(*sides(t), [0.0, 0.25, 0.5, 0.75, 1.0], DIGITS)
    per = [evaluated(t, lists.where(F.col("weight") == w)).where("metric = 'mrr'").groupBy("metric").agg(r(F.avg("value")).alias("value")).withColumn("weight", F.lit(w)) for w in (0.0, 0.25, 0.5, 0.75, 1.0)]
    swept = per[0].unionByName(per[1]).unionByName(per[2]).unionByName(per[3]).unionByName(per[4])
    return workflows.best_weights(swept).select("weight", F.col("value").alias("mrr"))


@query("a29_noise_rate", "SELECT round(max(n) / 100, 6) AS noise FROM (SELECT event_type, count(*) FILTER (value < 50 AND user_id % 2 = 0) AS n FROM events GROUP BY event_type)")
def _(t):
    reruns = t.events.select(F.col("event_type").alias("run"), F.when(F.col("value") < 50, "regressed").otherwise("unchanged").alias("class"), F.when(F.col("user_id") % 2 == 0, "stable").otherwise("unstable").alias("stability"))
    return scorecard.noise(reruns, 100).select(r("noise").alias("noise"))


@query("x10_versions", "SELECT name, CASE WHEN regexp_matches(name, '^.+-v[0-9]+$') THEN regexp_extract(name, '^(.*)-v([0-9]+)$', 1) || '-v' || (regexp_extract(name, '^(.*)-v([0-9]+)$', 2)::BIGINT + 1) ELSE name || '-v2' END AS next FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source ELSE source || '-v' || doc_id END AS name FROM documents)")
def _(t):
    name = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("-v"), F.col("doc_id").cast("string")))
    return t.documents.select(name.alias("name")).withColumn("next", golden.bump_col(F.col("name")))
