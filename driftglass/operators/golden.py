"""Golden query sets: import, mining, generation, curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftglass.functions.text import SPACE, collapse, sentences, terms

CASE = "id string, question string, expected_sources array<string>, tags array<string>, origin string, source_trace string"
_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "question", "reference_contexts", "ground_truth", "input", "context", "query", "trace_id", "expected_sources", "tags")])


def as_list(json: Column) -> Column:
    """A JSON list or a single string as an array; NULL where there is nothing."""
    listed = F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull() & (json != ""), F.array(json))
    return F.when(F.size(listed) > 0, listed)


def numbered(lines: DataFrame) -> DataFrame:
    """lines (n, value): n the line number; blank lines are dropped and the rest numbered anew from 1."""
    kept = lines.where(F.trim("value") != "")
    return kept.withColumn("n", F.row_number().over(Window.orderBy("n")))


def map_records(records: DataFrame) -> DataFrame:
    """Golden cases from numbered foreign records: question with contexts or an answer, or input with context."""
    r = records.select("n", F.from_json("value", _RECORD).alias("r")).select("n", "r.*")
    empty = F.array().cast("array<string>")
    known = F.col("question").isNotNull() | F.col("input").isNotNull()
    sources = F.when(F.col("question").isNotNull(), F.coalesce(as_list(F.col("reference_contexts")), as_list(F.col("ground_truth")), empty)).otherwise(F.coalesce(as_list(F.col("context")), empty))
    question = F.when(known, F.coalesce("question", "input")).otherwise(F.raise_error(F.concat(F.lit("unknown record at line "), F.col("n").cast("string"))).cast("string"))
    return r.select(F.coalesce("id", F.format_string("q_%03d", "n")).alias("id"), question.alias("question"), sources.alias("expected_sources"), F.coalesce(as_list(F.col("tags")), empty).alias("tags"), F.lit("imported").alias("origin"), F.lit(None).cast("string").alias("source_trace"))


def mine_traces(records: DataFrame) -> DataFrame:
    """Golden cases from numbered production traces: query, expected_sources, trace_id."""
    r = records.select("n", F.from_json("value", _RECORD).alias("r")).select("n", "r.*")
    empty = F.array().cast("array<string>")
    return r.select(F.format_string("q_%03d", "n").alias("id"), F.col("query").alias("question"), F.coalesce(as_list(F.col("expected_sources")), empty).alias("expected_sources"), empty.alias("tags"), F.lit("production").alias("origin"), F.col("trace_id").alias("source_trace"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value) of a text file in order; a golden set is one file read in one task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n"))).select((F.col("pos") + 1).alias("n"), F.col("col").alias("value"))


def import_file(spark: SparkSession, path: str) -> DataFrame:
    """A native document with cases, or JSON lines of foreign records."""
    whole = spark.read.text(path, wholetext=True)
    native = whole.select(F.from_json("value", f"cases array<struct<{', '.join(f.replace(' ', ':', 1) for f in CASE.split(', '))}>>").alias("d")).select(F.explode("d.cases").alias("c")).select("c.*")
    return native if native.head(1) else map_records(numbered(read_lines(spark, path)))


def curate(cases: DataFrame, edits: DataFrame, accept: list[str] | None = None, reject: list[str] | None = None) -> DataFrame:
    """Cases with edits (id, question, expected_sources, tags; NULL leaves a field) applied and rejected ones dropped."""
    known, edited = {r.id for r in cases.select("id").collect()}, {r.id for r in edits.select("id").collect()}
    unknown = {*(accept or ()), *(reject or ()), *edited} - known
    if unknown:
        raise ValueError(f"no such cases: {sorted(unknown)}")
    if both := {*(accept or ())} & {*(reject or ())}:
        raise ValueError(f"both accepted and rejected: {sorted(both)}")
    if both := edited & {*(reject or ())}:
        raise ValueError(f"both edited and rejected: {sorted(both)}")
    e = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in ("question", "expected_sources", "tags")))
    rows = cases.join(e, "id", "left")
    rows = rows.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in ("question", "expected_sources", "tags") else c for c in cases.columns))
    return rows.where(~F.col("id").isin(*reject)) if reject else rows


def top_directory(path: Column) -> Column:
    """The first directory of a path, or the file's stem."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def rarest_ngram(texts: DataFrame, frequency: DataFrame, key: str = "id") -> DataFrame:
    """(key, phrase): of all runs of two to four words the one with the rarest words, shorter and earlier first among equals."""
    words = texts.select(key, terms(F.col("text")).alias("w"))
    runs = words.select(key, "w", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("size")).where(F.size("w") >= F.col("size"))
    runs = runs.select(key, "size", F.posexplode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("i", "gram"))
    weight = runs.select(key, "size", "i", F.array_join("gram", " ").alias("phrase"), F.posexplode("gram").alias("pos", "term")).join(frequency, "term")
    scored = weight.groupBy(key, "size", "i", "phrase").agg((F.sum(F.lit(1.0) / F.col("df")) / F.first("size")).alias("score"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "size", "i"))
    return scored.withColumn("r", best).where("r = 1").select(key, "phrase")


def distinctive_sentence(texts: DataFrame, frequency: DataFrame, key: str = "id", least: int = 6) -> DataFrame:
    """(key, sentence): the sentence whose distinct words are rarest; short ones only where all are short."""
    rows = texts.select(key, F.posexplode(sentences(F.col("text"))).alias("i", "sentence")).withColumn("w", F.array_distinct(terms(F.col("sentence")))).withColumn("long", F.size(terms(F.col("sentence"))) >= least)
    scored = rows.select(key, "i", "sentence", "long", F.explode_outer("w").alias("term")).join(frequency, "term", "left").groupBy(key, "i", "sentence", "long").agg(F.sum(F.coalesce(F.lit(1.0) / F.col("df"), F.lit(0.0))).alias("score"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("long"), F.desc(F.round("score", 9)), "i"))
    return scored.withColumn("r", best).where("r = 1").select(key, F.trim("sentence").alias("sentence"))


def round_robin(chunks: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """At most limit chunks, one per document before any document gives a second; order by seeded hashes."""
    key = lambda c: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")), 256)
    depth = F.row_number().over(Window.partitionBy("doc_id").orderBy(key("chunk_id"), "chunk_id"))
    placed = chunks.withColumn("depth", depth)
    picked = placed.orderBy("depth", key("doc_id"), "doc_id").limit(limit)
    return picked.withColumn("pick", F.row_number().over(Window.orderBy("depth", key("doc_id"), "doc_id")))


_STARTS = ("when", "if")


def paraphrase(sentence: Column, phrase: Column) -> Column:
    lead = F.lower(F.split_part(F.trim(sentence), F.lit(" "), F.lit(1)))
    return F.when(lead.isin(*_STARTS), F.concat(F.lit("What happens "), F.regexp_replace(F.lower(sentence), r"[.!?]+$", ""), F.lit("?"))).otherwise(F.concat(F.lit("What do we know about "), phrase, F.lit("?")))


def generate(chunks: DataFrame, n: int, seed: int = 0, prefix: str = "q") -> DataFrame:
    """Golden cases from chunks (chunk_id, doc_id, source, text): exact-term and paraphrased questions in turn.

    Which wording a case gets depends on how many were accepted before it, so the driver walks the
    at most 4 n candidates; everything that reads the corpus is one plan.
    """
    spark = chunks.sparkSession
    pool = round_robin(chunks.select("chunk_id", "doc_id", "source", "text"), 4 * n, seed)
    frequency = chunks.select("chunk_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    chosen = distinctive_sentence(pool, frequency, "chunk_id")
    phrases = rarest_ngram(chosen.withColumnRenamed("sentence", "text"), frequency, "chunk_id")
    rows = pool.join(chosen, "chunk_id").join(phrases, "chunk_id").select("pick", "source", F.concat(F.lit("Where is "), "phrase", F.lit(" described?")).alias("exact"), paraphrase(F.col("sentence"), F.col("phrase")).alias("loose"), collapse(F.concat(F.lit("Where is "), "phrase", F.lit(" described?"))).alias("exact_key"), collapse(paraphrase(F.col("sentence"), F.col("phrase"))).alias("loose_key"))
    out, seen = [], set()
    for r in rows.orderBy("pick").collect():
        exact = len(out) % 2 == 0
        question, key = (r.exact, r.exact_key) if exact else (r.loose, r.loose_key)
        if key in seen:
            continue
        seen.add(key)
        tag = r.source.split("/")[0] if "/" in r.source else r.source.rsplit(".", 1)[0]
        out.append((f"{prefix}_{len(out):03d}", question, [r.source], [tag, "exact-term" if exact else "paraphrase"], "generated", None))
        if len(out) == n:
            break
    return spark.createDataFrame(out, CASE)


def from_questions(asked: DataFrame) -> DataFrame:
    """Cases of chunks (source, pick, question) that a model asked about; those without a question are left out."""
    rows = asked.where("question is not null")
    return rows.select(F.format_string("q_%03d", "pick").alias("id"), "question", F.array("source").alias("expected_sources"), F.array(top_directory(F.col("source"))).alias("tags"), F.lit("model").alias("origin"), F.col("chunk_id").alias("source_trace"))


def bump(name: str) -> str:
    """golden-v1 to golden-v2; a name without a version starts at 2."""
    stem, _, version = name.rpartition("-v")
    return f"{stem}-v{int(version) + 1}" if stem and version.isdigit() else f"{name}-v2"


def bump_col(name: Column) -> Column:
    """bump over a column."""
    stem, version = (F.regexp_extract(name, r"^(.+)-v([0-9]+)$", k) for k in (1, 2))
    return F.when(version == "", F.concat(name, F.lit("-v2"))).otherwise(F.concat(stem, F.lit("-v"), (version.cast("bigint") + 1).cast("string")))


SPACES = SPACE
