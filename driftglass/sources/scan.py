"""Corpus scans."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass import ids
from driftglass.functions.text import decode_utf8


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, doc_id, raw) of the .md and .txt files under root; paths relative to it.

    Files and folders whose names start with a dot or underscore are not seen by Spark's readers.
    """
    base = unquote(urlparse(root).path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    path = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring(path, F.lit(len(base) + 1), F.length(path)).alias("source_path"), ids.doc_key_col(F.col("content")).alias("doc_id"), decode_utf8(F.col("content")).alias("raw"))


def table(docs: DataFrame, path: str = "source_path", text: str = "text") -> DataFrame:
    """The same columns from a table of texts."""
    return docs.select(F.col(path).alias("source_path"), ids.doc_key_col(F.col(text)).alias("doc_id"), F.col(text).alias("raw"))
