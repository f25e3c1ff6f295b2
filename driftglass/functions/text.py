"""Parsing, tokenising and chunking of document text.

Line and token expressions stay in the JVM. Chunk spans are cut by one Arrow pass per document, so
no token is ever shuffled; a relational cut would explode and re-sort every token of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass import ids

#: White space as Python's regular expressions and str.strip see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TERM_PATTERN = r"([\p{L}\p{N}]+)"

PARSERS = ("text-v1", "markdown-v2")
#: One to three equal marks hugging a text that neither starts nor ends with white space.
_EMPHASIS = re.compile(r"(?<!\w)(?P<m>([*_])\2{0,2})(?!\s)(?P<body>\S|\S.*?\S)(?P=m)(?!\w)")
_HASHES = re.compile(r"^#{1,6}[ \t]*", re.MULTILINE)


def right_trim_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, SPACE + r"+\z", "")), "\n")


def parse_text(raw: Column) -> Column:
    """Plain parser: one kind of line end, no trailing white space."""
    return right_trim_lines(F.regexp_replace(raw, "\r\n?", "\n"))


def decode_utf8(content: Column) -> Column:
    """Strict decoding: invalid UTF-8 raises."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.raise_error(F.lit("invalid UTF-8")))


def strip_markdown(text: str) -> str:
    """Heading marks off, emphasis peeled until nothing changes, lines right-trimmed."""
    text = _HASHES.sub("", text)
    while (peeled := _EMPHASIS.sub(lambda m: m["body"], text)) != text:
        text = peeled
    return "\n".join(map(str.rstrip, text.split("\n")))


def parse_markdown(raw: Column) -> Column:
    @F.pandas_udf("string")
    def strip(texts):
        return texts.map(strip_markdown, na_action="ignore")

    return strip(parse_text(raw))


def parse(raw: Column, tool: str = "text-v1") -> Column:
    if tool not in PARSERS:
        raise ValueError(f"parser {tool!r} is unknown; known are {PARSERS}")
    return parse_text(raw) if tool == "text-v1" else parse_markdown(raw)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(1))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


#: Finds a character beyond Latin Extended-A, or one that is two in lower case: such texts are left to the JVM's tables.
_BEYOND = r"[^\x{0}-\x{12F}\x{131}-\x{17F}]"
_LATIN = np.array([chr(c).isalnum() for c in range(0x180)])


def packed_words(text: Column, words: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(text, words): the text itself where it is Latin, for latin_words, else its words."""
    beyond = text.rlike(_BEYOND)
    return F.when(~beyond, text).alias("text"), F.when(beyond, words(text)).alias("tokens")


def latin_words(texts: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """terms, or ascii_words, of Latin texts: how many each has, all of them, and the row of each; some may be empty strings, which do not count."""
    texts = pc.utf8_lower(texts.fill_null(""))
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]].copy()
    ok = raw >= 0x80
    if ascii_only:
        ok[:] = False
    else:
        lead = np.flatnonzero(raw >= 0xC0)
        other = lead[~_LATIN[(raw[lead] & 31).astype(np.int64) << 6 | raw[lead + 1] & 63]]
        ok[other] = ok[other + 1] = False
    ok |= (_LATIN[:128])[np.minimum(raw, 127)] & (raw < 128)
    raw[~ok] = 32
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw)))
    flat, row = words.flatten(), np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
    return np.bincount(row[pc.not_equal(flat, "").to_numpy(zero_copy_only=False)], minlength=len(texts)), flat, row


def words_of(texts: pa.Array, tokens: pa.Array, ascii_only: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """latin_words of rows of packed_words."""
    size, flat, row = latin_words(texts, ascii_only)
    if tokens.null_count < len(tokens):
        n = tokens.value_lengths().fill_null(0).to_numpy()
        size, flat, row = size + n, pa.concat_arrays((flat, tokens.flatten())), np.concatenate((row, np.repeat(np.arange(len(n)), n)))
    return size, flat, row


def collapse(text: Column) -> Column:
    """Lower case, white space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE + "+", " "))


def sentences(text: Column) -> Column:
    """Sentences for question generation: after a mark and white space, or at line ends."""
    return F.filter(F.split(text, r"(?<=[.!?])" + SPACE + r"+|\n+"), lambda s: F.trim(F.regexp_replace(s, SPACE, " ")) != "")


# -- chunk spans -----------------------------------------------------------------------------

Span = tuple[int, int]
#: Chunks that a task gathers before it gives them on.
CHUNK_ROWS = 4096
_TOKEN = re.compile(r"\S+")
_HEADING = re.compile(r"^#{1,6}(?=[\t ]|$)", re.MULTILINE)


def _windows(tokens: list[Span], size: int, overlap: int) -> list[Span]:
    n, step = len(tokens), size - overlap
    count = 0 if not n else 1 if n <= size else -((size - n) // step) + 1
    return [(tokens[k * step][0], tokens[min(k * step + size, n) - 1][1]) for k in range(count)]


def fixed_token_spans(text: str, max_tokens: int, overlap: int = 0) -> list[Span]:
    return _windows([m.span() for m in _TOKEN.finditer(text)], max_tokens, overlap)


def heading_spans(text: str, max_tokens: int, overlap: int = 0) -> list[Span]:
    """Token windows that never cross a heading line."""
    edges = sorted({0, len(text), *(m.start() for m in _HEADING.finditer(text))})
    out: list[Span] = []
    for a, b in zip(edges, edges[1:]):
        out += _windows([m.span() for m in _TOKEN.finditer(text, a, b)], max_tokens, overlap)
    return out


_SENTENCE = re.compile(r"(?s)(?=\S).*?(?:[.!?]+(?=\s|\Z)|(?=\n\n)|\Z)")


def sentence_spans(text: str, max_sentences: int) -> list[Span]:
    found = []
    for m in _SENTENCE.finditer(text):
        a, body = m.start(), m.group().rstrip()
        if body:
            found.append((a, a + len(body)))
    return [(found[i][0], found[min(i + max_sentences, len(found)) - 1][1]) for i in range(0, len(found), max_sentences)]


CHUNKERS: dict[str, tuple[Callable[..., list[Span]], tuple[str, ...]]] = {
    "fixed_token": (fixed_token_spans, ("max_tokens", "overlap")),
    "markdown_heading": (heading_spans, ("max_tokens", "overlap")),
    "sentence": (sentence_spans, ("max_sentences",)),
}


def check_chunker(tool: str, params: dict) -> dict:
    """Validated parameters of a chunker (its short name is the last part of tool)."""
    name = tool.rpartition(".")[2]
    if name not in CHUNKERS:
        raise ValueError(f"chunker {tool!r} is unknown; known are {sorted(CHUNKERS)}")
    known = {k: int(params[k]) for k in CHUNKERS[name][1] if k in params}
    if name == "sentence":
        if known.setdefault("max_sentences", 5) < 1:
            raise ValueError("max_sentences must be 1 or more")
    else:
        size, overlap = known.setdefault("max_tokens", 800 if name == "markdown_heading" else 512), known.setdefault("overlap", 0)
        if size < 1 or not 0 <= overlap < size:
            raise ValueError("max_tokens must be 1 or more and overlap from 0 to max_tokens - 1")
    return known


def chunk(docs: DataFrame, tool: str, params: dict, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ordinal, span_start, span_end, text, text_hash, chunk_id) of every document; NULL texts have no chunks."""
    known, cut = check_chunker(tool, params), CHUNKERS[tool.rpartition(".")[2]][0]

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ordinal, start, end, body = [], [], [], [], []

            def cut_rows(b=b):
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (ordinal, start, end)), pa.array(body, pa.string())], [doc, "ordinal", "span_start", "span_end", "text"])
                for x in (at, ordinal, start, end, body):
                    x.clear()
                return out

            for row in range(b.num_rows):  # one text at a time, and few chunks, are Python objects
                t = b.column(1)[row].as_py()
                spans = cut(t, **known) if t else []
                for s in range(0, len(spans), CHUNK_ROWS):
                    part = spans[s : s + CHUNK_ROWS]
                    at += [row] * len(part)
                    ordinal += range(s, s + len(part))
                    start += [x for x, _ in part]
                    end += [y for _, y in part]
                    body += [t[x:y] for x, y in part]
                    if len(at) >= CHUNK_ROWS:
                        yield cut_rows()
            if at:
                yield cut_rows()

    kind = docs.schema[doc].dataType.simpleString()
    cut_rows = docs.select(doc, text).mapInArrow(cut_all, f"`{doc}` {kind}, ordinal bigint, span_start bigint, span_end bigint, text string")
    return cut_rows.withColumn("text_hash", ids.text_key_col(F.col("text"))).withColumn("chunk_id", ids.chunk_key_col(F.col(doc), F.col("span_start"), F.col("span_end"), F.col("text")))
