"""Sentences, overlapping chunks, safe truncation and phrases that state facts. Offsets and limits are bytes of UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GAP = b" \n\r"
#: White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def sentences(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges. A sentence ends behind . ! ? before a space or line end, if over twenty bytes are before that mark, or at the
    first of two line ends; spaces and line ends between sentences belong to none; blank ones are dropped."""
    out, start, i, n = [], 0, 0, len(data)
    while i < n:
        c = data[i]
        stop = (c in b".!?" and i + 1 < n and data[i + 1] in _GAP and i - start > 20) or (c == 10 and i + 1 < n and data[i + 1] == 10)
        i += 1
        if stop:
            out.append((start, i))
            while i < n and data[i] in _GAP:
                i += 1
            start = i
    out.append((start, n))
    return [(a, b) for a, b in out if data[a:b].decode().strip(WHITE)]


def chunks(text: str, target: int = 4000, overlap: int = 500) -> list[tuple[str, int, int, int]]:
    """(text, index, start, end): runs of sentences of up to ``target`` bytes, one sentence at least; each run but the first is
    then extended backwards over sentences while they make ``overlap`` bytes at most, to the first of the run before at the farthest.
    Texts of chunks are trimmed, offsets are not. A text of up to ``target`` bytes, or all blank, is one chunk as it is."""
    data = text.encode()
    if not data:
        return []
    spans = sentences(data) if len(data) > target else []
    if not spans:
        return [(text, 0, 0, len(data))]
    runs, last = [], 0
    while last < len(spans):
        first, size = last, 0
        while last < len(spans):
            step = spans[last][1] - spans[last][0]
            if last > first and size + step > target:
                break
            size += step
            last += 1
        runs.append((first, last - 1))
    out = []
    for k, (first, last) in enumerate(runs):
        held = 0
        while k and first > runs[k - 1][0]:
            held += spans[first - 1][1] - spans[first - 1][0]
            if held > overlap:
                break
            first -= 1
        a, b = spans[first][0], spans[last][1]
        out.append((data[a:b].decode().strip(WHITE), len(out), a, b))
    return out


#: Bytes of an Arrow batch that goes to a worker, and characters of texts whose chunks make one that comes back: one text at least.
BATCH_BYTES, OUT_CHARS = 4 << 20, 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Texts may be long, so a batch is bounded by bytes too, not by rows alone; a session that has set its own bound keeps it."""
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


CHUNKS = "id long, text string, index long, start_offset long, end_offset long"


def chunk_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", target: int = 4000, overlap: int = 500) -> DataFrame:
    """(id, text, index, start_offset, end_offset) of each whole text; null and empty texts have no chunk."""

    names, kinds = ["id", "text", "index", "start_offset", "end_offset"], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, t in zip(batch.column("id"), batch.column("t")):
                if t := t.as_py():
                    rows += [(i.as_py(), *c) for c in chunks(t, target, overlap)]
                    size += len(t)
                    if size >= OUT_CHARS:
                        yield packed(rows)
                        rows, size = [], 0
            yield packed(rows)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, CHUNKS)


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most ``most`` bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    # Up to three bytes of a divided character are left at the end: the longest of these that is valid.
    tries = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, cut.cast("string")))


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(byte_prefix(text, most), F.lit(mark)))


# What states a fact, by kind, in order.
FACT_PATTERNS = [
    ("Decision", r"(?:we |let's |I'll |I )?(?:decided?|chose?|use|switch(?:ed|ing)? to|go(?:ing)? with)\s+(.{5,80})"),
    ("Decision", r"the approach is\s+(.{5,80})"),
    ("Error", r"(?:the )?bug (?:is|was) (?:caused by|in|due to)\s+(.{5,80})"),
    ("Error", r"doesn't work because\s+(.{5,80})"),
    ("Error", r"(?:the )?(?:fix|solution) (?:is|was)\s+(.{5,80})"),
    ("Supersession", r"instead of\s+(\S+(?:\s+\S+){0,3})\s+(?:we'll |let's )?use\s+(.{3,40})"),
    ("Supersession", r"replac(?:e|ing)\s+(\S+(?:\s+\S+){0,3})\s+with\s+(.{3,40})"),
    ("Relation", r"(\S+(?:\.\S+)?)\s+(?:depends on|calls|imports|requires)\s+(\S+(?:\.\S+)?)"),
    ("Relation", r"after changing\s+(\S+(?:\.\S+)?),?\s+(\S+(?:\.\S+)?)\s+broke"),
]
#: Case is ignored, classes are those of Unicode, and only a line feed ends a line for a dot.
FACT_FLAGS = "(?iUd)"


def facts(texts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, fact_type, fact): every match of every pattern, without white space at its ends. Null texts state nothing."""

    def matches(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(FACT_FLAGS + pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("fact_type"), F.btrim(m, F.lit(WHITE)).alias("fact")))

    found = F.concat(*[matches(*x) for x in FACT_PATTERNS])
    return texts.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.explode(found).alias("x")).select("id", "x.fact_type", "x.fact")
