"""Sentences and chunks as table functions that SQL calls with LATERAL; rows go to and from the workers in Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import bounded_batches, chunks, sentences


class Sentences:
    def eval(self, text: str):
        data = (text or "").encode()
        for k, (a, b) in enumerate(sentences(data)):
            yield data[a:b].decode(), k, a, b


class Chunks:
    def eval(self, text: str, target: int = 4000, overlap: int = 500):
        yield from chunks(text or "", target, overlap)


SHAPE = "text string, index long, start_offset long, end_offset long"


def register(spark: SparkSession) -> None:
    """Register ``sentences(text)`` and ``chunks(text, target, overlap)`` with a session: one row for each, offsets in bytes. Null and empty
    texts have none. ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 4000, 500) c``"""
    bounded_batches(spark)
    spark.udtf.register("sentences", udtf(Sentences, returnType=SHAPE, useArrow=True))
    spark.udtf.register("chunks", udtf(Chunks, returnType=SHAPE, useArrow=True))
