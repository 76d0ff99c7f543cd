"""Table functions for SQL: register(spark) makes them available by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from qaloom.operators.chunking import check_sizes, pack_elements, parse_elements, separator_windows


class SeparatorChunks:
    """separator_chunks(text, chunk_size, overlap, separator) -> chunk_index, chunk."""

    def eval(self, text: str, chunk_size: int, overlap: int, separator: str):
        check_sizes(chunk_size, overlap, separator)
        yield from enumerate(separator_windows(text or "", chunk_size, overlap, separator))


class SemanticChunks:
    """semantic_chunks(text, most) -> chunk_index, chunk, kinds."""

    def eval(self, text: str, most: int):
        for i, chunk in enumerate(pack_elements(parse_elements(text or ""), most)):
            yield i, "\n\n".join(b for _, b in chunk), [k for k, _ in chunk]


def register(spark: SparkSession) -> None:
    spark.udtf.register("separator_chunks", udtf(SeparatorChunks, returnType="chunk_index int, chunk string", useArrow=True))
    spark.udtf.register("semantic_chunks", udtf(SemanticChunks, returnType="chunk_index int, chunk string, kinds array<string>", useArrow=True))
