"""Files of any document format as pages, by a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (text, width, height) of a page; sizes are None where a format has none.
Page = tuple[str, float | None, float | None]
PAGES = "path string, page_number int, text string, width double, height double"


def plain_pages(content: bytes) -> Iterator[Page]:
    """UTF-8 text, form feeds between pages."""
    for page in content.decode("utf-8", "replace").split("\f"):
        yield page, None, None


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterator[Page]] = plain_pages, pattern: str | None = None) -> DataFrame:
    """``path, page_number, text, width, height`` of every page of every file; page numbers start at 1.

    ``extract`` turns a file's bytes into pages: give one that wraps a PDF library where there is one. A missing path is an
    error, as is a file the extractor fails on; an empty file has no pages. Files are dealt out by size and never gathered; one file is held at a time.
    """
    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", pattern) if pattern else files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                pages = list(extract(content.as_py()))
                texts, widths, heights = zip(*pages, strict=True) if pages else ((), (), ())
                numbers = range(1, len(pages) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(pages), pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(widths, pa.float64()), pa.array(heights, pa.float64())],
                    ["path", "page_number", "text", "width", "height"],
                )

    return files.load(path).select("path", "content").mapInArrow(run, PAGES)


def page_size(pages: DataFrame, number: int) -> DataFrame:
    """``path, width, height`` of one page of every file; no row for a file without that page."""
    return pages.where(F.col("page_number") == number).select("path", "width", "height")


def write_files(rows: DataFrame, path: str) -> None:
    """A file for each row of (name, content), in a folder that every executor reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
