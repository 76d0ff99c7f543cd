"""A corpus pipeline of five of the operators in qaloom.llm.

Each stage takes all that its predecessor kept, as Parquet, and its decisions take
effect: texts of no recognised language go, shared lines go, one document of each
near-duplicate group stays, contaminated documents go, and the rest are tokenised.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.bpe import digests
from qaloom.llm.common import may_match, remove, shared_dir, table
from qaloom.llm.decontam import uncontaminated
from qaloom.llm.langid import judge, train
from qaloom.llm.line_dedup import dedup_lines
from qaloom.llm.minhash import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language; null and letterless texts go. Rows stay as they are, repeated ones too; no rows, no rows."""
    return docs.where(~judge(spark, train(docs))(F.col("text"))["rejected"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has; every document stays, n_chars follows its text. Null texts become empty ones;
    rows of one id are one document; a row without an id keeps its lines."""
    # The columns that the operator does not return, as a struct: no name can clash and the text is not carried twice.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("_packed"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return dedup_lines(packed, carry=["_packed"]).select(*((new[c] if c in new else F.col("_packed").getField(c)).alias(c) for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group; rows without doc_id stay. Texts that surely stay are not shuffled."""
    gone = near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    rest = may_match(docs, gone, "doc_id").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return may_match(docs, gone, "doc_id", "left_anti").union(rest)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no window of a benchmark item occurs. Null and wordless texts stay; without items all do."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document, null texts as empty ones, a row for each row."""
    return digests(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near),
    ("decontamination", benchmarks),
    ("byte_bpe", tokens),
]
#: Language ID is no SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    root, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if last:
            remove(spark, last)
        last = f"{root}/{name}"
    return docs
