"""Collections of chunks as tables, and JSONL and checkpoint sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import chunk_id
from qaloom.operators.filters import require
from qaloom.schemas import CHUNK, GOLDEN, REQUIRED_METADATA


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; unset only in local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{os.path.abspath('spark-warehouse')}/scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Collection:
    """A persistent table of chunks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            spark.createDataFrame([], CHUNK).write.saveAsTable(name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, chunks: DataFrame) -> None:
        """Append; metadata must have the required keys, and missing ids are made from them."""
        ready = require(chunks, REQUIRED_METADATA)
        made = chunk_id(F.col("chapter"), F.col("section_id"), F.col("page_number"), F.col("chunk_index"))
        own = F.coalesce(F.col("id"), made) if "id" in chunks.columns else made
        extra = F.col("extra") if "extra" in chunks.columns else F.create_map().cast("map<string,string>")
        ready.withColumn("id", own).withColumn("extra", extra).select(
            *(F.col(f.name).cast(f.dataType) for f in CHUNK.fields)
        ).write.mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def stats(self, sample: int | None = None) -> DataFrame:
        return stats(self.rows(), self.name, sample)


def stats(chunks: DataFrame, name: str, sample: int | None = None) -> DataFrame:
    """Counts over all chunks; the profile over all too, or over the first ``sample`` by id."""
    profiled = chunks.orderBy("id").limit(sample) if sample else chunks
    profile = profiled.agg(
        F.count_distinct(F.coalesce("chapter", F.lit("unknown"))).alias("unique_chapters"),
        F.count_distinct(F.coalesce("section_id", F.lit("unknown"))).alias("unique_sections"),
        F.min(F.coalesce("page_number", F.lit(0))).cast("long").alias("page_min"),
        F.max(F.coalesce("page_number", F.lit(0))).cast("long").alias("page_max"),
        F.count("*").alias("total_chunks"),
    )
    total = chunks.agg(F.count("*").alias("total_chunks")) if sample else None
    if total is not None:
        profile = profile.drop("total_chunks").join(total)
    return profile.withColumn("collection_name", F.lit(name))


def write_golden(records: DataFrame, path: str) -> None:
    """JSONL of golden records; columns must fit the schema."""
    records.select(*(F.col(f.name).cast(f.dataType) for f in GOLDEN.fields)).write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, *paths: str) -> DataFrame:
    """Golden records with the file each came from; a malformed line fails the read."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(list(paths)).withColumn("source_file", F.input_file_name())


def write_dataset(records: DataFrame, path: str, card: Mapping[str, str]) -> None:
    """A dataset repository: Parquet under data/split=..., and its card as a one-row table of properties."""
    records.write.partitionBy("split").parquet(f"{path}/data")
    records.sparkSession.createDataFrame(sorted(card.items()), "name string, value string").coalesce(1).write.json(f"{path}/card")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def _append(rows: DataFrame, key: str, path: str) -> None:
    """Rows added to a log: a file a task however many keys there are, sorted by key so that a reader of one key skips the other row groups."""
    rows.sortWithinPartitions(key).write.mode("append").parquet(path)


class Runs:
    """Append-only log of experiment runs: parameters, metrics and prompts by run, and comparisons of runs."""

    SCHEMA = "run_id string, kind string, name string, step long, number double, text string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, rows: DataFrame) -> None:
        """rows: run_id, kind ('param', 'metric', 'prompt' or 'trace'), name, step, number, text; what lacks is null."""
        made = [F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in self.SCHEMA.split(", "))]
        _append(rows.select(*made), "run_id", self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def last_metrics(self) -> DataFrame:
        """``run_id, name, step, number``: the last value of every metric of every run."""
        metrics = self.rows().where("kind = 'metric'")
        return metrics.groupBy("run_id", "name").agg(F.max("step").alias("step"), F.max_by("number", "step").alias("number"))


def tool_json(result: DataFrame) -> DataFrame:
    """Each row as pretty-printed JSON text."""
    return result.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


class Checkpoints:
    """Append-only log of run states: save, list, latest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, states: DataFrame) -> None:
        """states: thread_id string, checkpoint_id long, state string."""
        _append(states.select("thread_id", F.col("checkpoint_id").cast("long"), "state"), "thread_id", self.path)

    def list(self, thread: str | None = None) -> DataFrame:
        rows = self.spark.read.schema("thread_id string, checkpoint_id long, state string").parquet(self.path)
        return rows if thread is None else rows.where(F.col("thread_id") == thread)

    def latest(self) -> DataFrame:
        return self.list().groupBy("thread_id").agg(F.max("checkpoint_id").alias("checkpoint_id"), F.max_by("state", "checkpoint_id").alias("state"))
