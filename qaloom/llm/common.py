"""What the operators of this package share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"
#: Fewer keys than this can each have more than 1/HOT_KEYS of all rows: the bound of what is broadcast as hot.
HOT_KEYS = 1000
#: Rows that one task may always take.
FEW = 20_000
#: Bits of the filter of ``may_match``, of which words of 64 are broadcast: 2**18 rows at most.
FILTER_BITS = 1 << 24
#: Bytes of a file of a table in between.
FILE = 32 << 20
#: The setting of the size of Arrow batches, its default, and the bytes used here.
BATCH_SIZE, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: Tables of up to this size may be dealt out anew, see ``table``.
SMALL = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one that lies in fewer splits than there are cores is dealt out to all of them.

    That concerns speed alone: no operator's result depends on the partitions, and at most SMALL bytes are moved.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "pages") or int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL:
        return found
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH bytes from here on, unless the session sets another size.

    What a task holds beside its longest text, on both sides of the border to Python, then is a few
    megabytes, whatever the length of texts.
    """
    if spark.conf.get(BATCH_SIZE) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SIZE, str(BATCH))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def stretches(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes: what bounds a worker's memory beside its longest text."""
    start, size = 0, 0
    for i, k in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + k > most:
            yield start, i
            start, size = i, 0
        size += k
    if start < len(texts):
        yield start, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (local tests) a folder of this machine is used, and
    only with a local master, where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.abspath('spark-warehouse')}/qaloom-shared"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """A folder of tables in the shared folder, for one call of an operator.

    ``cut`` writes a table and reads it again, which cuts lineage durably: a lost executor costs no
    recomputation of what lies before. ``drop`` deletes those tables that are no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        #: Rows of each table, counted as it was written.
        self.rows: dict[str, int] = {}

    def cut(self, df: DataFrame, name: str, most: int | None = None, width: int = 32) -> DataFrame:
        """Write and read again. ``most`` is how many rows of about ``width`` bytes there can be, where that is known:
        then a small table does not become a file a partition."""
        if most is not None:
            files = max(1, -(-most * width // FILE))
            if files < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(files)
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{name}")
        self.names.append(name)
        self.rows[name] = counted.get["n"]
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")
            self.names.remove(name)

    def drop_others(self, *keep: str) -> None:
        self.drop(*(n for n in self.names if n not in keep))


def copies_of(counts: DataFrame, keys: Sequence[str], n: str, total: int, hot_keys: int) -> Column:
    """To how many copies rows of a key are dealt, as an expression of the key columns; 1 where a key is not frequent.

    ``counts`` has a row a key, ``n`` how many rows it has, ``total`` of which there are in all. Keys with more than
    total / hot_keys have a power of two of copies, so that a copy has no more than that. By pigeonhole fewer than ``hot_keys`` keys are so
    frequent: those alone come to the driver, as hashes, and become sets in the plan.
    """
    limit = max(1.0, total / hot_keys)
    hot = counts.where(F.col(n) > limit).select(F.xxhash64(*keys).alias("k"), F.ceil(F.log2(F.col(n) / limit)).cast("int").alias("p")).collect()
    out = F.lit(1)
    for p in sorted({r["p"] for r in hot}):
        out = F.when(F.xxhash64(*keys).isin([r["k"] for r in hot if r["p"] == p]), F.lit(2**p)).otherwise(out)
    return out


def spread_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str], n: str, total: int, hot_keys: int = HOT_KEYS, counts: DataFrame | None = None
) -> DataFrame:
    """Join ``big`` with ``small``, of one row a key, so that no task takes all rows of a frequent key.

    ``n``, a column of ``small`` (or of ``counts``, a table of key and n), is how many rows of ``big`` (or at most how many) have the key, and ``total`` how
    many it has. Rows of frequent keys are dealt by a hash of the columns ``by`` to copies of small's row, see ``copies_of``;
    there are at most 4 * hot_keys copies. Up to FEW rows in all are joined as they are.
    """
    if total <= FEW and hot_keys == HOT_KEYS:  # no key can have many
        return big.join(small, list(keys))
    copies = copies_of(small if counts is None else counts, keys, n, total, hot_keys)
    dealt = big.withColumn("_copy", F.pmod(F.xxhash64(*by), copies).cast("int"))
    return dealt.join(small.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))), [*keys, "_copy"]).drop("_copy")


def may_match(df: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Those rows of ``df`` whose ``key``, a number, may be in the column of that name of ``keys``; with ``left_anti`` all others, which surely are not.

    For joins of wide rows with few keys: only what may match has to be shuffled, and the join that follows is exact. No row
    whose key is there is missed; of the others a share of at most (distinct keys) / FILTER_BITS passes. What is broadcast has a
    bound that the number of keys does not move. Repeated keys count once; a null key is a key like others.
    """

    def bit(frame: DataFrame) -> Column:
        return F.pmod(F.xxhash64(frame[key].cast("long")), F.lit(FILTER_BITS))

    words = (
        keys.select(F.shiftright(bit(keys), 6).alias("_word"), (bit(keys) % 64).cast("int").alias("_at"))
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_bits"))
    )
    found = (F.shiftright(bit(df), 6) == words["_word"]) & (F.getbit(words["_bits"], (bit(df) % 64).cast("int")) == 1)
    return df.join(F.broadcast(words), found, how)
