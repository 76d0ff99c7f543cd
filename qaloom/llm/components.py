"""Connected components of a graph that stays in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Workspace, spread_join


def _star(edges: DataFrame, large: bool, total: int, hot_keys: int) -> DataFrame:
    """One large-star or small-star step: a node's neighbours move to its smallest one."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = spread_join(both, least, ["u"], ["v"], "n", total, hot_keys)
    if large:
        moved = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60, hot_keys: int = HOT_KEYS, rows: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b), a <> b.

    Alternates large-star and small-star until nothing moves, which takes a
    logarithmic number of rounds. Each round is written to the shared folder and the one before
    deleted; only a count and a checksum of the edges come to the driver. Minima combine before
    the shuffle, and the rows of nodes with very many neighbours are dealt to several tasks.
    ``rows`` is how many edges there can be, if known.

    Defined cases: null ends and loops are left out, repeated edges count once; no edges, no rows.
    """
    space = Workspace(edges.sparkSession, "components")
    now = space.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges0", rows)
    seen = None
    for i in range(1, most + 1):
        total = space.rows[f"edges{i - 1}"]
        if not total:
            break
        state = total, now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            break
        seen = state
        now = space.cut(_star(_star(now, True, 2 * total, hot_keys), False, total, hot_keys), f"edges{i}", 2 * total)
        space.drop(f"edges{i - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
