"""Approximate vector search by cells: for more queries than an exact scan can serve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.sources.store import scratch

from .retrieval import _unit


@dataclass
class CellIndex:
    """Centroids, the cell of every item (a table in the shared folder), and how many cells a query looks into."""

    centroids: np.ndarray
    items: DataFrame
    probes: int
    recall: float
    digits: int = 6

    @classmethod
    def fit(
        cls, items: DataFrame, item_id: str = "id", vector: str = "embedding", sample: int = 20_000, target: float = 0.95, k: int = 10,
        part_rows: int = 50_000, seed: int = 3,
    ) -> CellIndex:
        """Centroids by k-means on at most ``sample`` items, those of smallest hash of their id (the bound of what comes to the
        driver: sample vectors); every item gets its nearest centroid's cell. ``probes`` is the smallest
        number of cells with which held-back items of the sample find at least ``target`` of their k nearest.

        Null vectors are left out. Cells of over ``part_rows`` items are dealt to several parts, so no task holds more.
        """
        base = items.select(F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        some = _unit([r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(sample).collect()] or [[0.0]])
        rng = np.random.default_rng(seed)
        cells = max(1, round(math.sqrt(len(some))))
        c = some[rng.choice(len(some), cells, replace=False)]
        for _ in range(10):
            own = (some @ c.T).argmax(axis=1)
            c = np.stack([some[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(cells)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        probes, recall = _probes(some, c, (some @ c.T).argmax(axis=1), rng, k, target)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (_unit(batch.column("v").to_pylist()) @ c.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        kind = dict(base.dtypes)["v"]
        placed = base.mapInArrow(assign, f"id long, v {kind}, cell int")
        path = scratch(items.sparkSession, "cells")
        placed.write.parquet(f"{path}/placed")
        placed = items.sparkSession.read.schema(placed.schema).parquet(f"{path}/placed")
        # At most as many rows as there are cells, so at most the square root of the sample.
        sizes = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
        return cls(c, placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), probes, recall)

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """``query_id, id, similarity, rank``: the k nearest items by cosine among those of the nearest cells, ties by id.

        Queries are not gathered: a row goes to each part of each cell it looks into, where the similarities are exact.
        """
        c, probes, digits = self.centroids, min(probes or self.probes, len(self.centroids)), self.digits

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = np.argsort(-(_unit(batch.column("v").to_pylist()) @ c.T), axis=1, kind="stable")[:, :probes] if batch.num_rows else np.zeros((0, probes))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["q", "v", "near"])

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [[], [], []]
            if left.num_rows and right.num_rows:
                keys, own = right["id"].to_numpy(), _unit(right["v"].to_pylist())
                ids, rows = left["q"].to_pylist(), _unit(left["v"].to_pylist())
                for lo in range(0, len(ids), 1024):
                    sims = np.round(rows[lo : lo + 1024] @ own.T, digits)
                    for q, s in zip(ids[lo : lo + 1024], sims, strict=True):
                        top = np.lexsort((keys, -s))[:k]
                        for column, values in zip(out, (np.full(len(top), q), keys[top], s[top]), strict=True):
                            column.append(values)
            empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({n: np.concatenate(v) if v else e for n, v, e in zip(("query_id", "id", "similarity"), out, empty, strict=True)})

        base = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL")
        looked = base.mapInArrow(look, f"q long, v {dict(base.dtypes)['v']}, near array<int>").select("q", "v", F.explode("near").alias("cell"))
        parts = F.broadcast(self.items.groupBy("cell").agg(F.max("parts").alias("parts")))
        asked = looked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("q", "v", "cell", "part")
        hits = asked.groupBy("cell", "part").cogroup(self.items.groupBy("cell", "part")).applyInArrow(best, "query_id long, id long, similarity double")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probes(some: np.ndarray, c: np.ndarray, cell: np.ndarray, rng: np.random.Generator, k: int, target: float) -> tuple[int, float]:
    """The fewest cells to look into for the target recall, and that recall, on up to 500 vectors of the sample."""
    asked = rng.choice(len(some), min(500, len(some)), replace=False)
    sims = some[asked] @ some.T
    sims[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(some) - 1)
    if k < 1:
        return 1, 1.0
    nearest = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    # At which of a query's cells, from the nearest on, each true neighbour is met.
    place = np.argsort(np.argsort(-(some[asked] @ c.T), axis=1), axis=1)
    met = np.take_along_axis(place, cell[nearest], axis=1)
    for probes in range(1, len(c) + 1):
        recall = float((met < probes).mean())
        if recall >= target:
            return probes, recall
    return len(c), 1.0
