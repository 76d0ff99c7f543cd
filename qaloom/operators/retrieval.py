"""Vector, hybrid and expanded retrieval."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, id long, similarity double, leg int"


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


#: Similarities that a task holds at once.
TILE = 1 << 20


class _Nearest:
    """The k items nearest to each search, ties by id."""

    def __init__(self, k: int, n: int, digits: int):
        self.k, self.digits, self.margin = k, digits, 10.0**-digits
        self.ids, self.sims, self.least = np.zeros((n, k), np.int64), np.full((n, k), -np.inf), np.full(n, -np.inf)

    def offer(self, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        least = self.least[at]
        if sims.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(sims, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(sims >= (least - self.margin)[:, None])
        if not len(row):
            return
        own = np.unique(row)
        place = np.repeat(own, self.k)
        row = np.concatenate([place, row])
        found = np.concatenate([self.sims[at[own]].ravel(), np.round(sims[row[len(place) :], column], self.digits)])
        keys = np.concatenate([self.ids[at[own]].ravel(), ids[column]])
        order = np.lexsort((keys, -found, row))
        row = row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = rank < self.k
        into, order, rank = at[row[kept]], order[kept], rank[kept]
        self.ids[into, rank], self.sims[into, rank] = keys[order], found[order]
        self.least[at[own]] = self.sims[at[own], -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, rank = np.nonzero(np.isfinite(self.sims))
        return at, self.ids[at, rank], self.sims[at, rank]


class _Before:
    """The item of a smaller id that is nearest to each search."""

    def __init__(self, n: int, digits: int):
        self.digits, self.ids, self.sims = digits, np.zeros(n, np.int64), np.full(n, -np.inf)

    def offer(self, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        sims = np.where(ids < queries[:, None], sims, -np.inf)
        best = sims.argmax(axis=1)
        top = np.round(sims[np.arange(len(at)), best], self.digits)
        nearer = top > self.sims[at]
        self.ids[at[nearer]], self.sims[at[nearer]] = ids[best[nearer]], top[nearer]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.isfinite(self.sims))
        return at, self.ids[at], self.sims[at]


class _Between:
    """The item of smallest id whose similarity to a search lies strictly between the limits."""

    def __init__(self, low: float, high: float, n: int, digits: int):
        self.low, self.high, self.digits = low, high, digits
        self.ids, self.sims = np.full(n, np.iinfo(np.int64).max), np.full(n, np.nan)

    def offer(self, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        sims = np.round(sims[:, order], self.digits)
        inside = (sims > self.low) & (sims < self.high)
        first = inside.argmax(axis=1)
        sooner = inside[np.arange(len(at)), first] & (ids[order[first]] < self.ids[at])
        self.ids[at[sooner]], self.sims[at[sooner]] = ids[order[first[sooner]]], sims[sooner, first[sooner]]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(~np.isnan(self.sims))
        return at, self.ids[at], self.sims[at]


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of lists of one length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _scan(
    items: DataFrame, queries: DataFrame, keep, item_id: str, query_id: str, vector: str, digits: int, block: int,
    legs: Sequence[str | None] = (None,), text: str | None = None, group: str | None = None,
) -> DataFrame:
    """Score all items against all queries, once for all legs, and keep what ``keep`` chooses of each task's items.

    ``keep(n, digits)`` makes what holds the choice of n searches (a search is a query on a leg) and is offered similarities.
    A leg is None or a query column with a keyword, and then only items whose ``text`` contains it
    count; the distinct keywords are gathered, and texts stay in the JVM. With ``group``, a column of both, only items of the query's group count.
    Queries are dealt into blocks of at most ``block`` vectors, the bound of what is broadcast and of
    what a task holds, beside ``TILE`` similarities at a time; items stream past each block, dealt evenly to tasks, and only what a task
    has chosen at its end leaves it, never the pairs. The work is queries times items: for very many queries use ``index.CellIndex``.
    """
    nothing = F.lit(None).cast("string")
    words = [F.col(leg) if leg else nothing for leg in legs]
    same = F.col(group).cast("string") if group else nothing
    chosen = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v"), F.array(*words).alias("w"), same.alias("g"))
    blocks = max(1, -(-chosen.count() // block))
    spark = items.sparkSession
    named = [r[0] for r in chosen.select(F.explode("w").alias("w")).where("w IS NOT NULL").distinct().collect()] if any(legs) else []
    has = F.filter(F.lit(named), lambda w: F.contains(F.col(text), w)) if named and text else F.array().cast("array<string>")
    base = items.select(F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v"), has.alias("t"), same.alias("g"))
    base = base.where("v IS NOT NULL").repartition(2 * max(spark.sparkContext.defaultParallelism, 4), F.xxhash64("id"))

    def run(shared):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, words, groups = shared.value
            # Searches with the same keyword and group look at the same items.
            searches: dict[tuple, list[int]] = {}
            for i, (ws, g) in enumerate(zip(words, groups, strict=True)):
                for leg, name in enumerate(legs):
                    if (name is None or ws[leg] is not None) and (group is None or g is not None):
                        searches.setdefault((ws[leg] if name else None, g), []).append(leg * len(ids) + i)
            searches = {key: np.array(at) for key, at in searches.items()}
            kept = keep(len(ids) * len(legs), digits)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                keys, units = batch.column("id").to_numpy(), _vectors(batch.column("v"))
                by_word, by_group = defaultdict(list), defaultdict(list)
                for w, i in zip(batch.column("t").flatten().to_pylist(), pc.list_parent_indices(batch.column("t")).to_pylist(), strict=True):
                    by_word[w].append(i)
                for i, g in enumerate(batch.column("g").to_pylist() if group else ()):
                    by_group[g].append(i)
                for (word, g), at in searches.items():
                    own = np.arange(len(keys)) if word is None else np.array(by_word.get(word, ()), np.int64)
                    if group:
                        own = np.intersect1d(own, np.array(by_group.get(g, ()), np.int64), assume_unique=True)
                    for a in range(0, len(own), 4096):
                        part = own[a : a + 4096]
                        some = units[part].T
                        step = max(1, TILE // len(part))
                        for b in range(0, len(at), step):
                            now = at[b : b + step]
                            kept.offer(now, ids[now % len(ids)], keys[part], vectors[now % len(ids)] @ some)
            at, found, sims = kept.found()
            for a in range(0, len(at), 65536):
                now = at[a : a + 65536]
                columns = (ids[now % len(ids)], found[a : a + 65536], sims[a : a + 65536], (now // len(ids)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "similarity", "leg"])

        return of

    found = None
    for i in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else chosen
        rows = part.where("v IS NOT NULL").collect()
        value = (np.array([r["q"] for r in rows], np.int64), _unit([r["v"] for r in rows]) if rows else None, [r["w"] for r in rows], [r["g"] for r in rows])
        hits = base.mapInArrow(run(spark.sparkContext.broadcast(value)), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def top_k(
    items: DataFrame,
    queries: DataFrame,
    k: int = 5,
    item_id: str = "id",
    query_id: str = "query_id",
    vector: str = "embedding",
    digits: int = 6,
    block: int = 8192,
    keywords: str | None = None,
    text: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """``query_id, id, similarity, rank``: the k nearest items of every query by cosine, ties by id.

    With ``keywords`` (a query column) only items whose ``text`` contains the query's; with ``group`` only items of the query's group.
    """
    return _ranked(_scan(items, queries, lambda n, d: _Nearest(k, n, d), item_id, query_id, vector, digits, block, (keywords,), text, group), k).drop("leg")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "leg").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_before(
    items: DataFrame, queries: DataFrame, item_id: str = "id", query_id: str = "query_id", vector: str = "embedding", digits: int = 6, block: int = 8192
) -> DataFrame:
    """``query_id, max_similarity``: how near the nearest item of a smaller id is."""
    hits = _scan(items, queries, _Before, item_id, query_id, vector, digits, block)
    return hits.groupBy("query_id").agg(F.max("similarity").alias("max_similarity"))


def first_between(
    items: DataFrame, queries: DataFrame, low: float, high: float, item_id: str = "id", query_id: str = "query_id", vector: str = "embedding", digits: int = 6, block: int = 8192
) -> DataFrame:
    """``query_id, id``: the item of smallest id whose similarity lies strictly between the limits."""
    hits = _scan(items, queries, lambda n, d: _Between(low, high, n, d), item_id, query_id, vector, digits, block)
    return hits.groupBy("query_id").agg(F.min("id").alias("id"))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, vector_weight: float = 0.7, keyword_weight: float = 0.3, digits: int = 9) -> DataFrame:
    """``query_id, id, combined_score, rank``: hits of all legs merged by id.

    Each leg has ``query_id, id, similarity, rank``; keyword legs also ``leg`` (from
    1), and an item counts once for every keyword leg it is in. Ties keep the order
    in which items were first met: the vector leg, then the keyword legs.
    """
    columns = ("query_id", "id", "similarity", "leg", "rank")
    return _fused(vector_hits.withColumn("leg", F.lit(0)).select(*columns).unionByName(keyword_hits.select(*columns)), k, vector_weight, keyword_weight, digits)


def _fused(hits: DataFrame, k: int, vector_weight: float = 0.7, keyword_weight: float = 0.3, digits: int = 9) -> DataFrame:
    """As ``fuse``, of all legs in one frame; leg 0 is that of vectors."""
    weighted = F.col("similarity") * F.when(F.col("leg") == 0, vector_weight).otherwise(keyword_weight)
    sums = hits.groupBy("query_id", "id").agg(F.round(F.sum(weighted), digits).alias("combined_score"), F.min(F.struct("leg", "rank")).alias("met"))
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "met", "id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("met")


def hybrid(items: DataFrame, queries: DataFrame, keywords: list[str], k: int = 5, text: str = "text", keep: int | None = None, **weights) -> DataFrame:
    """Vector leg and one leg for each keyword column of ``queries``, each of 2k hits of the same scan, fused to k (or ``keep``)."""
    hits = _ranked(_scan(items, queries, lambda n, d: _Nearest(2 * k, n, d), "id", "query_id", "embedding", 6, 8192, (None, *keywords), text), 2 * k)
    return _fused(hits, keep or k, **weights)


def best_per_id(hits: DataFrame, keys: list[str], score: Column, k: int, order: list[str]) -> DataFrame:
    """Hits of several query variants with each id once, at its best score, the k best of each ``order`` group."""
    once = hits.groupBy(*keys).agg(F.max(score).alias("score"))
    ranks = Window.partitionBy(*order).orderBy(F.desc("score"), *[c for c in keys if c not in order])
    return once.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score: Column, k: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """The k best of first-stage hits by a second score."""
    ranks = Window.partitionBy(query).orderBy(F.desc("rerank_score"), item)
    return hits.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def label_recall_precision(hits: DataFrame, items: DataFrame, queries: DataFrame, k: int, item_id: str = "id", query_id: str = "query_id", label: str = "label") -> DataFrame:
    """``query_id, recall, precision`` at k where all items of a query's label are relevant to it.

    Relevant items are counted by label and hits looked up by id, so no pair of a query and a relevant item is made.
    """
    labels = items.select(F.col(item_id).alias("id"), F.col(label).alias("_label"))
    sizes = labels.groupBy("_label").agg(F.count("*").alias("relevant"))
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(label).alias("_wanted"))
    good = hits.where(F.col("rank") <= k).join(labels, "id").join(wanted, "query_id").where("_label = _wanted")
    counts = good.groupBy("query_id").agg(F.count("*").alias("hits"))
    found = wanted.join(sizes, F.col("_wanted") == F.col("_label")).join(counts, "query_id", "left")
    n = F.coalesce("hits", F.lit(0))
    return found.select("query_id", (n / F.col("relevant")).alias("recall"), (n / F.lit(k)).alias("precision"))


def recall_precision(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, recall, precision`` at k. Both frames have ``query_id, id``; hits also ``rank``."""
    good = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    found = (
        hits.where(F.col("rank") <= k)
        .join(relevant.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    )
    return found.join(good, "query_id").select(
        "query_id", (F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision")
    )
