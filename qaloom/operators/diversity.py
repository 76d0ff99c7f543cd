"""Greedy acceptance: a candidate is compared with the accepted ones before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .judging import COGNITIVE_TARGETS, DIFFICULTY_TARGETS, TYPE_TARGETS, UNKNOWN_TARGET


class Vectors:
    """Unit vectors in a buffer that doubles, so that adding one copies none of the others as a rule."""

    def __init__(self):
        self.buffer, self.n = np.zeros((0, 0)), 0

    def __len__(self) -> int:
        return self.n

    def rows(self) -> np.ndarray:
        return self.buffer[: self.n]

    def add(self, v: np.ndarray) -> None:
        if self.n == len(self.buffer):
            wider = np.zeros((max(16, 2 * self.n), len(v)))
            if self.n:
                wider[: self.n] = self.rows()
            self.buffer = wider
        self.buffer[self.n] = v
        self.n += 1

    def nearest(self, v: np.ndarray) -> float:
        return float((self.rows() @ v).max())


def unit(vector) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    return v / max(np.linalg.norm(v), 1e-300)


def topic_memory(items: DataFrame, group: str, order: str, vector: str, limit: float = 0.85) -> DataFrame:
    """``group, order, accepted``: accepted if no accepted one before is more similar than ``limit``.

    Sequential by nature, so groups are the unit of parallelism; a group is walked
    in order with its accepted vectors as state. Use a key with many values.
    """
    kinds = dict(items.dtypes)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o")
        kept, flags = Vectors(), []
        for v in map(unit, part["v"]):
            fine = not len(kept) or kept.nearest(v) <= limit
            if fine:
                kept.add(v)
            flags.append(fine)
        return pd.DataFrame({group: part["g"], order: part["o"], "accepted": flags})

    base = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(vector).alias("v"))
    return base.groupBy("g").applyInPandas(walk, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, accepted boolean")


def _share_score(counts: dict, value, total: int, targets: dict[str, float]) -> float:
    target = targets.get(value, UNKNOWN_TARGET)
    share = counts.get(value, 0) / total
    return 1.0 if share <= target else max(0.0, 1 - (share - target) / target)


class DiversityState:
    """Accepted vectors and counts; what a batch walk and a stream both keep."""

    def __init__(self, threshold: float = 0.85):
        self.threshold, self.vectors = threshold, Vectors()
        self.counts: tuple[dict, dict, dict] = ({}, {}, {})

    def offer(self, vector, kind: str, difficulty: str, level: str) -> tuple[bool, float]:
        v, score = unit(vector), 1.0
        if n := len(self.vectors):
            content = 1 - self.vectors.nearest(v)
            rest = [
                _share_score(c, x, n, t)
                for c, x, t in zip(self.counts, (kind, difficulty, level), (TYPE_TARGETS, DIFFICULTY_TARGETS, COGNITIVE_TARGETS), strict=True)
            ]
            score = 0.35 * content + 0.30 * rest[0] + 0.20 * rest[1] + 0.15 * rest[2]
        if fine := score >= self.threshold:
            self.vectors.add(v)
            for c, x in zip(self.counts, (kind, difficulty, level), strict=True):
                c[x] = c.get(x, 0) + 1
        return fine, score


def greedy_diversity(items: DataFrame, group: str, order: str, threshold: float = 0.85) -> DataFrame:
    """``group, order, accepted, score`` over columns embedding, type, difficulty, cognitive_level."""
    kinds = dict(items.dtypes)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        state, part = DiversityState(threshold), part.sort_values("o")
        found = [state.offer(*r) for r in zip(part["embedding"], part["type"], part["difficulty"], part["cognitive_level"], strict=True)]
        return pd.DataFrame({group: part["g"], order: part["o"], "accepted": [f for f, _ in found], "score": [s for _, s in found]})

    base = items.select(F.col(group).alias("g"), F.col(order).alias("o"), "embedding", "type", "difficulty", "cognitive_level")
    return base.groupBy("g").applyInPandas(walk, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, accepted boolean, score double")


