"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.operators.diversity import DiversityState
from qaloom.operators.tasks import TERMINAL


def stream_tasks(events: DataFrame) -> DataFrame:
    """Updated task states from a stream of (task_id, seq, state); terminal states do not change."""

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        name, last, n = state.get if state.exists else (None, -1, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for seq, value in zip(rows["seq"], rows["state"], strict=True):
            if name in TERMINAL or seq <= last:
                continue
            name, last, n = value, int(seq), n + 1
        state.update((name, last, n))
        yield pd.DataFrame({"task_id": [key[0]], "state": [name], "n_events": [n], "last_seq": [last]})

    return events.groupBy("task_id").applyInPandasWithState(
        update, "task_id long, state string, n_events long, last_seq long", "state string, last long, n long", "update", "NoTimeout"
    )


def stream_diversity(questions: DataFrame, group: str = "chapter", threshold: float = 0.85) -> DataFrame:
    """Acceptance of streamed questions (group, id, embedding, type, difficulty, cognitive_level) with one state a group."""
    kind = dict(questions.dtypes)[group]

    def walk(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else DiversityState(threshold)
        rows = pd.concat(list(parts)).sort_values("id")
        found = [now.offer(*r) for r in zip(rows["embedding"], rows["type"], rows["difficulty"], rows["cognitive_level"], strict=True)]
        state.update((pickle.dumps(now),))
        yield pd.DataFrame({group: [key[0]] * len(rows), "id": rows["id"], "accepted": [f for f, _ in found], "score": [s for _, s in found]})

    return questions.groupBy(group).applyInPandasWithState(
        walk, f"`{group}` {kind}, id long, accepted boolean, score double", "state binary", "append", "NoTimeout"
    )


def dedupe_messages(messages: DataFrame, key: str = "message_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Messages without repeats of an id inside the watermark."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def telemetry(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: cost and calls by agent and event-time window, on a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", delay) if events.isStreaming else timed
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("cost"))
