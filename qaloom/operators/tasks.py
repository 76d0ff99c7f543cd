"""Task state from events, task listings and message history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "canceled", "rejected")


def reduce_events(events: DataFrame) -> DataFrame:
    """Current task of (task_id, seq, state) events: last state before or at the first terminal one.

    Terminal states are immutable, so what follows one is ignored. Aggregates
    combine before the shuffle; no task's events are gathered.
    """
    end = F.min(F.when(F.col("state").isin(*TERMINAL), F.col("seq")))
    ends = events.groupBy("task_id").agg(end.alias("end"))
    return (
        events.join(ends, "task_id")
        .where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
        .groupBy("task_id")
        .agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n_events"), F.max("seq").alias("last_seq"))
    )


def artifacts(events: DataFrame) -> DataFrame:
    """``task_id, artifact_id, text, complete`` from (task_id, artifact_id, seq, text, append, last_chunk).

    An event without append starts anew; an artifact is complete if its last event says so.
    """
    starts = F.max(F.when(~F.col("append"), F.col("seq")))
    last = events.groupBy("task_id", "artifact_id").agg(F.coalesce(starts, F.lit(-(2**62))).alias("start"))
    return (
        events.join(last, ["task_id", "artifact_id"]).where("seq >= start").groupBy("task_id", "artifact_id")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("p"), F.max_by("last_chunk", "seq").alias("complete"))
        .select("task_id", "artifact_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "complete")
    )


def drive(outcomes: DataFrame, transitions: list[tuple[str, str, str]], start: str) -> DataFrame:
    """``run, node, steps`` after all outcomes (run, seq, outcome) of a run, in order, from ``start`` by transitions (node, outcome, next).

    An outcome without a transition leaves a run where it is. A fold over the ordered outcomes of a run, in the JVM.
    """
    table = F.create_map(*(F.lit(x) for a, o, b in transitions for x in (f"{a}|{o}", b)))
    each = outcomes.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("seq", "outcome"))).alias("o"))
    node = F.aggregate("o", F.lit(start), lambda at, x: F.coalesce(F.try_element_at(table, F.concat(at, F.lit("|"), x["outcome"])), at))
    return each.select("run", node.alias("node"), F.size("o").cast("long").alias("steps"))


def unique_messages(messages: DataFrame, key: str = "message_id", order: str = "seq") -> DataFrame:
    """The first of the messages of each id; messages without an id are all different. Minima combine before the shuffle."""
    named = messages.where(F.col(key).isNotNull())
    rest = [c for c in messages.columns if c != key]
    first = named.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(key, "_first.*")
    return first.select(*messages.columns).unionByName(messages.where(F.col(key).isNull()))


def resubscribe(events: DataFrame, since: DataFrame) -> DataFrame:
    """``task_id, seq, kind, state`` of a stream taken up again after the events up to ``since`` (task_id, seq).

    The first row of a task (kind 'task') is its state as of then, the others (kind 'status') the
    events after it, in order; a task that had ended, or of which nothing is known, has no stream.
    """
    # Dealt once to all partitions, which are not put together again: events are many where they are few bytes. Events stream past hashes of
    # one row a task, and what a task needs to know are numbers, which are aggregated in hashes too: nothing sorts or holds the events.
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The filter makes its three readers the same to Spark, so that one shuffle serves them.
    dealt = events.select("task_id", "seq", "state").where("task_id IS NOT NULL AND seq IS NOT NULL").repartition(n, "task_id")
    asked = dealt.join(since.select("task_id", F.col("seq").alias("since")).hint("shuffle_hash"), "task_id")
    known, ended = F.col("seq") <= F.col("since"), F.col("state").isin(*TERMINAL)
    facts = asked.groupBy("task_id").agg(
        F.max(F.when(known, F.col("seq"))).alias("last"), F.max(F.when(known & F.col("state").isNotNull(), F.col("seq"))).alias("told"),
        F.max(F.when(known & ended, 1)).alias("over"), F.min(F.when(~known & ended, F.col("seq"))).alias("end"),
    ).where("last = told AND over IS NULL").select("task_id", "last", "end")
    kept = dealt.join(facts.hint("shuffle_hash"), "task_id").where("seq >= last AND (end IS NULL OR seq <= end)")
    # Not 'seq = last', which would become a key of the join and shuffle the events anew.
    task = kept.where("seq <= last").groupBy("task_id", "seq").agg(F.max("state").alias("state"))
    status = kept.where("seq > last").select("task_id", "seq", F.lit("status").alias("kind"), "state")
    return task.select("task_id", "seq", F.lit("task").alias("kind"), "state").unionByName(status)


def list_page(tasks: DataFrame, where: Column | None = None, after: tuple | None = None, size: int = 50) -> DataFrame:
    """One page, newest first, after the cursor (updated, id); the cursor of the next page is its last row."""
    if not 1 <= size <= 100:
        raise ValueError("size must be 1 to 100")
    found = tasks if where is None else tasks.where(where)
    if after:
        ts, key = F.lit(after[0]), F.lit(after[1])
        found = found.where((F.col("updated") < ts) | ((F.col("updated") == ts) & (F.col("id") > key)))
    return found.orderBy(F.desc("updated"), "id").limit(size)


def last_n(messages: DataFrame, n: int | None, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each context; none for 0, all for None."""
    if n is None:
        return messages
    ranks = Window.partitionBy(group).orderBy(F.desc(order))
    return messages.withColumn("_r", F.row_number().over(ranks)).where(F.col("_r") <= n).drop("_r")
