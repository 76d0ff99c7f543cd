"""Streams give what the batch operators give, across restarts."""

import time

from pyspark.sql import functions as F

from qaloom.operators.diversity import greedy_diversity
from qaloom.operators.tasks import reduce_events
from qaloom.streaming.stateful import dedupe_messages, stream_diversity, stream_tasks, telemetry

EVENTS = [(1, 1, "submitted"), (2, 1, "submitted"), (1, 2, "working"), (1, 3, "completed"), (1, 4, "working"), (2, 2, "failed")]


def drain(stream, name, path, mode):
    q = stream.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/ckpt")
    q = (q.option("path", f"{path}/out") if mode == "append" else q).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_tasks_stream_equals_batch_across_a_restart(spark, tmp_path):
    schema = "task_id long, seq long, state string"
    latest = {}
    for k, part in enumerate((EVENTS[:3], EVENTS[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_tasks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))

        def keep(df, _):
            latest.update({r["task_id"]: (r["state"], r["n_events"], r["last_seq"]) for r in df.collect()})

        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination(120)
        time.sleep(0.1 * k)
    want = {r["task_id"]: (r["state"], r["n_events"], r["last_seq"]) for r in reduce_events(spark.createDataFrame(EVENTS, schema)).collect()}
    assert latest == want


def test_diversity_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("label").alias("chapter"), F.col("vec_id").alias("id"), "embedding", F.lit("factoid").alias("type"), F.lit("expert").alias("difficulty"), F.lit("apply").alias("cognitive_level")
    )
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_diversity(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), threshold=0.3)
    drain(stream, "diversity", str(tmp_path), "append")
    got = {r["id"]: r["accepted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["id"]: r["accepted"] for r in greedy_diversity(e, "chapter", "id", 0.3).collect()}
    assert got == want and len(set(got.values())) == 2


def test_dedupe_and_telemetry(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ev.unionByName(ev).withColumn("message_id", F.col("event_id"))
    twice.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dedupe_messages(spark.readStream.schema(twice.schema).parquet(f"{tmp_path}/in"))
    drain(stream, "dedupe", str(tmp_path), "append")
    assert spark.read.parquet(f"{tmp_path}/out").count() == ev.count()
    assert telemetry(ev).agg(F.sum("calls")).first()[0] == ev.count()
