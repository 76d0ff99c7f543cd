"""What must not grow with the number of keys, queries or paths."""

import difflib
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from qaloom.functions import udfs
from qaloom.operators import chunking, graph, judging, retrieval, tasks
from qaloom.plans import ORACLES
from qaloom.sources.store import Checkpoints, Runs


def test_run_log_has_a_file_a_task_however_many_runs(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 2).select(
        F.concat(F.lit("r"), F.col("id") % 500).alias("run_id"), F.lit("metric").alias("kind"), F.lit("m").alias("name"), F.col("id").alias("step"), (F.col("id") / 2).alias("number")
    )
    runs = Runs(spark, f"{tmp_path}/runs")
    runs.log(rows)
    assert len([f for _, _, fs in os.walk(f"{tmp_path}/runs") for f in fs if f.endswith(".parquet")]) == 2
    got = {r["run_id"]: (r["step"], r["number"]) for r in runs.last_metrics().collect()}
    assert got == {f"r{k}": (3500 + k, (3500 + k) / 2) for k in range(500)}


def test_checkpoint_log_has_a_file_a_task_however_many_threads(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 2).select(F.concat(F.lit("t"), F.col("id") % 400).alias("thread_id"), F.col("id").alias("checkpoint_id"), F.lit("s").alias("state"))
    log = Checkpoints(spark, f"{tmp_path}/log")
    log.save(rows)
    log.save(rows.limit(0).unionByName(spark.createDataFrame([("t7", 9999, "last"), ("", 1, "empty")], rows.schema)).coalesce(1))
    assert len([f for _, _, fs in os.walk(f"{tmp_path}/log") for f in fs if f.endswith(".parquet")]) <= 4
    latest = {r["thread_id"]: r["checkpoint_id"] for r in log.latest().collect()}
    assert len(latest) == 401 and latest["t7"] == 9999 and latest["t8"] == 1608 and latest[""] == 1
    assert log.list("t8").count() == 5


def test_rarest_paths_are_those_of_all_paths(spark):
    rng = random.Random(5)
    names = [f"N{'abcd'[i % 4] * (i // 4 + 1)}" for i in range(24)]  # many are the beginning of another
    weights = [1 / (i + 1) for i in range(24)]
    mentions = [(p // 9, p % 9, e) for p in range(60) for e in rng.choices(names, weights, k=rng.randint(1, 5))]
    df = spark.createDataFrame(mentions, "doc long, para long, entity string")
    edges, freq = graph.co_occurrence(df), df.groupBy("entity").agg(F.count("*").alias("n"))
    roots = graph.both_ways(edges).select(F.col("a").alias("node")).distinct()
    found = graph.paths(edges, roots, 2)
    for k in (1, 3, 20):
        want = sorted(tuple(map(str, r)) for r in graph.rare_first(found, freq, k).select("path", "hops", "rarest", "rank").collect())
        assert want == sorted(tuple(map(str, r)) for r in graph.rarest_paths(edges, freq, k).select("path", "hops", "rarest", "rank").collect())


def test_rarest_paths_start_from_every_entity(spark):
    rows = spark.sql("SELECT 1L AS doc_id, 'Zebras Yonder Xenons' AS text")
    assert "LIKE" not in ORACLES["gr_secondary"] and "LIKE 'Er%'" in ORACLES["gr_paths"]
    mentioned = rows.select(F.lit(1).alias("doc"), F.lit(1).alias("para"), F.explode(F.split("text", " ")).alias("entity"))
    got = graph.rarest_paths(graph.co_occurrence(mentioned), mentioned.groupBy("entity").agg(F.count("*").alias("n")), 20)
    assert {r["path"][0] for r in got.collect()} == {"Zebras", "Yonder", "Xenons"} and got.count() == 12


def _held(k, sims, ids, queries):
    """What a keeper has of similarities offered in parts."""
    kept = k(len(queries), 6)
    for a in range(0, sims.shape[1], 37):
        for b in range(0, len(queries), 3):
            at = np.arange(b, min(b + 3, len(queries)))
            kept.offer(at, queries[at], ids[a : a + 37], sims[at, a : a + 37])
    return sorted((int(q), int(i), float(s)) for q, i, s in zip(*kept.found(), strict=True))


def test_keepers_choose_as_if_all_were_at_hand():
    rng = np.random.default_rng(3)
    ids, queries = rng.permutation(500), np.arange(0, 500, 50)
    sims = rng.normal(size=(10, 500)).round(1) / 4  # many ties
    sims[3] = np.sort(sims[3])
    top = np.round(sims, 6)
    order = [np.lexsort((ids, -row)) for row in top]
    want = sorted((q, int(ids[i]), float(top[q, i])) for q in range(10) for i in order[q][:7])
    assert _held(lambda n, d: retrieval._Nearest(7, n, d), sims, ids, queries) == want
    best = [(q, top[q][ids < queries[q]].max()) for q in range(10) if (ids < queries[q]).any()]
    assert [(q, s) for q, _, s in _held(retrieval._Before, sims, ids, queries)] == best
    inside = [(q, int(ids[(top[q] > 0.2) & (top[q] < 0.4)].min())) for q in range(10)]
    assert [(q, i) for q, i, _ in _held(lambda n, d: retrieval._Between(0.2, 0.4, n, d), sims, ids, queries)] == inside


def test_a_scan_is_bounded_and_counts_keywords(spark):
    items = spark.range(0, 6000).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).cast("array<float>").alias("embedding"))

    class Bounded(retrieval._Nearest):
        def offer(self, at, queries, ids, sims):
            assert sims.size <= 1 << 20
            super().offer(at, queries, ids, sims)

    hits = retrieval._scan(items, items.withColumnRenamed("id", "query_id"), lambda n, d: Bounded(5, n, d), "id", "query_id", "embedding", 6, 8192)
    assert hits.count() <= 6000 * 5 * 2 * max(spark.sparkContext.defaultParallelism, 4)
    part = items.where("id < 40").withColumn("text", F.when(F.col("id") % 2 == 0, "a the").otherwise(F.when(F.col("id") % 3 == 0, None).otherwise("der")))
    asked = part.where("id < 6").select(F.col("id").alias("query_id"), "embedding", F.element_at(F.array(F.lit("the"), F.lit("der"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("kw"))
    got = retrieval.top_k(part, asked, 100, keywords="kw", text="text", block=2).groupBy("query_id").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 20, 1: 13, 3: 20, 4: 13}


def test_resubscription_sorts_no_events(spark):
    rows = [(t, i, "working" if (t + i) % 9 else "failed") for t in range(50) for i in range(12)] + [(7, 3, "working"), (90, 1, None)]
    events = spark.createDataFrame(rows, "task_id long, seq long, state string")
    since = spark.createDataFrame([(t, t % 5) for t in range(60)] + [(90, 1)], "task_id long, seq long")
    found = tasks.resubscribe(events, since)
    want = []
    for t in range(50):
        own = sorted({(i, s) for k, i, s in rows if k == t})
        before = [x for x in own if x[0] <= t % 5]
        if any(s == "failed" for _, s in before):
            continue
        end = min((i for i, s in own if i > t % 5 and s == "failed"), default=99)
        want += [(t, before[-1][0], "task", "working")] + [(t, i, "status", s) for k, i, s in rows if k == t and t % 5 < i <= end]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    status = found.where("kind = 'status'")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in status and "Sort" not in status


def test_chunks_leave_in_bounded_batches(spark):
    rows = ((i, 0, "x" * 90) for i in range(50_000))
    schema = pa.schema([("id", pa.int64()), ("chunk_index", pa.int32()), ("chunk", pa.string())])
    sizes = [(b.num_rows, b.nbytes) for b in chunking.in_parts(rows, schema)]
    assert sum(n for n, _ in sizes) == 50_000 and max(b for _, b in sizes) < 2 * chunking.OUT
    docs = spark.createDataFrame([(1, "a b\n" * 9000), (2, None), (None, "c\nd")], "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in chunking.separator_chunks(docs, chunk_size=99, overlap=20).collect()]
    assert got == [(1, i, w) for i, w in enumerate(chunking.separator_windows("a b\n" * 9000, 99, 20, "\n"))] + [(None, 0, "c\nd")]


def test_difflib_compares_only_windows_that_may_be_better(monkeypatch):
    rng = random.Random(1)
    page = "".join(rng.choices("abcdefghij ", k=1500))
    quote = "".join(c if i % 4 else "#" for i, c in enumerate(page[700:740]))
    best, found = max(((difflib.SequenceMatcher(None, quote, page[i : i + 40]).ratio(), -i) for i in range(len(page) - 39)))
    calls, real = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    assert udfs.best_window_ratio(page, quote) == (best, page[-found : 40 - found]) and len(calls) < 200
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert udfs.common_length({c: sum(1 << i for i, y in enumerate(a) if y == c) for c in a}, len(a), b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_citations_for_difflib_are_not_put_in_few_tasks(spark):
    pages = spark.range(300).select("id", F.lit(1).alias("page_number"), F.concat(F.lit("a page of few words "), "id").alias("text")).withColumnRenamed("id", "doc")
    cites = pages.select("doc", "page_number", F.concat(F.lit("x"), F.substring("text", 2, 12)).alias("quote"))
    assert len({r[0] for r in judging.verify_citations(cites, pages).select(F.spark_partition_id()).collect()}) > 4


def test_paths_are_dealt_by_how_many_they_make(spark):
    star = spark.range(1, 400).select(F.lit("hub").alias("a"), F.format_string("leaf%d", "id").alias("b"))
    links = graph.both_ways(star)
    now = star.select(F.array("b", "a").alias("path"))
    made = graph._extended(now, links, 10_000)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == made.distinct().count() == 399 * 398 and max(sizes) < 60_000 and len(sizes) > 6
    got = {tuple(r["path"]) for r in graph.paths(star, spark.createDataFrame([("leaf7",)], "node string"), 2).collect()}
    assert got == {("leaf7", "hub")} | {("leaf7", "hub", f"leaf{i}") for i in range(1, 400) if i != 7}
