"""Queries for aggregates, windows, classifiers, scores, negatives, graphs and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaloom.operators import diversity, graph, judging, tasks
from qaloom.sources.store import stats

from .registry import (
    CHUNKS, EDGES, MENTIONS, QUESTIONS, SCORES, chunks, mentions, query, questions, scores,
)
from .search import _SEQ, sequences

W = "WITH "
R = lambda c, n=6: F.round(c, n)


@query("agg_stats", W + CHUNKS + " SELECT count(*) AS total_chunks, count(DISTINCT chapter) AS unique_chapters, count(DISTINCT section_id) AS unique_sections, min(page_number) AS page_min, max(page_number) AS page_max, 'docs' AS collection_name FROM chunks")
def _(read):
    return stats(chunks(read), "docs")


@query("agg_num_results", W + CHUNKS + " SELECT chapter, count(*) AS num_results, count(*) FILTER (WHERE contains(text, 'the')) AS num_matches FROM chunks GROUP BY 1")
def _(read):
    return chunks(read).groupBy("chapter").agg(F.count("*").alias("num_results"), F.count(F.when(F.contains("text", F.lit("the")), 1)).alias("num_matches"))


@query("agg_section_coverage", W + QUESTIONS + " SELECT chapter, count(*) AS n FROM questions GROUP BY 1")
def _(read):
    return questions(read).groupBy("chapter").agg(F.count("*").alias("n"))


@query("agg_chapter_target", W + QUESTIONS + """, c AS (SELECT chapter, count(*) AS n FROM questions GROUP BY 1)
  SELECT chapter, n, (sum(n) OVER () // count(*) OVER ())::BIGINT AS target, n > sum(n) OVER () // count(*) OVER () AS over FROM c""")
def _(read):
    c = questions(read).groupBy("chapter").agg(F.count("*").alias("n"))
    total = c.agg(F.floor(F.sum("n") / F.count("*")).alias("target"))
    return c.join(F.broadcast(total), F.lit(True)).withColumn("over", F.col("n") > F.col("target"))


@query("agg_coverage_var", W + QUESTIONS + """, c AS (SELECT chapter, count(*) AS n FROM questions GROUP BY 1)
  SELECT chapter, abs(n - avg(n) OVER ()) / avg(n) OVER () <= 0.2 AS balanced FROM c""")
def _(read):
    c = questions(read).groupBy("chapter").agg(F.count("*").alias("n"))
    mean = c.agg(F.avg("n").alias("m"))
    return c.join(F.broadcast(mean), F.lit(True)).select("chapter", (F.abs(F.col("n") - F.col("m")) / F.col("m") <= 0.2).alias("balanced"))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(question, '{'|'.join(ps)}', 'i') THEN '{t}'" for t, ps in judging.QUESTION_TYPES.items()) + " ELSE 'unknown' END"
_BLOOM = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(question), '{v}')" for v in vs) + f" THEN '{lv}'" for lv, vs in judging.BLOOM_VERBS.items()) + " ELSE 'understand' END"
TYPED = QUESTIONS + f", typed AS (SELECT *, {_TYPE} AS type, {_BLOOM} AS level FROM questions)"


def typed(read):
    return questions(read).select("*", judging.question_type(F.col("question")).alias("type"), judging.bloom_level(F.col("question")).alias("level"))


@query("cls_qtype", W + TYPED + " SELECT id, question, type FROM typed")
def _(read):
    return typed(read).select("id", "question", "type")


@query("cls_bloom", W + TYPED + " SELECT id, level FROM typed")
def _(read):
    return typed(read).select("id", "level")


@query("cls_difficulty", W + TYPED + " SELECT id, CASE WHEN level IN ('remember', 'understand') THEN 'beginner' WHEN level IN ('apply', 'analyze') THEN 'intermediate' ELSE 'expert' END AS difficulty FROM typed")
def _(read):
    easy, middle = F.col("level").isin("remember", "understand"), F.col("level").isin("apply", "analyze")
    return typed(read).select("id", F.when(easy, "beginner").when(middle, "intermediate").otherwise("expert").alias("difficulty"))


@query("cls_taxonomy", "SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS hops FROM lineitem GROUP BY 1")
def _(read):
    return read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_distinct("l_partkey").alias("hops"))


_DIST = W + TYPED + """, u AS (SELECT 'type' AS dimension, type AS value FROM typed UNION ALL SELECT 'difficulty', difficulty FROM typed UNION ALL SELECT 'cognitive_level', cognitive_level FROM typed),
 d AS (SELECT dimension, value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS share FROM u GROUP BY dimension, value) """


@query("agg_distribution", _DIST + "SELECT dimension, value, n, round(share, 6) AS share FROM d")
def _(read):
    return judging.distribution(typed(read), "type", "difficulty", "cognitive_level").withColumn("share", R(F.col("share")))


@query("agg_dist_gap", _DIST + "SELECT value, round(share - target, 6) AS gap FROM d JOIN (VALUES ('beginner', 0.3::DOUBLE), ('intermediate', 0.5), ('expert', 0.2)) t(value, target) USING (value) WHERE dimension = 'difficulty'")
def _(read):
    spark = read("region").sparkSession
    target = spark.createDataFrame(list(judging.DIFFICULTY_TARGETS.items()), "value string, target double")
    return judging.distribution(typed(read), "difficulty").join(F.broadcast(target), "value").select("value", R(F.col("share") - F.col("target")).alias("gap"))


@query("nm_type_stats", W + TYPED + " SELECT type, chapter, count(*) AS n FROM typed GROUP BY GROUPING SETS ((type), (chapter), (type, chapter))")
def _(read):
    return typed(read).groupingSets([["type"], ["chapter"], ["type", "chapter"]], "type", "chapter").agg(F.count("*").alias("n")).select("type", "chapter", "n")


@query("nm_complexity", W + TYPED + " SELECT chapter, round(avg(list_position(['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'], level)), 6) AS load FROM typed GROUP BY 1")
def _(read):
    return typed(read).groupBy("chapter").agg(R(F.avg(F.array_position(F.array(*map(F.lit, judging.LEVELS)), F.col("level")))).alias("load"))


@query("agg_mean_scores", W + SCORES + " SELECT chapter, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy), 6) AS relevancy, round(avg(context_precision), 6) AS precision FROM scores GROUP BY 1")
def _(read):
    return scores(read).groupBy("chapter").agg(R(F.avg("faithfulness")).alias("faithfulness"), R(F.avg("answer_relevancy")).alias("relevancy"), R(F.avg("context_precision")).alias("precision"))


@query("agg_acceptance", W + SCORES + " SELECT chapter, round(avg((iterations <= 1)::INT), 6) AS first_try, round(avg(iterations), 6) AS avg_iterations, round(avg((iterations > 1)::INT), 6) AS reflexion_rate FROM scores GROUP BY 1")
def _(read):
    first = (F.col("iterations") <= 1).cast("int")
    return scores(read).groupBy("chapter").agg(R(F.avg(first)).alias("first_try"), R(F.avg("iterations")).alias("avg_iterations"), R(F.avg(1 - first)).alias("reflexion_rate"))


@query("agg_cost", """WITH x AS (SELECT event_type AS agent, user_id AS question, event_id % 900 + 100 AS tokens_in, event_id % 400 + 20 AS tokens_out, value AS cost FROM events)
  SELECT agent, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 4) AS cost,
         round(sum(cost) / count(DISTINCT question), 4) AS cost_per_question, round(sum(cost) / (SELECT sum(cost) FROM x), 6) AS share FROM x GROUP BY ROLLUP (agent)""")
def _(read):
    log = read("events").select(F.col("event_type").alias("agent"), F.col("user_id").alias("question"), (F.col("event_id") % 900 + 100).alias("tokens_in"), (F.col("event_id") % 400 + 20).alias("tokens_out"), F.col("value").alias("cost"))
    found = judging.cost_report(log)
    return found.select("agent", "calls", "tokens_in", "tokens_out", F.round("cost", 4).alias("cost"), F.round("cost_per_question", 4).alias("cost_per_question"), R(F.col("share")).alias("share"))


@query("agg_latency", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS worst, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def _(read):
    return read("events").groupBy("event_type").agg(R(F.avg("value")).alias("mean"), F.max("value").alias("worst"), R(F.percentile("value", 0.5)).alias("median"))


@query("agg_entity_freq", W + MENTIONS + ", f AS (SELECT entity, count(*) AS n FROM mentions GROUP BY 1) SELECT entity, n, n = 1 AS long_tail FROM f")
def _(read):
    return mentions(read).groupBy("entity").agg(F.count("*").alias("n")).withColumn("long_tail", F.col("n") == 1)


@query("agg_agreement", """WITH m AS (SELECT count(*) AS n, sum((quality = 1)::INT) AS a, sum((toxic = 0)::INT) AS b, sum(((quality = 1) = (toxic = 0))::INT) AS same FROM labels)
  SELECT n, round(same / n, 6) AS agreement, round((same / n - (a / n * b / n + (1 - a / n) * (1 - b / n))) / (1 - (a / n * b / n + (1 - a / n) * (1 - b / n))), 6) AS kappa FROM m""")
def _(read):
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    m = read("labels").agg(F.count("*").alias("n"), F.avg(a.cast("int")).alias("a"), F.avg(b.cast("int")).alias("b"), F.avg((a == b).cast("int")).alias("same"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return m.select("n", R(F.col("same")).alias("agreement"), R((F.col("same") - chance) / (1 - chance)).alias("kappa"))


@query("agg_significance", W + SCORES + """, g AS (SELECT avg(faithfulness) FILTER (WHERE id % 2 = 0) AS m0, avg(faithfulness) FILTER (WHERE id % 2 = 1) AS m1,
  var_samp(faithfulness) FILTER (WHERE id % 2 = 0) AS v0, var_samp(faithfulness) FILTER (WHERE id % 2 = 1) AS v1, count(*) FILTER (WHERE id % 2 = 0) AS n0, count(*) FILTER (WHERE id % 2 = 1) AS n1 FROM scores)
  SELECT round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS t FROM g""")
def _(read):
    x = lambda k: F.when(F.col("id") % 2 == k, F.col("faithfulness"))
    g = scores(read).agg(*(f(x(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    return g.select(R((F.col("m0") - F.col("m1")) / F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))).alias("t"))


@query("agg_rejections", W + SCORES + """ SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN faithfulness < 0.85 THEN 'faithfulness' END,
  CASE WHEN answer_relevancy < 0.8 THEN 'relevancy' END, CASE WHEN NOT citation_verified THEN 'citation' END], lambda x: x IS NOT NULL)) AS reason FROM scores) GROUP BY 1""")
def _(read):
    reasons = F.array_compact(F.array(F.when(F.col("faithfulness") < 0.85, "faithfulness"), F.when(F.col("answer_relevancy") < 0.8, "relevancy"), F.when(~F.col("citation_verified"), "citation")))
    return scores(read).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_REL = "rel AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, (l_partkey % 3 > 0)::INT AS relevant FROM lineitem)"
_CP = W + _REL + """, m AS (SELECT id, rank, avg(relevant) OVER (PARTITION BY id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS m FROM rel)
  SELECT id, round(sum(m / rank) / sum(1 / rank), 6) AS context_precision FROM m GROUP BY 1"""


def _precision(read):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rel = read("lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("rank"), (F.col("l_partkey") % 3 > 0).cast("int").alias("relevant"))
    return judging.context_precision(rel).select("id", R(F.col("context_precision")).alias("context_precision"))


@query("win_ctx_precision", _CP)
def _(read):
    return _precision(read)


@query("sc_precision", _CP)
def _(read):
    return _precision(read)


def _penalty_sql(value: str, targets: dict) -> str:
    case = "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in targets.items()) + " ELSE 0.1 END"
    return W + TYPED + f""", c AS (SELECT id, {case} AS target, count(*) OVER (PARTITION BY chapter ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  count(*) OVER (PARTITION BY chapter, {value} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same FROM typed)
  SELECT id, round(CASE WHEN seen = 0 OR same / seen <= target THEN 1.0 ELSE greatest(0.0, 1 - (same / seen - target) / target) END, 6)::DOUBLE AS score FROM c"""


def _penalty(read, value, targets):
    return judging.balance_penalty(typed(read), "chapter", "id", value, targets, "score").select("id", R(F.col("score")).alias("score"))


@query("win_type_penalty", _penalty_sql("type", judging.TYPE_TARGETS))
def _(read):
    return _penalty(read, "type", judging.TYPE_TARGETS)


@query("win_difficulty_penalty", _penalty_sql("difficulty", judging.DIFFICULTY_TARGETS))
def _(read):
    return _penalty(read, "difficulty", judging.DIFFICULTY_TARGETS)


@query("win_cognitive_penalty", _penalty_sql("cognitive_level", judging.COGNITIVE_TARGETS))
def _(read):
    return _penalty(read, "cognitive_level", judging.COGNITIVE_TARGETS)


@query("win_progress", W + SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY id) AS rn FROM scores),
  b AS (SELECT chapter, (rn - 1) // 10 AS bucket, count(*) AS n, sum((iterations <= 1)::INT) AS first FROM r GROUP BY ALL)
  SELECT chapter, bucket, sum(n) OVER w::BIGINT AS done, round(sum(first) OVER w / sum(n) OVER w, 6) AS acceptance FROM b WINDOW w AS (PARTITION BY chapter ORDER BY bucket)""")
def _(read):
    rn = F.row_number().over(Window.partitionBy("chapter").orderBy("id"))
    b = scores(read).withColumn("bucket", F.floor((rn - 1) / 10)).groupBy("chapter", "bucket").agg(F.count("*").alias("n"), F.sum((F.col("iterations") <= 1).cast("int")).alias("first"))
    w = Window.partitionBy("chapter").orderBy("bucket")
    return b.select("chapter", "bucket", F.sum("n").over(w).alias("done"), R(F.sum("first").over(w) / F.sum("n").over(w)).alias("acceptance"))


_LAST = "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= {}"


@query("win_history_n", _LAST.format(2))
def _(read):
    return tasks.last_n(read("conversations").select("conv_id", "turn", "role"), 2)


@query("win_last3", _LAST.format(3))
def _(read):
    return tasks.last_n(read("conversations").select("conv_id", "turn", "role"), 3)


_BEST = W + _SEQ + ", a AS (SELECT sequence_id, ord, (question % 101) / 100.0 AS score FROM s) "


def attempts(read):
    return sequences(read).select("sequence_id", "ord", (F.col("question") % 101 / 100.0).alias("score"))


@query("win_best_attempt", _BEST + "SELECT sequence_id, ord AS best, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY score DESC, ord) AS r FROM a) WHERE r = 1")
def _(read):
    return attempts(read).groupBy("sequence_id").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("best"), F.max("score").alias("score"))


@query("st_reflexion", _BEST + """, f AS (SELECT *, min(ord) FILTER (WHERE score >= 0.9) OVER (PARTITION BY sequence_id) AS stop FROM a WHERE ord <= 3)
  SELECT sequence_id, ord AS chosen, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY (ord = stop) DESC NULLS LAST, score DESC, ord) AS r FROM f) WHERE r = 1""")
def _(read):
    """Replay of at most three attempts: the first of 0.9 or more, else the best, the earliest of equals."""
    good = F.when(F.col("score") >= 0.9, F.struct(F.lit(1).alias("a"), (-F.col("ord")).cast("double").alias("b"), F.lit(0).alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.col("score").alias("b"), (-F.col("ord")).alias("c")))
    return attempts(read).where("ord <= 3").groupBy("sequence_id").agg(F.max_by("ord", good).alias("chosen"), F.max_by("score", good).alias("score"))


@query("win_iter_gain", _BEST + "SELECT sequence_id, ord, round(score - lag(score) OVER (PARTITION BY sequence_id ORDER BY ord), 6)::DOUBLE AS gain FROM a")
def _(read):
    return attempts(read).select("sequence_id", "ord", R(F.col("score") - F.lag("score").over(Window.partitionBy("sequence_id").orderBy("ord"))).alias("gain"))


_RAGAS = "0.5 * faithfulness + 0.3 * answer_relevancy + 0.2 * context_precision"
_ACAD = "0.4 * completeness + 0.3 * terminology + 0.2 * cognitive + 0.1 * citations"


def _ragas(s):
    return judging.ragas(s["faithfulness"], s["answer_relevancy"], s["context_precision"])


def _acad(s):
    return judging.academic(s["completeness"], s["terminology"], s["cognitive"], s["citations"])


@query("sc_ragas", W + SCORES + f" SELECT id, round({_RAGAS}, 6)::DOUBLE AS weighted, round((faithfulness + answer_relevancy + context_precision + context_recall) / 4, 6) AS mean FROM scores")
def _(read):
    s = scores(read)
    return s.select("id", R(_ragas(s)).alias("weighted"), R(judging.ragas_mean(*(F.col(c) for c in ("faithfulness", "answer_relevancy", "context_precision", "context_recall")))).alias("mean"))


@query("sc_academic", W + SCORES + f" SELECT id, round({_ACAD}, 6)::DOUBLE AS score, round({_ACAD}, 6) >= 0.75 AS passed FROM scores")
def _(read):
    s = scores(read)
    return s.select("id", R(_acad(s)).alias("score")).withColumn("passed", F.col("score") >= 0.75)


@query("sc_composite", W + SCORES + f" SELECT id, round(0.4 * ({_RAGAS}) + 0.3 * constitutional + 0.3 * ({_ACAD}), 6)::DOUBLE AS score FROM scores")
def _(read):
    s = scores(read)
    return s.select("id", R(judging.composite(_ragas(s), s["constitutional"], _acad(s))).alias("score"))


@query("sc_verdict", W + SCORES + f" SELECT id, CASE WHEN faithfulness >= 0.85 AND answer_relevancy >= 0.80 AND context_precision >= 0.70 AND context_recall >= 0.75 AND round({_ACAD}, 6) >= 0.75 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM scores")
def _(read):
    from qaloom.operators.filters import GATES, passes

    s = scores(read)
    return s.select("id", F.when(passes(GATES) & (R(_acad(s)) >= 0.75), "ACCEPT").otherwise("REJECT").alias("verdict"))


@query("sc_diversity", W + SCORES + " SELECT id, round(0.35 * completeness + 0.30 * terminology + 0.20 * cognitive + 0.15 * citations, 6)::DOUBLE AS score FROM scores")
def _(read):
    s = scores(read)
    return s.select("id", R(judging.diversity(s["completeness"], s["terminology"], s["cognitive"], s["citations"])).alias("score"))


@query("sc_constitution", """SELECT o_orderkey AS id, round(1 - sum(CASE o_orderstatus WHEN 'O' THEN 0.5 WHEN 'F' THEN 1.0 ELSE 0.25 END) / 6, 6)::DOUBLE AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(read):
    v = read("orders").join(read("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").groupBy(F.col("o_orderkey").alias("id")).agg(F.collect_list("o_orderstatus").alias("v"))
    return v.select("id", R(judging.constitution(F.col("v"), {"O": 0.5, "F": 1.0, "P": 0.25})).alias("score"))


@query("sc_terminology", "SELECT l_orderkey AS id, round(1 - sum((l_linenumber % 3 = 0)::INT) / greatest(count(*), 1), 6) AS score FROM lineitem GROUP BY 1")
def _(read):
    g = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum((F.col("l_linenumber") % 3 == 0).cast("int")).alias("e"), F.count("*").alias("n"))
    return g.select("id", R(judging.terminology(F.col("e"), F.col("n"))).alias("score"))


@query("sc_citation_cov", "SELECT l_orderkey AS id, round(least(sum((l_linenumber % 2 = 0)::INT) / (count(*) / 2.5), 1.0), 6)::DOUBLE AS score FROM lineitem GROUP BY 1")
def _(read):
    g = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum((F.col("l_linenumber") % 2 == 0).cast("int")).alias("c"), F.count("*").alias("n"))
    return g.select("id", R(judging.citation_coverage(F.col("c"), F.col("n"))).alias("score"))


@query("sc_alignment", W + TYPED + f""", x AS (SELECT id, list_position({judging.LEVELS!r}, level) AS q, list_position({judging.LEVELS!r}, cognitive_level) AS a FROM typed)
  SELECT id, CASE WHEN coalesce(a, 0) >= q THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM x""")
def _(read):
    return typed(read).select("id", judging.alignment(F.col("level"), F.col("cognitive_level")).alias("score"))


_SENT = r"list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: length(x) > 0)"


@query("sc_faithful", W + f"s AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents) SELECT doc_id, count(*) AS statements, round(avg((length(s) >= 20)::INT), 6) AS score FROM s GROUP BY 1")
def _(read):
    """Share of supported statements; support is a stand-in here (a statement of 20 characters or more)."""
    s = read("documents").select("doc_id", F.explode(F.split("text", r"\.")).alias("s")).withColumn("s", F.trim("s")).where(F.length("s") > 0)
    return s.groupBy("doc_id").agg(F.count("*").alias("statements"), R(F.avg((F.length("s") >= 20).cast("int"))).alias("score"))


@query("sc_relevancy", "SELECT a.vec_id AS id, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5 GROUP BY 1")
def _(read):
    """Mean cosine to five reverse questions, here the five next vectors."""
    from qaloom.functions.vectors import cosine

    e = read("embeddings")
    near = e.select(F.col("embedding").alias("b"), F.explode(F.array(*(F.col("vec_id") - i for i in range(1, 6)))).alias("id"))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(near, "id").groupBy("id").agg(R(F.avg(cosine(F.col("a"), F.col("b")))).alias("score"))


@query("sc_selfassess", W + SCORES + " SELECT id FROM scores WHERE context_recall < 0.7")
def _(read):
    return scores(read).where("context_recall < 0.7").select("id")


_SAY = """a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || ' causes ' || p_type WHEN 1 THEN 'If ' || p_name || ', then ' || p_type
  WHEN 2 THEN p_name || ' increases ' || p_type ELSE p_name || ' is ' || p_type END AS answer FROM part)"""


@query("neg_invert", W + _SAY + r""" SELECT id, answer, CASE WHEN regexp_matches(answer, '(.+?)\s+causes?\s+(.+)', 'i') THEN regexp_replace(answer, '(.+?)\s+causes?\s+(.+)', '\2 causes \1', 'i')
  WHEN regexp_matches(answer, 'If\s+(.+?),\s+then\s+(.+)', 'i') THEN regexp_replace(answer, 'If\s+(.+?),\s+then\s+(.+)', 'If \2, then \1', 'i')
  WHEN contains(lower(answer), 'increases') THEN replace(answer, 'increases', 'decreases') WHEN contains(lower(answer), 'higher') THEN replace(answer, 'higher', 'lower')
  WHEN contains(lower(answer), 'above') THEN replace(answer, 'above', 'below') ELSE answer END AS negative FROM a""")
def _(read):
    k, n, t = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    say = F.when(k == 0, F.concat(n, F.lit(" causes "), t)).when(k == 1, F.concat(F.lit("If "), n, F.lit(", then "), t)).when(k == 2, F.concat(n, F.lit(" increases "), t)).otherwise(F.concat(n, F.lit(" is "), t))
    return read("part").select(F.col("p_partkey").alias("id"), say.alias("answer")).withColumn("negative", judging.invert(F.col("answer")))


@query("neg_entity_swap", """WITH m AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY 1)
  SELECT p_partkey AS id, replace('The ' || p_name || ' turns.', p_name, CASE WHEN lo = p_name THEN hi ELSE lo END) AS negative FROM part JOIN m USING (p_brand) WHERE lo <> hi""")
def _(read):
    """Another entity of the same section; the pick is the smallest (or largest) by name instead of random."""
    part = read("part")
    m = part.groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi")).where("lo <> hi")
    other = F.when(F.col("lo") == F.col("p_name"), F.col("hi")).otherwise(F.col("lo"))
    return part.join(m, "p_brand").select(F.col("p_partkey").alias("id"), F.replace(F.concat(F.lit("The "), "p_name", F.lit(" turns.")), F.col("p_name"), other).alias("negative"))


@query("neg_plausible", "SELECT event_id AS id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 0.5) AS plausibility FROM events")
def _(read):
    said = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return read("events").select(F.col("event_id").alias("id"), F.coalesce(said.try_cast("double"), F.lit(0.5)).alias("plausibility"))


_SAID = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' causes ' || p_type WHEN 2 THEN p_name || ' increases ' || p_type ELSE p_name || ' is ' || p_type END"


@query("neg_assemble", f"""WITH m AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, max(p_size) AS top FROM part GROUP BY 1), x AS (SELECT *, {_SAID} AS answer FROM part JOIN m USING (p_brand)),
  n AS (SELECT p_partkey AS id, replace(answer, p_name, CASE WHEN lo = p_name THEN hi ELSE lo END) AS swapped,
     CASE p_partkey % 4 WHEN 0 THEN p_type || ' causes ' || p_name WHEN 2 THEN replace(answer, 'increases', 'decreases') ELSE answer END AS inverted, 'Size ' || top || ' of ' || p_brand AS adjacent, answer FROM x),
  l AS (SELECT id, answer, unnest(['entity_swap', 'relation_inversion', 'adjacent_confusion']) AS strategy, unnest([swapped, inverted, adjacent]) AS text FROM n)
  SELECT id, strategy, text, 0.5::DOUBLE AS plausibility FROM l WHERE text <> answer""")
def _(read):
    """The negatives of all three strategies by answer; those that do not differ from it go. Scores come from the judge's answer, 0.5 where it is no number."""
    from qaloom.functions.udfs import generate

    part = read("part")
    k, n, t = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    say = F.when(k == 0, F.concat(n, F.lit(" causes "), t)).when(k == 2, F.concat(n, F.lit(" increases "), t)).otherwise(F.concat(n, F.lit(" is "), t))
    near = part.groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"), F.max("p_size").alias("top"))
    rows = part.join(near, "p_brand").select(
        F.col("p_partkey").alias("id"), say.alias("answer"), F.replace(say, n, F.when(F.col("lo") == n, F.col("hi")).otherwise(F.col("lo"))).alias("swapped"),
        F.format_string("Size %d of %s", "top", "p_brand").alias("adjacent"),
    ).withColumn("inverted", judging.invert(F.col("answer")))
    score = generate(F.concat(F.lit("How plausible is: "), F.col("text")))
    return judging.negatives(rows, score).select("id", "strategy", "text", "plausibility")


def edges(read):
    return graph.co_occurrence(mentions(read))


@query("jn_cooccur", W + EDGES + " SELECT a, b FROM edges")
def _(read):
    return edges(read)


@query("gr_context", W + EDGES + " SELECT a AS entity, count(*) AS degree FROM links GROUP BY 1")
def _(read):
    return graph.both_ways(edges(read)).groupBy(F.col("a").alias("entity")).agg(F.count("*").alias("degree"))


@query("jn_entity_ctx", W + MENTIONS + " SELECT entity, count(DISTINCT (doc, para)) AS n_contexts, min(doc) AS first_doc FROM mentions GROUP BY 1")
def _(read):
    m = mentions(read).select("entity", "doc", "para").distinct()
    return m.groupBy("entity").agg(F.count("*").alias("n_contexts"), F.min("doc").alias("first_doc"))


#: Walks start from every entity with this beginning.
_ROOT = "root AS (SELECT DISTINCT a AS node FROM links WHERE a LIKE 'Er%')"


def _roots(links):
    return graph.both_ways(links).where("a LIKE 'Er%'").select(F.col("a").alias("node")).distinct()


@query("gr_bfs", W.rstrip() + " RECURSIVE " + EDGES + ", " + _ROOT + """, walk AS (SELECT node, 0 AS depth FROM root UNION SELECT b, depth + 1 FROM walk JOIN links ON a = node WHERE depth < 3)
  SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def _(read):
    e = edges(read)
    return graph.bfs(e, _roots(e), 3)


_PATHS = W.rstrip() + " RECURSIVE " + EDGES + ", " + _ROOT + """, walk AS (SELECT [node] AS path, 0 AS hops FROM root
  UNION ALL SELECT list_append(path, b), hops + 1 FROM walk JOIN links ON a = path[-1] WHERE hops < 2 AND NOT list_contains(path, b)) """


@query("gr_paths", _PATHS + "SELECT array_to_string(path, '|') AS path, hops FROM walk WHERE hops > 0")
def _(read):
    e = edges(read)
    return graph.paths(e, _roots(e), 2).select(F.array_join("path", "|").alias("path"), "hops")


#: From every entity.
_ALL_PATHS = _PATHS.replace(" WHERE a LIKE 'Er%'", "")


@query("gr_secondary", _ALL_PATHS + """, f AS (SELECT entity, count(*) AS n FROM mentions GROUP BY 1), p AS (SELECT array_to_string(path, '|') AS path, path[1] AS r, hops, unnest(path) AS entity FROM walk WHERE hops > 0),
  s AS (SELECT path, r, hops, min(n) AS rarest FROM p JOIN f USING (entity) GROUP BY ALL)
  SELECT path, hops, rarest, rank FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY rarest, hops, path) AS rank FROM s) WHERE rank <= 20""")
def _(read):
    freq = mentions(read).groupBy("entity").agg(F.count("*").alias("n"))
    return graph.rarest_paths(edges(read), freq, 20).select(F.array_join("path", "|").alias("path"), "hops", "rarest", "rank")


@query("gr_strategy", W + EDGES + """, n AS (SELECT a AS entity, count(*) AS degree FROM links GROUP BY 1), u AS (SELECT entity, count(*) AS uses FROM mentions GROUP BY 1)
  SELECT entity, CASE WHEN degree >= 3 AND uses <= 5 THEN 'chain' ELSE 'combine' END AS strategy FROM n JOIN u USING (entity)""")
def _(read):
    n = graph.both_ways(edges(read)).groupBy(F.col("a").alias("entity")).agg(F.count("*").alias("degree"))
    u = mentions(read).groupBy("entity").agg(F.count("*").alias("use"))
    return graph.strategy(n.join(u, "entity"), 3, 5).select("entity", "strategy")


@query("gr_sim_select", """WITH s AS (SELECT a.vec_id AS root, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0)
  SELECT root, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 3""")
def _(read):
    """Neighbours (vectors of the root's label) nearest to the root. Vectors have unit length, so the dot product is the cosine."""
    from qaloom.operators.retrieval import top_k

    e = read("embeddings")
    roots = e.where(F.col("vec_id") % 20 == 0)
    near = top_k(e, roots, 4, item_id="vec_id", query_id="vec_id", group="label").where("id <> query_id")
    ranks = Window.partitionBy("query_id").orderBy("rank")
    return near.select(F.col("query_id").alias("root"), "id", F.row_number().over(ranks).alias("rank")).where("rank <= 3")


_CONCEPT = "e AS (SELECT DISTINCT p_name AS a, p_type AS b, ['prerequisite', 'part-of', 'compare'][p_size % 3 + 1] AS type FROM part)"


def concept_edges(read):
    kind = F.element_at(F.array(*map(F.lit, ("prerequisite", "part-of", "compare"))), F.col("p_size") % 3 + 1)
    return read("part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b"), kind.alias("type")).distinct()


_LADDER = """e AS (SELECT p_partkey - 1 AS a, p_partkey AS b, CASE WHEN p_partkey % 5 = 0 THEN 'compare' ELSE 'prerequisite' END AS type FROM part
  UNION SELECT p_partkey - 3, p_partkey, 'prerequisite' FROM part WHERE p_partkey % 3 = 0)"""


@query("gr_concept", "WITH RECURSIVE " + _LADDER + """, w AS (SELECT b AS concept, b AS needs, 0 AS steps FROM e WHERE b % 20 = 0
  UNION SELECT concept, a, steps + 1 FROM w JOIN e ON e.b = needs WHERE type = 'prerequisite' AND steps < 3)
  SELECT concept, needs, min(steps) AS steps FROM w WHERE needs <> concept GROUP BY 1, 2""")
def _(read):
    """Concepts and relations added, and what every twentieth concept needs to be understood first, three steps far."""
    k = F.col("p_partkey")
    part = read("part")
    e = part.select((k - 1).alias("a"), k.alias("b"), F.when(k % 5 == 0, "compare").otherwise("prerequisite").alias("type"))
    more = part.where("p_partkey % 3 = 0").select((k - 3).alias("a"), k.alias("b"), F.lit("prerequisite").alias("type"))
    both = e.unionByName(more).distinct()
    return graph.ancestors(both, both.where("b % 20 = 0").select(F.col("b").alias("concept")), 3)


@query("jn_prereq", W + _CONCEPT + " SELECT b AS concept, a AS prerequisite FROM e WHERE type = 'prerequisite'")
def _(read):
    return concept_edges(read).where("type = 'prerequisite'").select(F.col("b").alias("concept"), F.col("a").alias("prerequisite"))


@query("jn_compare_pairs", W + _CONCEPT + " SELECT a, b FROM e WHERE type = 'compare'")
def _(read):
    return concept_edges(read).where("type = 'compare'").select("a", "b")


@query("st_topic_memory")
def _(read):
    return diversity.topic_memory(read("embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.3)


@query("st_diversity")
def _(read):
    t = typed(read).select("id", "chapter", "type", "difficulty", F.col("level").alias("cognitive_level"))
    e = read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return diversity.greedy_diversity(t.join(e, "id"), "chapter", "id", 0.5)


_NODES = [("select_section", "ok", "generate_question"), ("generate_question", "ok", "check_diversity"), ("check_diversity", "pass", "generate_answer"),
          ("check_diversity", "fail", "generate_question"), ("generate_answer", "ok", "critic"), ("critic", "accept", "save_result"), ("critic", "reject", "generate_question")]


_RUN = "CASE WHEN event_id % 5 = 0 THEN 'fail' WHEN event_id % 7 = 0 THEN 'reject' WHEN event_id % 2 = 0 THEN 'pass' ELSE 'ok' END"


@query("st_graph", "WITH RECURSIVE g AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{o}', '{b}')" for a, o, b in _NODES) + f""") t(node, outcome, next_node)),
  ev AS (SELECT user_id AS run, {_RUN} AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  w AS (SELECT run, 0::BIGINT AS n, 'select_section' AS node FROM ev WHERE n = 1
    UNION ALL SELECT w.run, ev.n, coalesce(g.next_node, w.node) FROM w JOIN ev ON ev.run = w.run AND ev.n = w.n + 1 LEFT JOIN g ON g.node = w.node AND g.outcome = ev.outcome)
  SELECT run, arg_max(node, n) AS node, max(n) AS steps FROM w GROUP BY 1""")
def _(read):
    """Runs driven through the graph by their outcomes, in order; an outcome without a transition leaves a run where it is."""
    k = F.col("event_id")
    outcome = F.when(k % 5 == 0, "fail").when(k % 7 == 0, "reject").when(k % 2 == 0, "pass").otherwise("ok")
    return tasks.drive(read("events").select(F.col("user_id").alias("run"), k.alias("seq"), outcome.alias("outcome")), _NODES, "select_section")


@query("st_balance", W + QUESTIONS + ", c AS (SELECT chapter, count(*) AS n FROM questions GROUP BY 1) SELECT chapter FROM c WHERE n < (SELECT avg(n) FROM c)")
def _(read):
    c = questions(read).groupBy("chapter").agg(F.count("*").alias("n"))
    full = c.join(F.broadcast(c.agg(F.avg("n").alias("m"))), F.lit(True)).where("n >= m").select("chapter")
    return c.select("chapter").join(full, "chapter", "left_anti")


@query("st_hard_log", W + SCORES + " SELECT id, CASE WHEN iterations >= 3 THEN 'hard' ELSE 'kept' END AS sink FROM scores")
def _(read):
    return scores(read).select("id", F.when(F.col("iterations") >= 3, "hard").otherwise("kept").alias("sink"))


_STATE = "['submitted', 'working', 'input-required', 'completed', 'failed'][(event_id * 7 + user_id) % 5 + 1]"
_EVENTS = f"ev AS (SELECT user_id AS task_id, event_id AS seq, {_STATE} AS state, ts FROM events)"


def task_events(read):
    states = F.array(*map(F.lit, ("submitted", "working", "input-required", "completed", "failed")))
    return read("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(states, ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int")).alias("state"), "ts", "event_type")


_ENDS = W + _EVENTS + ", x AS (SELECT *, min(seq) FILTER (WHERE state IN ('completed', 'failed', 'canceled', 'rejected')) OVER (PARTITION BY task_id) AS e FROM ev) "


@query("a2a_reduce", _ENDS + "SELECT task_id, arg_max(state, seq) AS state, count(*) AS n_events, max(seq) AS last_seq FROM x WHERE e IS NULL OR seq <= e GROUP BY 1")
def _(read):
    return tasks.reduce_events(task_events(read))


@query("a2a_order", W + _EVENTS + " SELECT task_id, seq, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS position FROM ev")
def _(read):
    return task_events(read).select("task_id", "seq", F.row_number().over(Window.partitionBy("task_id").orderBy("seq")).alias("position"))


@query("a2a_terminal", _ENDS + "SELECT task_id, seq FROM x WHERE e IS NOT NULL AND seq > e")
def _(read):
    """Events that come after their task's terminal state, which are refused."""
    ev = task_events(read)
    ends = ev.where(F.col("state").isin(*tasks.TERMINAL)).groupBy("task_id").agg(F.min("seq").alias("e"))
    return ev.join(ends, "task_id").where("seq > e").select("task_id", "seq")


@query("a2a_dedupe", """WITH m AS (SELECT event_id AS seq, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'm' || (event_id % 997) END AS message_id FROM events)
  SELECT message_id, min(seq) AS seq, arg_min(user_id, seq) AS user_id FROM m WHERE message_id IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, seq, user_id FROM m WHERE message_id IS NULL""")
def _(read):
    """Messages sent again under one id count once; those without an id all count."""
    k = F.col("event_id")
    m = read("events").select(F.when(k % 11 == 0, None).otherwise(F.concat(F.lit("m"), k % 997)).alias("message_id"), k.alias("seq"), "user_id")
    return tasks.unique_messages(m)


_PARTS = """a AS (SELECT user_id AS task_id, 'a' || (event_id % 3) AS artifact_id, event_id AS seq, event_type || event_id AS text, event_id % 4 > 0 AS append, event_id % 17 = 0 AS last_chunk FROM events)"""


@query("a2a_artifacts", W + _PARTS + """, s AS (SELECT task_id, artifact_id, max(seq) FILTER (WHERE NOT append) AS start FROM a GROUP BY 1, 2)
  SELECT task_id, artifact_id, string_agg(text, '' ORDER BY seq) AS text, arg_max(last_chunk, seq) AS complete FROM a JOIN s USING (task_id, artifact_id) WHERE seq >= coalesce(start, seq) GROUP BY 1, 2""")
def _(read):
    """Artifacts put together from their update events."""
    k = F.col("event_id")
    e = read("events").select(F.col("user_id").alias("task_id"), F.concat(F.lit("a"), k % 3).alias("artifact_id"), k.alias("seq"), F.concat("event_type", k).alias("text"), (k % 4 > 0).alias("append"), (k % 17 == 0).alias("last_chunk"))
    return tasks.artifacts(e)


@query("a2a_resub", W + _EVENTS + """, s AS (SELECT task_id, min(seq) AS since FROM ev GROUP BY 1),
  x AS (SELECT task_id, seq, state, since, min(seq) FILTER (WHERE state IN ('completed', 'failed', 'canceled', 'rejected')) OVER (PARTITION BY task_id) AS e FROM ev JOIN s USING (task_id)),
  t AS (SELECT task_id, max(seq) AS seq, arg_max(state, seq) AS state FROM x WHERE seq <= since AND (e IS NULL OR e > since) GROUP BY 1)
  SELECT task_id, seq, 'task' AS kind, state FROM t UNION ALL SELECT task_id, x.seq, 'status', x.state FROM x JOIN t USING (task_id) WHERE x.seq > since AND (e IS NULL OR x.seq <= e)""")
def _(read):
    """A stream taken up again after a task's first event: the task as it then was, then what follows."""
    ev = task_events(read)
    return tasks.resubscribe(ev, ev.groupBy("task_id").agg(F.min("seq").alias("seq")))


@query("a2a_context", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY 1")
def _(read):
    return read("conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


_TASKS = W + _EVENTS + ", t AS (SELECT task_id AS id, max(ts) AS updated FROM ev GROUP BY 1) "


@query("srt_tasks_page", _TASKS + "SELECT id, epoch_us(updated) AS updated_us, (SELECT count(*) FROM t) AS total_size FROM t ORDER BY updated DESC, id LIMIT 50")
def _(read):
    t = task_events(read).groupBy(F.col("task_id").alias("id")).agg(F.max("ts").alias("updated"))
    page = tasks.list_page(t, size=50).join(F.broadcast(t.agg(F.count("*").alias("total_size"))), F.lit(True))
    return page.select("id", F.unix_micros(F.col("updated").cast("timestamp")).alias("updated_us"), "total_size")


@query("p_push_list", "SELECT c_custkey AS id FROM customer WHERE c_custkey > 100 ORDER BY 1 LIMIT 50")
def _(read):
    return read("customer").select(F.col("c_custkey").alias("id")).where("id > 100").orderBy("id").limit(50)


@query("p_discovery", "SELECT p_brand AS agent FROM part GROUP BY 1 HAVING list_contains(list(p_type), 'PROMO')")
def _(read):
    agents = read("part").groupBy(F.col("p_brand").alias("agent")).agg(F.collect_set("p_type").alias("skills"))
    return agents.where(F.array_contains("skills", "PROMO")).select("agent")


@query("ext_telemetry", "SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2")
def _(read):
    from qaloom.streaming.stateful import telemetry

    return telemetry(read("events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "calls", F.round("cost", 4).alias("cost"))


@query("nm_coverage", W + CHUNKS + " SELECT chapter, round(count(DISTINCT section_id) FILTER (WHERE section_id IN (SELECT doc_id::VARCHAR FROM labels)) / count(DISTINCT section_id), 6) AS coverage FROM chunks GROUP BY 1")
def _(read):
    cited = read("labels").select(F.col("doc_id").cast("string").alias("section_id"), F.lit(1).alias("hit")).distinct()
    s = chunks(read).select("chapter", "section_id").distinct().join(cited, "section_id", "left")
    return s.groupBy("chapter").agg(R(F.count("hit") / F.count("*")).alias("coverage"))


@query("nm_alignment", W + SCORES + " SELECT round(corr(faithfulness, answer_relevancy), 6) AS r FROM scores")
def _(read):
    return scores(read).agg(R(F.corr("faithfulness", "answer_relevancy")).alias("r"))


@query("nm_human_corr", "SELECT round(corr(quality, n_chars), 6) AS r FROM labels JOIN documents USING (doc_id)")
def _(read):
    return read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id").agg(R(F.corr("quality", "n_chars")).alias("r"))


@query("nm_lowq_detect", "SELECT quality, n_chars >= 500 AS passed, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def _(read):
    j = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", (F.col("n_chars") >= 500).alias("passed")).agg(F.count("*").alias("n"))


@query("nm_calibrate", W + TYPED + ", x AS (SELECT difficulty, (id % 5 > 0)::INT AS correct FROM typed) SELECT difficulty, round(avg(correct), 6) AS observed FROM x GROUP BY 1")
def _(read):
    return typed(read).groupBy("difficulty").agg(R(F.avg((F.col("id") % 5 > 0).cast("int"))).alias("observed"))


@query("nm_vote", "SELECT l_orderkey AS id, round(avg(l_quantity), 6) AS mean, count(*) AS votes FROM lineitem GROUP BY 1")
def _(read):
    return read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(R(F.avg("l_quantity")).alias("mean"), F.count("*").alias("votes"))


_STAGES = """p AS (SELECT p_name AS name, p_partkey AS version, p_type AS prompt, ((p_partkey * 7) % 101) / 100.0::DOUBLE AS score FROM part)"""


@query("nm_prompt_reg", W + _STAGES + """, d AS (SELECT name, arg_max(version, version) AS dev FROM p GROUP BY 1), s AS (SELECT name, max(version) AS staging FROM p WHERE score >= 0.5 GROUP BY 1),
  r AS (SELECT name, max(version) AS prod FROM p WHERE score >= 0.85 GROUP BY 1) SELECT name, dev, staging, prod FROM d LEFT JOIN s USING (name) LEFT JOIN r USING (name)""")
def _(read):
    """Every version is in dev; the latest that passes a stage's gate is promoted to it."""
    p = read("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("version"), ((F.col("p_partkey") * 7) % 101 / 100.0).alias("score"))
    return judging.promoted(p, {"dev": 0.0, "staging": 0.5, "prod": 0.85})


@query("nm_tracker", W + SCORES + """ SELECT chapter AS run_id, 'faithfulness' AS name, max(id) AS step, arg_max(faithfulness, id) AS number FROM scores GROUP BY 1""")
def _(read):
    """Metrics of runs logged in two appends beside their parameters; the last value of each."""
    from qaloom.sources.store import Runs, scratch

    s = scores(read).select(F.col("chapter").alias("run_id"), F.lit("metric").alias("kind"), F.lit("faithfulness").alias("name"), F.col("id").alias("step"), F.col("faithfulness").alias("number"))
    runs = Runs(s.sparkSession, scratch(s.sparkSession, "runs"))
    runs.log(s.where("step % 2 = 0"))
    runs.log(s.where("step % 2 = 1"))
    runs.log(s.select("run_id", F.lit("param").alias("kind"), F.lit("threshold").alias("name"), F.lit("0.85").alias("text")).distinct())
    return runs.last_metrics()
