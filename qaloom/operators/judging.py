"""Question classifiers, quality scores, verdicts and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Question types and their patterns, in order; the first match wins.
QUESTION_TYPES = {
    "factoid": ["^What is", "^Who", "^When", "^Where"],
    "definition": ["^Define", "definition of"],
    "process": ["^How does", "^How to", "process of"],
    "comparison": ["compare", "difference between", "contrast"],
    "application": ["when to use", "application of", "example of"],
    "reasoning": ["^Why", "reason for", "cause of"],
    "calculation": ["^Calculate", "^Compute", "^Find the value"],
}
# Bloom levels and their verbs, in order; the first substring wins.
BLOOM_VERBS = {
    "remember": ["define", "list", "recall", "name", "identify", "what is"],
    "understand": ["explain", "describe", "summarize", "interpret", "how does"],
    "apply": ["calculate", "demonstrate", "use", "apply", "solve"],
    "analyze": ["compare", "contrast", "examine", "distinguish", "why"],
    "evaluate": ["justify", "critique", "assess", "judge", "evaluate"],
    "create": ["design", "develop", "formulate", "construct", "derive"],
}
LEVELS = list(BLOOM_VERBS)
DIFFICULTY_TARGETS = {"beginner": 0.30, "intermediate": 0.50, "expert": 0.20}
COGNITIVE_TARGETS = {"remember": 0.15, "understand": 0.30, "apply": 0.25, "analyze": 0.20, "evaluate": 0.07, "create": 0.03}
TYPE_TARGETS = dict.fromkeys(QUESTION_TYPES, 1 / 7)
UNKNOWN_TARGET = 0.1


def question_type(question: Column, fallback: str = "unknown") -> Column:
    cases = reduce(lambda c, kv: c.when(question.rlike("(?i)" + "|".join(kv[1])), kv[0]), QUESTION_TYPES.items(), F)
    return cases.otherwise(F.lit(fallback))


def bloom_level(text: Column) -> Column:
    low = F.lower(text)
    has = lambda verbs: reduce(lambda a, b: a | b, (F.contains(low, F.lit(v)) for v in verbs))
    return reduce(lambda c, kv: c.when(has(kv[1]), kv[0]), BLOOM_VERBS.items(), F).otherwise(F.lit("understand"))


def alignment(question_level: Column, answer_level: Column) -> Column:
    levels = F.array(*map(F.lit, LEVELS))
    return F.when(F.array_position(levels, answer_level) >= F.array_position(levels, question_level), 1.0).otherwise(0.5)


def ragas(faithfulness: Column, relevancy: Column, precision: Column) -> Column:
    return 0.5 * faithfulness + 0.3 * relevancy + 0.2 * precision


def ragas_mean(*metrics: Column) -> Column:
    return reduce(lambda a, b: a + b, metrics) / len(metrics)


def academic(completeness: Column, terminology: Column, cognitive: Column, citations: Column) -> Column:
    return 0.4 * completeness + 0.3 * terminology + 0.2 * cognitive + 0.1 * citations


def composite(ragas_score: Column, constitutional: Column, academic_score: Column) -> Column:
    return 0.4 * ragas_score + 0.3 * constitutional + 0.3 * academic_score


def diversity(content: Column, kind: Column, difficulty: Column, cognitive: Column) -> Column:
    return 0.35 * content + 0.30 * kind + 0.20 * difficulty + 0.15 * cognitive


def coverage(covered: Column, relevant: Column) -> Column:
    """Share of relevant concepts that are covered; 1 where none is relevant."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(relevant, covered)) / n)


def terminology(errors: Column, terms: Column) -> Column:
    return 1 - errors / F.greatest(terms, F.lit(1))


def citation_coverage(citations: Column, claims: Column) -> Column:
    return F.when(claims > 0, F.least(citations / (claims / F.lit(2.5)), F.lit(1.0))).otherwise(F.lit(1.0))


def constitution(violations: Column, weights: dict[str, float]) -> Column:
    """1 - sum of severity weights / 6 over an array of severities."""
    severity = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return 1 - F.aggregate(violations, F.lit(0.0), lambda s, v: s + F.coalesce(severity[v], F.lit(0.0))) / 6


def context_precision(relevance: DataFrame, group: str = "id", rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """``id, context_precision``: prefix means weighted by 1/rank."""
    prefix = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return (
        relevance.withColumn("m", F.avg(F.col(relevant).cast("double")).over(prefix))
        .groupBy(group)
        .agg((F.sum(F.col("m") / F.col(rank)) / F.sum(1 / F.col(rank))).alias("context_precision"))
    )


def balance_penalty(questions: DataFrame, group: str, order: str, value: str, targets: dict[str, float], into: str) -> DataFrame:
    """Score of each question by how far its value's share among earlier ones exceeds the target; 1 for the first."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    of_value = Window.partitionBy(group, value).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    target = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col(value)], F.lit(UNKNOWN_TARGET))
    seen, same = F.count("*").over(before), F.count("*").over(of_value)
    share = same / seen
    return questions.withColumn(
        into,
        F.when(seen == 0, 1.0).when(share <= target, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (share - target) / target)),
    )


def distribution(rows: DataFrame, *columns: str) -> DataFrame:
    """``dimension, value, n, share`` for several columns in one pass."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def invert(answer: Column) -> Column:
    """The answer with its causal or conditional relation flipped, else with an opposite, else unchanged."""
    causal, conditional = r"(?i)(.+?)\s+causes?\s+(.+)", r"(?i)If\s+(.+?),\s+then\s+(.+)"
    from qaloom.functions.text import strip

    part = lambda p, g: strip(F.regexp_extract(answer, p, g))
    out = F.when(answer.rlike(causal), F.replace(answer, F.regexp_extract(answer, causal, 0), F.concat(part(causal, 2), F.lit(" causes "), part(causal, 1))))
    out = out.when(
        answer.rlike(conditional),
        F.replace(answer, F.regexp_extract(answer, conditional, 0), F.concat(F.lit("If "), part(conditional, 2), F.lit(", then "), part(conditional, 1))),
    )
    for word, opposite in (("increases", "decreases"), ("higher", "lower"), ("above", "below")):
        out = out.when(F.contains(F.lower(answer), F.lit(word)), F.replace(answer, F.lit(word), F.lit(opposite)))
    return out.otherwise(answer)


def cost_report(log: DataFrame) -> DataFrame:
    """Calls, tokens, cost, cost per question and share of the whole by agent, and of all (agent null), of (agent, question, tokens_in, tokens_out, cost)."""
    sums = log.rollup("agent").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"),
        F.count_distinct("question").alias("questions"), F.grouping("agent").alias("whole"),
    )
    whole = F.broadcast(sums.where("whole = 1").select(F.col("cost").alias("total")))
    return sums.join(whole, F.lit(True)).select(
        "agent", "calls", "tokens_in", "tokens_out", "cost", F.try_divide("cost", "questions").alias("cost_per_question"), F.try_divide("cost", "total").alias("share")
    )


def negatives(rows: DataFrame, score: Column) -> DataFrame:
    """``id, strategy, text, plausibility`` of (id, answer, swapped, inverted, adjacent): a row for each negative that differs from the answer.

    ``score`` is a judge's answer as text over the column ``text``; what is no number counts as 0.5.
    """
    kinds = {"entity_swap": "swapped", "relation_inversion": "inverted", "adjacent_confusion": "adjacent"}
    each = F.array(*(F.struct(F.lit(k).alias("strategy"), F.col(c).alias("text")) for k, c in kinds.items()))
    long = rows.select("id", "answer", F.explode(each).alias("n")).select("id", "answer", "n.*").where("text <> answer")
    return long.withColumn("plausibility", F.coalesce(score.try_cast("double"), F.lit(0.5)))


def promoted(versions: DataFrame, gates: dict[str, float]) -> DataFrame:
    """The latest version of each name that passes each stage's gate, of (name, version, score); null where none does."""
    return versions.groupBy("name").agg(*(F.max(F.when(F.col("score") >= gate, F.col("version"))).alias(stage) for stage, gate in gates.items()))


def context_recall(needs: DataFrame) -> DataFrame:
    """``id, recall`` of (id, need, found): the share of the distinct needs of an id that were found at least once."""
    each = needs.groupBy("id", "need").agg(F.max(F.col("found").cast("int")).alias("found"))
    return each.groupBy("id").agg(F.avg("found").alias("recall"))


def verify_citations(citations: DataFrame, pages: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``exists, similarity_score, actual_text, verdict`` added to citations (doc, page_number, quote).

    Quotes found verbatim (in any case) never leave the JVM; the rest are slid over
    their page by difflib. A missing or empty page, or one shorter than the quote, gives NOT_FOUND with 0.
    """
    from qaloom.functions.udfs import sequence_ratio

    joined = citations.join(pages.select("doc", "page_number", F.col("text").alias("_page")), ["doc", "page_number"], "left")
    page, quote = F.coalesce("_page", F.lit("")), F.coalesce("quote", F.lit(""))
    low = F.lower(page)
    # Offsets in the lower-cased page are those of the page only where lower-casing keeps all lengths (and is without context, as of a sigma).
    even = (F.length(low) == F.length(page)) & (F.length(F.lower(quote)) == F.length(quote)) & ~F.contains(page, F.lit("\u03a3"))
    marked = joined.withColumn("_exact", (F.length(page) > 0) & even & F.contains(low, F.lower(quote)))
    exact = marked.where("_exact").select(
        "*", F.lit(1.0).alias("_ratio"), F.expr("substring(_page, greatest(locate(lower(coalesce(quote, '')), lower(_page)), 1), length(coalesce(quote, '')))").alias("actual_text")
    )
    # The few that need difflib are dealt out evenly, as each costs far more than reading it; to a number of tasks, as Spark would put few bytes together.
    n = int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = marked.where(~F.col("_exact")).repartition(n, *citations.columns).withColumn("_w", sequence_ratio(page, quote)).select(
        *marked.columns, F.col("_w.ratio").alias("_ratio"), F.col("_w.window").alias("actual_text")
    )
    both = exact.unionByName(rest)
    verdict = F.when(F.col("_ratio") >= threshold, "ACCURATE").when(F.col("_ratio") >= 0.70, "INACCURATE").otherwise("NOT_FOUND")
    return both.select(
        *citations.columns, (F.col("_ratio") >= threshold).alias("exists"), F.round("_ratio", 3).alias("similarity_score"), "actual_text", verdict.alias("verdict")
    )
