"""The registry of queries, and the carrier tables they share.

The reference ships no data, so each operator runs over carriers built from the
given tables, the same way here and in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions.text import chunk_id, fill
from qaloom.operators.chunking import fixed_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (read), where read(table) gives a DataFrame, and its oracle."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Question templates by type.
TEMPLATES = {
    "definition": ["What is {concept}?", "Define {concept} in the context of {domain}.", "Explain the meaning of {concept}."],
    "comparison": [
        "What is the difference between {concept_a} and {concept_b}?",
        "Compare and contrast {concept_a} and {concept_b}.",
        "How does {concept_a} differ from {concept_b}?",
    ],
    "application": ["When would you use {concept}?", "Provide an example of {concept} in practice.", "How is {concept} applied in {domain}?"],
    "reasoning": ["Why does {phenomenon} occur?", "Explain the cause of {phenomenon}.", "What is the reason for {phenomenon}?"],
    "process": ["How does {process} work?", "Describe the steps involved in {process}.", "Explain the mechanism of {process}."],
    "calculation": ["Calculate {variable} given {conditions}.", "Find the value of {variable} when {conditions}.", "Solve for {variable}: {equation}."],
    "analysis": [
        "What are the implications of {concept}?",
        "Analyze the relationship between {concept_a} and {concept_b}.",
        "Evaluate the impact of {concept} on {domain}.",
    ],
}
FLAT = [t for ts in TEMPLATES.values() for t in ts]
LEVEL_NAMES = ["remember", "understand", "apply", "analyze", "evaluate", "create", "unlisted"]


def chunks(read) -> DataFrame:
    docs = read("documents").select("doc_id", "source", "text")
    page = (F.floor(F.col("chunk_index") / 4) + 1).cast("int")
    section = F.col("doc_id").cast("string")
    return fixed_chunks(docs).select(
        "doc_id", F.col("source").alias("chapter"), section.alias("section_id"), page.alias("page_number"), "chunk_index",
        F.col("chunk").alias("text"), chunk_id(F.col("source"), section, page, F.col("chunk_index")).alias("id"),
    )


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
CHUNKS = f"""chunks AS (
  SELECT doc_id, source AS chapter, doc_id::VARCHAR AS section_id, (i // 4) + 1 AS page_number, i AS chunk_index, list[i + 1] AS text,
         'chunk_' || source || '_sec' || doc_id || '_page' || ((i // 4) + 1) || '_idx' || i AS id
  FROM (SELECT *, unnest(range(0, len(list))) AS i FROM (
    SELECT doc_id, source, list_filter(list_transform(range(0, ceil(length(text) / 450.0)::BIGINT),
      lambda k: {STRIP.format("substr(text, k * 450 + 1, 500)")}), lambda x: x <> '') AS list FROM documents)))"""


def pages(read) -> DataFrame:
    """Paragraphs as pages: doc, page_number from 1, text."""
    return read("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "doc", (F.col("p") + 1).alias("page_number"), "text"
    )


PAGES = """pages_ AS (SELECT doc_id AS doc, unnest(range(1, len(l) + 1)) AS page_number, unnest(l) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def toc(read) -> DataFrame:
    return read("part").select(
        F.col("p_size").alias("doc"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 3 + 1).cast("int").alias("level"),
        F.col("p_name").alias("title"), (F.floor(F.col("p_partkey") / 10) + 1).cast("int").alias("page"),
    )


TOC = "toc AS (SELECT p_size AS doc, p_partkey AS ord, p_partkey % 3 + 1 AS level, p_name AS title, p_partkey // 10 + 1 AS page FROM part)"


def _chapter():
    """Brands by thousands of parts, so that chapters grow in number, not in size."""
    return F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 1000))


def questions(read) -> DataFrame:
    """A question a part, its template cycling; with difficulty and level."""
    part = read("part")
    template = F.element_at(F.array(*map(F.lit, FLAT)), (F.col("p_partkey") % 21 + 1).cast("int"))
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    text = fill(template, {
        "concept": name, "concept_a": name, "concept_b": kind, "domain": brand, "phenomenon": kind, "process": name,
        "variable": F.lit("x"), "conditions": kind, "equation": F.concat(F.lit("x = "), F.col("p_size")),
    })
    return part.select(
        F.col("p_partkey").alias("id"), _chapter().alias("chapter"), text.alias("question"),
        F.element_at(F.array(F.lit("beginner"), F.lit("intermediate"), F.lit("expert")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("difficulty"),
        F.element_at(F.array(*map(F.lit, LEVEL_NAMES)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("cognitive_level"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_fill() -> str:
    out = f"{_sql_list(FLAT)}[p_partkey % 21 + 1]"
    slots = {"concept": "p_name", "concept_a": "p_name", "concept_b": "p_type", "domain": "p_brand", "phenomenon": "p_type",
             "process": "p_name", "variable": "'x'", "conditions": "p_type", "equation": "'x = ' || p_size"}
    for k, v in slots.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


QUESTIONS = f"""questions AS (SELECT p_partkey AS id, p_brand || '-' || (p_partkey // 1000) AS chapter, {_sql_fill()} AS question,
  ['beginner', 'intermediate', 'expert'][p_partkey % 3 + 1] AS difficulty, {_sql_list(LEVEL_NAMES)}[p_partkey % 7 + 1] AS cognitive_level FROM part)"""

#: Score columns and the multipliers that spread part keys over 0.00 to 1.00.
SCORE_STEPS = {"faithfulness": 1, "answer_relevancy": 7, "context_precision": 13, "context_recall": 17, "completeness": 19,
               "terminology": 23, "cognitive": 29, "citations": 31, "constitutional": 37}


def scores(read) -> DataFrame:
    cols = [((F.col("p_partkey") * m) % 101 / 100.0).alias(k) for k, m in SCORE_STEPS.items()]
    return read("part").select(
        F.col("p_partkey").alias("id"), _chapter().alias("chapter"), *cols,
        (F.col("p_partkey") % 4).cast("int").alias("iterations"), (F.col("p_partkey") % 5 > 0).alias("citation_verified"),
    )


SCORES = "scores AS (SELECT p_partkey AS id, p_brand || '-' || (p_partkey // 1000) AS chapter, " + ", ".join(
    f"((p_partkey * {m}) % 101) / 100.0::DOUBLE AS {k}" for k, m in SCORE_STEPS.items()
) + ", p_partkey % 4 AS iterations, p_partkey % 5 > 0 AS citation_verified FROM part)"


def mentions(read) -> DataFrame:
    """Capitalised words of six letters or more by paragraph."""
    return pages(read).select(
        "doc", F.col("page_number").alias("para"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("entity")
    )


MENTIONS = PAGES + ", mentions AS (SELECT doc, page_number AS para, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS entity FROM pages_)"
EDGES = MENTIONS + """, once AS (SELECT DISTINCT doc, para, entity FROM mentions),
 edges AS (SELECT DISTINCT x.entity AS a, y.entity AS b FROM once x JOIN once y USING (doc, para) WHERE x.entity < y.entity),
 links AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges)"""


def vectors(read) -> DataFrame:
    """Embeddings with the texts of documents of the same number."""
    docs = read("documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("chapter"))
    return read("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").join(docs, "id", "left")


def vector_queries(read) -> DataFrame:
    """Every twentieth vector as a query, with two keywords: the first two words of its label's turn."""
    return read("embeddings").where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.element_at(F.array(*map(F.lit, KEYWORDS)), (F.col("label") % 4 + 1).cast("int")).alias("kw1"),
        F.element_at(F.array(*map(F.lit, KEYWORDS)), ((F.col("label") + 1) % 4 + 1).cast("int")).alias("kw2"),
    )


KEYWORDS = ["the", "der", "que", "les"]
VECTORS = f"""vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, text, source AS chapter FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
 q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe, {_sql_list(KEYWORDS)}[label % 4 + 1] AS kw1, {_sql_list(KEYWORDS)}[(label + 1) % 4 + 1] AS kw2
       FROM embeddings WHERE vec_id % 20 = 0),
 sims AS (SELECT query_id, id, kw1, kw2, text, chapter, label, round(list_cosine_similarity(qe, e), 6) AS similarity FROM q, vectors)"""
