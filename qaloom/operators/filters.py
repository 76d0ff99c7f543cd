"""Metadata filters, gates and triggers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(spec: Mapping[str, Any]) -> Column:
    """A predicate from a filter object: {"col": v}, {"col": {"$gte": v}}, {"$and": [...]}, {"$or": [...]}."""
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            both = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(both, map(where, value)))
        elif isinstance(value, Mapping):
            parts += [_OPS[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == F.lit(value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contains(spec: Mapping[str, str], text_col: str = "text") -> Column:
    """A predicate on the text: {"$contains": keyword}, case-sensitive."""
    return reduce(lambda a, b: a & b, (F.col(text_col).contains(v) for k, v in spec.items() if k == "$contains"), F.lit(True))


def by_metadata(chunks: DataFrame, **equal: Any) -> DataFrame:
    return chunks.where(where(equal))


def tool_filter(chunks: DataFrame, chapter=None, section=None, page_min=None, page_max=None) -> DataFrame:
    """The four optional predicates that the retrieval tool advertises."""
    tests = [
        (chapter, lambda v: F.col("chapter") == v), (section, lambda v: F.col("section_id") == v),
        (page_min, lambda v: F.col("page_number") >= v), (page_max, lambda v: F.col("page_number") <= v),
    ]
    return reduce(lambda df, t: df if t[0] is None else df.where(t[1](t[0])), tests, chunks)


def require(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows as they are; the query fails if a required key is null in any."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    message = F.concat(F.lit("missing metadata: "), F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in keys)))
    return chunks.where(F.when(missing, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def passes(thresholds: Mapping[str, float], strict: bool = False) -> Column:
    """Whether every metric reaches (or, strictly, exceeds) its threshold."""
    tests = (F.col(k) > v if strict else F.col(k) >= v for k, v in thresholds.items())
    return reduce(lambda a, b: a & b, tests)


GATES = {"faithfulness": 0.85, "answer_relevancy": 0.80, "context_precision": 0.70, "context_recall": 0.75}
EARLY_GATES = {"faithfulness": 0.80, "answer_relevancy": 0.75}


def trigger() -> Column:
    """What to do about the first metric that fails; null if none does."""
    return (
        F.when(F.col("iterations") >= 3, "log_hard")
        .when(F.col("faithfulness") < 0.85, "cite_other_pages")
        .when(F.col("answer_relevancy") < 0.80, "rephrase_question")
        .when(F.col("context_precision") < 0.70, "keyword_search")
        .when(~F.col("citation_verified"), "retrieve_new_chunks")
    )
