"""Schemas of the engine's records, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _d, _b = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CHUNK = _struct(
    id=_s, text=_s, chapter=_s, section_id=_s, page_number=_i, chunk_index=_i, extra=T.MapType(_s, _s)
)
#: The keys that every chunk's metadata must have.
REQUIRED_METADATA = ("chapter", "section_id", "page_number", "chunk_index")
GOLDEN = _struct(
    id=_s,
    question=_s,
    question_type=_s,
    difficulty=_s,
    cognitive_level=_s,
    answer=_s,
    context=T.ArrayType(_struct(text=_s, page=_i, section=_s, relevance_score=_d)),
    citations=T.ArrayType(_struct(page=_i, quote=_s, verified=_b)),
    hard_negatives=T.ArrayType(_struct(text=_s, strategy=_s, plausibility=_d)),
    ragas_scores=_struct(faithfulness=_d, answer_relevancy=_d, context_precision=_d),
    constitutional_scores=_struct(
        factual_accuracy=_d, completeness=_d, terminology=_d, depth=_d, clarity=_d, no_hallucination=_d
    ),
    metadata=_struct(generated_at=_s, iterations=_i, generation_time_seconds=_d, cost_usd=_d),
)
