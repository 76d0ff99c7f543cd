"""Engine configuration: defaults, environment, YAML, session settings and validation."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any


# The environment names that are read, and where YAML files keep which field.
ENVIRONMENT = ("CHUNK_SIZE", "CHUNK_OVERLAP", "TARGET_QUESTIONS", "MAX_REFLEXION_LOOPS", "DIVERSITY_THRESHOLD", "MIN_FAITHFULNESS", "MIN_ANSWER_RELEVANCE", "MIN_CONTEXT_PRECISION")
YAML = {
    "generator.diversity.content_threshold": "diversity_threshold",
    "answerer.hyde.enabled": "hyde",
    "answerer.self_rag.quality_threshold": "self_rag_quality",
    "answerer.self_rag.relevance_threshold": "self_rag_relevance",
    "critic.ragas.faithfulness_threshold": "min_faithfulness",
    "critic.ragas.relevancy_threshold": "min_answer_relevance",
    "critic.ragas.precision_threshold": "min_context_precision",
    "critic.constitutional.severity_threshold": "constitutional_gate",
    "critic.academic.completeness_threshold": "min_completeness",
    "critic.academic.terminology_threshold": "min_terminology",
    "generation.target_questions": "target_questions",
    "generation.max_reflexion_iterations": "max_reflexion_loops",
    "quality_gates.composite_score": "composite_gate",
    "quality_gates.faithfulness": "min_faithfulness",
    "quality_gates.answer_relevancy": "min_answer_relevance",
    "quality_gates.constitutional": "constitutional_gate",
}


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 50
    target_questions: int = 100
    max_reflexion_loops: int = 3
    diversity_threshold: float = 0.85
    min_question_words: int = 10
    max_question_words: int = 50
    min_faithfulness: float = 0.85
    min_answer_relevance: float = 0.80
    min_context_precision: float = 0.70
    min_context_recall: float = 0.75
    min_completeness: float = 0.75
    min_terminology: float = 0.90
    min_citation_coverage: float = 0.60
    constitutional_gate: float = 0.75
    composite_gate: float = 0.85
    hyde: bool = True
    synonyms: bool = True
    max_variants: int = 5
    semantic_max_chunk: int = 800
    self_rag_quality: float = 0.7
    self_rag_relevance: float = 0.6

    def with_values(self, values: Mapping[str, Any]) -> Config:
        """A copy with the known keys of ``values`` (strings are cast to each field's type)."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        cast = lambda k, v: str(v).lower() in {"1", "true", "yes"} if known[k] is bool else known[k](v)
        return replace(self, **{k: cast(k, v) for k, v in values.items() if k in known})

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "QALOOM_") -> Config:
        """Fields from environment variables: the names in ENVIRONMENT, and any field's upper-cased name behind ``prefix``."""
        plain = {k.lower(): env[k] for k in ENVIRONMENT if k in env}
        return cls().with_values(plain | {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)})

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Fields from the places of YAML files named in YAML, or from top-level keys of their own names; others are ignored."""
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configuration needs PyYAML") from e

        flat = dict(_flat(yaml.safe_load(text) or {}))
        return cls().with_values({k: v for k, v in flat.items() if "." not in k} | {YAML[k]: v for k, v in flat.items() if k in YAML})

    @classmethod
    def from_spark(cls, spark, prefix: str = "spark.qaloom.") -> Config:
        """Fields from session settings under ``prefix``."""
        found = {f.name: spark.conf.get(prefix + f.name, None) for f in fields(cls)}
        return cls().with_values({k: v for k, v in found.items() if v is not None})

    def validate(self) -> bool:
        shares = [v for f in fields(self) if isinstance(v := getattr(self, f.name), float)]
        return all(0 <= v <= 1 for v in shares) and 0 <= self.chunk_overlap < self.chunk_size


def _flat(tree: Mapping[str, Any], at: str = ""):
    """Dotted paths to the leaves of nested mappings."""
    for k, v in tree.items():
        if isinstance(v, Mapping):
            yield from _flat(v, f"{at}{k}.")
        else:
            yield f"{at}{k}", v
