"""The tool registry: names, descriptions, argument schemas and dispatch to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import definitions, equations, keyword_hits, word_count
from qaloom.operators.filters import tool_filter
from qaloom.operators.judging import verify_citations
from qaloom.operators.retrieval import top_k
from qaloom.operators.structure import section_text


@dataclass
class Tool:
    name: str
    description: str
    arguments: dict[str, type]
    required: tuple[str, ...]
    call: Callable[..., DataFrame]


@dataclass
class Library:
    """A document's tables: pages (doc, page_number, text), sections (doc, id, level, title, start_page, end_page), chunks, embedder."""

    pages: DataFrame
    sections: DataFrame
    chunks: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    tools: dict[str, Tool] = field(default_factory=dict)

    def __post_init__(self):
        for t in (
            Tool("get_curriculum", "Chapters and sections.", {}, (), self.curriculum),
            Tool("read_section_content", "Text, definitions and equations of a section.", {"section_id": str}, ("section_id",), self.section),
            Tool("vector_search", "Nearest chunks.", {"query": str, "k": int, "filters": dict}, ("query",), self.search),
            Tool("keyword_search", "Matches of a keyword with context.", {"keyword": str, "context": int}, ("keyword",), self.keyword),
            Tool("verify_citation", "Whether a page has a quote.", {"page_number": int, "quote": str, "threshold": float}, ("page_number", "quote"), self.citation),
        ):
            self.tools[t.name] = t

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self.tools:
            raise ValueError(f"Unknown tool: {name}")
        tool = self.tools[name]
        if missing := [a for a in tool.required if a not in arguments]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        for key, value in arguments.items():
            if key not in tool.arguments or not isinstance(value, tool.arguments[key]):
                raise ValueError(f"{name}: bad argument {key}")
        return tool.call(**arguments)

    def curriculum(self) -> DataFrame:
        return self.sections.orderBy("doc", "start_page", "level", "id")

    def section(self, section_id: str) -> DataFrame:
        """Content of a section; one row with an error if there is none."""
        chosen = self.sections.where(F.col("id") == section_id)
        if chosen.isEmpty():
            return self.sections.sparkSession.createDataFrame([(f"Section {section_id} not found",)], "error string")
        return section_text(chosen, self.pages).select(
            F.col("id").alias("section_id"), "full_text", definitions(F.col("full_text")).alias("key_definitions"),
            equations(F.col("full_text")).alias("equations"), word_count(F.col("full_text")).alias("word_count"),
        )

    def search(self, query: str, k: int = 5, filters: dict | None = None) -> DataFrame:
        names = {"chapter": "chapter", "section": "section", "page_min": "page_min", "page_max": "page_max"}
        chunks = tool_filter(self.chunks, **{names[n]: v for n, v in (filters or {}).items()})
        q = chunks.sparkSession.createDataFrame([(0, self.embed(query))], "query_id long, embedding array<float>")
        hits = top_k(chunks, q, k, item_id="chunk_key")
        return hits.join(chunks, hits["id"] == chunks["chunk_key"]).select(
            "rank", "text", "page_number", "section_id", "chapter", (1 - F.col("similarity")).alias("distance"), "similarity"
        )

    def keyword(self, keyword: str, context: int = 50) -> DataFrame:
        hits = F.explode(keyword_hits(F.col("text"), F.lit(keyword), context)).alias("hit")
        return self.pages.select("doc", "page_number", hits).select("doc", "page_number", "hit.*")

    def citation(self, page_number: int, quote: str, threshold: float = 0.85) -> DataFrame:
        docs = self.pages.select("doc").distinct()
        return verify_citations(docs.select("doc", F.lit(page_number).alias("page_number"), F.lit(quote).alias("quote")), self.pages, threshold)
