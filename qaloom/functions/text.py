"""Text functions: Column in, Column out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extraction patterns, as Java regular expressions with Unicode classes.
DEFINED_AS = r"(?U)([A-Z][a-z\s]+)\s+is\s+defined\s+as\s+([^.]+\.)"
DEFINITION = r"(?Ui)Definition:\s*([^.]+\.)"
EQUATION = r"(?U)([A-Za-z][\w]*)\s*=\s*([^,\n.]+)"
CHAPTER = r"(?Uim)^Chapter\s+(\d+)[:\.]?\s+(.+)$"
CONCEPT_DEFINED = r"(?U)([A-Z][a-z\w\s]+?)\s+(?:is defined as|means|refers to)"
CONCEPT_LAW = r"(?U)((?:Theorem|Law|Principle|Rule)\s+of\s+[A-Z][a-z\w\s]+)"

_HITS = pa.list_(pa.struct([("position", pa.int32()), ("text", pa.string()), ("before", pa.string()), ("after", pa.string())]))


def strip(c: Column) -> Column:
    """Python's str.strip(): white space is Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Python's str.split()."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def chunk_id(chapter: Column, section: Column, page: Column, index: Column) -> Column:
    return F.format_string("chunk_%s_sec%s_page%d_idx%d", chapter, section, page, index)


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def definitions(c: Column, most: int = 10) -> Column:
    """Matches of both definition patterns, the first pattern's first, up to ``most``."""
    return F.slice(F.concat(_all(c, DEFINED_AS, 0), _all(c, DEFINITION, 0)), 1, most)


def equations(c: Column, most: int = 15, under: int = 50) -> Column:
    """Stripped equation matches shorter than ``under``, up to ``most``."""
    found = F.transform(_all(c, EQUATION, 0), strip)
    return F.slice(F.filter(found, lambda x: F.length(x) < under), 1, most)


def chapters(c: Column) -> Column:
    """(number, title) of every chapter heading."""
    return F.arrays_zip(_all(c, CHAPTER, 1).alias("number"), _all(c, CHAPTER, 2).alias("title"))


def concepts(c: Column) -> Column:
    """Distinct concepts named in definitions and laws, sorted."""
    return F.array_sort(F.array_distinct(F.concat(_all(c, CONCEPT_DEFINED, 1), _all(c, CONCEPT_LAW, 1))))


def keyword_hits(text: Column, keyword: Column, context: int = 50) -> Column:
    """Overlapping case-insensitive matches: position (from 0), match, and clipped context on both sides.

    Each search starts behind the last hit and slices are taken by index, so the work is linear in the text and its hits;
    SQL's substring would walk the text from its start for every hit.
    """

    def hits(t: str | None, k: str | None) -> list[dict] | None:
        if t is None or k is None:
            return None
        low, wanted, n, found, at = t.lower(), k.lower(), len(k), [], -1
        while wanted and (at := low.find(wanted, at + 1)) >= 0:
            found.append({"position": at, "text": t[at : at + n], "before": t[max(0, at - context) : at], "after": t[at + n : at + n + context]})
        return found

    def run(texts: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([hits(t, k) for t, k in zip(texts.to_pylist(), words.to_pylist(), strict=True)], _HITS)

    return F.arrow_udf(run, "array<struct<position:int,text:string,before:string,after:string>>")(text, keyword)


def header(chapter: Column, section: Column, title: Column, texts: Column) -> Column:
    """Context header and the joined texts of a chunk's elements."""
    return F.concat(F.format_string("[Chapter %s, Section %s: %s]\n\n", chapter, section, title), F.array_join(texts, "\n\n"))


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """Fill {name} slots; raises where one is left."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.when(out.rlike(r"\{\w+\}"), F.raise_error(F.concat(F.lit("Missing required parameter in: "), out))).otherwise(out)


def synonym_variants(query: Column, term: Column, synonyms: Column, most: int = 3) -> Column:
    """The query with a term replaced by each of its synonyms; the match ignores case, the replacement does not."""
    found = F.transform(synonyms, lambda s: F.replace(query, term, s))
    return F.slice(F.when(F.contains(F.lower(query), F.lower(term)), found).otherwise(F.array().cast("array<string>")), 1, most)


def html_text(c: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, white space collapses."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))
