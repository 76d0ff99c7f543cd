"""Queries for sources, sinks, filters, chunkers and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaloom.functions import text as T
from qaloom.operators import chunking, filters, structure

from .registry import CHUNKS, PAGES, QUESTIONS, SCORES, STRIP, TOC, chunks, pages, query, questions, scores, toc

W = "WITH "


@query("src_page", W + PAGES + " SELECT doc, coalesce(max(text) FILTER (WHERE page_number = 3), '') AS text FROM pages_ GROUP BY doc")
def _(read):
    page = F.max(F.when(F.col("page_number") == 3, F.col("text")))
    return pages(read).groupBy("doc").agg(F.coalesce(page, F.lit("")).alias("text"))


@query("src_page_range", W + PAGES + " SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM pages_ WHERE page_number BETWEEN 2 AND 4 GROUP BY doc")
def _(read):
    p = pages(read).where("page_number BETWEEN 2 AND 4").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    return p.select("doc", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("full_text"))


def _shelf(read):
    """Documents by part size: a third have bookmarks, a third chapter headings on a page, a third neither."""
    part = read("part").select(F.col("p_size").alias("doc"), F.col("p_partkey").alias("n"), "p_name")
    head = F.concat(F.lit("Preface\nChapter "), F.col("doc"), F.lit(": "), "p_name", F.lit(" \nbody\n"))
    leaf = part.where("doc % 3 > 0").withColumn("page_number", F.row_number().over(Window.partitionBy("doc").orderBy("n")))
    text = F.when((F.col("doc") % 3 == 1) & (F.col("page_number") % 7 == 1), head).otherwise(F.lit("body\n"))
    return toc(read).where("doc % 3 = 0"), leaf.select("doc", "page_number", text.alias("text")), toc(read).groupBy("doc").agg((F.max("page") + 5).alias("pages"))


_SHELF = """, leaf AS (SELECT p_size AS doc, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part WHERE p_size % 3 = 1),
 everything AS (SELECT p_size AS doc, max(p_partkey // 10 + 1) + 5 AS pages FROM part GROUP BY 1)
 SELECT doc, id, level, title, start_page, end_page FROM t WHERE doc % 3 = 0
 UNION ALL SELECT doc, 'ch' || doc, 1, p_name, 1, pages FROM leaf JOIN everything USING (doc) WHERE n <= 20 AND n % 7 = 1
 UNION ALL SELECT doc, unnest(['ch1', '1.1']), unnest([1, 2]), unnest(['Full Document', 'Content']), 1, pages FROM everything WHERE doc % 3 = 2"""


@query("src_pdf", "SELECT page_id, 1 AS page_number, strlen(coalesce(html, '')) AS size FROM pages")
def _(read):
    """Files of any format by a pluggable page extractor; here UTF-8 files of one page each, written from the pages."""
    from qaloom.sources.store import scratch
    from qaloom.sources.files import read_pages, write_files

    src = read("pages").select(F.concat("page_id", F.lit(".html")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    write_files(src, path := scratch(src.sparkSession, "files"))
    found = read_pages(src.sparkSession, path)
    return found.select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "page_number", F.octet_length("text").cast("long").alias("size"))


@query("src_html_docx", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages""")
def _(read):
    return read("pages").select("page_id", T.html_text(F.col("html")).alias("text"))


SYNONYMS = {"ring": ["band", "loop", "hoop", "circle"], "widget": ["gadget", "device"], "bolt": ["screw"]}


@query("src_synonyms", """SELECT term, synonym, count(p_partkey) AS n FROM (SELECT unnest(['bolt', 'ring', 'ring', 'ring', 'ring', 'widget', 'widget']) AS term,
  unnest(['screw', 'band', 'loop', 'hoop', 'circle', 'gadget', 'device']) AS synonym) LEFT JOIN part ON contains(lower(p_name), term) GROUP BY 1, 2""")
def _(read):
    """The dictionary as a small table, with how many part names have each term."""
    spark = read("region").sparkSession
    table = spark.createDataFrame([(t, s) for t, ss in SYNONYMS.items() for s in ss], "term string, synonym string")
    names = read("part").select(F.lower("p_name").alias("name")).groupBy("name").agg(F.count("*").alias("k"))
    return F.broadcast(table).join(names, F.contains("name", F.col("term")), "left").groupBy("term", "synonym").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))


@query("snk_tool_json")
def _(read):
    from qaloom.sources.store import tool_json

    return tool_json(chunks(read).select("id", "page_number", "chapter"))


@query("val_required")
def _(read):
    return filters.require(chunks(read), ["chapter", "section_id", "page_number", "chunk_index"]).select("id", "chapter")


_C = W + CHUNKS + " SELECT id, chapter, section_id, page_number, chunk_index FROM chunks WHERE "
_COLS = ["id", "chapter", "section_id", "page_number", "chunk_index"]


@query("flt_meta_eq", _C + "chapter = 'src3'")
def _(read):
    return chunks(read).where(filters.where({"chapter": "src3"})).select(_COLS)


@query("flt_meta_range", _C + "page_number >= 1 AND page_number <= 2")
def _(read):
    return chunks(read).where(filters.where({"$and": [{"page_number": {"$gte": 1}}, {"page_number": {"$lte": 2}}]})).select(_COLS)


@query("flt_contains", _C + "contains(text, 'The')")
def _(read):
    return chunks(read).where(filters.contains({"$contains": "The"})).select(_COLS)


@query("flt_by_metadata", _C + "chapter = 'src1' AND page_number = 1")
def _(read):
    return filters.by_metadata(chunks(read), chapter="src1", page_number=1).select(_COLS)


@query("flt_tool", _C + "chapter = 'src2' AND page_number BETWEEN 1 AND 3")
def _(read):
    return filters.tool_filter(chunks(read), chapter="src2", page_min=1, page_max=3).select(_COLS)


_GATE = "faithfulness >= 0.85 AND answer_relevancy >= 0.80 AND context_precision >= 0.70 AND context_recall >= 0.75"


@query("flt_gate", W + SCORES + f" SELECT id, {_GATE} AS passed FROM scores")
def _(read):
    return scores(read).select("id", filters.passes(filters.GATES).alias("passed"))


@query("flt_gate_simple", W + SCORES + " SELECT id FROM scores WHERE faithfulness > 0.80 AND answer_relevancy > 0.75")
def _(read):
    return scores(read).where(filters.passes(filters.EARLY_GATES, strict=True)).select("id")


@query("flt_trigger", W + SCORES + """ SELECT id, CASE WHEN iterations >= 3 THEN 'log_hard' WHEN faithfulness < 0.85 THEN 'cite_other_pages'
  WHEN answer_relevancy < 0.80 THEN 'rephrase_question' WHEN context_precision < 0.70 THEN 'keyword_search'
  WHEN NOT citation_verified THEN 'retrieve_new_chunks' END AS action FROM scores""")
def _(read):
    return scores(read).select("id", filters.trigger().alias("action"))


@query("flt_isrel", W + SCORES + """ , n AS (SELECT *, count(*) FILTER (WHERE faithfulness >= 0.6) OVER (PARTITION BY chapter) AS good FROM scores)
  SELECT id, 'first' AS leg FROM n WHERE faithfulness >= 0.6 UNION ALL SELECT id, 'retry' FROM n WHERE good < 2 AND answer_relevancy >= 0.6""")
def _(read):
    good = F.sum((F.col("faithfulness") >= 0.6).cast("int")).over(Window.partitionBy("chapter"))
    n = scores(read).withColumn("good", good)
    retry = n.where("good < 2 AND answer_relevancy >= 0.6").select("id", F.lit("retry").alias("leg"))
    return n.where("faithfulness >= 0.6").select("id", F.lit("first").alias("leg")).unionByName(retry)


_PROMPT = "'Given the topic ' || chapter || ', ' || question"


@query("flt_words", W + QUESTIONS + rf", w AS (SELECT id, len(string_split_regex({_PROMPT}, '\s+')) AS n_words FROM questions) SELECT * FROM w WHERE n_words BETWEEN 10 AND 50")
def _(read):
    long = F.concat(F.lit("Given the topic "), "chapter", F.lit(", "), "question")
    return questions(read).select("id", T.word_count(long).alias("n_words")).where("n_words BETWEEN 10 AND 50")


@query("flt_scenario", W + QUESTIONS + " SELECT id FROM questions WHERE chapter IN ('Brand#2-0', 'Brand#17-0') AND difficulty = 'expert' AND contains(lower(question), 'a')")
def _(read):
    return questions(read).where(F.col("chapter").isin("Brand#2-0", "Brand#17-0") & (F.col("difficulty") == "expert") & F.contains(F.lower("question"), F.lit("a"))).select("id")


@query("prj_hits", W + CHUNKS + " SELECT id, text, chapter AS meta_chapter, page_number AS meta_page FROM chunks")
def _(read):
    hits = chunks(read).select("id", "text", F.struct("chapter", "page_number").alias("metadata"))
    return hits.select("id", "text", F.col("metadata.chapter").alias("meta_chapter"), F.col("metadata.page_number").alias("meta_page"))


@query("prj_tool_chunks", W + CHUNKS + " SELECT text, page_number, section_id, chapter, round(1 - 1 / (1 + chunk_index), 6)::DOUBLE AS relevance_score FROM chunks")
def _(read):
    return chunks(read).select("text", "page_number", "section_id", "chapter", F.round(1 - 1 / (1 + F.col("chunk_index")), 6).alias("relevance_score"))


@query("flt_section", W + TOC + """, k AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY ord) AS ch FROM toc WHERE level <= 2)
  SELECT doc, title FROM (SELECT *, row_number() OVER (PARTITION BY doc, ch, level ORDER BY ord) AS sec FROM k) WHERE level = 2 AND ch = 1 AND sec = 2""")
def _(read):
    return _toc(read).where("id = '1.2'").select("doc", "title")


def _toc(read):
    last = toc(read).groupBy("doc").agg((F.max("page") + 5).alias("pages"))
    return structure.number_toc(toc(read), last)


_TOC_SQL = W + TOC + """, last AS (SELECT doc, max(page) + 5 AS pages FROM toc GROUP BY doc),
 k AS (SELECT * FROM (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY ord) AS ch FROM toc WHERE level <= 2) WHERE ch > 0),
 c AS (SELECT doc, ch, title, page, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY ord) - 1, pages) AS end_page FROM k JOIN last USING (doc) WHERE level = 1),
 s AS (SELECT k.doc, k.ch, k.title, k.page, row_number() OVER w AS sec, coalesce(lead(k.page) OVER w - 1, c.end_page) AS end_page
       FROM k JOIN c ON c.doc = k.doc AND c.ch = k.ch WHERE level = 2 WINDOW w AS (PARTITION BY k.doc, k.ch ORDER BY k.ord)),
 t AS (SELECT doc, 'ch' || ch AS id, 1 AS level, title, page AS start_page, end_page FROM c UNION ALL SELECT doc, ch || '.' || sec, 2, title, page, end_page FROM s) """


@query("src_toc_bookmark", _TOC_SQL + _SHELF)
def _(read):
    return structure.contents(*_shelf(read))


@query("win_toc_end", _TOC_SQL + "SELECT doc, id, start_page, end_page FROM t")
def _(read):
    return _toc(read).select("doc", "id", "start_page", "end_page")


@query("win_toc_ids", _TOC_SQL + "SELECT doc, id, level, title FROM t")
def _(read):
    return _toc(read).select("doc", "id", "level", "title")


@query("win_chunk_index", W + CHUNKS + " SELECT doc_id, chunk_index, length(text) AS n FROM chunks")
def _(read):
    return chunks(read).select("doc_id", "chunk_index", F.length("text").alias("n"))


@query("chk_fixed", W + CHUNKS + " SELECT doc_id, chunk_index, text FROM chunks")
def _(read):
    return chunks(read).select("doc_id", "chunk_index", "text")


def _separator_sql(size: int, overlap: int) -> str:
    """Windows one after another; each looks for the last line end in its last fifth from behind."""
    tail = size // 5
    back = f"strpos(reverse(substr(text, start + {size - tail} + 1, {tail})), chr(10))"
    end = f"CASE WHEN start + {size} < length(text) AND {back} > 0 THEN start + {size} - {back} + 1 ELSE start + {size} END"
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, text, start, {end} AS stop FROM (SELECT doc_id, text, 0 AS start FROM documents WHERE length(text) > 0)
  UNION ALL SELECT doc_id, text, start, {end} FROM (SELECT doc_id, text, stop - {overlap} AS start FROM w WHERE stop - {overlap} < length(text))
), c AS (SELECT doc_id AS id, start, {STRIP.format("substr(text, start + 1, stop - start)")} AS chunk FROM w)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_index, chunk FROM c WHERE chunk <> ''"""


@query("chk_fixed_sep", _separator_sql(500, 50))
def _(read):
    return chunking.separator_chunks(read("documents"))


@query("chk_fixed_sep_99", _separator_sql(99, 20))
def _(read):
    """A size that five does not divide."""
    return chunking.separator_chunks(read("documents"), chunk_size=99, overlap=20)


@query("chk_meta", W + CHUNKS + " SELECT id, 'override' AS chapter, page_number::VARCHAR AS page FROM chunks")
def _(read):
    base = F.create_map(F.lit("chapter"), F.col("chapter"), F.lit("page"), F.col("page_number").cast("string"))
    extra = F.create_map(F.lit("chapter"), F.lit("override"))
    keep = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return chunks(read).withColumn("m", F.map_concat(keep, extra)).select("id", F.col("m")["chapter"].alias("chapter"), F.col("m")["page"].alias("page"))


def structured(read):
    """Texts with theorems, definitions, examples, equations and proofs, from parts; the last paragraph's length varies."""
    n, name, kind = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")
    return read("part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat_ws("", F.lit("Intro to "), name, F.lit(".\n\nTheorem "), n, F.lit(": "), kind, F.lit(" holds.\nProof: by "), name,
                    F.lit(".\n\nDefinition "), n, F.lit(": a "), kind, F.lit(".\n\nExample "), n, F.lit(": take F = "), F.col("p_size"),
                    F.lit("\n\nClosing words on "), F.repeat(F.concat(name, F.lit(", ")), F.col("p_size") * 2), F.lit("all.")).alias("text"),
    )


_PARSED = """WITH x AS (SELECT p_partkey AS id, ['paragraph', 'theorem', 'proof', 'definition', 'example', 'equation', 'paragraph'] AS kinds,
  ['Intro to ' || p_name || '.', 'Theorem ' || p_partkey || ': ' || p_type || ' holds.', 'Proof: by ' || p_name || '.', 'Definition ' || p_partkey || ': a ' || p_type || '.',
   'Example ' || p_partkey || ': take F = ' || p_size, 'F = ' || p_size, 'Closing words on ' || repeat(p_name || ', ', 2 * p_size) || 'all.'] AS bodies FROM part),
 e AS (SELECT id, unnest(range(0, 7))::INT AS position, unnest(kinds) AS kind, unnest(bodies) AS text FROM x) """
_PACKED = _PARSED + """, p AS (SELECT *, CASE WHEN position < 5 THEN position WHEN position = 5 THEN 4
   WHEN length(text) <= 800 - length(lag(text) OVER w) - length(lag(text, 2) OVER w) THEN 4 ELSE 5 END::INT AS chunk_index FROM e WINDOW w AS (PARTITION BY id ORDER BY position)),
 k AS (SELECT id, chunk_index, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text, count(*)::INT AS num_elements, bool_or(kind = 'theorem') AS has_theorem,
   bool_or(kind = 'definition') AS has_definition, bool_or(kind = 'equation') AS has_equation, bool_or(kind = 'example') AS has_example FROM p GROUP BY 1, 2) """


@query("chk_parse", _PARSED + "SELECT * FROM e")
def _(read):
    return chunking.elements(structured(read))


@query("chk_semantic", _PACKED + "SELECT id, chunk_index, text, num_elements FROM k")
def _(read):
    return chunking.semantic_chunks(structured(read)).select("id", "chunk_index", "text", "num_elements")


@query("chk_create", _PACKED + "SELECT * REPLACE ('[Chapter 1, Section ' || id || ': Parts]' || chr(10) || chr(10) || text AS text) FROM k")
def _(read):
    s = chunking.semantic_chunks(structured(read))
    head = T.header(F.lit("1"), F.col("id"), F.lit("Parts"), F.array("text"))
    return s.select("id", "chunk_index", head.alias("text"), "has_theorem", "has_definition", "has_equation", "has_example", "num_elements")


@query("win_equation_ctx", _PACKED + "SELECT id, chunk_index, num_elements FROM k WHERE has_equation")
def _(read):
    return chunking.semantic_chunks(structured(read)).where("has_equation").select("id", "chunk_index", "num_elements")


@query("fn_elements", _PARSED + "SELECT * FROM e WHERE kind <> 'paragraph'")
def _(read):
    return chunking.elements(structured(read)).where("kind <> 'paragraph'")


@query("agg_element_counts", _PARSED + "SELECT kind, count(*) AS n FROM e GROUP BY 1")
def _(read):
    return chunking.elements(structured(read)).groupBy("kind").agg(F.count("*").alias("n"))


def prose(read):
    """Sentences with definitions, equations, laws and chapter headings, from parts."""
    return read("part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("", F.lit("Chapter "), F.col("p_size"), F.lit(": "), F.col("p_name"), F.lit("\nUnit is defined as "), F.col("p_type"),
                    F.lit(". Definition: "), F.col("p_name"), F.lit(". Then F = "), F.col("p_size"), F.lit(", and x1= "), F.col("p_brand"),
                    F.lit("; Law of Parts and Size.")).alias("text"),
    )


PROSE = """prose AS (SELECT p_partkey AS id, 'Chapter ' || p_size || ': ' || p_name || chr(10) || 'Unit is defined as ' || p_type || '. Definition: ' || p_name
  || '. Then F = ' || p_size || ', and x1= ' || p_brand || '; Law of Parts and Size.' AS text FROM part)"""


@query("fn_definitions", W + PROSE + r""" SELECT id, array_to_string((regexp_extract_all(text, '([A-Z][a-z\s]+)\s+is\s+defined\s+as\s+([^.]+\.)')
  || regexp_extract_all(text, '(?i)Definition:\s*([^.]+\.)'))[1:10], '|') AS found FROM prose""")
def _(read):
    return prose(read).select("id", F.array_join(T.definitions(F.col("text")), "|").alias("found"))


@query("top_defs", W + PROSE + r""" SELECT id, len((regexp_extract_all(text, '([A-Z][a-z\s]+)\s+is\s+defined\s+as\s+([^.]+\.)')
  || regexp_extract_all(text, '(?i)Definition:\s*([^.]+\.)'))[1:1]) AS n FROM prose""")
def _(read):
    return prose(read).select("id", F.size(T.definitions(F.col("text"), 1)).alias("n"))


_EQ = r"list_filter(list_transform(regexp_extract_all(text, '([A-Za-z][\p{L}\p{N}_]*)\s*=\s*([^,\n.]+)'), lambda x: trim(x)), lambda x: length(x) < 50)"


@query("fn_equations", W + PROSE + f" SELECT id, array_to_string({_EQ}[1:15], '|') AS found FROM prose")
def _(read):
    return prose(read).select("id", F.array_join(T.equations(F.col("text")), "|").alias("found"))


@query("top_eqs", W + PROSE + f" SELECT id, array_to_string({_EQ}[1:1], '|') AS found FROM prose")
def _(read):
    return prose(read).select("id", F.array_join(T.equations(F.col("text"), 1), "|").alias("found"))


@query("set_union_patterns", W + PROSE + r""" SELECT id, unnest(regexp_extract_all(text, '([A-Z][a-z\s]+)\s+is\s+defined\s+as\s+([^.]+\.)')
  || regexp_extract_all(text, '(?i)Definition:\s*([^.]+\.)')) AS found FROM prose""")
def _(read):
    return prose(read).select("id", F.explode(T.definitions(F.col("text"), 1_000_000)).alias("found"))


@query("fn_toc_regex", W + PROSE + r" SELECT id, regexp_extract(text, '(?im)^Chapter\s+(\d+)[:\.]?\s+(.+)$', 1) AS number, regexp_extract(text, '(?im)^Chapter\s+(\d+)[:\.]?\s+(.+)$', 2) AS title FROM prose")
def _(read):
    return prose(read).select("id", F.explode(T.chapters(F.col("text"))).alias("c")).select("id", "c.number", "c.title")


@query("fn_keyword_hits", """WITH p AS (SELECT doc_id, text, unnest(l) AS part, generate_subscripts(l, 1) AS k, len(l) AS n FROM (SELECT doc_id, text, string_split(lower(text), 'ar') AS l FROM documents)),
  h AS (SELECT doc_id, text, k < n AS hit, (sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS i FROM p)
  SELECT doc_id AS id, (i - 1)::INT AS position, substr(text, i, 2) AS text, substr(text, greatest(i - 10, 1), least(i - 1, 10)) AS before, substr(text, i + 2, 10) AS after FROM h WHERE hit""")
def _(read):
    return read("documents").select(F.col("doc_id").alias("id"), F.explode(T.keyword_hits(F.col("text"), F.lit("AR"), 10)).alias("h")).select("id", "h.*")


_CONCEPTS = r"""list_sort(list_distinct(regexp_extract_all(text, '([A-Z][a-z\p{L}\p{N}_\s]+?)\s+(?:is defined as|means|refers to)', 1)
  || regexp_extract_all(text, '((?:Theorem|Law|Principle|Rule)\s+of\s+[A-Z][a-z\p{L}\p{N}_\s]+)', 1)))"""


@query("fn_concepts", W + PROSE + f" SELECT id, array_to_string({_CONCEPTS}, '|') AS found FROM prose")
def _(read):
    return prose(read).select("id", F.array_join(T.concepts(F.col("text")), "|").alias("found"))


@query("set_distinct_concepts", W + PROSE + f" SELECT DISTINCT unnest({_CONCEPTS}) AS concept FROM prose")
def _(read):
    return prose(read).select(F.explode(T.concepts(F.col("text"))).alias("concept")).distinct()


@query("fn_header", W + CHUNKS + " SELECT id, '[Chapter ' || chapter || ', Section ' || section_id || ': Text]' || chr(10) || chr(10) || text AS text FROM chunks")
def _(read):
    return chunks(read).select("id", T.header(F.col("chapter"), F.col("section_id"), F.lit("Text"), F.array("text")).alias("text"))


@query("fn_template", W + QUESTIONS + " SELECT id, question FROM questions")
def _(read):
    return questions(read).select("id", "question")


@query("fn_prompt", W + QUESTIONS + " SELECT id, 'Section: ' || chapter || chr(10) || 'Question: ' || question || chr(10) || 'Answer with citations.' AS prompt FROM questions")
def _(read):
    t = F.lit("Section: {section}\nQuestion: {question}\nAnswer with citations.")
    return questions(read).select("id", T.fill(t, {"section": F.col("chapter"), "question": F.col("question")}).alias("prompt"))


_VARIANTS = """v AS (SELECT p_partkey AS id, lower(p_name) AS query FROM part),
 syn AS (SELECT * FROM (VALUES ('ring', ['band', 'loop', 'hoop', 'circle']), ('widget', ['gadget', 'device']), ('bolt', ['screw'])) t(term, synonyms))"""


def _variants(read, most=3):
    q = read("part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("query"))
    table = F.array(*(F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, ss)).alias("synonyms")) for t, ss in SYNONYMS.items()))
    s = q.select("*", F.explode(table).alias("s")).where(F.contains("query", F.col("s.term")))
    return s.select("id", "query", F.explode(T.synonym_variants(F.col("query"), F.col("s.term"), F.col("s.synonyms"), most)).alias("variant"))


@query("fn_synonym_variants", W + _VARIANTS + " SELECT id, query, replace(query, term, unnest(synonyms[1:3])) AS variant FROM v, syn WHERE contains(query, term)")
def _(read):
    return _variants(read)


@query("top_synonyms", W + _VARIANTS + " SELECT id, replace(query, term, unnest(synonyms[1:2])) AS variant FROM v, syn WHERE contains(query, term)")
def _(read):
    return _variants(read, 2).select("id", "variant")


@query("exp_query", W + _VARIANTS + """ SELECT id, 'original' AS kind, query AS variant FROM v UNION ALL SELECT p_partkey, 'hyde', 'A ' || lower(p_name) || ' is a ' || lower(p_type) || ' of ' || p_brand || '.' FROM part
  UNION ALL SELECT id, 'synonym', replace(query, term, unnest(synonyms[1:3])) FROM v, syn WHERE contains(query, term)""")
def _(read):
    # The hypothetical answer comes from the generation surface, here a model that answers by a fixed phrase.
    from qaloom.functions.udfs import generate

    part = read("part")
    q = part.select(F.col("p_partkey").alias("id"), F.lit("original").alias("kind"), F.lower("p_name").alias("variant"))
    prompt = F.concat_ws("|", F.lower("p_name"), F.lower("p_type"), "p_brand")
    hyde = part.select(F.col("p_partkey").alias("id"), F.lit("hyde").alias("kind"), generate(prompt, lambda p: "A {} is a {} of {}.".format(*p.split("|"))).alias("variant"))
    return q.unionByName(hyde).unionByName(_variants(read).select("id", F.lit("synonym").alias("kind"), "variant"))


@query("fn_strip", r"SELECT doc_id, length(regexp_replace(chr(9) || text || chr(8195), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS n FROM documents")
def _(read):
    return read("documents").select("doc_id", F.length(T.strip(F.concat(F.lit("\t"), "text", F.lit(" ")))).alias("n"))


@query("fn_lower", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def _(read):
    return read("documents").select("doc_id", F.md5(F.lower("text")).alias("digest"))


@query("fn_round", W + SCORES + " SELECT id, round(faithfulness / 7, 3) AS r FROM scores")
def _(read):
    return scores(read).select("id", F.round(F.col("faithfulness") / 7, 3).alias("r"))


@query("fn_chunk_id", W + CHUNKS + " SELECT id FROM chunks")
def _(read):
    return chunks(read).select("id")


@query("agg_word_count", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda x: x <> '')) AS n_words FROM documents")
def _(read):
    return read("documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("snk_add", W + CHUNKS + " SELECT id, text, chapter, page_number, chunk_index, section_id AS doc FROM chunks")
def _(read):
    """Chunks added to a collection in two appends, metadata checked, ids made where there are none, and read back."""
    import uuid

    from qaloom.sources.store import Collection

    c = chunks(read).withColumn("extra", F.create_map(F.lit("doc"), "section_id"))
    store = Collection(c.sparkSession, f"added_{uuid.uuid4().hex}")
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    store.add(c.where(even))
    store.add(c.where(~even).drop("id"))
    return store.rows().select("id", "text", "chapter", "page_number", "chunk_index", F.col("extra")["doc"].alias("doc"))


@query("snk_drop", "SELECT 0 AS tables")
def _(read):
    """A collection that is dropped is gone."""
    import uuid

    from qaloom.sources.store import Collection

    spark = read("region").sparkSession
    store = Collection(spark, f"dropped_{uuid.uuid4().hex}")
    store.drop()
    return spark.createDataFrame([(int(spark.catalog.tableExists(store.name)),)], "tables int")


@query("src_collection", W + CHUNKS + " SELECT count(*) AS total_chunks, count(DISTINCT chapter) AS unique_chapters FROM chunks WHERE chunk_index = 0")
def _(read):
    """A collection is opened again under its name."""
    import uuid

    from qaloom.sources.store import Collection

    c = chunks(read).where("chunk_index = 0")
    name = f"opened_{uuid.uuid4().hex}"
    Collection(c.sparkSession, name).add(c)
    return Collection(c.sparkSession, name).stats().select("total_chunks", "unique_chapters")


@query("snk_hf", W + QUESTIONS + " SELECT CASE WHEN id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM questions GROUP BY 1")
def _(read):
    """Golden records as a dataset repository: Parquet files by split, and a card; read back by split."""
    from qaloom.sources.store import read_dataset, scratch, write_dataset

    g = golden(read).withColumn("split", F.when(F.col("id").cast("long") % 10 == 0, "test").otherwise("train"))
    write_dataset(g, path := scratch(g.sparkSession, "dataset"), {"license": "unknown"})
    return read_dataset(g.sparkSession, path).groupBy("split").agg(F.count("*").alias("n"))


def config_rows(read, values):
    return read("region").sparkSession.createDataFrame(sorted((k, str(v)) for k, v in values.items()), "name string, value string")


@query("src_env", "SELECT unnest(['chunk_size', 'diversity_threshold', 'min_faithfulness']) AS name, unnest(['400', '0.9', '0.8']) AS value")
def _(read):
    from qaloom.config import Config

    c = Config.from_env({"CHUNK_SIZE": "400", "DIVERSITY_THRESHOLD": "0.9", "MIN_FAITHFULNESS": "0.8", "HYDE": "0"})
    return config_rows(read, {k: v for k, v in vars(c).items() if v != getattr(Config(), k)})


@query("src_yaml", "SELECT unnest(['min_terminology', 'hyde', 'target_questions']) AS name, unnest(['0.95', 'False', '20']) AS value")
def _(read):
    from qaloom.config import Config

    text = """
critic:
  academic:
    terminology_threshold: 0.95
answerer:
  hyde: {enabled: false}
generation:
  target_questions: 20  # few
"""
    return config_rows(read, {k: v for k, v in vars(Config.from_yaml(text)).items() if v != getattr(Config(), k)})


@query("udf_tools", _TOC_SQL + "SELECT doc, id, title, start_page, end_page FROM t")
def _(read):
    """A registered tool called by name; unknown names and bad arguments are errors."""
    from qaloom.sources.tools import Library

    tools = Library(pages(read), _toc(read))
    for name, arguments in (("no_such_tool", {}), ("keyword_search", {}), ("get_curriculum", {"x": 1})):
        try:
            tools.call(name, **arguments)
        except ValueError:
            continue
        raise AssertionError(f"{name} must be refused")
    return tools.call("get_curriculum").select("doc", "id", "title", "start_page", "end_page")


def golden(read):
    """Golden records made of the question carrier; what it lacks is null."""
    from qaloom.schemas import GOLDEN

    q = questions(read).select(F.col("id").cast("string").alias("id"), "question", "difficulty", "cognitive_level", F.col("chapter").alias("answer"))
    return q.select(*(F.col(f.name) if f.name in q.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in GOLDEN.fields))


_GOLDEN = W + QUESTIONS + " SELECT id::VARCHAR AS id, question, difficulty, cognitive_level FROM questions"


@query("snk_jsonl", _GOLDEN)
def _(read):
    """Written as JSONL and read back against the schema."""
    from qaloom.sources.store import read_golden, scratch, write_golden

    g = golden(read)
    write_golden(g, path := scratch(g.sparkSession, "golden"))
    return read_golden(g.sparkSession, path).select("id", "question", "difficulty", "cognitive_level")


@query("src_jsonl", W + QUESTIONS + " SELECT id % 2 AS approach, count(*) AS n FROM questions GROUP BY 1")
def _(read):
    """Two approaches' datasets read as one, told apart by file."""
    from qaloom.sources.store import read_golden, scratch, write_golden

    g = golden(read)
    root = scratch(g.sparkSession, "approaches")
    for k in (0, 1):
        write_golden(g.where(F.col("id").cast("long") % 2 == k), f"{root}/approach={k}")
    rows = read_golden(g.sparkSession, f"{root}/approach=0", f"{root}/approach=1")
    which = F.regexp_extract("source_file", "approach=([01])", 1).cast("long")
    return rows.groupBy(which.alias("approach")).agg(F.count("*").alias("n"))


_LOG = W + SCORES + " SELECT chapter AS thread_id, max(id) AS checkpoint_id, arg_max(iterations, id)::VARCHAR AS state FROM scores GROUP BY 1"


@query("snk_checkpoint", _LOG)
def _(read):
    """Latest state of every thread of an append-only log."""
    from qaloom.sources.store import Checkpoints, scratch

    s = scores(read).select(F.col("chapter").alias("thread_id"), F.col("id").alias("checkpoint_id"), F.col("iterations").cast("string").alias("state"))
    log = Checkpoints(s.sparkSession, scratch(s.sparkSession, "log"))
    log.save(s)
    return log.latest()


@query("st_checkpoint", W + SCORES + " SELECT chapter AS thread_id, count(*) AS checkpoints FROM scores GROUP BY 1")
def _(read):
    """Checkpoints listed by thread, saved in two runs as after a restart."""
    from qaloom.sources.store import Checkpoints, scratch

    s = scores(read).select(F.col("chapter").alias("thread_id"), F.col("id").alias("checkpoint_id"), F.col("iterations").cast("string").alias("state"))
    log = Checkpoints(s.sparkSession, scratch(s.sparkSession, "log"))
    log.save(s.where("checkpoint_id % 2 = 0"))
    log.save(s.where("checkpoint_id % 2 = 1"))
    return log.list().groupBy("thread_id").agg(F.count("*").alias("checkpoints"))


@query("udtf_chunk", "SELECT id AS doc_id, chunk_index, chunk FROM (" + _separator_sql(500, 50) + ")")
def _(read):
    from qaloom.functions.udtf import register

    docs = read("documents").select("doc_id", "text")
    register(docs.sparkSession)
    return docs.sparkSession.sql(
        "SELECT doc_id, chunk_index, chunk FROM {docs}, LATERAL separator_chunks(text, 500, 50, '\\n')", docs=docs
    )
