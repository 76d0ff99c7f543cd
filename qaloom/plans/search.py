"""Queries for joins, retrieval, set operations and vector functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaloom.functions.vectors import cosine, distance_to_similarity, dot
from qaloom.operators import judging, retrieval, structure

from .registry import CHUNKS, PAGES, QUESTIONS, SCORES, TOC, VECTORS, chunks, pages, query, questions, scores, toc, vector_queries, vectors

W = "WITH "
_RANKED = W + VECTORS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) "


@query("jn_query_chunk", _RANKED + "SELECT query_id, id, similarity, rank FROM r WHERE rank <= 10")
def _(read):
    return retrieval.top_k(vectors(read), vector_queries(read), 10)


@query("top_vector", _RANKED + "SELECT query_id, id, round(1 - similarity, 6) AS distance, rank FROM r WHERE rank <= 5")
def _(read):
    return retrieval.top_k(vectors(read), vector_queries(read), 5).select("query_id", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")


_HYBRID = W + VECTORS + """,
 v AS (SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= 10),
 k1 AS (SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims WHERE contains(text, kw1)) WHERE rank <= 10),
 k2 AS (SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims WHERE contains(text, kw2)) WHERE rank <= 10),
 legs AS (SELECT query_id, id, similarity * 0.7 AS s, 0 AS leg, rank FROM v UNION ALL SELECT query_id, id, similarity * 0.3, 1, rank FROM k1 UNION ALL SELECT query_id, id, similarity * 0.3, 2, rank FROM k2),
 sums AS (SELECT query_id, id, round(sum(s), 9) AS combined_score, min(leg * 1000 + rank) AS met FROM legs GROUP BY ALL),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, met, id) AS rank FROM sums) """


@query("top_hybrid", _HYBRID + "SELECT query_id, id, combined_score, rank FROM f WHERE rank <= 5")
def _(read):
    return retrieval.hybrid(vectors(read), vector_queries(read), ["kw1", "kw2"], 5)


@query("jn_hybrid_outer", _HYBRID + "SELECT query_id, id, combined_score FROM sums")
def _(read):
    return retrieval.hybrid(vectors(read), vector_queries(read), ["kw1", "kw2"], 5, keep=30).select("query_id", "id", "combined_score")


@query("exp_hyde", W + """q AS (SELECT a.vec_id AS query_id, list_transform(range(1, 65), lambda i: (a.embedding[i] + b.embedding[i])::DOUBLE) AS qe
   FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
 sims AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings)
 SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= 5""")
def _(read):
    e = read("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("answer"))
    q = e.where(F.col("vec_id") % 20 == 0).join(nxt, "vec_id").select(
        F.col("vec_id").alias("query_id"), F.zip_with("embedding", "answer", lambda a, b: a + b).alias("embedding")
    )
    return retrieval.top_k(e, q, 5, item_id="vec_id")


_EXPANDED = W + """q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS qe0, v FROM embeddings, range(0, 2) t(v) WHERE vec_id % 20 = 0),
 q2 AS (SELECT query_id, v, CASE WHEN v = 0 THEN qe0 ELSE list_transform(qe0, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END) END AS qe FROM q),
 sims AS (SELECT query_id, v, vec_id AS id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM q2, embeddings),
 legs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= 10),
 m AS (SELECT query_id, id, max(similarity) AS score FROM legs GROUP BY ALL)"""


def _expanded(read):
    e = read("embeddings")
    q = e.where(F.col("vec_id") % 20 == 0)
    half = F.transform("embedding", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0).cast("float")))
    first = retrieval.top_k(e, q.withColumnRenamed("vec_id", "query_id"), 10, item_id="vec_id")
    other = retrieval.top_k(e, q.select(F.col("vec_id").alias("query_id"), half.alias("embedding")), 10, item_id="vec_id")
    return first.unionByName(other)


@query("top_expanded", _EXPANDED + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 5")
def _(read):
    return retrieval.best_per_id(_expanded(read), ["query_id", "id"], F.col("similarity"), 5, ["query_id"])


@query("set_dedupe_results", _EXPANDED + " SELECT DISTINCT query_id, id FROM legs")
def _(read):
    return _expanded(read).dropDuplicates(["query_id", "id"]).select("query_id", "id")


@query("top_rerank")
def _(read):
    from qaloom.functions.udfs import pair_score

    docs = vectors(read).select("id", "text")
    texts = docs.select(F.col("id").alias("query_id"), F.col("text").alias("qt"))
    first = retrieval.top_k(vectors(read), vector_queries(read), 20).drop("rank").join(docs, "id").join(texts, "query_id")
    return retrieval.rerank(first, pair_score(F.col("qt"), F.col("text")), 5).select("query_id", "id", "rerank_score", "rank")


@query("agg_recall_prec_k", _RANKED + """, g AS (SELECT q.query_id, e.vec_id AS id FROM embeddings e JOIN (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0) q ON q.label = e.label),
 n AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY 1)
 SELECT query_id, round(count(g.id) / relevant, 6) AS recall, round(count(g.id) / 5.0, 6)::DOUBLE AS precision FROM r LEFT JOIN g USING (query_id, id) JOIN n USING (query_id) WHERE rank <= 5 GROUP BY query_id, relevant""")
def _(read):
    hits = retrieval.top_k(vectors(read), vector_queries(read), 5)
    e = read("embeddings")
    q = e.where(F.col("vec_id") % 20 == 0)
    found = retrieval.label_recall_precision(hits, e, q, 5, item_id="vec_id", query_id="vec_id")
    return found.select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_PAIR = "SELECT a.vec_id AS id, {} FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(read):
    e = read("embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")


@query("fn_cosine", _PAIR.format("round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine"))
def _(read):
    return _neighbours(read).select("id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("fn_dot", _PAIR.format("round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot"))
def _(read):
    return _neighbours(read).select("id", F.round(dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("fn_dist_to_sim", W + SCORES + " SELECT id, round(1 - faithfulness, 6) AS similarity FROM scores")
def _(read):
    return scores(read).select("id", F.round(distance_to_similarity(F.col("faithfulness")), 6).alias("similarity"))


@query("fn_weighted", W + SCORES + " SELECT id, round(0.35 * faithfulness + 0.30 * answer_relevancy + 0.20 * context_precision + 0.15 * context_recall, 6)::DOUBLE AS score FROM scores")
def _(read):
    s = scores(read)
    return s.select("id", F.round(judging.diversity(s["faithfulness"], s["answer_relevancy"], s["context_precision"], s["context_recall"]), 6).alias("score"))


_HIST = W + """c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT c.id, round(list_cosine_similarity(c.e, h.embedding::DOUBLE[]), 6) AS sim FROM c JOIN embeddings h ON h.vec_id < c.id) """


def _candidates(read):
    return read("embeddings").where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")


@query("jn_history_sim", _HIST + "SELECT id, max(sim) AS max_similarity FROM s GROUP BY id")
def _(read):
    """Candidates are the vectors of ids divisible by 20, their history all earlier vectors."""
    near = retrieval.nearest_before(read("embeddings"), _candidates(read), item_id="vec_id")
    return near.withColumnRenamed("query_id", "id")


@query("jn_semi_redundant", _HIST + "SELECT DISTINCT id FROM s WHERE sim > 0.4")
def _(read):
    near = retrieval.nearest_before(read("embeddings"), _candidates(read), item_id="vec_id")
    return near.where("max_similarity > 0.4").select(F.col("query_id").alias("id"))


_ADJ = W + VECTORS + """, a AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM sims WHERE similarity > 0.4 AND similarity < 0.8)
 SELECT query_id, id{} FROM a WHERE n = 1"""


def _adjacent(read):
    return retrieval.first_between(vectors(read), vector_queries(read), 0.4, 0.8)


@query("jn_adjacent", _ADJ.format(""))
def _(read):
    return _adjacent(read)


@query("neg_adjacent", W + VECTORS + """, a AS (SELECT query_id, min(id) AS id FROM sims WHERE similarity > 0.4 AND similarity < 0.8 GROUP BY 1)
 SELECT query_id, id, split_part(text, '.', 1) AS fact FROM a JOIN vectors USING (id)""")
def _(read):
    return _adjacent(read).join(vectors(read), "id").select("query_id", "id", F.substring_index("text", ".", 1).alias("fact"))


@query("jn_section_pages", W + TOC + "," + PAGES + """, k AS (SELECT *, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY ord) - 1, page + 5) AS e FROM toc WHERE level = 1)
 SELECT k.doc, k.ord, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM k JOIN pages_ p ON p.doc = k.doc AND page_number BETWEEN page AND e GROUP BY ALL""")
def _(read):
    e = F.coalesce(F.lead("page").over(Window.partitionBy("doc").orderBy("ord")) - 1, F.col("page") + 5)
    s = toc(read).where("level = 1").select("doc", F.col("ord").alias("id"), F.col("page").alias("start_page"), e.alias("end_page"))
    return structure.section_text(s, pages(read)).withColumnRenamed("id", "ord")


_CITES = """c AS (SELECT item_id, item_id AS doc, 1 + item_id % 5 AS page_number, text AS quote FROM benchmark
  UNION ALL SELECT 1000000 + doc * 1000 + page_number, doc, page_number, text FROM pages_
  UNION ALL SELECT -1 - doc, doc, 1, substr(text, 1, 19) || '#' || substr(text, 21, 20) FROM pages_ WHERE page_number = 1 AND doc % 10 = 0)"""


def citations(read):
    """Quotes of benchmark items on some page, of every page whole on itself, and of a tenth of first pages with a sign changed."""
    b = read("benchmark").select("item_id", F.col("item_id").alias("doc"), (1 + F.col("item_id") % 5).cast("int").alias("page_number"), F.col("text").alias("quote"))
    p = pages(read)
    whole = p.select((1000000 + F.col("doc") * 1000 + F.col("page_number")).alias("item_id"), "doc", "page_number", F.col("text").alias("quote"))
    changed = F.concat(F.substring("text", 1, 19), F.lit("#"), F.substring("text", 21, 20))
    near = p.where("page_number = 1 AND doc % 10 = 0").select((-1 - F.col("doc")).alias("item_id"), "doc", "page_number", changed.alias("quote"))
    return b.unionByName(whole).unionByName(near)


@query("jn_citation_page", W + PAGES + ", " + _CITES + " SELECT item_id, p.text IS NOT NULL AND length(p.text) > 0 AS has_page, coalesce(contains(lower(p.text), lower(quote)), FALSE) AS exact FROM c LEFT JOIN pages_ p USING (doc, page_number)")
def _(read):
    j = citations(read).join(pages(read), ["doc", "page_number"], "left")
    return j.select("item_id", (F.col("text").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)).alias("has_page"), F.coalesce(F.contains(F.lower("text"), F.lower("quote")), F.lit(False)).alias("exact"))


@query("sc_citation")
def _(read):
    return judging.verify_citations(citations(read), pages(read)).select("item_id", "exists", "similarity_score", "verdict")


@query("fn_seq_ratio")
def _(read):
    from qaloom.functions.udfs import sequence_ratio

    p = read("part").select(F.col("p_partkey").alias("id"), sequence_ratio(F.concat("p_name", F.lit(" of "), "p_type"), F.col("p_type")).alias("r"))
    return p.select("id", "r.ratio", "r.window")


@query("jn_anti_exclude", W + CHUNKS + " SELECT DISTINCT section_id FROM chunks WHERE section_id NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def _(read):
    covered = read("labels").select(F.col("doc_id").cast("string").alias("section_id")).distinct()
    return chunks(read).select("section_id").distinct().join(covered, "section_id", "left_anti")


_SEQ = """s AS (SELECT o_orderkey AS sequence_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey AS question
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sequences(read):
    """Question sequences: the parts of an order; each depends on the one before."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return read("lineitem").select(F.col("l_orderkey").alias("sequence_id"), F.row_number().over(w).alias("ord"), F.col("l_partkey").alias("question"))


@query("jn_depends_on", W + _SEQ + " SELECT b.sequence_id, b.ord, b.question, a.question AS depends_on FROM s a JOIN s b ON a.sequence_id = b.sequence_id AND b.ord = a.ord + 1")
def _(read):
    s = sequences(read).withColumn("depends_on", F.when(F.col("ord") > 1, F.array(F.col("ord") - 1)))
    e = s.select("sequence_id", "ord", "question", F.explode("depends_on").alias("before"))
    earlier = s.select("sequence_id", F.col("ord").alias("before"), F.col("question").alias("depends_on"))
    return e.join(earlier, ["sequence_id", "before"]).select("sequence_id", "ord", "question", "depends_on")


@query("jn_approach", W + SCORES + " SELECT 'approach' || (id % 3) AS approach, count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy), 6) AS relevancy FROM scores GROUP BY 1")
def _(read):
    return scores(read).groupBy(F.concat(F.lit("approach"), F.col("id") % 3).alias("approach")).agg(
        F.count("*").alias("n"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("answer_relevancy"), 6).alias("relevancy")
    )


_SETS = """k AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey % 20))) AS relevant, list_sort(list_distinct(list(l_suppkey % 20))) AS covered FROM lineitem GROUP BY 1)"""


def concept_sets(read):
    k = lambda c: F.array_sort(F.collect_set(F.col(c) % 20))
    return read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(k("l_partkey").alias("relevant"), k("l_suppkey").alias("covered"))


@query("set_missing", W + _SETS + " SELECT id, unnest(list_filter(relevant, lambda x: NOT list_contains(covered, x))) AS concept FROM k")
def _(read):
    return concept_sets(read).select("id", F.explode(F.array_except("relevant", "covered")).alias("concept"))


@query("set_covered", W + _SETS + " SELECT id, unnest(list_filter(relevant, lambda x: list_contains(covered, x))) AS concept FROM k")
def _(read):
    return concept_sets(read).select("id", F.explode(F.array_intersect("relevant", "covered")).alias("concept"))


_COVER = "round(len(list_filter(relevant, lambda x: list_contains(covered, x))) / len(relevant), 6)"


@query("agg_overlap_concepts", W + _SETS + f" SELECT id, {_COVER} AS coverage FROM k")
def _(read):
    return concept_sets(read).select("id", F.round(judging.coverage(F.col("covered"), F.col("relevant")), 6).alias("coverage"))


@query("sc_completeness", W + _SETS + f" SELECT id, {_COVER} AS score, {_COVER} >= 0.75 AS passed FROM k")
def _(read):
    s = concept_sets(read).select("id", F.round(judging.coverage(F.col("covered"), F.col("relevant")), 6).alias("score"))
    return s.withColumn("passed", F.col("score") >= 0.75)


@query("sc_recall", W + """n AS (SELECT l_orderkey AS id, l_partkey % 20 AS need, max((l_suppkey % 3 = 0)::INT) AS found FROM lineitem GROUP BY 1, 2)
  SELECT id, round(avg(found), 6) AS recall, avg(found) >= 0.75 AS passed FROM n GROUP BY 1""")
def _(read):
    """Context recall: of the concepts an answer needs, those that at least one retrieved context has. Our own rule; the gate is given."""
    needs = read("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 20).alias("need"), (F.col("l_suppkey") % 3 == 0).alias("found"))
    return judging.context_recall(needs).select("id", F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.75).alias("passed"))


@query("set_chunk_merge", W + CHUNKS + ", " + PAGES + " SELECT section_id, 'vector' AS leg, text FROM chunks UNION ALL SELECT doc::VARCHAR, 'keyword', text FROM pages_")
def _(read):
    v = chunks(read).select("section_id", F.lit("vector").alias("leg"), "text")
    k = pages(read).select(F.col("doc").cast("string").alias("section_id"), F.lit("keyword").alias("leg"), "text")
    return v.unionByName(k, allowMissingColumns=True)


@query("smp_limit", W + CHUNKS + " SELECT id FROM chunks ORDER BY id LIMIT 100")
def _(read):
    return chunks(read).select("id").orderBy("id").limit(100)


@query("nm_active", _RANKED + "SELECT query_id, id FROM r WHERE rank = 1")
def _(read):
    return retrieval.top_k(vectors(read), vector_queries(read), 1).select("query_id", "id")


@query("udf_embed")
def _(read):
    from qaloom.functions.udfs import embed

    return questions(read).select("id", F.size(embed(F.col("question"))).alias("dims"))


@query("top_vector_index")
def _(read):
    """The same search by an index of cells; an approximation whose recall the fit measures."""
    from qaloom.operators.index import CellIndex

    index = CellIndex.fit(vectors(read))
    return index.search(vector_queries(read), 5)


@query("udf_llm", W + """x AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z0-9_]+') AS a, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+') AS b FROM part WHERE p_partkey % 2 = 0)
  SELECT id, printf('%.3f', len(list_filter(list_distinct(a), lambda t: list_contains(b, t))) / len(list_distinct(a))) AS answer FROM x
  UNION ALL SELECT p_partkey, 'unknown' FROM part WHERE p_partkey % 2 = 1""")
def _(read):
    """Prompts through the generation surface; the default model is a lexical stand-in that judges support."""
    from qaloom.functions.udfs import generate

    ask = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" Context: "), "p_name", F.lit(" "), "p_type")).otherwise(F.col("p_name"))
    return read("part").select(F.col("p_partkey").alias("id"), generate(ask).alias("answer"))


@query("udf_cross")
def _(read):
    from qaloom.functions.udfs import pair_score

    return questions(read).select("id", pair_score(F.col("question"), F.col("chapter")).alias("score"))
