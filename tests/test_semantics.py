"""Hand-worked cases of the reference semantics."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.config import Config
from qaloom.functions import text as T
from qaloom.functions.udfs import best_window_ratio
from qaloom.operators import chunking, filters, judging, structure, tasks
from qaloom.operators.diversity import topic_memory
from qaloom.sources.store import Checkpoints, Collection, read_golden, write_golden
from qaloom.sources.tools import Library


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (449, 1), (450, 1), (451, 2), (499, 2), (500, 2), (501, 2), (950, 3), (951, 3)])
def test_fixed_chunk_counts(spark, n, chunks):
    df = spark.createDataFrame([("x" * n,)], "text string")
    assert chunking.fixed_chunks(df).count() == chunks
    assert len(list(chunking.separator_windows("x" * n, 500, 50, "\n\n"))) == chunks


def test_chunk_parameters_that_never_end_are_refused(spark):
    for size, overlap, separator in ((100, 100, None), (100, 85, "\n\n")):
        with pytest.raises(ValueError):
            chunking.check_sizes(size, overlap, separator)


def test_separator_windows_end_at_the_separator():
    parts = list(chunking.separator_windows("a" * 90 + "\n" + "b" * 60, 100, 10, "\n"))
    assert parts[0] == "a" * 90 and parts[1] == "a" * 9 + "\n" + "b" * 60


def slow_windows(text, size, overlap, separator):
    """By definition: a window ends behind the last separator that lies wholly in its last fifth."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        inside = [i for i in range(max(0, end - int(0.2 * size)), end - len(separator) + 1) if text.startswith(separator, i)] if end < len(text) else []
        end = inside[-1] + len(separator) if inside else end
        out += [text[at:end].strip()] if text[at:end].strip() else []
        at = end - overlap
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 20), st.sampled_from(["\n", "\n\n", "ab"]))
def test_separator_windows_of_any_size(text, size, overlap, separator):
    try:
        chunking.check_sizes(size, overlap, separator)
    except ValueError:
        return
    assert chunking.separator_windows(text, size, overlap, separator) == slow_windows(text, size, overlap, separator)


def test_fixed_chunks_of_any_text(spark):
    texts = ["é😀" * 700, "x" * 900 + "\n" * 60, "", "a\n" * 500, None]
    for size, overlap in ((500, 50), (99, 20), (10, 9), (7, 0)):
        got = chunking.fixed_chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), chunk_size=size, overlap=overlap)
        step, want = size - overlap, []
        for i, t in enumerate(texts):
            parts = [p for k in range(-(-len(t or "") // step)) if (p := (t or "")[k * step : k * step + size].strip())]
            want += [(i, k, p) for k, p in enumerate(parts)]
        assert sorted((r["id"], r["chunk_index"], r["chunk"]) for r in got.collect()) == want


def test_semantic_packing_by_room():
    e = lambda kind, n: (kind, "x" * n)
    elements = [e("paragraph", 500), e("paragraph", 300), e("example", 1), e("equation", 900), e("paragraph", 1), e("theorem", 5), e("equation", 5), e("paragraph", 5), e("equation", 5)]
    assert chunking.chunk_numbers(elements, 800) == [0, 0, 1, 1, 2, 3, 4, 5, 5]
    assert chunking.chunk_numbers([]) == [] and chunking.pack_elements([]) == []


QUESTIONS = [
    ("What is entropy?", "factoid", "remember"),
    ("Define momentum.", "definition", "remember"),
    ("What is the definition of energy?", "factoid", "remember"),
    ("How does photosynthesis work?", "process", "understand"),
    ("Compare speed and velocity.", "comparison", "analyze"),
    ("What is the difference between mass and weight?", "factoid", "remember"),
    ("When would you use Newton's third law?", "factoid", "apply"),
    ("Why does ice float?", "reasoning", "analyze"),
    ("Calculate the force on a 5kg object.", "calculation", "apply"),
]


def test_question_classes(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUESTIONS], "q string")
    got = df.select("q", judging.question_type(F.col("q")), judging.bloom_level(F.col("q"))).collect()
    assert [tuple(r) for r in got] == QUESTIONS


def test_equations_and_definitions(spark):
    assert one(spark, T.equations(F.col("t")), t="Newton's Second Law: F = ma relates force, mass. x = 3.14") == ["F = ma relates force", "x = 3"]
    assert one(spark, T.definitions(F.col("t")), t="Energy is defined as work done. Definition: a b c.") == ["Energy is defined as work done.", "Definition: a b c."]


def test_keyword_hits_overlap(spark):
    hits = one(spark, T.keyword_hits(F.col("t"), F.lit("AA"), 2), t="xaaay")
    assert [(h["position"], h["before"], h["after"]) for h in hits] == [(1, "x", "ay"), (2, "xa", "y")]
    assert one(spark, T.keyword_hits(F.col("t"), F.lit("longer than it")), t="x") == []


def test_citations(spark):
    pages = spark.createDataFrame([(1, 1, "Energy is conserved in closed systems."), (1, 2, "")], "doc long, page_number int, text string")
    cases = [
        (1, 1, "ENERGY is conserved", True, 1.0, "ACCURATE"), (1, 2, "x", False, 0.0, "NOT_FOUND"), (1, 9, "x", False, 0.0, "NOT_FOUND"),
        (1, 1, "y" * 99, False, 0.0, "NOT_FOUND"), (1, 1, "", True, 1.0, "ACCURATE"), (1, 1, "energy is conserwed", True, None, "ACCURATE"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "doc long, page_number int, quote string")
    got = {(r["page_number"], r["quote"]): r for r in judging.verify_citations(df, pages).collect()}
    for _, page, quote, exists, score, verdict in cases:
        r = got[page, quote]
        assert (r["exists"], r["verdict"]) == (exists, verdict) and (score is None or r["similarity_score"] == score)


def test_window_ratio_is_difflib_with_autojunk():
    page = "the quick brown fox jumps over the lazy dog " * 8
    quote = page[30:260].replace("fox", "fax")
    low = page.lower()
    want = max(difflib.SequenceMatcher(None, quote, low[i : i + len(quote)]).ratio() for i in range(len(low) - len(quote) + 1))
    assert best_window_ratio(page, quote)[0] == want


def test_window_ratio_offsets_are_those_of_the_page(spark):
    page = "İİİ Energy is conserved."
    assert best_window_ratio(page, "energy is conserved") == (1.0, "Energy is conserved")
    assert best_window_ratio("ab", "abc") == (0.0, "") and best_window_ratio("ab", "") == (1.0, "")
    pages = spark.createDataFrame([(1, 1, page), (1, 2, "")], "doc long, page_number int, text string")
    df = spark.createDataFrame([(1, 1, "energy is conserved"), (1, 2, "")], "doc long, page_number int, quote string")
    got = {r["page_number"]: (r["actual_text"], r["verdict"]) for r in judging.verify_citations(df, pages).collect()}
    assert got == {1: ("Energy is conserved", "ACCURATE"), 2: ("", "NOT_FOUND")}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcİΣ é", min_size=1, max_size=40), st.text(alphabet="abcİΣ é", min_size=1, max_size=12))
def test_window_ratio_is_that_of_all_windows(page, quote):
    best, found = 0.0, ""
    for i in range(len(page) - len(quote) + 1):
        ratio = difflib.SequenceMatcher(None, quote.lower(), page[i : i + len(quote)].lower()).ratio()
        if ratio > best:
            best, found = ratio, page[i : i + len(quote)]
    assert best_window_ratio(page, quote) == (best, found)


def test_index_finds_the_nearest(spark):
    from qaloom.operators import retrieval
    from qaloom.operators.index import CellIndex

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = CellIndex.fit(e, part_rows=30)  # many parts a cell
    exact = {(r["query_id"], r["id"]) for r in retrieval.top_k(e, q, 5).collect()}
    found = index.search(q, 5).collect()
    hits = {(r["query_id"], r["id"]) for r in found}
    assert len(found) == len(exact) and len(hits & exact) / len(exact) >= 0.9 and index.recall >= 0.95
    whole = {(r["query_id"], r["id"], r["rank"]) for r in index.search(q, 5, probes=10**6).collect()}
    assert whole == {(r["query_id"], r["id"], r["rank"]) for r in retrieval.top_k(e, q, 5).collect()}
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<float>")
    assert CellIndex.fit(few).search(few.withColumnRenamed("id", "query_id"), 3).count() == 1
    assert CellIndex.fit(few.limit(0)).search(few.withColumnRenamed("id", "query_id"), 3).count() == 0


def test_scores(spark):
    assert abs(one(spark, judging.ragas(F.lit(1.0), F.lit(0.86), F.lit(0.82))) - 0.922) < 1e-9
    assert round(one(spark, judging.composite(F.lit(0.91), F.lit(0.87), F.lit(0.71))), 2) == 0.84
    assert one(spark, judging.citation_coverage(F.lit(3), F.lit(0))) == 1.0
    assert one(spark, judging.coverage(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0


@pytest.mark.parametrize("a,b", [("Heat causes expansion", "expansion causes Heat"), ("If A, then B", "If B, then A"), ("X increases Y", "X decreases Y"), ("X is Y", "X is Y")])
def test_invert(spark, a, b):
    assert one(spark, judging.invert(F.col("t")), t=a) == b


def test_toc(spark):
    rows = [(0, 1, 2, "Early", 1), (0, 2, 1, "Classical Mechanics", 1), (0, 3, 2, "Newton's Laws", 1), (0, 4, 3, "Deep", 2), (0, 5, 2, "Energy", 13), (0, 6, 1, "Next", 25)]
    toc = spark.createDataFrame(rows, "doc int, ord int, level int, title string, page int")
    got = structure.number_toc(toc, spark.createDataFrame([(0, 45)], "doc int, pages int"))
    assert {(r["id"], r["start_page"], r["end_page"]) for r in got.collect()} == {("ch1", 1, 24), ("1.1", 1, 12), ("1.2", 13, 24), ("ch2", 25, 45)}


def test_contents_fall_back(spark):
    toc = spark.createDataFrame([(1, 1, 1, "One", 1)], "doc int, ord int, level int, title string, page int")
    pages = spark.createDataFrame([(1, 1, "Chapter 9: no"), (2, 1, "x\nChapter 3: Three \n"), (2, 2, "chapter 4. Four"), (2, 21, "\nChapter 5: late"), (3, 1, "no headings")], "doc int, page_number int, text string")
    last = spark.createDataFrame([(1, 7), (2, 30), (3, 5), (4, 1)], "doc int, pages int")
    got = sorted(tuple(r) for r in structure.contents(toc, pages, last).collect())
    assert got == [(1, "ch1", 1, "One", 1, 7), (2, "ch3", 1, "Three", 1, 30), (2, "ch4", 1, "Four", 1, 30),
                   (3, "1.1", 2, "Content", 1, 5), (3, "ch1", 1, "Full Document", 1, 5), (4, "1.1", 2, "Content", 1, 1), (4, "ch1", 1, "Full Document", 1, 1)]


def test_files_as_pages(spark, tmp_path):
    from qaloom.sources.files import page_size, read_pages

    (tmp_path / "a.txt").write_bytes("one\ftwo é".encode())
    (tmp_path / "b.bin").write_bytes(b"")
    got = sorted((r["path"][-5:], r["page_number"], r["text"]) for r in read_pages(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two é")]
    sized = read_pages(spark, str(tmp_path), lambda c: [(c.decode(), 210.0, 297.0)], "*.txt")
    assert [tuple(r)[1:] for r in page_size(sized, 1).collect()] == [(210.0, 297.0)] and page_size(sized, 2).count() == 0
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path / "none")).collect()


def test_semantic_elements():
    text = "Intro.\n\nTheorem 1: all is well.\nProof: obvious.\n\nBody text\nF = ma\n\nEnd."
    kinds = [k for k, _ in chunking.parse_elements(text)]
    assert kinds[:3] == ["paragraph", "theorem", "proof"] and "equation" in kinds
    chunks = chunking.pack_elements(chunking.parse_elements(text))
    assert [("theorem", "Theorem 1: all is well.")] in chunks


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, None)], "page_number int, chapter string")
    ids = lambda spec: [r[0] for r in df.where(filters.where(spec)).collect()]
    assert ids({"$or": [{"page_number": 1}, {"page_number": {"$gt": 5}}]}) == [1, 9]
    assert ids({"page_number": {"$in": [1, 5], "$ne": 5}}) == [1] and ids({}) == [1, 5, 9]
    with pytest.raises(Exception, match="missing metadata"):
        filters.require(df, ["chapter"]).collect()


def test_template_with_an_empty_slot_raises(spark):
    with pytest.raises(Exception, match="Missing required parameter"):
        one(spark, T.fill(F.lit("What is {concept}?"), {"domain": F.lit("x")}))


def test_topic_memory_ignores_rejected(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.436]), (1, 3, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "g int, o int, v array<double>")
    got = {r["o"]: r["accepted"] for r in topic_memory(df, "g", "o", "v", 0.85).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_config():
    c = Config.from_env({"CHUNK_SIZE": "100", "HYDE": "false", "QALOOM_SYNONYMS": "false", "chunk_overlap": "7"})
    assert (c.chunk_size, c.hyde, c.synonyms, c.chunk_overlap) == (100, True, False, 50) and c.validate()
    c = Config.from_yaml("quality_gates: {composite_score: 0.7}\nchunk_size: 300\nother: [1, 2]\n")
    assert (c.composite_gate, c.chunk_size) == (0.7, 300) and Config.from_yaml("") == Config()
    assert not Config(diversity_threshold=1.5).validate() and not Config(chunk_overlap=500).validate()


def test_collection_golden_and_checkpoints(spark, tmp_path):
    store = Collection(spark, "chunks_under_test")
    store.add(spark.createDataFrame([("x", "ch1", "1.1", 5, 0), ("y", "ch1", "1.1", 6, 1)], "text string, chapter string, section_id string, page_number int, chunk_index int"))
    assert {r["id"] for r in store.rows().collect()} == {"chunk_ch1_sec1.1_page5_idx0", "chunk_ch1_sec1.1_page6_idx1"}
    r = store.stats().first()
    assert (r["total_chunks"], r["unique_chapters"], r["page_min"], r["page_max"]) == (2, 1, 5, 6)
    assert store.stats(sample=1).first()["total_chunks"] == 2
    store.drop()
    golden = spark.createDataFrame([("q1",)], "id string")
    from qaloom.schemas import GOLDEN

    full = golden.select(*(F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in GOLDEN.fields))
    write_golden(full, f"{tmp_path}/g")
    assert read_golden(spark, f"{tmp_path}/g").first()["id"] == "q1"
    (tmp_path / "bad.json").write_text('{"id": ')
    with pytest.raises(Exception):
        read_golden(spark, str(tmp_path / "bad.json")).collect()
    log = Checkpoints(spark, f"{tmp_path}/log")
    log.save(spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "c")], "thread_id string, checkpoint_id long, state string"))
    assert {(r["thread_id"], r["state"]) for r in log.latest().collect()} == {("t", "b"), ("u", "c")}


def test_tools(spark):
    pages = spark.createDataFrame([(1, 1, "Energy is defined as work."), (1, 2, "F = ma here.")], "doc long, page_number int, text string")
    sections = spark.createDataFrame([(1, "1.1", 2, "Energy", 1, 2)], "doc long, id string, level int, title string, start_page int, end_page int")
    lib = Library(pages, sections)
    r = lib.call("read_section_content", section_id="1.1").first()
    assert r["key_definitions"] == ["Energy is defined as work."] and r["word_count"] == 9
    assert lib.call("read_section_content", section_id="9").first()["error"]
    assert lib.call("keyword_search", keyword="ENERGY").count() == 1
    assert lib.call("verify_citation", page_number=2, quote="F = ma").first()["exists"]
    for bad in (lambda: lib.call("nope"), lambda: lib.call("keyword_search"), lambda: lib.call("keyword_search", keyword=3)):
        with pytest.raises(ValueError):
            bad()


def test_task_events(spark):
    rows = [(1, 1, "submitted"), (1, 2, "completed"), (1, 3, "working"), (2, 1, "working")]
    got = {r["task_id"]: (r["state"], r["n_events"]) for r in tasks.reduce_events(spark.createDataFrame(rows, "task_id long, seq long, state string")).collect()}
    assert got == {1: ("completed", 2), 2: ("working", 1)}
    parts = [(1, 0, 1, "a", False, True), (1, 0, 2, "b", True, True), (1, 0, 3, "c", False, False), (1, 0, 4, "d", True, False), (1, 1, 1, "z", True, True)]
    made = tasks.artifacts(spark.createDataFrame(parts, "task_id long, artifact_id long, seq long, text string, append boolean, last_chunk boolean"))
    assert {r["artifact_id"]: (r["text"], r["complete"]) for r in made.collect()} == {0: ("cd", False), 1: ("z", True)}


def test_resubscription_starts_with_the_task(spark):
    rows = [(1, 1, "submitted"), (1, 2, "working"), (1, 3, "completed"), (1, 4, "working"), (2, 1, "completed"), (2, 2, "working"), (3, 9, "working")]
    events = spark.createDataFrame(rows, "task_id long, seq long, state string")
    since = spark.createDataFrame([(1, 2), (2, 1), (3, 5)], "task_id long, seq long")
    got = sorted(tuple(r) for r in tasks.resubscribe(events, since).collect())
    assert got == [(1, 2, "task", "working"), (1, 3, "status", "completed")]


def test_messages_count_once(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 3, "x"), (None, 3, "x")], "message_id string, seq long, text string")
    assert sorted((r["seq"], r["text"]) for r in tasks.unique_messages(df).collect()) == [(1, "first"), (3, "x"), (3, "x")]


def test_paging_covers_all_tasks(spark):
    t = spark.createDataFrame([(i, i % 7) for i in range(120)], "id long, updated long")
    seen, after = [], None
    while page := tasks.list_page(t, after=after, size=50).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["updated"], page[-1]["id"])
    assert sorted(seen) == list(range(120))
    with pytest.raises(ValueError):
        tasks.list_page(t, size=101)
