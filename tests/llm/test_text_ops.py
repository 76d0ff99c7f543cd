"""Line dedup, decontamination, quality rules and language ID against brute force."""

import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from qaloom.llm import decontam, langid, line_dedup, quality_rules

from .helpers import LONG, edge_docs, empty_docs, same

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\f\r"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_line_dedup_matches_sql(spark):
    assert same(line_dedup.op3_line_dedup(spark, SF), line_dedup.OP3_SQL, documents=table(spark, "documents")) == 200


def test_line_dedup_edges(spark):
    out = {(r["doc_id"], r["text"]): r for r in line_dedup.dedup_lines(edge_docs(spark)).collect()}
    fox = "The quick brown fox jumps over the lazy dog near the river bank today"
    assert (1, fox) in out and (None, fox) in out, "the first holder and a row without id keep the line"
    assert out[6, ""]["n_dropped"] == 1
    assert out[2, ""]["n_lines"] == out[3, ""]["n_lines"] == 1
    assert out[8, "other\nother"]["n_dropped"] == 1 and out[8, "other\nother"]["n_lines"] == 3
    assert (5, LONG) in out
    assert line_dedup.dedup_lines(edge_docs(spark)).count() == 12
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_line_dedup_counts_documents_not_lines(spark):
    docs = spark.createDataFrame([(1, "one long line here\none long line here"), (2, "x"), (3, "ONE long line here ")], "doc_id long, text string")
    three = line_dedup.dedup_lines(docs, min_docs=3)
    assert {r["n_dropped"] for r in three.collect()} == {0}
    two = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert two == {1: 0, 2: 0, 3: 1}


def test_line_dedup_of_frequent_lines(spark):
    """Keys dealt to several tasks or not: every key is a frequent one with many hot_keys, hardly any with few."""
    rows = [(i, "\n".join(["A line that all of them share", f"line number {i % 7} of a few", f"line {i} alone", "short"] * (1 + i % 2))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pick = lambda df: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())
    plain, dealt, few = (pick(line_dedup.dedup_lines(docs, hot_keys=n)) for n in (1000, 999, 2))
    assert plain == dealt == few and sum(r[2] for r in plain) > 400
    query = docs.selectExpr("doc_id", "text")
    out = line_dedup.dedup_lines(query, hot_keys=999).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS kept_sha256")
    assert same(out, line_dedup.OP3_SQL, documents=docs) == 200


def test_line_dedup_is_native(spark):
    plan = line_dedup.op3_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_matches_sql(spark):
    n = same(decontam.op2_decontamination(spark, SF), decontam.OP2_SQL, documents=table(spark, "documents"), benchmark=table(spark, "benchmark"))
    assert n == 200


def test_decontamination_edges_and_spans(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "!!"), (None, "river"), (4, "QUICK Brown-fox"), (5, "ipsum dolor")], "item_id long, text string")
    out = {(r["doc_id"]): r for r in decontam.decontaminate(edge_docs(spark), items).collect()}
    r = out[1]
    assert (r["n_words"], r["n_hit"], list(r["items"])) == (14, 3, [1, 4])
    text = "The quick brown fox jumps over the lazy dog near the river bank today"
    assert {text[s["start"] : s["end"]] for s in r["spans"]} == {"quick brown fox"}
    assert out[2]["n_words"] == out[3]["n_words"] == 0 and out[9]["n_words"] == 2
    assert out[5]["n_hit"] == 8000 and list(out[5]["items"]) == [5]
    assert decontam.decontaminate(empty_docs(spark), items).count() == 0
    none = decontam.decontaminate(edge_docs(spark), items.limit(0))
    assert none.count() == 12 and none.where("n_hit > 0").count() == 0


def test_decontamination_in_blocks_is_the_same(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    one = decontam.decontaminate(docs, items)
    many = decontam.decontaminate(docs, items, max_block_mb=0.002)
    pick = lambda df: {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["items"]), sorted((s["start"], s["end"], s["item_id"]) for s in r["spans"])) for r in df.collect()}
    assert pick(one) == pick(many)


def brute_windows(items, text, size):
    """(n_words, hit word positions, (first, number, item) of all occurrences), by comparing every window with every place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, found = words(text), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found |= {(p, n, item) for p in range(len(own) - n + 1) if own[p : p + n] == w[i : i + n]}
    return len(own), {q for p, n, _ in found for q in range(p, p + n)}, found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB é", max_size=24), max_size=4), st.text(alphabet="ab É.", max_size=50), st.integers(1, 6))
def test_windows_match_brute_force(items, text, size):
    items = list(enumerate(items)) + [(0, "a b a b a b")]
    n, hit, found = brute_windows(items, text, size)
    got = decontam.scan(decontam.Windows(items, size), text)
    assert (got[0], got[1]) == (n, len(hit)) and {(w, k, i) for _, _, i, w, k in got[2]} == found
    for a, b, _, w, k in got[2]:
        assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[a:b].lower()) == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())[w : w + k]


def test_offsets_of_long_texts(monkeypatch):
    text = "é日 " * 500 + "quick brown fox! " + "x " * 700 + "Quick brown FOX"
    want = decontam.scan(decontam.Windows([(1, "quick brown fox")], 10), text)
    monkeypatch.setattr(decontam, "STRIDE", 64)
    assert decontam.scan(decontam.Windows([(1, "quick brown fox")], 10), text) == want
    assert [text[a:b] for a, b, *_ in want[2]] == ["quick brown fox", "Quick brown FOX"]


def test_automaton_is_as_large_as_the_items():
    """Nodes follow the words of the items, not their ten-fold overlapping windows."""
    import random

    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(200))) for i in range(500)]
    nodes = decontam.Windows(items, 10).automaton.get_stats()["nodes_count"]
    assert nodes <= 100_000 + 1


def brute_ratio(docs, trusted, buckets):
    """The log ratios by counting every n-gram of every text in Python."""
    raw, target = [0] * buckets, [0] * buckets
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    for d, text in docs:
        h = [xxhash.xxh64(w.encode(), 42).intdigest() for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        pairs = [xxhash.xxh64(b.to_bytes(8, "little"), xxhash.xxh64(a.to_bytes(8, "little"), 42).intdigest()).intdigest() for a, b in zip(h, h[1:])]
        for g in h + pairs:
            raw[signed(g) % buckets] += 1
            target[signed(g) % buckets] += d in trusted
    nr, nt = sum(raw) + 0.5 * buckets, sum(target) + 0.5 * buckets
    return [round(1e6 * math.log((t + 0.5) / nt / ((r + 0.5) / nr))) for r, t in zip(raw, target)]


def test_quality_fit_and_query_match_brute_force(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    trusted = {r["doc_id"] for r in quality_rules.trusted_ids(labels).collect()}
    ratio = quality_rules.fit_ratio(docs, quality_rules.trusted_ids(labels))
    want = brute_ratio(rows, trusted, len(ratio))
    assert max(abs(a - b) for a, b in zip(ratio, want)) <= 1
    out = quality_rules.op10_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(tuple(r) for r in out.collect()) == sorted((d, *brute_quality(t, ratio)[:7]) for d, t in rows)


def test_quality_score_at_the_threshold_is_kept(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    ratio = [-60_000] * 8192
    keep = lambda t: quality_rules.quality_rules(docs, ratio, threshold=t).first()["kept"]
    assert keep(-0.06) and not keep(-0.0599)


def brute_quality(text, ratio):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(tri)
    hit = set()
    for i, t in enumerate(tri):
        if c[t] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    h = [xxhash.xxh64(w.encode(), 42).intdigest() for w in words]

    def chain(a, b):
        one = xxhash.xxh64(a.to_bytes(8, "little"), 42).intdigest()
        return xxhash.xxh64(b.to_bytes(8, "little"), one).intdigest()

    grams = [signed(x) % len(ratio) for x in h] + [signed(chain(a, b)) % len(ratio) for a, b in zip(h, h[1:])]
    score = sum(ratio[g] for g in grams) / len(grams) / 1e6 if grams else None
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit),
        failed, not failed and score is not None and score >= -0.06, None if score is None else round(score, 9),
    )


@pytest.mark.parametrize("docs", ["table", "edges"])
def test_quality_rules_match_brute_force(spark, docs):
    docs = table(spark, "documents") if docs == "table" else edge_docs(spark)
    ratio = quality_rules.fit_ratio(docs, quality_rules.trusted_ids(table(spark, "labels")))
    out = quality_rules.quality_rules(docs, ratio).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((d, *brute_quality(t, ratio)) for d, t in texts), key=str)
    got = sorted(((*tuple(r)[:8], None if r["score"] is None else round(r["score"], 9)) for r in out.collect()), key=str)
    assert got == want


def test_quality_ratio_counts_every_document(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    trusted = {r["doc_id"] for r in quality_rules.trusted_ids(labels).collect()}
    assert trusted and trusted == {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    plain = quality_rules.fit_ratio(docs, quality_rules.trusted_ids(labels))
    assert any(plain) and quality_rules.fit_ratio(empty_docs(spark), quality_rules.trusted_ids(labels)) == [0] * 8192
    assert quality_rules.quality_rules(empty_docs(spark), plain).count() == 0
    plan = quality_rules.quality_rules(docs, plain)._jdf.queryExecution().toString()
    assert not re.search("PythonUDF|Pandas|ArrowEval", plan)


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out) and not any(r["rejected"] for r in out)


def test_language_id_matches_brute_force(spark):
    """Counts by a loop over n-grams, cosines by sums over dictionaries, for the registered query."""
    docs = table(spark, "documents")
    model = langid.train(docs)
    mask = 2**32 - 1

    def grams(text):
        raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(langid._PLAIN).split()) + b" "
        n = Counter()
        for size in langid.SIZES:
            for i in range(len(raw) - size + 1):
                code = size
                for byte in raw[i : i + size]:
                    code = (code * 0x01000193 & mask) ^ byte
                code = (code ^ (code >> 15)) * 0x2C1B3C6D & mask
                n[code >> 20] += 1
        return n

    found = {r["doc_id"]: r for r in langid.op4_language_id(spark, SF).collect()}
    for r in docs.limit(40).collect():
        got = found[r["doc_id"]]
        if not r["text"] or not langid.LETTER.search(r["text"]):
            assert got["lang_pred"] == "und" and got["rejected"]
            continue
        v = {g: math.log1p(k) * float(model.idf[g]) for g, k in grams(r["text"]).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got["lang_pred"] == model.langs[best] and abs(got["score"] - cosines[best]) < 1e-4
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "der schnelle Fuchs " * 50 + "x" * 300
    whole = langid.counts([text, "ab"])
    assert list(langid.pieces(text)) == [text]
    monkeypatch.setattr(langid, "PIECE", 100)
    assert "".join(langid.pieces(text)) == text and max(map(len, langid.pieces(text))) <= 100
    split = langid.counts([text, "ab"])
    assert (split[1] == whole[1]).all() and abs(split[0].sum() / whole[0].sum() - 1) < 0.1 and split.dtype == whole.dtype


def test_other_scripts_are_rejected(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    docs = spark.createDataFrame([(1, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι"), (2, "Все люди рождаются свободными"), (3, "すべての人間は、生まれながらにして自由"), (4, "כל בני האדם נולדו")], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(docs, model).collect())


def test_language_id_edges(spark):
    model = langid.fit(["der die das und ist nicht ein Haus"] * 3 + ["the and of house is not a"] * 3, ["de"] * 3 + ["en"] * 3)
    out = {}
    for r in langid.identify(edge_docs(spark), model).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert all(out[k][0]["lang_pred"] == "und" and out[k][0]["rejected"] and out[k][0]["score"] == 0 for k in (2, 3, 4, 9))
    assert out[1][0]["lang_pred"] == "en" and len(out[6]) == 2 and None in out
    assert langid.identify(empty_docs(spark), model).count() == 0
    none = langid.train(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.identify(edge_docs(spark), none).collect()} == {"und"}


def test_language_id_learns_only_from_the_rest(spark):
    docs = table(spark, "documents")
    ids = {r["id"] for r in langid.training_rows(docs, "doc_id", "text", "lang", 300, 64).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    few = langid.training_rows(docs, "doc_id", "text", "lang", 5, 64).groupBy("lang").count().collect()
    assert all(r["count"] <= 5 for r in few)


def test_long_texts_of_an_unlearned_language_are_rejected(spark):
    from qaloom.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    finnish = (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa "
        "esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen tai kieleen perustuvaa erotusta. "
    )
    polish = (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
        "i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej "
        "deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań. "
    )
    assert model.judge([finnish, polish, finnish * 5])[2].all()
    texts = [r["text"] for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").collect() if langid.LETTER.search(r["text"])]
    assert model.judge(texts)[2].mean() < 0.01
    words = [t.split()[0] for t in texts[:500] if langid.LETTER.search(t.split()[0])]
    assert model.judge(words)[2].mean() < 0.02


def test_every_language_is_learned(spark):
    from qaloom.llm import langid

    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, f"{alphabet[k] * 3}{alphabet[i]} {alphabet[k] * 2}{alphabet[-k]}", f"l{k:02}") for k in range(10) for i in range(26 if k else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.train(docs, per_lang=20, max_langs=4).langs) == {f"l{k:02}" for k in range(10)}
    found = langid.training_rows(docs, "doc_id", "text", "lang", 20, 4).groupBy("lang").count().collect()
    assert len(found) == 10 and all(r["count"] == 8 for r in found)
