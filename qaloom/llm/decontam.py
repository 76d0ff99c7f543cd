"""Benchmark decontamination by one Aho-Corasick automaton.

The automaton's symbols are words. Its patterns are the aligned blocks of half a window
of every normalised benchmark item, of which each window holds one, so it is as large as the items and
not as their overlapping windows. Each text is normalised and scanned once; around
hits the whole windows are confirmed and mapped back to offsets of the original.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import Workspace, small_batches, stretches, table

#: Bytes to bytes: A-Z become a-z; ASCII that is no letter or digit becomes a space; the rest stays.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_FIELDS = ("start", "end", "item_id", "word", "words")
SPANS = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS]))
_ARROW_SPANS = pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))
#: Bytes of a text that are mapped to code points at once.
STRIDE = 1 << 20


def _mixed(n: int) -> np.ndarray:
    """A fixed random number for each word id."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """The windows of benchmark items: ``size`` consecutive words, or all words of a shorter item."""

    def __init__(self, items: Sequence[tuple[int, str | None]], size: int):
        self.size, half = size, (size + 1) // 2
        self.words: dict[bytes, int] = {}
        streams, self.items, short = [], [], {}
        for item, text in items:
            known = self.words
            ids = [known.setdefault(w, len(known) + 1) for w in (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()]
            if len(ids) >= size:
                streams.append(np.array(ids, np.int32))
                self.items.append(item)
            elif ids:
                short.setdefault(tuple(ids), []).append(item)
        self.ends = np.cumsum([len(s) for s in streams], dtype=np.int64)
        self.stream = np.concatenate(streams) if streams else np.zeros(0, np.int32)
        self.code = _mixed(len(self.words) + 1)
        self.place = np.cumprod(np.full(size, 0xD1342543DE82EF95, np.uint64))
        starts = [np.arange(a, b - size + 1) for a, b in zip(self.ends - [len(s) for s in streams], self.ends, strict=True)]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        keys = self.keys_of(self.stream, self.starts)
        order = np.argsort(keys, kind="stable")
        self.starts, self.keys = self.starts[order], keys[order]
        # A pattern leads to (its words, the items that are it as a whole, whether it is a block).
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for s in streams:
            for at in range(0, len(s) - half + 1, half):
                self.automaton.add_word(tuple(s[at : at + half].tolist()), (half, (), True))
        for ids, owners in short.items():
            self.automaton.add_word(ids, (len(ids), tuple(owners), self.automaton.get(ids, None) is not None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def keys_of(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(self.size):
            out += self.code[ids[starts + j]] * self.place[j]
        return out

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, number of words, item) of every occurrence of a window."""
        get = self.words.get
        ids = tuple([get(w, 0) for w in words])
        found, near = [], []
        if len(self.automaton):
            for end, (n, owners, block) in self.automaton.iter(ids):
                found += [(end - n + 1, n, item) for item in owners]
                if block:
                    near.append(end)
        if not near:
            return found
        # Windows that hold a block that was hit start at most so far before its end.
        ends, half = np.array(near), (self.size + 1) // 2
        starts = np.unique((ends[:, None] - np.arange(half - 1, self.size)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(ids) - self.size)]
        ids = np.array(ids, np.int32)
        keys = self.keys_of(ids, starts)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            own = self.starts[lo[k] : hi[k]]
            window = ids[starts[k] : starts[k] + self.size]
            own = own[(self.stream[own[:, None] + np.arange(self.size)] == window).all(axis=1)]
            at = np.unique(np.searchsorted(self.ends, own, "right"))
            found += [(int(starts[k]), self.size, self.items[i]) for i in at.tolist()]
        return found


def _points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte offset; offsets ascend. Memory is bounded by STRIDE."""
    out, before, lo = np.zeros(len(at), np.int64), 0, 0
    for base in range(0, len(raw) + 1, STRIDE):
        part = raw[base : base + STRIDE]
        sums = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        hi = int(np.searchsorted(at, base + STRIDE, "left"))
        out[lo:hi] = before + sums[at[lo:hi] - base]
        before, lo = before + int(sums[-1]), hi
    return out


def _word_bounds(plain: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of those (ascending) numbers start and end."""
    first, last = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for out, edge in ((first, 1), (last, -1)):
        seen, lo, before = 0, 0, 0
        for base in range(0, len(plain) + 1, STRIDE):
            solid = (plain[base : base + STRIDE] != 32).view(np.int8)
            if base + STRIDE > len(plain):
                solid = np.append(solid, np.int8(0))
            marks = base + np.flatnonzero(np.diff(solid, prepend=np.int8(before)) == edge)
            before = int(solid[-1])
            hi = int(np.searchsorted(wanted, seen + len(marks), "left"))
            out[lo:hi] = marks[wanted[lo:hi] - seen]
            seen, lo = seen + len(marks), hi
    return first, last


def scan(windows: Windows, text: str | None):
    """(words, hit words, spans (start, end, item, first word, words), start and end in code points of the original)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    plain = raw.translate(NORMAL)
    words = plain.split()
    found = sorted(set(windows.find(words))) if words else []
    if not found:
        return len(words), 0, []
    change = np.zeros(len(words) + 1, np.int64)
    for w, n, _ in found:
        change[w] += 1
        change[w + n] -= 1
    wanted = np.unique([x for w, n, _ in found for x in (w, w + n - 1)])
    first, last = _word_bounds(np.frombuffer(plain, np.uint8), wanted)
    data = np.frombuffer(raw, np.uint8)
    first, last = _points(data, first), _points(data, last)
    place = {w: i for i, w in enumerate(wanted.tolist())}
    spans = [(int(first[place[w]]), int(last[place[w + n - 1]]), item, w, n) for w, n, item in found]
    return len(words), int((np.cumsum(change) > 0).sum()), spans


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS)])


def scanner(spark: SparkSession, items: Sequence[tuple[int, str | None]], size: int = 10) -> Callable[[Column], Column]:
    """A column function: text to (n_words, n_hit, spans). The automaton is built once a Python worker task."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(sorted((i, t or "") for i, t in items))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(shared.value, size)
        for texts in batches:
            out = []
            for a, b in stretches(texts):
                out += [scan(windows, t) for t in texts.slice(a, b - a).to_pylist()]
            spans = pa.array([[dict(zip(_FIELDS, s, strict=True)) for s in spans] for *_, spans in out], _ARROW_SPANS)
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), spans], ["n_words", "n_hit", "spans"])

    return F.arrow_udf(run, FOUND, ArrowUDFType.SCALAR_ITER)


def known_items(items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    return items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL")


def n_blocks(known: DataFrame, max_block_mb: float) -> int:
    mb = (known.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / 1e6
    return 1 if mb <= max_block_mb else int(np.ceil(2 * mb / max_block_mb))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    carry: Sequence[str] = (),
    max_block_mb: float = 16.0,
) -> DataFrame:
    """Find benchmark windows in every whole text.

    Words are runs of digits, letters and non-ASCII characters after A-Z is
    lower-cased. A window is ``size`` consecutive words of an item, or all words
    of a shorter item. Returns ``doc_id, n_words, n_hit, items`` (ids of items with
    a window that occurs, distinct, ascending), ``spans`` (start and end in code points of the
    original, item, first word and number of words of each occurrence) and the columns in ``carry``.

    Items of up to ``max_block_mb`` of text are broadcast (that is the bound), and documents are not shuffled.
    More items are dealt by hash to several automata that are never held together: each is a pass of its own,
    whose hits are written to the shared folder and joined by document at the end. Results are the same.

    Defined cases: null or wordless texts have no words and no hits; null or
    wordless items have no windows; an item without an id is left out. Copies of an
    item all count as hit, and so do items under one id; repeated rows and null ids each get a row. A very long text is
    held with its words, offsets are counted in stretches. Further columns are ignored, whatever their names.
    There are no ties: every occurrence counts. No rows, no rows; no items, no hits.
    """
    spark = docs.sparkSession
    known = known_items(items, item_id_col, item_text_col)
    blocks = n_blocks(known, max_block_mb)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *carry)
    if blocks == 1:
        found = base.withColumn("_f", scanner(spark, [tuple(r) for r in known.collect()], size)("_text"))
        n_words, n_hit, spans = (F.col("_f")[c] for c in ("n_words", "n_hit", "spans"))
    else:
        found, n_words, n_hit, spans = _by_blocks(base, known, size, blocks)
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["item_id"]))).alias("items"),
        spans.alias("spans"),
        *carry,
    )


def uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10, max_block_mb: float = 16.0) -> DataFrame:
    """Rows of ``docs``, with all their columns, in whose ``text`` no window occurs. Cases are as in ``decontaminate``."""
    known = known_items(items)
    blocks = n_blocks(known, max_block_mb)
    for k in range(blocks):
        some = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        docs = docs.where(scanner(docs.sparkSession, [tuple(r) for r in some], size)(F.col("text"))["n_hit"] == 0)
        if k < blocks - 1:  # one automaton at a time
            docs = Workspace(docs.sparkSession, "uncontaminated").cut(docs, f"block{k}")
    return docs


def _by_blocks(base: DataFrame, known: DataFrame, size: int, blocks: int):
    """The base with columns of the number of words and of the hits of all blocks, block after block."""
    spark, space = base.sparkSession, Workspace(base.sparkSession, "decontamination")
    keyed = base.withColumn("_row", F.xxhash64("_text"))
    texts, hits, counts = keyed.select(F.col("doc_id").alias("_id"), "_row", "_text"), None, None
    for k in range(blocks):
        some = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        scanned = texts.select("_id", "_row", scanner(spark, [tuple(r) for r in some], size)("_text").alias("_f"))
        if not k:
            scanned = space.cut(scanned, "first")
            counts = scanned.select("_id", "_row", F.col("_f.n_words").alias("_words")).distinct()
        part = scanned.where("_f.n_hit > 0").select("_id", "_row", F.col("_f.spans").alias("s")).distinct()
        part = space.cut(part, f"block{k}")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("_id", "_row").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("_spans"))
    same = lambda other: other["_id"].eqNullSafe(keyed["doc_id"]) & (other["_row"] == keyed["_row"])
    joined = keyed.join(counts, same(counts), "left").drop("_id").drop(counts["_row"]).join(merged, same(merged), "left").drop("_id").drop(merged["_row"])
    spans = F.coalesce("_spans", F.array().cast(SPANS))
    # Spans in order of their words: each adds those words that are past all before it.
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["word"].alias("a"), (s["word"] + s["words"]).alias("b"))))
    n_hit = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda x, s: F.struct((x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], x["to"]))).alias("n"), F.greatest(x["to"], s["b"]).alias("to")),
        lambda x: x["n"],
    )
    return joined, F.col("_words"), n_hit, spans


def op2_decontamination(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
