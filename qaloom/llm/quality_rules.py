"""Quality rules with DataFrame functions only.

Text counts give a base verdict; beyond it, a document is kept by the mean
log-likelihood ratio of its hashed word n-grams between two multinomials, one of
trusted documents and one of the whole raw corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

SYMBOLS = "#*$%&|<>"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def _count(text: Column, chars: str) -> Column:
    """Occurrences of ASCII characters; replace() works on bytes, far faster than translate()."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_next(items: Column, following: Column, n: Column) -> Column:
    """Hash each of the first n items with the one that follows it."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(
        F.slice(items, F.lit(1), n), F.slice(following, F.lit(2), n), lambda a, b: F.xxhash64(a, b)
    )


def _grams(hashes: Column, pairs: Column, buckets: int) -> Column:
    """Hash buckets of the words and of the pairs of neighbouring words."""
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _h (a hash a word) and _p (a hash a pair), each computed once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("_h")
    return (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .withColumn("_h", _hashes(_words(F.col("_text"))))
        .withColumn("_p", _with_next(F.col("_h"), F.col("_h"), n - 1))
    )


def _neighbours(items: Column, f) -> Column:
    """f of each item and the next."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), f)


def fit_ratio(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 8192,
    smoothing: float = 0.5,
) -> list[int]:
    """Millionths of log(p_trusted / p_raw) for each bucket.

    Every document counts in the raw multinomial; those with an id in ``trusted``
    (a frame of at most a bounded number of ids, see ``trusted_ids``) count in the
    target. Only the ``buckets`` sums come to the driver.

    Defined cases: null and empty texts have no n-grams; repeated rows count as often as they occur; null ids count in the raw
    multinomial alone. No documents or no trusted ones: every ratio is 0.
    """
    ids = F.broadcast(trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("_t")))
    sums = (
        _hashed(docs, id_col, text_col)
        .join(ids, "_id", "left")
        .select(F.coalesce("_t", F.lit(0)).alias("_t"), F.explode(_grams(F.col("_h"), F.col("_p"), buckets)).alias("_b"))
        .groupBy("_b")
        .agg(F.count("*").alias("raw"), F.sum("_t").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in sums:
        raw[r["_b"]], target[r["_b"]] = r["raw"], r["target"]
    nr, nt = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    if not any(target):
        return [0] * buckets
    return [round(1e6 * math.log((t + smoothing) / nt / ((r + smoothing) / nr))) for r, t in zip(raw, target, strict=True)]


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", max_trusted: int = 20_000) -> DataFrame:
    """Ids of documents with no label but quality 1 and none toxic.

    At most ``max_trusted``, those of smallest hash: the bound that makes the ids
    safe to broadcast, whatever the number of labels.
    """
    return (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_x"))
        .where("_q = 1 AND _x = 0")
        .select(id_col)
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_trusted)
    )


def quality_rules(
    docs: DataFrame,
    ratio: list[int],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    threshold: float = -0.06,
) -> DataFrame:
    """Counts, base verdict, score and verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept``. ``score`` is the mean log ratio
    of the document's n-grams; kept are documents that pass the base rules and
    score at least ``threshold``.

    Defined cases: a null, empty or blank text has no words, counts of 0, a null
    score, and fails the base rules. Repeated rows each get a row, null ids
    too. A score at exactly the threshold is kept. A very long text is one row of arrays of its words' hashes. Further input
    columns are ignored, whatever their names. An empty ``docs`` gives no rows; with no trusted documents every
    ratio is 0 and the base rules decide alone.
    """
    buckets = len(ratio)
    weights = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<bigint>")
    n = F.size("_h")
    counted = _hashed(docs, id_col, text_col).select(
        F.col("_id").alias("doc_id"),
        n.alias("_n"),
        (F.length("_text") - _count(F.col("_text"), BLANKS)).alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        _with_next(F.col("_p"), F.slice("_h", F.lit(2), F.greatest(n - 1, F.lit(0))), n - 2).alias("_win"),
        F.aggregate(
            _grams(F.col("_h"), F.col("_p"), buckets), F.lit(0).cast("bigint"), lambda a, b: a + F.get(weights, b)
        ).alias("_sum"),
        F.greatest(2 * n - 1, F.lit(0)).alias("_grams"),
    )
    ordered = counted.select(
        "doc_id", "_n", "word_chars", "n_symbols", "_sum", "_grams",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Only texts with a window found twice need their windows in order.
        F.when(
            F.size("_win") > F.size(F.array_distinct("_win")),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")).alias("_s"),
    )
    placed = ordered.withColumn(
        "_at",
        F.sort_array(F.array_distinct(F.flatten(_neighbours(
            F.col("_s"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))
        )))),
    )
    # Each window adds its words up to the start of the next, three at the most.
    covered = F.aggregate(
        _neighbours(F.col("_at"), lambda a, b: F.least(F.lit(3), b - a)),
        F.when(F.size("_at") > 0, F.lit(3)).otherwise(F.lit(0)).cast("bigint"),
        lambda a, x: a + x,
    )
    return (
        placed.select(
            "doc_id", F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
            covered.alias("n_repeat_words"),
            F.when(F.col("_grams") > 0, F.col("_sum") / F.col("_grams") / 1e6).alias("score"),
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
    )


def op10_quality_rules(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    ratio = fit_ratio(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules(docs, ratio)
