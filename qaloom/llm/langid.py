"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams; each language has
several centroids, clustered by spherical k-means; the nearest by cosine wins, and
a text too far from every centroid is marked as rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import small_batches, stretches, table

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: ASCII other than letters becomes a space, once A-Z is lower-cased.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SIZES, DIMS = (1, 2, 3), 4096
#: Characters counted at once.
PIECE = 1 << 19
#: Lengths in bytes at which training texts are measured for the rejection limits; the first is one word.
LENGTHS = (1, 8, 16, 32, 64, 128, 256, 512, 1024)


def pieces(text: str) -> Iterator[str]:
    """Stretches of a text of at most PIECE characters, cut behind white space where there is any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = blank + 1 if blank >= at else end
        yield text[at:end]
        at = end


def counts(texts: Sequence[str], dims: int = DIMS) -> np.ndarray:
    """Counts of hashed n-grams of bytes, one row a text, over whole texts; a very long text is counted piece by piece."""
    total = np.zeros((len(texts), dims), np.int64)
    group, size = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            group.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                _add(total, group)
                group, size = [], 0
    _add(total, group)
    return total


def _add(total: np.ndarray, group: list[tuple[int, str]]) -> None:
    plain = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" " for _, t in group]
    raw = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32)
    part = np.repeat(np.arange(len(plain), dtype=np.int32), [len(p) for p in plain])
    rows, dims = np.array([i for i, _ in group], np.int64), total.shape[1]
    for n in SIZES:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, np.uint32)
        for j in range(n):
            code = (code * np.uint32(0x01000193)) ^ raw[j : j + len(code)]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        inside = part[: len(code)] == part[n - 1 :]
        slot = rows[part[: len(code)][inside]] * dims + (code[inside] >> np.uint32(32 - dims.bit_length() + 1))
        total += np.bincount(slot, minlength=total.size).reshape(total.shape)


@dataclass(frozen=True)
class Model:
    """What prediction needs: a few hundred kilobytes, whatever the corpus."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    #: The lowest limit, and the limits of texts with so many distinct n-grams.
    reject_below: float
    limits: tuple[tuple[float, ...], tuple[float, ...]] = ((1.0,), (0.0,))

    def judge(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the cosine is below the limit of texts of as many distinct n-grams,
        so that a repeated word counts as a short text."""
        n = counts(texts, len(self.idf))
        v = np.log1p(n.astype(np.float32)) * self.idf
        cos = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)
        far = score < np.interp(np.log((n > 0).sum(axis=1) + 1), np.log(np.array(self.limits[0]) + 1), self.limits[1])
        return [self.langs[i] for i in best], score, far

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def vectors(text: str) -> list[np.ndarray]:
    """Counts of the whole text and of its beginnings of LENGTHS that have a letter (None where there is none)."""
    parts = [text, *(beginning(text, n) for n in LENGTHS)]
    real = [i for i, x in enumerate(parts) if x and LETTER.search(x)]
    found = iter(counts([parts[i] for i in real]))
    return [next(found) if i in set(real) else None for i in range(len(parts))]


def fit(texts: Sequence[str], langs: Sequence[str], clusters: int = 4, rounds: int = 12, seed: int = 5) -> Model:
    """Train on labelled texts, see ``fit_vectors``; null and letterless texts and null languages are left out."""
    rows = [(lang, vectors(t)) for t, lang in zip(texts, langs, strict=True) if t and lang is not None and LETTER.search(t)]
    return fit_vectors(rows, clusters, rounds, seed)


def fit_vectors(rows: Sequence[tuple[str, Sequence[np.ndarray | bytes | None]]], clusters: int = 4, rounds: int = 12, seed: int = 5) -> Model:
    """Train on (language, ``vectors`` of a text). The rejection limits follow the length: at each of LENGTHS the
    0.1% quantile of the cosines of training texts cut to that length at the end of a word.

    Vectors may be packed; a language's, or 512 of a length, are made dense at a time.
    """
    if not rows:
        return Model(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), (), 0.0)
    df = np.zeros(DIMS, np.int64)
    for _, v in rows:
        df += _dense(v[0]) > 0
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)

    def unit(some: Sequence[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.stack([_dense(x) for x in some]).astype(np.float32)) * idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    rng, centres, names = np.random.default_rng(seed), [], []
    for lang in sorted({lang for lang, _ in rows}):
        own = unit([v[0] for x, v in rows if x == lang])
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(rounds):
            nearest = (own @ c.T).argmax(axis=1)
            moved = [own[nearest == k].mean(axis=0) if (nearest == k).any() else c[k] for k in range(len(c))]
            c = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in moved])
        centres.append(c)
        names += [lang] * len(c)
    c = np.concatenate(centres).astype(np.float32)
    sizes, limits = [], []
    for k in range(1, len(LENGTHS) + 1):
        part = [v[k] for _, v in rows if v[k] is not None]
        if not part:
            continue
        near = np.concatenate([(unit(part[i : i + 512]) @ c.T).max(axis=1) for i in range(0, len(part), 512)])
        sizes.append(float(np.median([(_dense(x) > 0).sum() for x in part])))
        limits.append(float(np.quantile(np.clip(near, 0, 1), 0.001)))
    # Longer texts have no lower limits than shorter ones.
    sizes, limits = np.maximum.accumulate(sizes), np.maximum.accumulate(limits)
    return Model(idf, c, tuple(names), float(limits[0]), (tuple(sizes.tolist()), tuple(limits.tolist())))


def beginning(text: str, length: int) -> str | None:
    """The first words of a text, up to the one that reaches ``length`` bytes; none if the text is shorter."""
    size = 0
    for m in re.finditer(r"\S+", text):
        size += len(m.group().encode("utf-8", "replace")) + 1
        if size >= length:
            return text[: m.end()]
    return None


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_langs: int) -> DataFrame:
    """Whole labelled texts of non-held-out documents: at most ``per_lang`` of every language.

    Where there are more than ``max_langs`` languages, each has fewer, so that the total
    stays at per_lang x max_langs, but one at least; no language is left out.
    Chosen by hash of the id. The ranks cut each task's rows to ``per_lang`` a
    language before anything is shuffled, and texts are fetched by a join with
    the chosen ids, so what is sorted or sent stays small and bounded.
    """
    from pyspark.sql import Window

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang")
    )
    langs = labelled.select("lang").distinct().count()
    per_lang = max(1, min(per_lang, per_lang * max_langs // max(1, langs)))
    ranks = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = labelled.withColumn("r", F.row_number().over(ranks)).where(F.col("r") <= per_lang).select("id", "lang")
    ids = F.broadcast(picked.select(F.col("id").alias("_picked")).distinct())
    return docs.join(ids, docs[id_col] == ids["_picked"], "left_semi").where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, max_langs: int = 64
) -> Model:
    """A model of the bounded sample of ``training_rows``.

    Texts become counts where they lie; what comes to the driver is at most ``per_lang * max_langs`` sparse
    vectors (or one a language, if those are more), so it is bounded in bytes, whatever the length of texts.

    Defined cases: null and letterless texts and null languages are left out, held-out and null ids too.
    Repeated rows of a chosen id all train. Ties between ids of one hash go by id. No rows: a model without languages.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, per_lang, max_langs)

    def run(batches):
        for batch in batches:
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "lang")), strict=True):
                if text and LETTER.search(text):
                    packed = [b"" if v is None else _pack(v) for v in vectors(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([lang]), pa.array([packed], pa.list_(pa.binary()))], ["id", "lang", "v"])

    small_batches(docs.sparkSession)
    found = rows.mapInArrow(run, "id string, lang string, v array<binary>").collect()
    found.sort(key=lambda r: (r["lang"], r["id"], r["v"]))
    return fit_vectors([(r["lang"], [bytes(x) if x else None for x in r["v"]]) for r in found])


def _pack(v: np.ndarray) -> bytes:
    return zlib.compress(v.astype(np.uint32).tobytes(), 1)


def _dense(v: np.ndarray | bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(v), np.uint32) if isinstance(v, bytes) else v


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def judge(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function: text to (lang_pred, score, rejected). Only the text goes to Python."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            langs, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for a, b in stretches(texts, PIECE):
                for lo in range(a, b, 512):
                    words = texts.slice(lo, min(b, lo + 512) - lo).to_pylist()
                    good = [i for i, t in enumerate(words) if t and LETTER.search(t)] if own.langs else []
                    if good:
                        found, s, f = own.judge([words[i] for i in good])
                        at = lo + np.array(good)
                        score[at], far[at] = s, f
                        for i, lang in zip(at.tolist(), found, strict=True):
                            langs[i] = lang
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(far)], ["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, FOUND, ArrowUDFType.SCALAR_ITER)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every whole text, and the columns in ``carry``.

    ``score`` is the cosine with the nearest centroid; ``rejected`` marks texts
    below the model's limit for their length or of no language at all. Prediction reads the text alone.

    Defined cases: a null text, one without a letter, or a model without
    languages gives 'und', score 0, rejected. Equal cosines go to the first
    language by name. Repeated rows and null ids each get a row. A very long text is counted in pieces of
    PIECE characters. Further columns are ignored, whatever their names. No rows, no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *carry)
    return base.withColumn("_f", judge(docs.sparkSession, model)("_text")).select(
        "doc_id", F.col("_f.lang_pred").alias("lang_pred"), F.col("_f.score").alias("score"), F.col("_f.rejected").alias("rejected"), *carry
    )


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
