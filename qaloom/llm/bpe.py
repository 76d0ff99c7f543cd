"""Byte-level BPE as a monoid.

A piece (one match of the splitting pattern) is encoded by halves. Two encoded
neighbours are joined by re-encoding a window around their border, which grows
until the tokens outside provably stay: byte-pair encodings are exactly those
token sequences whose neighbouring pairs all encode to themselves, so a window
whose two outer borders pass that test completes the encoding of the whole.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import small_batches, stretches, table

#: Bytes up to which a stretch is merged directly, and its encoding remembered.
LEAF = 6
#: The same for pieces over LONG bytes, which are too seldom alike to remember.
WIDE, LONG = 512, 4096
#: Bytes of a stretch whose encoding is remembered.
SHORT = 16
#: Entries of each cache of a Python worker; a full cache is emptied, which changes no result.
CACHE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """An encoder and decoder of one vocabulary; holds bounded caches only."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.short: dict[bytes, list[int]] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.direct(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings side by side."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            n, m = min(width, len(left)), min(width, len(right))
            window = self.direct(self.decode(left[-n:] + right[:m]))
            head, tail = left[: len(left) - n], right[m:]
            if (not head or self.stable(head[-1], window[0])) and (not tail or self.stable(window[-1], tail[0])):
                return head + window + tail
            width *= 2

    def direct(self, piece: bytes) -> list[int]:
        """merge(), remembered for what is short."""
        if len(piece) > SHORT:
            return self.merge(piece)
        found = self.short.get(piece)
        if found is None:
            if len(self.short) >= CACHE:
                self.short.clear()
            found = self.short[piece] = self.merge(piece)
        return found

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left; candidates wait in a heap."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] - i != size:
                continue
            alive[j] = False
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
                if (r := ranks.get(piece[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[end[i]] - i))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i] - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def tree(self, piece: bytes, leaf: int) -> list[int]:
        if len(piece) <= leaf:
            return self.direct(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half], leaf), self.tree(piece[half:], leaf))

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        found = (whole,) if whole is not None else tuple(self.tree(raw, WIDE if len(raw) > LONG else LEAF))
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if len(text) <= 64:
            self.pieces[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        known, fresh, out = self.pieces, self.piece, []
        for p in self.split.findall(text):
            out += known.get(p) or fresh(p)
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        """Concatenate up the tree; leaves are runs of tokens."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _lists(each: list[np.ndarray]) -> pa.ListArray:
    """Lists of ids. A batch of stretches() has fewer ids than bytes, unless one text is longer; a text has under 2^31 bytes."""
    ends = np.cumsum([0, *map(len, each)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32), pa.int32()))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    decoded: str | None = None,
) -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids`` (array of int) and the columns in ``carry``.

    ``ranks_path`` is a rank file that every executor has at that place; each Python
    worker reads it once a task. Rows stay in their partitions. With ``decoded`` a column of that
    name has the bytes that the ids decode to, made in the same pass.

    Defined cases: a null or empty text has no ids. Repeated rows each get a row;
    null ids stay; further columns are ignored, whatever their names. Of pairs of equal rank the leftmost
    merges first. A very long text is encoded alone, in memory of some multiple of its length. No rows, no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *carry)
    others = [f for f in base.schema.fields if f.name != "_text"]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]

    def run(batches):
        bpe = Bpe(load_ranks(ranks_path), pattern)
        for batch in batches:
            for a, b in stretches(batch.column("_text")):
                part = batch.slice(a, b - a)
                each = [np.array(bpe.encode(t), np.int32) for t in part.column("_text").to_pylist()]
                more = [pa.array([bpe.decode(x.tolist()) for x in each], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in others] + [_lists(each), *more], [f.name for f in others + added])

    return base.mapInArrow(run, T.StructType(others + added))


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes of the token ids as a binary column; a null list gives no bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = Bpe(load_ranks(ranks_path), pattern)
        for ids in batches:
            yield pa.array([bpe.decode(x or ()) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn(into, F.arrow_udf(run, T.BinaryType(), ArrowUDFType.SCALAR_ITER)(ids_col))


def tokenizer() -> tuple[str, str]:
    """Path of the public rank file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Token count and digests of the ids and of what they decode to; defined cases as in ``encode``."""
    path, pattern = tokenizer()
    return encode(docs, path, pattern, carry=carry, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *carry,
    )


def op8_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
