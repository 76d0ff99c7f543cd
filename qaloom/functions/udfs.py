"""Python surfaces, vectorised by Arrow: what Catalyst cannot express, and pluggable models.

The default embedder, judge and pair scorer are deterministic lexical stand-ins,
not models; use them for plumbing, not for measurements.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(masks: dict[str, int], size: int, text: str) -> int:
    """The length of the longest common subsequence of a text and one of ``size`` characters, whose places are the bits of ``masks``."""
    full = (1 << size) - 1
    rest = full
    for c in text:
        if m := masks.get(c):
            shared = rest & m
            rest = (rest + shared | rest - shared) & full
    return size - rest.bit_count()


def best_window_ratio(page: str, quote: str) -> tuple[float, str]:
    """The best difflib ratio of a quote with any window of its length; the first best wins.

    Windows are cut from the page as it is and lower-cased each, since lower-casing can lengthen a text. How many
    characters a window shares with the quote, kept up to date as it slides, bounds its ratio, and so does their longest
    common subsequence, as the blocks that difflib matches are one; difflib compares only
    windows whose bounds exceed the best so far, in order, so its result is that of comparing all.
    """
    wanted, size = quote.lower(), len(quote)
    if not wanted:
        return 1.0, ""
    if size > len(page):
        return 0.0, ""
    best, found = 0.0, ""
    matcher = difflib.SequenceMatcher(None)
    lows = [c.lower() for c in page]
    masks: dict[str, int] = {}
    for i, c in enumerate(wanted):
        masks[c] = masks.get(c, 0) | 1 << i
    spare = Counter(wanted)  # what of the quote the window at hand lacks; negative where it has more
    shared, length, sigma = 0, 0, "\u03a3" in page

    def enter(low: str) -> None:
        nonlocal shared, length
        for c in low:
            shared += spare[c] > 0
            spare[c] -= 1
            length += 1

    def leave(low: str) -> None:
        nonlocal shared, length
        for c in low:
            spare[c] += 1
            shared -= spare[c] > 0
            length -= 1

    for low in lows[:size]:
        enter(low)
    for i in range(len(page) - size + 1):
        if i:
            leave(lows[i - 1])
            enter(lows[i + size - 1])
        # A sigma is lower-cased by what precedes it, so there the count is no bound.
        if 2.0 * shared / (len(wanted) + length) <= best and not sigma:
            continue
        window = page[i : i + size].lower()
        if window == wanted:
            return 1.0, page[i : i + size]
        if best and 2.0 * common_length(masks, len(wanted), window) / (len(wanted) + len(window)) <= best:
            continue
        # The order of the sequences and the fresh matcher matter for ties inside difflib.
        matcher.set_seqs(wanted, window)
        ratio = matcher.ratio()
        if ratio > best:
            best, found = ratio, page[i : i + size]
    return best, found


def sequence_ratio(page: Column, quote: Column) -> Column:
    """(ratio, window) of a quote on a page."""
    kind = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("window", T.StringType())])

    def run(pages: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        rows = [best_window_ratio(p, q or "") if p else (0.0, "") for p, q in zip(pages, quotes, strict=True)]
        return pd.DataFrame(rows, columns=["ratio", "window"])

    return F.pandas_udf(run, kind)(page, quote)


def _terms(text: str) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def hashed_vector(text: str, dims: int = 64) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    for w in _terms(text):
        h = zlib.crc32(w.encode())
        v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(text: Column, embedder=hashed_vector) -> Column:
    """Vectors of texts by any picklable function of one string."""
    return F.pandas_udf(lambda s: s.map(lambda t: [float(x) for x in embedder(t)]), T.ArrayType(T.FloatType()))(text)


def overlap(a: str, b: str) -> float:
    """Share of the first text's terms that the second has."""
    x, y = set(_terms(a)), set(_terms(b))
    return len(x & y) / len(x) if x else 0.0


#: A prompt's words that open a statement to judge, for the stand-in below.
STATEMENT = re.compile(r"(?is)^(.*?)\bcontext:\s*(.*)$")


def echo_judge(prompt: str) -> str:
    """A stand-in for a hosted model: the share of the words before 'Context:' that occur behind it, as text; else 'unknown'."""
    m = STATEMENT.match(prompt or "")
    return f"{overlap(m[1], m[2]):.3f}" if m else "unknown"


def generate(prompt: Column, model=echo_judge) -> Column:
    """Answers of a model, any picklable function of one prompt; a prompt whose call fails has a null answer.

    An executor's task calls it row by row within Arrow batches: a hosted model belongs behind a client with its own retries.
    """

    def run(prompts: pd.Series) -> pd.Series:
        def call(p):
            try:
                return model(p)
            except Exception:
                return None

        return prompts.map(call, na_action="ignore")

    return F.pandas_udf(run, T.StringType())(prompt)


def pair_score(a: Column, b: Column, scorer=overlap) -> Column:
    """Scores of text pairs: the place for a cross-encoder or a judge."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([float(scorer(x, y)) for x, y in zip(left, right, strict=True)])

    return F.pandas_udf(run, T.DoubleType())(a, b)
