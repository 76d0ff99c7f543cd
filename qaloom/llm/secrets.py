"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest sees a candidate's length, its character transitions, how much of it
words of the corpus cover, the path or address it stands in and neighbouring words. It is trained
in numpy from labelled findings.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small_batches, stretches, table
from .findings import Finding, labelled

_CHARS = r"A-Za-z0-9+/_=\-"
#: Runs of any length; what such a run lacks (digits, letters) the forest sees.
CANDIDATE = re.compile(rf"(?<![{_CHARS}])[{_CHARS}]{{16,}}")
#: Parts of a web token, and private keys over several lines.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.\-])[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,})+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=:,.\s\\\-]*?-----END \1-----")
ALNUM = re.compile(r"[A-Za-z0-9]")
# Words that speak for and against a secret nearby.
FOR = frozenset("token key secret password passwd pwd apikey api_key access_key secret_key auth bearer credential credentials private".split())
AGAINST = frozenset(
    "commit sha sha1 sha256 md5 hash checksum digest uuid guid etag revision rev build version example sample dummy placeholder test id file image".split()
)
# Parts of a path or address that say what lies there.
TRIAL = frozenset("test tests testing mock mocks fixture fixtures example examples sample samples doc docs demo".split())
SETTINGS = frozenset("env cfg conf config ini yml yaml toml properties settings secrets credentials".split())
WORD = re.compile(r"[A-Za-z_]+")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAMES = "|".join(sorted(FOR, key=len, reverse=True))
#: A name that ends in a FOR word, also as in DB_PASSWORD and apiToken, before its sign of assignment.
NAME = re.compile(rf"(?:(?<![A-Za-z])(?i:{_NAMES})|(?<=[a-z])(?:{'|'.join(sorted((w.title() for w in FOR), key=len, reverse=True))}))[0-9]*[\"'`\]]*\s*$")
SIGN = re.compile(r"(?<![=:])[=:]")
VALUE = re.compile(r"""[=:>]*\s*(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)'|`([^`\n]+)`|["'`]?([^\s"'`]+))""")
NAMES = (
    "length", "entropy", "class_changes", "transition", "digits", "upper", "hex", "coverage", "slashes", "address", "depth", "extension", "trial", "settings", "for",
    "against", "assigned", "quoted", "repeats", "dotted", "signs",
)

#: A value inside another, as in the parameters of a link.
PART = re.compile(r"""[=:>]*["'`]?([^\s"'`&;,|?]+)""")


@dataclass(frozen=True)
class Lexicon:
    """Words of the corpus, the most frequent first, and the log-probabilities of letter pairs in them, smoothed."""

    ordered: tuple[str, ...]
    words: frozenset[str]
    pairs: np.ndarray

    @staticmethod
    def of(counts: Mapping[str, int]) -> Lexicon:
        c = np.full((27, 27), 0.5)
        for w, n in sorted(counts.items()):
            codes = [26, *(ord(x) - 97 for x in w), 26]
            np.add.at(c, (codes[:-1], codes[1:]), n)
        return Lexicon(tuple(sorted(counts, key=lambda w: (-counts[w], w))), frozenset(counts), np.log(c / c.sum(axis=1, keepdims=True)))


def lexicon(docs: DataFrame, text_col: str = "text", rule: int = 16) -> Lexicon:
    """The corpus's dictionary: words of 3 to 20 letters a-z that occur at least sqrt(words) / rule times, counted over all texts.

    Counts combine before the shuffle; what comes to the driver grows more slowly than the square root of the corpus.
    Null and empty texts have no words; no rows, no words.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"), lambda w: w.rlike("^[a-z]{3,20}$"))
    space = Workspace(docs.sparkSession, "lexicon")
    counted = space.cut(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") >= math.sqrt(total) / rule).collect()
    space.drop("words")
    return Lexicon.of({r["w"]: r["n"] for r in found})


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets, in order: values of any length assigned to a FOR word, and runs of 16 or more.

    A run is split where an equals sign stands before something else, as in NAME=value
    but not in base64 padding; where that leaves no part of 16, it stays whole unless
    an assigned value lies in it. Web tokens of dotted parts and private keys of several lines are candidates as a whole.
    """
    found, outer, inner = {m.span() for p in (DOTTED, PEM) for m in p.finditer(text)}, 0, 0
    for m in SIGN.finditer(text):
        if m.start() < inner or not NAME.search(text[max(0, m.start() - 64) : m.start()]):
            continue
        nested = m.start() < outer
        if v := (PART if nested else VALUE).match(text, m.end()):
            a, b = v.span(v.lastindex)
            outer, inner = (outer, b) if nested else (b, 0)
            if v.lastindex in (1, 4) and text[a - 1] not in "\"'`":
                b = a + len(text[a:b].rstrip(".,;:")) or b
            if a < b and ALNUM.search(text, a, b):
                found.add((a, b))
    assigned = sorted(found)
    for m in CANDIDATE.finditer(text):
        parts, at = [], m.start()
        for cut in re.finditer(r"(?<!=)=+(?=[^=])", m.group()):
            parts.append((at, m.start() + cut.start()))
            at = m.start() + cut.end()
        parts = [(a, b) for a, b in [*parts, (at, m.end())] if b - a >= 16]
        if not parts:
            k = bisect.bisect_left(assigned, (m.start(), 0))
            parts = [] if k < len(assigned) and assigned[k][0] < m.end() else [m.span()]
        found.update((a, b) for a, b in parts if ALNUM.search(text, a, b))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def covered(s: str, words: frozenset[str]) -> float:
    """The share of characters in dictionary words, cut at signs, digits and capitals."""
    low = s.lower()
    runs = [(m.start(), m.end()) for m in re.finditer(r"[a-z]{3,}", low) if m.group() in words]
    runs += [m.span() for m in re.finditer(r"[A-Z]?[a-z]{2,}", s) if m.group().lower() in words]
    inside = np.zeros(len(s), bool)
    for a, b in runs:
        inside[a:b] = True
    return float(inside.mean())


def around(text: str, start: int, end: int, reach: int = 200) -> str:
    """The unbroken token that a candidate stands in, up to ``reach`` characters to each side."""
    before, after = text[max(0, start - reach) : start], text[end : end + reach]
    return re.search(r"[^\s\"'`<>()|]*$", before).group() + text[start:end] + re.match(r"[^\s\"'`<>()|]*", after).group()


def features(text: str, start: int, end: int, lex: Lexicon, source: str | None = None) -> list[float]:
    """NAMES of a candidate. ``source`` is the path or address of the document, if known."""
    s = text[start:end]
    n, low, counts = len(s), s.lower(), Counter(s)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in s]
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in low]
    before = text[max(0, start - 48) : start]
    last = WORD.findall(before)[-3:]
    near = [w.lower() for w in last]
    named = [*near, *(x.lower() for w in last for x in PIECE.findall(w))]
    token = around(text, start, end)
    places = set(re.findall(r"[a-z]+", (source or "").lower())) | (set(re.findall(r"[a-z]+", token.lower())) if "/" in token else set())
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(np.mean(lex.pairs[codes[:-1], codes[1:]])) if n > 1 else 0.0,
        kinds.count(0) / n,
        kinds.count(2) / n,
        float(all(c in "0123456789abcdefABCDEF-" for c in s)),
        covered(s, lex.words),
        s.count("/") / n,
        float("://" in token or token.startswith(("www.", "data:"))),
        float(len(re.findall(r"[/\\]+", token))),
        float(bool(re.search(r"\.[A-Za-z]{1,5}$", token))),
        float(bool(places & TRIAL)),
        float(bool(places & SETTINGS)),
        float(any(w in FOR for w in named)),
        float(any(w in AGAINST for w in near) or any(w in AGAINST for w in re.findall(r"[a-z]{4,}", low))),
        float(bool(re.search(r"[=:][=>]?\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and bool(before)),
        1 - len(counts) / n,
        float("." in s),
        kinds.count(3) / n,
    ]


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            f = np.maximum(self.feature[at], 0)
            go = np.where(x[np.arange(len(x)), f] <= self.limit[at], self.left[at], self.right[at])
            at = np.where(inner, go, at)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int) -> Tree:
    nodes: list[list] = []

    def split(rows: np.ndarray, level: int) -> int:
        me, p = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, p])
        if level >= depth or len(rows) < 2 * leaf or p in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            v = x[rows, f]
            for limit in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                low = v <= limit
                a = int(low.sum())
                b = len(rows) - a
                if a < leaf or b < leaf:
                    continue
                pa, pb = y[rows[low]].mean(), y[rows[~low]].mean()
                gain = p * (1 - p) - (a * pa * (1 - pa) + b * pb * (1 - pb)) / len(rows)
                if gain > best[0]:
                    best = (gain, int(f), float(limit))
        if best[1] < 0:
            return me
        low = x[rows, best[1]] <= best[2]
        nodes[me][:2] = best[1:]
        nodes[me][2] = split(rows[low], level + 1)
        nodes[me][3] = split(rows[~low], level + 1)
        return me

    split(rng.integers(0, len(y), len(y)), 0)
    f, limit, left, right, value = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(limit), np.array(left), np.array(right), np.array(value))


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def train(findings: Sequence[tuple[str, int, int, bool]], lex: Lexicon, trees: int = 40, depth: int = 9, leaf: int = 5, seed: int = 11) -> Forest:
    """A forest from labelled findings (text, start, end, is a secret); at most a bounded list of them."""
    x = np.array([features(t, a, b, lex) for t, a, b, _ in findings])
    y = np.array([float(k) for *_, k in findings])
    rng = np.random.default_rng(seed)
    return Forest(tuple(_grow(x, y, rng, depth, leaf) for _ in range(trees)))


def labelled_findings(lex: Lexicon, n: int = 3000, seed: int = 17, families: Sequence[str] | None = None) -> list[Finding]:
    """``n`` labelled findings of ``findings.FAMILIES`` among the 2,000 most frequent words of the corpus."""
    return labelled(candidates, lex.ordered[:2000], n, seed, families)


def outermost(findings: list[dict]) -> list[dict]:
    """Findings, in order of their start, without those that lie inside an earlier one."""
    out: list[dict] = []
    for f in findings:
        if not out or f["end"] > out[-1]["end"]:
            out.append(f)
    return out


FOUND = "doc_id long, n_candidates long, findings array<struct<start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, forest: Forest, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, findings`` of every whole text.

    A candidate is a run of 16 or more of ``A-Za-z0-9+/_=-`` (see ``candidates``), a
    value of any length and signs that is assigned to a word such as password, a dotted web token or a private key; findings are those
    the forest gives at least ``threshold``, with their offsets in code points and scores.
    Of findings inside each other the outermost is given. ``source_col`` names a column with the path or address of a document.

    Defined cases: null and empty texts have no candidates. Repeated rows and null
    ids each get a row, equal secrets each a finding; a score at exactly the threshold is a finding. A very long text is searched
    alone, in memory of some multiple of its length. Further columns are ignored, whatever their names. No rows, no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((forest, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, words = shared.value
        for batch in batches:
            for a, b in stretches(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                spans = [candidates(t) if t else [] for t in texts]
                x = [features(t, lo, hi, words, src) for t, src, own in zip(texts, part.column("source").to_pylist(), spans, strict=True) for lo, hi in own]
                scores = iter(trees.predict(np.array(x)).tolist() if x else [])
                found = [outermost([{"start": lo, "end": hi, "score": s} for (lo, hi), s in [(span, next(scores)) for span in own] if s >= threshold]) for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in spans], pa.int64()), pa.array(found, _SPANS)], ["doc_id", "n_candidates", "findings"]
                )

    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), source.alias("source"))
    return base.mapInArrow(run, FOUND).select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), "findings")


def op5_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lex = lexicon(docs)
    found = scan(docs, train(labelled_findings(lex), lex), lex, source_col="source")
    spans = F.transform("findings", lambda x: F.concat_ws("-", x["start"], x["end"]))
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(spans, ",").alias("spans"))
