"""Document scores by masked pseudo-likelihood.

A bidirectional window network, trained in numpy, predicts every token from the two
tokens on either side of it; the conditional log-probabilities of all tokens of a
text sum to its score. The output is factored into token classes and members, so a
prediction costs two small softmaxes rather than one over the vocabulary.

The vocabulary, classes and members follow the corpus: every word that occurs at least
sqrt(tokens) / RULE times has an id of its own. Every other word shares one of RARE ids
for its place in the text and is told apart by its spelling: a byte trigram model of all
rare words of the corpus gives each its own probability.

Nothing depends on how rows lie in partitions: documents are dealt by hash to shards whose number
follows the corpus, a shard trains over its documents in the order of their ids, and weights are averaged in the order of shards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small_batches, stretches, table
from .shingles import _SOLID, word_hashes

OFFSETS = (-2, -1, 1, 2)
#: The smallest network; a larger corpus has more classes and members.
CLASSES = MEMBERS = 32
VOCABULARY = CLASSES * MEMBERS
RULE = 4
#: Id 0 stands for what lies outside the text; ids 1 to RARE are shared by words out of the vocabulary.
RARE, WIDTH = 64, 16
#: Tokens of a shard, and the number of shards beyond which they grow longer instead.
SHARD, SHARDS = 1_000_000, 8192
#: Tokens that are shuffled together, and those of one step.
MIXED, BATCH = 65_536, 4096
#: Weights in a row as they are averaged, shards averaged at once, and tokens scored at once.
BLOCK, FAN, CHUNK = 16_384, 64, 4096
#: Bytes of a very long text that are split into words at once.
PIECE = 4 << 20
_BLANK = re.compile(rb"[ \t\n\x0b\f\r]")


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where words start and end in them, and each text's number of words."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(plain)
    if not n:
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64) for _ in range(3))
    bounds = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1]
    data = plain.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    solid = np.concatenate(([False], _SOLID[raw], [False]))
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return raw, starts, ends, np.diff(np.searchsorted(starts, bounds))


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in stretches of bounded size, each with the number of its first text; a very long text comes in
    several arrays of one entry under the same number, cut at white space."""
    for a, b in stretches(texts):
        part = texts.slice(a, b - a)
        raw = part[0].as_py().encode() if b - a == 1 and (pc.binary_length(part)[0].as_py() or 0) > PIECE else None
        if raw is None:
            yield a, part
            continue
        at = 0
        while at < len(raw):
            m = _BLANK.search(raw, min(len(raw), at + PIECE))
            end = m.end() if m else len(raw)
            yield a, pa.array([raw[at:end].decode()], pa.large_string())
            at = end


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Stands before and after a word.
END = 32


def spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and the end of every word, with the two bytes before it, as columns, and each word's number of columns."""
    sizes = ends - starts
    tail = np.cumsum(sizes + 2)
    at = np.repeat(tail - sizes - starts, sizes)
    source = np.arange(len(at)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    buffer = np.full((tail[-1] if len(tail) else 0) + 2, END, np.uint8)
    buffer[source + at] = _LOW[raw[source]]
    keep = np.ones(len(buffer) - 2, bool)
    keep[tail - 1] = False
    return np.stack([buffer[:-2][keep], buffer[1:-1][keep], buffer[2:][keep]]), sizes + 1


class Spelling:
    """Probabilities of words by their bytes: trigrams, smoothed by bigrams, bytes and at last an even share.

    They sum to 1 over all words. The table has one place for each byte the corpus has and one for all others.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        """Distinct trigrams (first * 65536 + second * 256 + third) and how often each occurs."""
        triples = np.stack([codes >> 16, (codes >> 8) & 255, codes & 255]).astype(np.int64)
        seen = np.union1d(triples.ravel(), [END])
        self.place = np.full(256, len(seen), np.int64)
        self.place[seen] = np.arange(len(seen))
        self.side = side = len(seen) + 1
        n = np.zeros((side, side, side))
        n[tuple(self.place[triples])] = counts
        one = (n.sum(axis=(0, 1)) + 1 / 256) / (n.sum() + 1)
        two = (n.sum(axis=0) + one) / (n.sum(axis=(0, 2))[:, None] + 1)
        self.log = np.log((n + two) / (n.sum(axis=2)[:, :, None] + 1)).astype(np.float32).ravel()

    def log_probs(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        (a, b, c), sizes = spelled(raw, starts, ends)
        logs = self.log[(self.place[a] * self.side + self.place[b]) * self.side + self.place[c]]
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))


class Network:
    """Embeddings of the four neighbours sum to a hidden layer, which with the unigram log-shares of classes and of
    members in their class gives the two softmaxes. Embeddings and output weights are trained."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, flat: np.ndarray | None = None):
        """vocabulary: word hashes, the most frequent first; counts: how often each shared id and each word occurs."""
        self.vocabulary, self.counts = vocabulary, counts
        self.side = side = max(CLASSES, math.ceil(math.sqrt(len(vocabulary) + RARE + 1)))
        self.order = np.argsort(vocabulary)
        self.known = vocabulary[self.order]
        share = np.full(side * side, 0.5)
        share[1 : 1 + len(counts)] += counts
        share = share.reshape(side, side)
        self.classes = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        self.members = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        rows = len(OFFSETS) * side * side
        if flat is None:
            flat = np.random.default_rng(3).normal(0, 0.1, (rows + 2 * side) * WIDTH)
        flat = flat.astype(np.float32).reshape(-1, WIDTH)
        self.inner, self.outer = flat[:rows].copy(), flat[rows:].copy()
        self.past_inner, self.past_outer = (np.full(x.shape, 1e-6, np.float32) for x in (self.inner, self.outer))
        self.shift = (np.arange(len(OFFSETS)) * side * side)[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.ravel(), self.outer.ravel()])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = (hashes % np.uint64(RARE)).astype(np.int64) + 1
        if not len(self.known):
            return rare
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at] + RARE + 1, rare)

    def neighbours(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the embeddings at OFFSETS around places of a stream, in which two zeros stand around every text."""
        return np.stack([stream[at + o] for o in OFFSETS]).astype(np.int64) + self.shift

    def forward(self, rows: np.ndarray, target: np.ndarray):
        h = self.inner[rows[0]]
        for r in rows[1:]:
            h += self.inner[r]
        np.tanh(h, out=h)
        k, m = target // self.side, target % self.side
        z = h @ self.outer.T
        z[:, : self.side] += self.classes
        z[:, self.side :] += self.members[k]
        return h, k, m, z

    def log_probs(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, k, m, z = self.forward(rows, target)
        at = np.arange(len(target))
        own = z[at, k].astype(np.float64) + z[at, self.side + m]
        np.exp(z, out=z)
        return own - np.log(z[:, : self.side].sum(axis=1)) - np.log(z[:, self.side :].sum(axis=1))

    def gradients(self, rows: np.ndarray, target: np.ndarray):
        """Of the mean negative log-probability: by the hidden layer before tanh, and by the output weights."""
        h, k, m, z = self.forward(rows, target)
        n, s, at = len(target), self.side, np.arange(len(target))
        np.exp(z, out=z)
        z[:, :s] /= z[:, :s].sum(axis=1, keepdims=True)
        z[:, s:] /= z[:, s:].sum(axis=1, keepdims=True)
        z[at, k] -= 1
        z[at, s + m] -= 1
        z /= n
        return (z @ self.outer) * (1 - h * h), z.T @ h

    def step(self, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One Adagrad step on a batch; of the embeddings only rows of the batch have a gradient."""
        dx, g = self.gradients(rows, target)
        self.past_outer += g * g
        self.outer -= rate * g / np.sqrt(self.past_outer)
        used = rows.ravel()
        order = np.argsort(used, kind="stable")
        held = used[order]
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        g, at = np.add.reduceat(dx[order % len(target)], first, axis=0), held[first]
        past = self.past_inner[at] + g * g
        self.past_inner[at] = past
        self.inner[at] -= rate * g / np.sqrt(past)


class Shard:
    """Trains a network on a shard's texts, which come one after another; a function of the texts and their order alone."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.seen = net, rate, 0
        self.waiting, self.size = [np.zeros(2, np.int32)], 2

    def add(self, ids: np.ndarray, ends: bool) -> None:
        """Ids of a text or a part of it; ``ends`` if it ends there."""
        some = np.concatenate([ids.astype(np.int32), np.zeros(2 if ends else 0, np.int32)])
        self.waiting.append(some)
        self.size += len(some)
        if self.size >= MIXED + 4:
            stream = np.concatenate(self.waiting)
            while len(stream) >= MIXED + 4:
                self._train(stream[: MIXED + 4])
                stream = stream[MIXED:]
            self.waiting, self.size = [stream], len(stream)

    def finish(self) -> Network:
        self._train(np.concatenate(self.waiting))
        return self.net

    def _train(self, stream: np.ndarray) -> None:
        """Steps over the places of a stretch of the stream but the outer two on each side, in mixed order."""
        at = np.flatnonzero(stream[2:-2]) + 2
        at = at[np.random.default_rng(len(at)).permutation(len(at))]
        for lo in range(0, len(at), BATCH):
            some = at[lo : lo + BATCH]
            self.net.step(self.net.neighbours(stream, some), stream[some].astype(np.int64), self.rate)
        self.seen += len(at)


def vocabulary(docs: DataFrame, text_col: str = "text", least: int = VOCABULARY - RARE - 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all words that occur at least sqrt(tokens) / RULE times, the most frequent first, or of the ``least``
    most frequent where those are more; how often each shared id and each such word occurs; and the number of tokens.

    Counts combine before the shuffle. What comes to the driver grows more slowly than the square root of the corpus.
    Words of equal count go by hash. Null and wordless texts have no words; no rows, no words.
    """
    space = Workspace(docs.sparkSession, "vocabulary")
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for _, part in pieces(batch.column("text")):
                raw, starts, ends, _ = words(part)
                h, c = np.unique(word_hashes(raw, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counted = space.cut(counted, "words")
    shared = np.zeros(RARE, np.int64)
    for r in counted.groupBy(F.pmod("h", F.lit(RARE)).alias("k")).agg(F.sum("c").alias("c")).collect():
        shared[r["k"]] = r["c"]
    total = int(shared.sum())
    top = counted.where(F.col("c") >= math.sqrt(total) / RULE).collect()
    if len(top) < least:
        top = counted.orderBy(F.desc("c"), "h").limit(least).collect()
    space.drop("words")
    top.sort(key=lambda r: (-r["c"], r["h"]))
    known, counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    np.subtract.at(shared, (known % np.uint64(RARE)).astype(np.int64), counts)
    return known, np.concatenate([shared, counts]), total


TRAINED = "shard long, i long, v binary, w double"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, shard_tokens: int = SHARD) -> tuple[Network, Spelling]:
    """The network, trained on every token of the corpus, and the spelling of all words outside its vocabulary.

    Shards of about ``shard_tokens`` tokens (at most SHARDS of them; beyond that they are longer) run over their own texts
    from a common start, and weights are averaged in the cluster, by tokens seen, FAN shards at a
    time. What is shuffled and learned grows with the input; what comes to the driver is one set of
    weights and the counts of byte trigrams. Texts stream through a task, so memory does not grow with a shard.

    Defined cases: null and wordless texts train nothing. Rows of equal id go by text, so repeated rows and null ids are
    no matter; copies train as often as they occur. Further columns are ignored, whatever their names. No rows: the network as it starts.
    """
    spark = docs.sparkSession
    known, counts, total = vocabulary(docs, text_col)
    shared = spark.sparkContext.broadcast((known, counts))
    shards = max(1, min(SHARDS, -(-total // shard_tokens)))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def local(batches):
        trigrams, now, own = np.zeros(1 << 24, np.int64), None, None

        def weights():
            if own and own.seen + own.size > 2:
                flat = own.finish().flat()
                if own.seen:
                    lows = range(0, len(flat), BLOCK)
                    yield _rows([now] * len(lows), list(lows), [flat[lo : lo + BLOCK].tobytes() for lo in lows], [float(own.seen)] * len(lows))

        for batch in batches:
            shard_of = batch.column("shard").to_numpy()
            texts = batch.column("text")
            edges = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), len(shard_of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shard_of[a] != now:
                    yield from weights()
                    now, own = int(shard_of[a]), Shard(Network(*shared.value), rate)
                last = None
                for first, part in pieces(texts.slice(a, b - a)):
                    if last is not None and first != last:
                        own.add(np.zeros(0, np.int32), True)
                    raw, starts, ends, lengths = words(part)
                    ids = own.net.ids(word_hashes(raw, starts, ends))
                    rare = ids <= RARE
                    (x, y, z), _ = spelled(raw, starts[rare], ends[rare])
                    np.add.at(trigrams, (x.astype(np.int64) << 16) | (y.astype(np.int64) << 8) | z, 1)
                    at = 0
                    for k, n in enumerate(lengths.tolist()):
                        own.add(ids[at : at + n], k < len(lengths) - 1)
                        at += n
                    last = first + len(part) - 1
                own.add(np.zeros(0, np.int32), True)
        yield from weights()
        codes = np.flatnonzero(trigrams)
        yield _rows([None] * len(codes), codes, [None] * len(codes), trigrams[codes].astype(np.float64))

    space = Workspace(spark, "trained")
    sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text").select("shard", "text")
    trained = space.cut(sorted_.mapInArrow(local, TRAINED), "shards")
    means, span = trained.where("shard IS NOT NULL").withColumnRenamed("shard", "k"), shards
    while True:
        groups = means.withColumn("g", F.floor(F.col("k") / FAN)).groupBy("i", "g")
        means, span = groups.applyInArrow(_sums(span == shards), "i long, k long, v binary, w double"), -(-span // FAN)
        if span == 1:
            break
    flat = Network(known, counts).flat()
    for r in means.collect():
        flat[r["i"] : r["i"] + BLOCK] = np.frombuffer(r["v"], np.float64) / r["w"]
    found = trained.where("shard IS NULL").groupBy("i").agg(F.sum("w").alias("w")).orderBy("i").toArrow()
    space.drop("shards")
    spelling = Spelling(found["i"].to_numpy(), found["w"].to_numpy())
    return Network(known, counts, flat), spelling


def _rows(shard, i, v, w) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.binary()), pa.array(w, pa.float64())], ["shard", "i", "v", "w"])


def _sums(first: bool):
    """Sums of weights by tokens seen, in the order of shards (k); ``first`` for weights as they were trained."""

    def of(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part["k"].to_pylist(), part["v"].to_pylist(), part["w"].to_pylist(), strict=True))
        total = sum(np.frombuffer(v, np.float32).astype(np.float64) * w if first else np.frombuffer(v, np.float64) for _, v, w in rows)
        return pa.table({"i": part["i"].slice(0, 1), "k": part["g"].slice(0, 1), "v": [total.tobytes()], "w": [sum(w for *_, w in rows)]})

    return of


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", spelling: Spelling | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob``: the summed conditional log-probabilities of whole texts.

    With ``spelling``, a word outside the vocabulary has the probability of its shared id
    times its own among the id's words, of which each id has 1 / RARE by hash; without, all
    words of a shared id score alike. Each text is scored for itself, so its score does not depend on its neighbours.

    Defined cases: null and wordless texts have no tokens, a sum of 0 and a null
    mean. Repeated rows each get the same score; null ids stay; further columns are
    ignored, whatever their names. A very long text is split into words piece by piece and held as ids.
    There are no ties. Without any documents there are no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.counts, net.flat(), spelling))

    def run(batches: Iterator[pa.RecordBatch]):
        *weights, letters = shared.value
        own = Network(*weights)
        for batch in batches:
            sums, sizes, open_, last = np.zeros(len(batch)), np.zeros(len(batch), np.int64), [], None

            def close(i, ids):
                stream = np.concatenate([np.zeros(2, np.int32), *ids, np.zeros(2, np.int32)])
                for lo in range(2, len(stream) - 2, CHUNK):
                    at = np.arange(lo, min(lo + CHUNK, len(stream) - 2))
                    sums[i] += own.log_probs(own.neighbours(stream, at), stream[at].astype(np.int64)).sum()
                sizes[i] = len(stream) - 4

            for first, part in pieces(batch.column("text")):
                if last is not None and first != last:
                    close(last, open_)
                    open_ = []
                raw, starts, ends, lengths = words(part)
                ids = own.ids(word_hashes(raw, starts, ends)).astype(np.int32)
                if letters:
                    rare = np.flatnonzero(ids <= RARE)
                    owner = np.repeat(np.arange(len(part)), lengths)[rare]
                    sums[first : first + len(part)] += np.bincount(owner, letters.log_probs(raw, starts[rare], ends[rare]) + math.log(RARE), len(part))
                at = 0
                for k, n in enumerate(lengths.tolist()):
                    if k:
                        close(first + k - 1, open_)
                        open_ = []
                    open_.append(ids[at : at + n])
                    at += n
                last = first + len(part) - 1
            if last is not None:
                close(last, open_)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums)], ["doc_id", "n_tokens", "log_prob"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, log_prob double").withColumn(
        "mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    )


def op1_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net, spelling = train(docs)
    return score(docs, net, spelling=spelling)
