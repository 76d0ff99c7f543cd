"""Near-duplicate detection by HyperMinHash.

One hash a shingle picks a bucket; a bucket keeps the smallest rest of its hashes
as a leading-zero count and ten bits of mantissa, 16 bits in all. Bands of these
registers propose pairs, the share of equal registers, corrected for chance
collisions, sorts out the hopeless, and full shingle sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Workspace, copies_of, may_match, small_batches, spread_join, stretches, table
from .components import components
from .shingles import U, mix, shingles

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
ROWS = 4
BANDS = BUCKETS // ROWS
#: Chance that registers of different minima agree: equal leading-zero counts (1/3) and mantissas.
CHANCE = 2.0**-MANTISSA_BITS / 3
#: A set of fewer than SURE * BUCKETS shingles has buckets without any, which borrow; its estimate sorts nothing out.
SURE = 4
#: Where an empty bucket looks for a register to borrow, one random order a bucket.
_BORROW = np.stack([np.random.default_rng(7 + i).permutation(BUCKETS) for i in range(BUCKETS)])
SKETCH = "doc_id long, n long, f1 long, f2 long, regs binary"


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers (uint16, texts by BUCKETS) of sorted shingle hashes; a text without any gets zeros."""
    n = len(offsets) - 1
    regs = np.zeros((n, BUCKETS), np.uint16)
    if not len(hashes):
        return regs
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (hashes >> U(64 - BUCKET_BITS)).astype(np.int64)
    slot = owner * BUCKETS + bucket
    new = np.concatenate(([True], slot[1:] != slot[:-1]))  # sorted hashes: the first of a bucket is its smallest
    rest = hashes[new] << U(BUCKET_BITS)
    _, exponent = np.frexp((rest >> U(11)).astype(np.float64))
    zeros = np.where(rest == 0, 64 - BUCKET_BITS, 53 - exponent).astype(np.uint64)
    mantissa = np.where(zeros < 63, rest << (zeros + U(1)), U(0)) >> U(64 - MANTISSA_BITS)
    regs.reshape(-1)[slot[new]] = ((zeros << U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    full = np.zeros((n, BUCKETS), bool)
    full.reshape(-1)[slot[new]] = True
    filled = full.any(axis=1)
    rows, cols = np.nonzero(~full & filled[:, None])
    source = regs.copy()
    for t in range(BUCKETS):
        if not len(rows):
            break
        look = _BORROW[cols, t]
        hit = full[rows, look]
        regs[rows[hit], cols[hit]] = source[rows[hit], look[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return regs


def estimate(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance collisions."""
    equal = (left == right).mean(axis=1)
    return np.clip((equal - CHANCE) / (1 - CHANCE), 0, 1)


def _sketches(batches):
    for batch in batches:
        texts = batch.column("text")
        for a, b in stretches(texts):
            hashes, offsets = shingles(texts.slice(a, b - a))
            size = np.diff(offsets)
            f = np.zeros((2, b - a), np.uint64)
            if len(hashes):
                some = np.flatnonzero(size)
                for k, salt in enumerate((U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))):
                    f[k, some] = np.add.reduceat(mix(hashes ^ salt), offsets[some])
            regs = registers(hashes, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(size), *(pa.array(x.view(np.int64)) for x in f),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "n", "f1", "f2", "regs"],
            )


def _sets(batches):
    for batch in batches:
        texts = batch.column("text")
        for a, b in stretches(texts):
            hashes, offsets = shingles(texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64))),
                ],
                ["doc_id", "n", "set"],
            )


def _estimates(batches):
    for batch in batches:
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb")
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("n_a"), pa.array(estimate(left, right), pa.float64())], ["a", "b", "n", "estimate"]
        )


def _with_end(pairs: DataFrame, ends: DataFrame, end: str, other: str, total: int, hot_keys: int) -> DataFrame:
    """Pairs with the row of ``ends`` (doc_id and more) of one end, whose columns get its name behind theirs."""
    many = pairs.groupBy(end).agg(F.count("*").alias("_many"))
    small = ends.select(*(F.col(c).alias(end if c == "doc_id" else f"{c}_{end}") for c in ends.columns)).join(many, end)
    return spread_join(pairs, small, [end], [other], "_many", total, hot_keys).drop("_many")


def _of_ends(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``rows`` that may be of an end of the pairs; one filter for both ends."""
    return may_match(rows, pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct()), "doc_id")


def _linked(space: Workspace, pairs: DataFrame, total: int, regs: DataFrame, sets: DataFrame, percent: int, margin: float, hot_keys: int) -> DataFrame:
    """Those pairs (a, b), of a written table, whose full sets overlap enough.

    The estimate sorts out pairs that lie ``margin`` below the limit; where a set has so few shingles
    that buckets borrow from each other, it has no say.
    """
    if not total:
        return pairs
    regs = _of_ends(regs, pairs)
    both = _with_end(_with_end(pairs, regs, "b", "a", total, hot_keys), regs, "a", "b", total, hot_keys)
    sized = both.where(f"100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a").select("a", "b", "n_a", F.col("regs_a").alias("ra"), F.col("regs_b").alias("rb"))
    found = sized.mapInArrow(_estimates, "a long, b long, n long, estimate double")
    likely = space.cut(found.where((F.col("estimate") >= percent / 100 - margin) | (F.col("n") < SURE * BUCKETS)).select("a", "b"), name := f"likely{len(space.names)}", total)
    total, sets = space.rows[name], _of_ends(sets.select("doc_id", "set"), likely)
    full = _with_end(_with_end(likely, sets, "b", "a", total, hot_keys), sets, "a", "b", total, hot_keys)
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return full.where(100 * common >= percent * union).select("a", "b")


def _rest(space: Workspace, members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, hot_keys: int) -> DataFrame:
    """Pairs that may link yet, between components that meet in a bucket.

    The exact way for buckets whose smallest member does not settle them: of the
    documents in buckets with several components, two that link share one of their
    rarest shingles (the prefix filter), so those are the keys of a further join.
    A document with more unshared shingles than a link allows drops out. In each
    key only members outside its largest component look for partners, and only
    pairs whose shingles from the common one on can still reach the overlap that
    their sizes ask for (the positional filter; a linking pair passes at its first common shingle).
    Members of a frequent key are dealt to several tasks.
    """
    known = members.join(labels, members["rep"] == labels["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    mixed = space.cut(mixed, "mixed", space.rows["members"], 16)
    open_ = space.cut(spread_join(known, mixed, ["key"], ["rep"], "n", space.rows["members"], hot_keys).select("rep", "comp").distinct(), "open", space.rows["members"])
    # Sets of a few others may pass here: any order of the shingles that holds for all of them will do, and the join with open_ below is exact.
    some = may_match(sets.withColumnRenamed("doc_id", "rep"), open_, "rep")
    tokens = some.select("rep", "n", F.explode("set").alias("token"))
    tokens_in_all = some.agg(F.sum("n")).first()[0] or 0
    common = space.cut(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "common", tokens_in_all // 2, 16)
    ranked = (
        spread_join(tokens, common, ["token"], ["rep"], "f", tokens_in_all, hot_keys)
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s"))
        # 1 + n - ceil(percent * n / 100) of the rarest, those nobody shares first
        .withColumn("left", (1 + F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) - (F.col("n") - F.size("s"))).cast("int"))
        .where("left > 0")
        .select("rep", "n", (F.col("n") - F.size("s")).alias("u"), F.posexplode(F.slice("s", F.lit(1), F.col("left"))).alias("i", "t"))
        # what a pair can share from its first common shingle on
        .select("rep", "n", F.col("t.token").alias("token"), (F.col("n") - F.col("u") - F.col("i")).alias("tail"))
        .join(open_, "rep")
    )
    keys = space.cut(ranked, "prefixes", tokens_in_all)
    total = space.rows["prefixes"]
    sizes = keys.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("f")).where("k > 1").drop("k")
    main = space.cut(main, "main", total // 2, 24)
    meet = space.cut(spread_join(keys, main, ["token"], ["rep"], "f", total, hot_keys), "meet", total, 48)
    # Those outside the largest component are dealt to so many copies of the key's members.
    copies = copies_of(main, ["token"], "f", total, hot_keys)
    minor = meet.where("comp <> main").withColumn("copy", F.pmod(F.xxhash64("rep"), copies).cast("int"))
    other = meet.select("token", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("tail").alias("tail2"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    near = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    enough = (100 + percent) * F.least("tail", "tail2") >= percent * (F.col("n") + F.col("n2"))
    return (
        minor.join(other, ["token", "copy"])
        .where((F.col("comp") != F.col("comp2")) & near & enough)
        .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, margin: float = 0.2, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents link when 100 * intersection >= percent * union of their sets of
    distinct five-word shingles, confirmed on full sets; a component's id is its
    smallest doc_id, and kept is true for that document. ``percent`` is 80 or
    more. A link is proposed by 32 bands of four registers, of which a pair at
    0.8 shares none with a chance under one in ten million; the estimate drops a pair
    only if it lies ``margin`` (over five deviations) below the limit.

    Texts with equal sets are one node from the start, so groups of copies never
    pair up. In each band bucket members are compared with the smallest one, and
    what that leaves open goes through _rest; no step lists all pairs of a group. Keys
    with over 1/hot_keys of the rows of a join are dealt to several tasks. The result is a table in the shared
    folder; those in between are deleted.

    Defined cases: a null or wordless text has no shingles and links with nothing,
    not even with its like. Rows of one id are one node. A row without an id takes
    no part, has a null component_id and is kept. A pair at exactly the limit links. A very long text is
    hashed alone, in memory of some multiple of its length. Further columns are ignored, whatever their names. No rows, no rows.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more: the bands are laid out for that")
    small_batches(docs.sparkSession)
    space = Workspace(docs.sparkSession, "near")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = space.cut(base.mapInArrow(_sketches, SKETCH), "sketches")
    real = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = space.cut(
        real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.count("*").alias("copies")), "classes", space.rows["sketches"], 320
    )
    bands = classes.select(
        "rep",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda i: F.xxhash64(i, F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
            )
        ).alias("key"),
    )
    shared = bands.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("many")).where("first < last").drop("last")
    shared = space.cut(shared, "shared", BANDS * space.rows["classes"] // 2, 24)
    members = space.cut(spread_join(may_match(bands, shared, "key"), shared, ["key"], ["rep"], "many", BANDS * space.rows["classes"], hot_keys).drop("many"), "members", BANDS * space.rows["classes"])
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = space.cut(may_match(base, ids, "doc_id").join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, n long, set array<long>"), "sets")
    regs = classes.select(F.col("rep").alias("doc_id"), "n", "regs")
    stars = space.cut(members.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars", space.rows["members"], 16)
    first = space.cut(_linked(space, stars, space.rows["stars"], regs, sets, percent, margin, hot_keys), "links", space.rows["stars"], 16)
    labels = space.cut(components(first, hot_keys=hot_keys, rows=space.rows["links"]), "labels", 2 * space.rows["links"], 16)
    open_ = space.cut(_rest(space, members.select("key", "rep"), sets, labels, percent, hot_keys), "open_pairs", space.rows["members"], 16)
    more = _linked(space, open_, space.rows["open_pairs"], regs, sets, percent, margin, hot_keys)
    renamed = (
        more.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    joined = components(renamed, hot_keys=hot_keys, rows=space.rows["open_pairs"])
    # Components of components: the many nodes of one are dealt by their ids.
    many = labels.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("n"))
    moved = joined.join(many, "node").select(F.col("node").alias("c1"), F.col("component").alias("c2"), "n")
    inner = labels.select("node", F.col("component").alias("c1"))
    final = (
        spread_join(inner, moved, ["c1"], ["node"], "n", space.rows["labels"], hot_keys).select("node", F.col("c2").alias("comp"))
        .unionByName(inner.join(moved.select("c1"), "c1", "left_anti").select("node", F.col("c1").alias("comp")))
        .unionByName(joined.join(labels, "node", "left_anti").select("node", F.col("component").alias("comp")))
    )
    by_class = classes.select("f1", "f2", "n", "rep", "copies").join(final, F.col("rep") == F.col("node"), "left").select(
        "f1", "f2", "n", "copies", F.coalesce("comp", "rep").alias("component_id")
    )
    linked = spread_join(real.drop("regs"), by_class, ["f1", "f2", "n"], ["doc_id"], "copies", space.rows["sketches"], hot_keys, classes)
    alone = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    rows = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    result = space.cut(rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result", space.rows["sketches"])
    space.drop_others("result")
    return result


def op9_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen
), comp AS (SELECT node, min(seen) AS least FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(least, d.doc_id), d.doc_id) AS component_id,
       d.doc_id = least(coalesce(least, d.doc_id), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""
