"""Line deduplication with DataFrame functions only.

Lines are exploded with their positions, their normalised forms hashed to 128
bits, documents counted per hash, and documents put together again from the
lines that stay, by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, HOT_KEYS, Workspace, ascii_lower, spread_join, table


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    min_chars: int = 10,
    min_docs: int = 2,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share, but for the one of smallest id.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased; keys under ``min_chars`` code points are never dropped. Returns
    ``doc_id, text, n_lines, n_dropped`` and the columns named in ``carry``;
    further input columns are ignored, so their names cannot clash.

    Defined cases: a null or empty text is one empty line and comes back as an
    empty text. Rows of the same id are one document when documents are counted,
    and each row stays. A row without an id counts for no document and keeps all
    its lines. A document all of whose lines go has the text ''; no rows, no rows.
    There are no ties: the smallest id keeps a line, in all places it has it. A very long text is
    exploded into rows and put together again as one array of its lines.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry
    ).withColumn("_row", F.xxhash64("text"))
    space, key = Workspace(docs.sparkSession, "lines"), F.col("_key")
    lines = (
        base.where(F.col("doc_id").isNotNull())
        .select("doc_id", "_row", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("_pos", "_line"))
        .select("doc_id", "_row", "_pos", F.btrim("_line", F.lit(BLANKS)).alias("_key"))
        .where(F.length(key) >= min_chars)
        .select("doc_id", "_row", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("second"), key).alias("_h2"))
    )
    # With a limit of two, a smallest id unlike the largest is a count of two, and
    # both combine before the shuffle, so a line in a third of all documents is cheap.
    enough = F.min("doc_id") < F.max("doc_id") if min_docs == 2 else F.count_distinct("doc_id") >= min_docs
    lines = space.cut(lines, "lines")
    found = lines.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"), enough.alias("_enough"))
    shared = space.cut(found.where("_enough").drop("_enough"), "shared", space.rows["lines"] // 2, 40)
    # Lines of a very frequent key are dealt to several tasks.
    total = shared.agg(F.sum("_n")).first()[0] or 0
    drops = (
        spread_join(lines, shared, ["_h1", "_h2"], ["doc_id", "_row", "_pos"], "_n", total, hot_keys)
        .where(F.col("doc_id") != F.col("_first"))
        .groupBy("doc_id", "_row")
        .agg(F.collect_set("_pos").alias("_drops"))
    )
    drops = space.cut(drops, "drops", total, 40)
    space.drop("lines", "shared")
    split = F.split("text", "\n")
    # The stretches between dropped positions, so that the work is linear in the lines.
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("_edges") - 2),
        lambda j: F.slice(
            F.col("_lines"),
            F.get("_edges", j) + 2,
            F.get("_edges", j + 1) - F.get("_edges", j) - 1,
        ),
    )
    joined = base.join(drops, ["doc_id", "_row"], "left").select(
        "doc_id", "text", *carry, F.coalesce("_drops", F.array().cast("array<int>")).alias("_drops"), split.alias("_lines")
    )
    marked = joined.withColumn(
        "_edges",
        F.sort_array(F.concat(F.array(F.lit(-1)), "_drops", F.array(F.size("_lines")))),
    )
    return marked.select(
        "doc_id",
        F.when(F.size("_drops") == 0, F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n")).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_drops").cast("long").alias("n_dropped"),
        *carry,
    )


def op3_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
