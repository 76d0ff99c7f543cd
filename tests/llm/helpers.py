"""Fixtures with the awkward rows that every operator must take."""

LONG = ("lorem ipsum dolor sit amet " * 4000).strip()
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, "  \n\t\n ", "en", "a", 5),
    (5, LONG, "en", "a", 1),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today", "fr", "a", 10),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today", "fr", "a", 10),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
    (7, "ÉTÉ déjà vu, naïve façade 日本語 😀 — ok\nThe same shared line of text\n", "fr", "b", 3),
    (8, "the SAME shared line of text\t\nother\nother", "en", "b", 3),
    (9, "1234 5678 !!! ###", "de", None, 3),
    (10, "a", "es", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["n_words", "kept", "ids", "spans", "items", "score", "n_lines", "_text", "rejected", "regs", "component_id", "set", "decoded", "n_dropped"]


def edge_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql, **tables):
    """Rows of a DuckDB query over Spark frames."""
    import duckdb

    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    r = c.sql(sql)
    return [c[0] for c in r.description], r.fetchall()


def same(df, sql, **tables):
    """The frame's rows are those of the SQL, by column name."""
    columns, found = duck(sql, **tables)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(found, key=key)
    return len(got)
