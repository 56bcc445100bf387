"""Small inputs with the awkward rows that every operator must take."""

import duckdb

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """rows: (doc_id, text) or whole rows; without a text of their own the other columns are filled in."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC)


def awkward(spark, rows=()):
    """Nulls in every column, empty and very long texts, repeated rows and equal ids, beside the given rows."""
    long = "word after word and then, one more " * 30_000
    odd = [(None, None, None, None, None), (900, None, "en", None, 0), (901, "", None, "s", None), (902, long, "en", "s", len(long)), (903, "same\nrow", "en", "s", 8), (903, "same\nrow", "en", "s", 8), (None, "no id but text", "en", "s", 14), (904, " \t\n ", "de", "s", 4)]
    return documents(spark, [*rows, *odd])


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = "h1 h2 th pos key part size score target copies _id _th _k _n text_sha256 n_words kept fingerprint component_id held_out n_lines n_dropped dropped kept_runs source_size".split()
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


def duck(sql, **tables):
    """Rows and columns of the SQL over pandas tables."""
    c = duckdb.connect()
    for k, v in tables.items():
        c.register(k, v)
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def rows(df, *columns):
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key) if columns else df.collect()
