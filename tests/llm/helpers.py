"""Small tables with the awkward rows that every operator must take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang) or (doc_id, text, lang, source)."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s in full], DOC_SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return docs(spark, [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (4, "one two"), (None, "a b c d"), (6, long, "en", "s"), (7, long, None, "s"), (8, "9" * 30_000), (9, "+" + " " * 20_000 + "@" * 5000)])


def clashing(df):
    """The same with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    out = df
    for name in ("fp", "found", "items", "n_words", "n_hit", "spans", "cands", "c", "component_id", "probability", "topic", "key", "block", "rank", "n_tokens", "contaminated"):
        out = out.withColumn(name, F.lit("x"))
    return out
