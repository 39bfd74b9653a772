"""Small documents tables with the awkward cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row int, mark string"


def docs(spark, texts, lang="en", source="s"):
    """texts: doc_id -> text, or (doc_id, text) pairs. The last three columns clash with internal names."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, "y") for i, t in pairs], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
