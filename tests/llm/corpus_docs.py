"""Small documents tables; the extra columns clash with names used inside the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, keep_id string, words int, score string"


def make_docs(spark, texts, start=0, lang="en"):
    """Documents with ids from ``start``."""
    return spark.createDataFrame([(start + i, t, lang, "s", 0, "x", "y", 3, "z") for i, t in enumerate(texts)], SCHEMA)
