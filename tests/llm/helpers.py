from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """From (doc_id, text) or (doc_id, text, lang) rows."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCS)


def clashing(df):
    """The same rows with columns that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("key", "h", "d", "n", "k", "ws", "id", "x", "score", "items", "spans", "copies", "component")})
