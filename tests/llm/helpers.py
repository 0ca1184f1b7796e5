"""Small tables for the training-data operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, sources=None, extra=None):
    """texts: the text column; ids default to 0, 1, ...; extra: more columns, as (ddl, values)."""
    rows = [(i if ids is None else ids[i], t, "en", (sources[i] if sources else "src0"), len(t or "")) for i, t in enumerate(texts)]
    if extra:
        return spark.createDataFrame([r + tuple(extra[1]) for r in rows], f"{DOCS}, {extra[0]}")
    return spark.createDataFrame(rows, DOCS)
