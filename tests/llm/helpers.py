"""Tables for the tests of this folder."""

#: Schema with extra columns whose names clash with those that operators make.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, score string, name string, block int, size string, kept string"


def documents(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1]), "u", "x", "n", 7, "z", "k") for r in rows]
    return spark.createDataFrame(full, DOCS)
