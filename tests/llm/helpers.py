"""Small inputs with the awkward rows that every operator has to take."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key double, h long"


def doc_frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones; rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None, "x", 1.0, 7) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


AWKWARD = [
    (1, None, None),
    (2, "", "s0"),
    (3, " \t\n", "s1"),
    (None, "a row without id", "s0"),
    (5, "the same text twice", "s2"),
    (5, "the same text twice", "s2"),
    (6, "the same text twice", None),
]
