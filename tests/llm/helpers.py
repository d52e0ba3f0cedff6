"""Awkward documents that every operator must take: nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, d string, gone string, word string"
LONG = "the quick onan erthe fox is ention " * 4000


def rows(texts, start=1):
    return [(i, t, "en", "s", len(t) if t is not None else None, 0.5, "x", "y", "z", "w") for i, t in enumerate(texts, start)]


def awkward():
    base = rows(["", None, "Les.", "one two three four five six seven eight nine ten\nsecond line here", "one two three four five six seven eight nine ten\nsecond line here", LONG, "é" * 3000, "\n\n\n", "   ", "🙂 你好 don't 'll 12 AB"])
    r = base[3]
    return base + [r, (None, r[1], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def frame(spark, data=None):
    return spark.createDataFrame(awkward() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
