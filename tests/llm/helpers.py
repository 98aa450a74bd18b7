"""Small corpora that every operator must survive."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text."""
    return [
        (1, None, None),
        (2, "", "a"),
        (3, " \n\t ", "a"),
        (4, "one two three four five", "a"),
        (5, "one two three four five", "b"),
        (5, "one two three four five", "b"),
        (6, "word " * 30000, "b"),
        (7, "naïve Ünïcode tëxt 文字 mixed", None),
        (8, "x" * 5000, "c"),
    ]
