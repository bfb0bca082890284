"""Rows with nulls, empty and long texts, ties and repeats, and names that clash."""

#: Names that operators use themselves or return, as extra columns.
CLASHES = [
    "n_words", "kept", "score", "predicted", "passages", "size", "taken", "target", "start", "length", "sequence_id", "offset", "fingerprint", "component_id", "fp", "id", "hash", "none", "n_tokens", "n_bytes",
    "media", "shard", "slot", "key", "part", "payload", "first", "__row", "__text", "__size", "__key", "__part", "__salt", "bin", "unit", "p",
]
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(12000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away " * 6, "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", "fr", "b", 0),
    (4, " \t\n\x0b\x0c\r ", "fr", None, 7),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Élan vital à l'œuvre <|endoftext|> #1 $2 日本語 😀  spaces   here\n\nline\nline\n", "fr", "b", 1),
    (7, "same text for two documents of one class indeed it is the very same", "en", "a", 1),
    (8, "same text for two documents of one class indeed it is the very same", "en", "b", 1),
    (8, "same text for two documents of one class indeed it is the very same", "en", "b", 1),
    (9, "one", "de", "c", 3),
    (None, "a document without an id but with a few words of its own to keep", "de", "c", 3),
    (None, None, None, None, None),
    (10, "\x1fctrl\x1c words\x85 İstanbul ΣΑΣ don't we'll 12 345,6.7!", "de", "", 5),
]
#: Rows that are all alike, a source of rows that are alike by threes, and one without repeats.
REPEATS = [(1, "a", "en", "s", 1)] * 1000 + [(2, "two words", "en", "t", 9)] * 3 + [(3, "more than three words here", "en", "t", 26)] * 3 + [(4, "one two three", "en", None, 13), (None, "x y", "en", None, 3), (None, "x y", "en", None, 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df
