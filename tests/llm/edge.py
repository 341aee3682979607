"""Documents with every awkward case, and columns whose names clash with those the operators make."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, n_words string, score string, copies long, h string, ids string, n_lines string, starts int, rank int"
PLAIN = (
    "The quiet river {i} went past an old house where people {i} had lived for many years and {i} nobody knew their names or why {i} they left when winter came to "
    "this {i} valley with its long nights and deep {i} snow on roofs that were never mended {i} because someone said spring would bring better {i} weather, new roads, more trade "
    "and perhaps {i} another chance at building what was lost {i} before all of it began."
)
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "word", "en", "a", 4), (5, "one two three", "de", None, 13),
    (6, PLAIN.format(i=6), "en", "a", 300), (7, PLAIN.format(i=6), "en", "b", 300), (8, PLAIN.format(i=8), None, "b", 300), (8, PLAIN.format(i=8), None, "b", 300),
    (9, "long " + " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1), (10, "x" * 200_000, "en", "a", 1), (11, "ünïcödé 漢字 😀 " * 30, "fr", "b", 1), (None, PLAIN.format(i=99), "en", "b", 1),
    (12, "same line of ten words which is here for a test\n" * 30, "en", "b", 1), (13, "!!! ### $$$ 123", "en", "c", 1),
]


def documents(spark):
    rows = [(*r, True, 0, "x", "y", 5, "h", "i", "l", 3, 4) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark).limit(0)
