"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s0", 10),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s0", 10),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s0", 10),
    (3, None, None, None, None),
    (4, "", "en", "s1", 0),
    (5, " \n\t ", "en", "s1", 4),
    (None, "alpha beta", "en", "s1", 10),
    (None, "alpha beta", "en", "s1", 10),
    (6, "Grüße, ñandú: 1ﬁ 漢字 😀 " * 4000, "de", None, 1),
    (7, "word " * 30000, "en", "s0", 1),
    (8, "x" * 200_000, "en", "s0", 1),
    (9, "x" * 200_000, "en", "s0", 1),
    (10, "one", "en", "s0", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "sha", "fp", "t", "n", "tag", "kept", "top", "score", "p", "id2", "n_bytes", "cls")


def awkward(spark, clashing=True):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING if clashing else ():
        df = df.selectExpr("*", f"'{c}!' as {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
