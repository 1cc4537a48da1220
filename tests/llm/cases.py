"""Small tables for the tests of the training-data operators."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PASSAGE = " ".join(f"{w}{k}" for k in range(5) for w in WORDS)
LONG = " ".join(f"{w}{k}" for k in range(1500) for w in WORDS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed: int, n: int = 80) -> str:
    return " ".join(WORDS[(seed * 7 + k * (k + seed)) % 20] + str((seed * k) % 13) for k in range(n))


ROWS = [
    (1, text(1), "en", "a", 1),
    (2, text(2) + " " + PASSAGE, "en", None, 2),
    (3, "Ünïcödé Straße " + PASSAGE + " ende", "de", "b", None),
    (4, None, "en", "a", 0),
    (5, "", None, "a", 0),
    (6, " \t\n ", "en", "a", 3),
    (7, text(1), "en", "a", 1),
    (7, text(1), "en", "a", 1),
    (8, "### !!! 123 $$$", "fr", "c", 1),
    (9, LONG, "en", "a", 1),
    (10, LONG + " more", "en", "a", 1),
    (None, text(1), "en", "a", 1),
    (None, text(11), None, None, None),
    (11, "one", "de", "b", 1),
    (12, "Eins zwei drei", "de", "b", 1),
    (13, "日本語 の テキスト 😀 naïve", "ja", "b", 1),
]
CLASHING = ["key", "th", "chunk", "fp", "hash", "kind", "bucket", "score", "lang_pred", "kept", "own", "other", "n", "code", "pos", "word", "term", "t", "row", "u", "v", "root"]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=ROWS):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return table(spark, rows).withColumns({c: F.lit(7) for c in CLASHING})


def saved(df, folder, name="documents"):
    """A directory of tables, as the queries read it."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
