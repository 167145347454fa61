import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, node string, spans int, n_words int"
LONG = "\n".join(f"word{n} follows word{n + 1} here" for n in range(4000))
LINES = "first line of it\nsecond line of it\nthird line of it\nfourth line of it"
CASES = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a"),
    (2, LINES, "en", "a"),
    (3, "before it\n" + LINES + "\nafter it", "en", "b"),
    (3, "before it\n" + LINES + "\nafter it", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, LONG, "en", "a"),
    (7, "  \n\n \t ", "de", "a"),
    (8, "!!! ### 123 456", "de", "a"),
    (None, "der Hund und die Katze", "de", "a"),
    (None, None, None, None),
    (9, "日本語のテキスト \U0001d400\U0001d401 café", "fr", "c"),
    (10, "a a a a a a a a a a a a a a a a", "en", "a"),
    (11, "x" * 50_000, "en", "a"),
]


@pytest.fixture(scope="session")
def cases():
    return CASES


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*c, len(c[1] or ""), 1, "n", 2, 3) for c in CASES], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
