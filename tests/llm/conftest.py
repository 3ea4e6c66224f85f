import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeats, odd characters, and columns whose names clash with outputs."""
    base = "The quick brown fox jumps over the lazy dog while seven wizards box with jovial quartz judges near the bank of the river."
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, "   \n\t ", "en", None), (3, "12345 !!! ???", None, "a"),
        (4, base, "en", "a"), (5, base, "en", "b"), (6, base.replace("seven", "eight"), "en", "b"), (7, base.upper(), "en", "b"),
        (8, "Ünïcödé 中文字符 without many spaces 😀😀 naïve café", "fr", "c"), (9, LONG, "la", "c"), (10, LONG, "la", "c"),
        (11, "one\ntwo\n" + base + "\nthree", None, "d"), (12, "x" * 30000, "en", "d"), (13, "a b", "en", "d"), (14, "A  b", "en", "d"),
        (15, "\x00\x01 control \x1c chars\x85 and spaces", "en", "e"), (100, "it's <|endoftext|> we'll", "en", "e"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), 7, "clash", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start long, removed string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_texts(odd_docs):
    return sorted((r["doc_id"], r["text"]) for r in odd_docs.collect())
