import pytest

#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, ties, odd white space, other alphabets.
ODD = [
    (None, "a text without an id that goes on for more than five words", "en"), (1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "one", "en"), (4, "one", "en"), (5, "one", None),
    (6, "Don't  stop!\r\nLine two é́ 日本語 🙂🙂 'sabc 1234", "en"), (7, "word " * 400, "en"), (8, "x" * 3000, "de"), (9, "Released under the MIT License.\n***\n***", "en"),
    (10, "a b c d e f g h i j k l m n o p", "fr"), (11, "z a b c d e f g h i j k l m n o p", "fr"), (12, "<|endoftext|> \x00\x0b ★ end ", "es"),
]
EXTRA = ["n_words", "_row", "version", "kept"]


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 7, "r", 1.5, False) for r in ODD], "doc_id long, text string, lang string, n_words int, _row string, version double, kept boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
