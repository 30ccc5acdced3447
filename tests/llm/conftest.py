import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, score double"


def document_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and ids."""
    long = " ".join(f"word{k % 977} tail{k % 13}," for k in range(30_000))
    texts = ["The quick brown fox jumps. Over it, the lazy dog!", "", None, "   \n\t ", "É à la carte — 12 % déjà vu.\x1c\xa0x", long, "one", "two words", "<|endoftext|> stays", "The quick brown fox jumps. Over it, the lazy dog!"]
    rows = [(k, t, "en", f"s{k % 3}", 0, "clash", k, 0.5) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (0, "another text under a known id", "fr", None, None, None, None, None), (None, "no id here", None, "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
