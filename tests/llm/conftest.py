import pytest

pytest.importorskip("verdara.llm")

#: NULLs, empty and blank texts, repeated rows, equal texts, a long text, odd characters.
LONG = "word " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, None), (3, "", "en"),
    (4, " \n\t ", "de"), (5, "one", None), (5, "one", None), (None, "no id here", "en"),
    (None, None, None), (8, "the quick brown fox jumps over the lazy dog", "fr"),
    (9, LONG, "en"), (10, "Ünïcödé 日本語 text 😀 x\r\n\x0bend", "xx"), (11, "x" * 5000, "en"),
    (12, "a@b.co 1.2.3.4 +1 (803) 555-5351\nMIT License\n\nReleased under the MIT License.", "en")]


@pytest.fixture(scope="session")
def edge_rows():
    return ROWS


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with columns whose names clash with those that operators add or use."""
    return spark.createDataFrame(
        [(k, t, g, "mine", -1, True, 0.5, "z") for k, t, g in ROWS],
        "doc_id bigint, text string, lang string, spans string, n_words int, kept boolean, "
        "score double, _key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
