"""Small tables with every awkward case, shared by the operator tests."""

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names operators use themselves."""
    prose = "The river ran past the old mill, and the miller watched it go by every single morning of the year."
    rows = [
        (1, prose, "en", "s", 1, 0.5, "x", 7),
        (1, prose, "en", "s", 1, 0.5, "x", 7),
        (2, prose.upper(), "en", None, None, None, None, None),
        (3, None, "en", "s", 0, 0.1, "y", 8),
        (4, "", None, "s", 0, 0.2, "z", 9),
        (5, " \n\t ", "de", "s", 3, 0.3, "z", 9),
        (6, "12345 ... !!", "de", "s", 3, 0.3, "z", 9),
        (7, "Der Fluss zog an der alten Mühle vorbei und der Müller sah ihm jeden Morgen nach. " * 2000, "de", "s", 1, 0.9, "q", 1),
        (8, "x" * 50_000, "en", "s", 1, 0.9, "q", 1),
        (9, "日本語のテキスト 🙂 é \x00 ​", "en", "s", 1, 0.9, "q", 1),
        (None, prose + " It never came back.", "en", "s", 1, 0.9, "q", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, found string, key long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_pages(spark):
    long = "<p>" + "Long paragraph, with commas, and so on. " * 3000 + "</p>"
    same = "<html><body><article><p>" + "Copy of a page, word for word. " * 60 + "</p></article></body></html>"
    rows = [
        (1, "http://a/1", same, "t", 1), (2, "http://a/2", same, "t", 1), (3, None, same, None, None), (3, None, same, None, None),
        (4, "http://a/4", None, "t", 1), (5, "http://a/5", "", "t", 1), (6, "http://a/6\r\nX: y", "<p>short", "t", 1),
        (7, "http://a/7", "<p>short", "t", 1), (8, "http://a/8", long, "t", 1), (None, "http://a/n", same, "t", 1),
        (9, "http://a/9", "<<<a <b <p class='x>&amp;&#x41;&bogus;</ <!-- never closed", "t", 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, digest int")
