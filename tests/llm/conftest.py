"""Shared odd inputs: nulls, empty and long texts, repeats, extra columns with clashing names."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, node int, label string, batch binary"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = "Long words keep coming, ere thé end. " * 9000
    rows = [
        (5, None, "en", None, None), (1, "", "en", "s", 0), (2, " \t\n ", None, "s", 3), (3, "The cat sat.", "en", "s", 1), (4, "The cat sat.", "en", "s", 1), (4, "The cat sat.", "en", "s", 1),
        (None, "no id here", "en", None, 1), (7, long_text, "en", "s", 9), (8, "ÀÉ 日本 <|endoftext|> it's  x\u0301 12 %%% \U0001F600", None, "s", 2), (9, "!!! 123 $$$", "fr", "s", 3),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, "l", b"b") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
