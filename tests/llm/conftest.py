import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Awkward rows for every operator on documents: nulls, blanks, repeats, odd white space, names that clash.
AWKWARD = [
    (None, "a text without an id, of several words", None, None),
    (None, None, None, None),
    (1, None, "en", "s1"),
    (2, "", "en", None),
    (3, " \t\n\x0b\x0c\r ", None, "s1"),
    (4, "One two  three\tfour\nfive six", "en", "s1"),
    (4, "One two  three\tfour\nfive six", "en", "s1"),
    (4, "another text under the same id", "en", "s2"),
    (5, "é \x0b" + "é ü z " * 40, "de", "s2"),
    (6, "word " * 3000, "en", "s1"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with extra columns named like helper columns of the operators."""
    rows = [(*r, 7, "x", "y", "k") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d long, tie string, size string, key string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def sf_dir():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    return folder
