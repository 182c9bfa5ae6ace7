"""Fixtures of the training-data tests (a second conftest.py would hide the first)."""

import pytest

from dealflow.llm.common import ship_package

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, bucket string, ids int, "
          "key string, size string, digest int, root int, a int, b int, first string, place int, lang_pred int, rank int")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty, blank and long texts, ties, repeated rows and clashing names."""
    extra = (1, "x", 2, "k", "s", 3, 4, 5, 6, "f", 7, 8, 9)
    line = "the quick brown fox jumps over the lazy dog and runs away from here today"
    rows = [
        (1, line, "en", "s1"), (1, line, "en", "s1"), (2, line, "en", "s2"), (3, line.upper(), "en", None),
        (None, line, None, "s1"), (None, None, None, None), (4, None, "en", "s1"), (5, "", "de", "s2"), (6, "   \n\t ", None, "s2"),
        (7, "1234 5678 !!", "en", "s1"), (8, "der hund und die katze sind nicht im haus", "de", "s2"),
        (9, "le chat et le chien sont dans la maison", "fr", "s1"), (10, "el gato y el perro en la casa", "es", "s3"),
        (11, (line + " again\n") * 400, "en", "s3"), (12, "x" * 30000, "en", "s3"), (13, "é" * 5000 + " 漢字 🙂", None, "s1"),
        (13, "another text under one id that is used twice by mistake", "en", "s1"),
        (14, line.replace("lazy", "lazi"), "en", "s1"), (15, "one two", "en", "s2"), (16, "one two", "en", "s2"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *extra) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
