from __future__ import annotations

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) rows with a column that clashes with nothing and one that might."""

    def build(*rows):
        return spark.createDataFrame([(i, t, "x", 7, 1, 2, 3) for i, t in rows], "doc_id long, text string, cls string, n long, _id int, _tk int, _gone int")

    return build


#: Nulls in any column, empty and blank texts, repeated rows and ids, a long text, odd characters.
ODD = [
    (None, "a line of a text without an id"), (1, None), (2, ""), (3, " \n\t\n "), (4, "one two"), (4, "one two"),
    (5, "same id"), (5, "other text of the same id"), (6, "long word " * 4000), (7, "x" * 30000), (8, "  é ß 漢字 😀\x00\x1c end"),
    (9, "A b C d E f G\r\nh"), (10, "a B c D e F g\r\nH"),
]
