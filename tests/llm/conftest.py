"""Tables that the tests of this folder share."""

import pytest
from pyspark.sql import functions as F

from catloom.llm import tokens
from edge_rows import EDGE, SCHEMA, SF


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.vocabulary_path(), cache_words=500)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and very long texts, ties, a repeated row, and columns named like results."""
    rows = [(i, t, None, None, None) for i, t in EDGE]
    clash = {c: F.lit("x") for c in "kept fingerprint score _id _text rate start keep_id component_id n _row p features".split()}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 0), (10, 1, 0), (13, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
