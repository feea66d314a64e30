"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, further columns."""
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import TEXTS


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en" if t and len(t) % 2 else None, None, 7, "x", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t string, part int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where(F.lit(False))
