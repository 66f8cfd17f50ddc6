import pytest
from llm_cases import SCHEMA, hard_rows, make


@pytest.fixture(scope="session")
def hard(spark):
    return make(spark, hard_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
