import pytest

from tests.llm.helpers import documents


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark)
