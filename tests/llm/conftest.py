import pytest


@pytest.fixture(scope="session", autouse=True)
def _prepared(spark):
    from trustfold.llm.common import prepare

    prepare(spark)
