import pytest

from pricelake.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)
