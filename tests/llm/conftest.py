import pytest

from tablesync.llm.common import ship_package


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    """Python workers find the package wherever the tests are started."""
    ship_package(spark)
