import pytest

from marlstone.session import open_session


@pytest.fixture(scope="session")
def spark():
    return open_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
