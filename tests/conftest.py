import pytest

from vintagekit.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
