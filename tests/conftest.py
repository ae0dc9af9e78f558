import pytest

from corpusloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
