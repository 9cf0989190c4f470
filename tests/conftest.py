import pytest

from fairlineage.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, app="tests", spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
