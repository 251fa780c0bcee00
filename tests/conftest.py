import pytest

from corpusflow.session import build_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="10g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
