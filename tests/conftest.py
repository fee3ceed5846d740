import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    s = session("tests", "4", 4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
