import pytest

from siftspan.sources.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", "local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="3g", spark__sql__warehouse__dir=f"file://{shared}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
