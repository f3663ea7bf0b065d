"""One local session for all tests; its scratch tables go to a temporary folder named in spark.checkpoint.dir."""

import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
