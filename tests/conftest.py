import os

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")

import pytest

from millrace.session import local_session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
