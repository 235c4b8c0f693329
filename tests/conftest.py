import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from foliate.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    return session
