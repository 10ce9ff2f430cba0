import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hitlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(**{
        "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LOG_SCHEMA = ("datetime timestamp_ntz, ip string, method string, uri string, status string, "
              "bytes string, response_time string, user_agent string")
START = datetime(2024, 1, 1)


def request(ip="1.2.3.4", at=0, uri="/a", status="200", size="10", took="5", agent="curl/8.4.0",
            method="GET"):
    """One raw log row, ``at`` seconds after the start."""
    return (START + timedelta(seconds=at), ip, method, uri, status, size, took, agent)


@pytest.fixture(scope="session")
def log(spark):
    def make(rows):
        return spark.createDataFrame(rows, LOG_SCHEMA)
    return make


@pytest.fixture(scope="session")
def feats(log):
    from hitlens.operators.features import extract_features

    def make(rows):
        return extract_features(log(rows))
    return make


@pytest.fixture(scope="session")
def hours(spark):
    """Hourly series from a list of request counts."""
    def make(counts):
        rows = [(START + timedelta(hours=i), int(c)) for i, c in enumerate(counts)]
        return spark.createDataFrame(rows, "datetime timestamp_ntz, requests long")
    return make
