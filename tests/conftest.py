import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from treegauge.session import build_session

    session = build_session("local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)
    return collect
