import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from eventlens.operators.ordering import clear  # noqa: E402
from eventlens.sources.events import EventLog  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """EventLog from a list of events (dicts or raw lines), in order, all of one application unless `apps` is given."""

    def make(events, apps=None):
        rows = [
            (apps[i] if apps else "a", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)
        ]
        return EventLog(spark.createDataFrame(rows, "app_key string, seq bigint, value string"))

    return make


def row(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()
