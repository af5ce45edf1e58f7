import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from accesswatch.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("test tables are not here")
    return SF_SMALL


def log_rows(spark, rows):
    """Logs from (LogID, UserID, Timestamp text, method, endpoint, ip, status, role), short rows filled up."""
    from pyspark.sql import functions as F

    filled = [tuple(r) + ("GET", "/patient/records/1000", "10.0.0.1", 200, "Doctor")[len(r) - 3 :] for r in rows]
    schema = (
        "LogID string, UserID bigint, Timestamp string, HTTP_Method string, Endpoint string, "
        "IP_Address string, HTTP_Response int, Role string"
    )
    return spark.createDataFrame(filled, schema).withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
