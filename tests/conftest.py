import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    base = tempfile.mkdtemp(prefix="spark-")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.checkpoint.dir", f"file://{base}/checkpoint").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
