import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def seqs(spark):
    def make(*rows, sample="s"):
        data = [(sample, i + 1, f"n{i + 1}", r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "sample_id string, seq_idx bigint, seq_name string, seq string")

    return make
