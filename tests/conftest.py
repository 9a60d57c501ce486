import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).parent.parent
sys.path.insert(0, str(HERE))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.executorEnv.PYTHONPATH", str(HERE))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    made.sparkContext.environment["PYTHONPATH"] = str(HERE)
    yield made
    made.stop()
