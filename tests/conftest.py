import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH", "")])])
SMALL = "/root/testdata/sf0.001"


from pyspark.sql import SparkSession  # noqa: E402  (after the workers' path is set)

# made here, since test modules build column expressions as they are imported
SPARK = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
)
SPARK.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SPARK
    SPARK.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
