import contextlib
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="worksift-tests-") as folder:
        conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
        conf |= {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"}
        with contextlib.chdir(folder):  # Python workers start where the JVM did: they find no copy of the package there
            session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
        session.sparkContext.setLogLevel("OFF")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
