import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cairnmem.runtime import let_workers_import

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    let_workers_import(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
