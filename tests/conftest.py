import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def configured(spark):
    """Set session options for one test."""
    changed = {}

    def apply(**options):
        names = {"group": "spark.factorloom.groupRows", "frame": "spark.factorloom.frameRows"}
        for key, value in options.items():
            name = names.get(key, key)
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, str(value))

    yield apply
    for name, old in changed.items():
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
