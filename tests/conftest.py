from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[*]")
        .appName("keydrivers-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def orders(spark, sf_dir):
    from workload.fixtures import order_features

    return order_features(spark, sf_dir).persist()


@pytest.fixture(scope="session")
def vehicle_csv(spark, tmp_path_factory) -> str:
    from vehicle_data import vehicle_rows

    path = str(tmp_path_factory.mktemp("vehicles") / "ratings.csv")
    vehicle_rows(1_200).to_csv(path, index=False)
    return path


@pytest.fixture(scope="session")
def vehicles(spark, vehicle_csv):
    from keydrivers.plans import load_vehicles

    return load_vehicles(spark, vehicle_csv).persist()
