import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from keyferry import schemas  # noqa: E402
from keyferry.session import apply_conf  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield apply_conf(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def keyspace(spark):
    """Make a keyspace from (key, value[, ttl_s[, node]]) tuples."""

    def make(*rows):
        filled = [(r[0], "string", r[1], *(r[2:] + (-1, 0)[len(r) - 2 :])) for r in rows]
        return spark.createDataFrame(filled, schemas.KEYSPACE)

    return make


def values(df):
    return {row["key"]: row["value"] for row in df.collect()}


def plan_of(df) -> str:
    """The physical plan, without the first guess of adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
