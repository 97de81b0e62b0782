import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tickloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def small_blocks(spark):
    """Force the split form of every plan on small data."""
    names = {"rowsPerBlock": "40", "broadcastRows": "100000", "broadcastSlices": "100000", "rowsPerJoinKey": "50"}

    def use(**changes):
        for name, value in {**names, **{k: str(v) for k, v in changes.items()}}.items():
            spark.conf.set(f"spark.tickloom.{name}", value)

    use()
    yield use
    for name in names:
        spark.conf.unset(f"spark.tickloom.{name}")
