import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from padron import build_session

    session = build_session(
        "padron-tests",
        "local[8]",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def partitions(spark):
    """Set the number of shuffle partitions for one block."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def use(n: int) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield use
    spark.conf.set("spark.sql.shuffle.partitions", before)
