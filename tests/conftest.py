import json
import os
import shutil
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

from tickloom.schemas import RECORD_DDL

os.environ["TZ"] = "UTC"
time.tzset()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """``HH:MM:SS[.ffffff]`` on the first day of 2024, in UTC."""
    return datetime.fromisoformat(f"2024-01-01T{text}").replace(tzinfo=timezone.utc)


def clock(value: datetime) -> str:
    """The reverse of :func:`at` for times Spark returns."""
    return value.time().isoformat()


def record(timestamp, value, offset=0):
    body = value if value is None or isinstance(value, str) else json.dumps(value)
    payload = None if body is None else bytearray(body, "utf-8")
    return (None, payload, "raw", 0, offset, timestamp, 0, None)


@pytest.fixture
def records(spark):
    """Topic records from (timestamp, payload) pairs."""

    def make(pairs):
        rows = [record(t, v, i) for i, (t, v) in enumerate(pairs)]
        return spark.createDataFrame(rows, RECORD_DDL).coalesce(1)

    return make


def trade(trade_id, product="P", price="1.0", size="1", side="BUY"):
    return {
        "trade_id": trade_id,
        "product_id": product,
        "price": price,
        "size": size,
        "side": side,
    }


@pytest.fixture
def topic(spark, records, tmp_path):
    """A raw topic on disk. ``add`` appends one file, later than all before."""
    folder = tmp_path / "raw"
    folder.mkdir()

    class Topic:
        path = str(folder)
        files = 0

        def add(self, pairs):
            part = tmp_path / f"part-{self.files}"
            records(pairs).write.parquet(str(part))
            source = next(part.glob("part-*.parquet"))
            target = folder / f"{self.files:04d}.parquet"
            shutil.copyfile(source, target)
            stamp = 1_700_000_000 + 10 * self.files
            os.utime(target, (stamp, stamp))
            self.files += 1

    return Topic()


def shift(moment: datetime, **delta) -> datetime:
    return moment + timedelta(**delta)
