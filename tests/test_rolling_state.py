"""Recent volume over streams, against the batch operator and brute force."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import at, clock, trade
from tickloom.operators import recent_volume
from tickloom.operators.rolling_state import frame_sums
from tickloom.params import JobParams, stream_session
from tickloom.schemas import METRICS_DDL
from tickloom.streaming import dropped_late, read_recent_volume, run_to_end, start_recent_volume, state_rows

PARAMS = JobParams(available_now=True, max_files_per_trigger=1, state_partitions=2)


@pytest.mark.parametrize("width", [0, 3, 40, 10**6])
def test_frame_sums_equal_brute_force(width):
    rng = random.Random(width)
    for _ in range(200):
        n = rng.randrange(0, 40)
        times = sorted(rng.randrange(60) for _ in range(n))
        values = [rng.choice((None, 0.0, 1.5, 2.0, 7.25)) for _ in range(n)]
        first = rng.randrange(n + 1)
        while 0 < first < n and times[first] == times[first - 1]:
            first += 1
        frames = [[v for s, v in zip(times, values) if t - width <= s <= t and v is not None] for t in times]
        assert frame_sums(times, values, width, first) == [sum(f) if f else None for f in frames[first:]]


def streamed(spark, tmp_path, files, span, delay):
    """The stream's query and rows, over files of aggregates that come one by one."""
    session = stream_session(spark, PARAMS)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, METRICS_DDL).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    source = session.readStream.schema(METRICS_DDL).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    metrics = source.parquet(str(tmp_path / "in" / "*")).withWatermark("api_call_timestamp", delay)
    target = str(tmp_path / "out")
    writer = recent_volume(metrics, span).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    query = run_to_end(writer.trigger(availableNow=True).start(target))
    return query, spark.read.parquet(target).collect()


def row(seconds, product, volume):
    return (at("00:00:00") + timedelta(seconds=seconds), product, 1, 0, 1, volume, 1.0)


def test_rows_out_of_order_equal_the_batch_operator(spark, tmp_path):
    """Repeated times, nulls, a row exactly a span earlier; the tail is not out yet."""
    rng = random.Random(5)
    moments = [(s, p) for s in range(0, 4000, 7) for p in ("A", "A", None) if rng.random() < 0.4]
    rows = [row(s, p, rng.choice((None, 1.0, 2.5, 4.0))) for s, p in moments]
    files, late = [[] for _ in range(8)], 0
    for r in rows:
        files[min(7, int((r[0] - at("00:00:00")).total_seconds() + rng.randrange(0, 120)) // 520)].append(r)
    query, got = streamed(spark, tmp_path, files, "700 seconds", "5 minutes")
    newest = max(r[0] for r in rows) - timedelta(minutes=5)
    batch = recent_volume(spark.createDataFrame(rows, METRICS_DDL), "700 seconds").where(F.col("api_call_timestamp") <= newest)
    key = lambda r: (r[0], str(r[1]), str(r["share_volume"]), str(r["recent_volume"]))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert 300 < len(got) < len(rows) and len({key(r) for r in got}) > 200
    assert dropped_late(query) == 0


def test_late_rows_are_dropped_and_old_state_goes(spark, tmp_path):
    files = [
        [row(0, "A", 1.0), row(10, "A", 2.0), row(10, "B", 8.0)],
        [row(500, "A", 4.0)],
        [row(480, "A", 16.0)],
        [row(5, "A", 64.0), row(2000, "C", 1.0)],
        [row(4000, "C", 1.0)],
    ]
    query, got = streamed(spark, tmp_path, files, "490 seconds", "60 seconds")
    assert sorted((r[1], clock(r[0]), r["recent_volume"]) for r in got) == [
        ("A", "00:00:00", 1.0), ("A", "00:00:10", 3.0), ("A", "00:08:00", 19.0), ("A", "00:08:20", 22.0),
        ("B", "00:00:10", 8.0), ("C", "00:33:20", 1.0),
    ]
    assert dropped_late(query) == 1
    held = state_rows(query, "transformWithStateInPySparkExec")
    assert held and held[-1] < max(held)


def test_trades_to_volume_in_one_query_with_restart(spark, topic, tmp_path):
    """Dedup, aggregates and sums behind one watermark, resumed after each file."""
    polls = [
        [("00:00:00", "a", "1"), ("00:00:00", "b", "2")],
        [("00:00:01", "b", "2"), ("00:00:01", "c", "4")],
        [("00:05:00", "d", "8"), ("00:04:30", "e", "16")],
        [("00:00:30", "late", "99"), ("00:10:00", "f", "32")],
        [("00:10:00.000001", "g", "64"), ("00:30:00", "h", "1")],
    ]
    target = str(tmp_path / "t")
    for rows in polls:
        topic.add([(at(t), [trade(i, size=s)]) for t, i, s in rows])
        run_to_end(start_recent_volume(spark, PARAMS, str(tmp_path / "c"), target, "5 minutes", topic.path))
    found = read_recent_volume(spark, target).collect()
    assert sorted((clock(r[0]), r["share_volume"], r["recent_volume"]) for r in found) == [
        ("00:00:00", 3.0, 3.0), ("00:00:01", 4.0, 7.0), ("00:04:30", 16.0, 23.0), ("00:05:00", 8.0, 31.0),
        ("00:10:00", 32.0, 40.0), ("00:10:00.000001", 64.0, 96.0),
    ]


@pytest.mark.parametrize("change", [{"rocksdb": False}, {"output_mode": "update"}])
def test_other_modes_are_refused(spark, tmp_path, change):
    with pytest.raises(ValueError, match="RocksDB"):
        start_recent_volume(spark, PARAMS.but(**change), str(tmp_path), str(tmp_path))
