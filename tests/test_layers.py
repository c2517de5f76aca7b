import os
import re
import time
from datetime import date, datetime, timedelta, timezone

import pytest

from tests.conftest import at, shift, trade
from tickloom.functions import local_time, parse_ticks, utc_date
from tickloom.operators import tick_metrics, unique_ticks
from tickloom.params import JobParams
from tickloom.plans import (
    batch_layer,
    build_batch_layer,
    latest_rows,
    lookback,
    read_batch_layer,
    refresh_batch_layer,
    serving_view,
    to_table_rows,
    write_rows,
)
from tickloom.plans.layers import DATE, _of_dates, read_rows, with_date
from tickloom.schemas import METRIC_FIELDS, TABLE_DDL
from tickloom.sources import read_records

DAY = {"days": 1}


def week(records, extra=()):
    """Seven days; each day's last trade is delivered again the next day."""
    polls = []
    for day in range(7):
        start = shift(at("12:00:00"), days=day)
        polls.append((start, [trade(f"{day}-{i}", "AB"[i % 2]) for i in range(6)]))
        polls.append((shift(start, days=1), [trade(f"{day}-5", "B")]))
    return parse_ticks(records([*polls, *extra]), METRIC_FIELDS)


def as_set(rows):
    columns = [c for c in sorted(rows.columns) if c != DATE]
    return sorted(tuple(map(str, r)) for r in rows.select(columns).collect())


def table_row(when, product, trades, layer_price=1.0):
    return (when, when.replace(minute=0, second=0), product, trades, 0, trades, 1.0, layer_price)


def test_written_table_equals_the_computed_rows(spark, records, tmp_path):
    rows = batch_layer(week(records))
    write_rows(rows, str(tmp_path / "t"))
    assert as_set(read_rows(spark, str(tmp_path / "t"))) == as_set(rows)


def built(spark, ticks, tmp_path):
    path = str(tmp_path / "layer")
    build_batch_layer(ticks, path)
    return path


def refreshed(spark, ticks, path, start, end):
    touched = refresh_batch_layer(ticks, path, start, end)
    assert as_set(read_batch_layer(spark, path)) == as_set(batch_layer(ticks))
    return [d.day for d in touched]


def test_refresh_rewrites_only_what_changes(spark, records, tmp_path):
    path = built(spark, week(records), tmp_path)
    files = lambda: {str(p) for p in (tmp_path / "layer" / "rows").glob("*/*.parquet")}
    before = files()
    late = (shift(at("12:00:00"), days=3), [trade("late", "A", size="5")])
    ticks = week(records, [late])
    assert refreshed(spark, ticks, path, date(2024, 1, 3), date(2024, 1, 6)) == [3, 4, 5]
    kept = {p for p in before if re.search(f"{DATE}=2024-01-0[1267]", p)}
    assert kept <= files() and len(kept) == 4


def test_refresh_moves_a_trade_whose_earlier_copy_comes_late(spark, records, tmp_path):
    path = built(spark, week(records), tmp_path)
    late = (shift(at("11:00:00"), days=1), [trade("5-0", "A")])
    assert refreshed(spark, week(records, [late]), path, date(2024, 1, 2), date(2024, 1, 3)) == [2, 6]
    # Back again, when that copy is withdrawn.
    assert refreshed(spark, week(records), path, date(2024, 1, 2), date(2024, 1, 3)) == [2, 6]


def test_refresh_does_not_count_a_trade_polled_long_before(spark, records, tmp_path):
    path = built(spark, week(records), tmp_path)
    again = (shift(at("11:00:00"), days=6), [trade("0-0", "A")])
    assert refreshed(spark, week(records, [again]), path, date(2024, 1, 7), date(2024, 1, 8)) == [7]


def test_refresh_clears_a_date_without_rows(spark, records, tmp_path):
    extra = (shift(at("11:00:00"), days=20), [trade("x"), trade(None)])
    path = built(spark, week(records, [extra]), tmp_path)
    assert refreshed(spark, week(records), path, date(2024, 1, 21), date(2024, 1, 22)) == [21]
    assert read_batch_layer(spark, path).where(f"{DATE} = '2024-01-21'").count() == 0
    assert refreshed(spark, week(records), path, date(2024, 1, 21), date(2024, 1, 21)) == []


def test_refresh_prunes_landed_ticks_by_date(spark, records, tmp_path):
    landed = str(tmp_path / "ticks")
    dated = week(records).withColumn(DATE, utc_date("api_call_timestamp"))
    dated.write.partitionBy(DATE).parquet(landed)
    ticks = spark.read.parquet(landed)
    window = _of_dates(ticks, [date(2024, 1, 3)])
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert DATE in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    path = built(spark, ticks.drop(DATE), tmp_path)
    assert refreshed(spark, ticks, path, datetime(2024, 1, 3), datetime(2024, 1, 4)) == [3]


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
def test_nothing_depends_on_the_session_or_process_zone(spark, records, tmp_path, zone):
    """Polls near midnight, in a session and a process outside UTC."""
    polls = [(shift(at("23:10:00"), days=d), [trade(f"{d}-{i}", size=str(d)) for i in range(3)]) for d in range(4)]
    ticks = parse_ticks(records(polls), METRIC_FIELDS)
    raw = str(tmp_path / "ticks")
    ticks.write.parquet(raw)
    facts = lambda df: sorted(
        map(tuple, df.selectExpr("unix_micros(api_call_timestamp_utc)", "unix_micros(api_call_timestamp_hour)", "num_trades", f"string({DATE})").collect())
    )
    expected = facts(with_date(batch_layer(ticks)))
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    old = os.environ["TZ"]
    os.environ["TZ"] = zone
    time.tzset()
    try:
        path = built(other, other.read.parquet(raw), tmp_path)
        refresh_batch_layer(other.read.parquet(raw), path, datetime(2024, 1, 2), datetime(2024, 1, 4))
        rows = read_batch_layer(other, path)
        assert facts(rows) == expected
        assert all(r[1] % 3_600_000_000 == 0 for r in expected)
        found = lookback(rows, datetime(2024, 1, 2, 23), datetime(2024, 1, 3, 23, 30))
        assert sorted(f[3] for f in facts(found)) == ["2024-01-02", "2024-01-03"]
        local = other.read.parquet(raw).select(local_time("api_call_timestamp", "Asia/Tokyo").cast("string"))
        assert {r[0][11:] for r in local.collect()} == {"08:10:00"}
    finally:
        os.environ["TZ"] = old
        time.tzset()


def test_local_time_through_a_clock_change(spark):
    zone = "America/New_York"
    seconds = [1730611800, 1730615400, 1730619000]  # around the hour that New York has twice
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", zone)
    df = other.createDataFrame([(s,) for s in seconds], "s bigint").selectExpr("timestamp_seconds(s) AS t")
    found = [r[0] for r in df.select(local_time("t", zone).cast("string")).collect()]
    assert found == ["2024-11-03 01:30:00", "2024-11-03 01:30:00", "2024-11-03 02:30:00"]


def test_refresh_needs_whole_utc_dates(spark, records, tmp_path):
    path = built(spark, week(records), tmp_path)
    with pytest.raises(ValueError, match="midnights"):
        refresh_batch_layer(week(records), path, datetime(2024, 1, 3, 1), datetime(2024, 1, 4))
    east = timezone(timedelta(hours=5))
    with pytest.raises(ValueError, match="UTC"):
        refresh_batch_layer(week(records), path, datetime(2024, 1, 3, tzinfo=east), datetime(2024, 1, 4, tzinfo=east))


def test_refresh_reads_only_its_stretch_of_the_raw_records(spark, records, tmp_path):
    raw = str(tmp_path / "raw")
    records([(at("00:00:00"), [trade("1")])]).write.parquet(raw)
    ticks = parse_ticks(read_records(spark, JobParams(), raw), METRIC_FIELDS)
    plan = ticks.where("api_call_timestamp >= timestamp'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "GreaterThanOrEqual(timestamp" in scan
    assert "ReadSchema: struct<value:binary,timestamp:timestamp>" in scan


def test_lookback_prunes_dates(spark, records, tmp_path):
    path = str(tmp_path / "t")
    write_rows(batch_layer(week(records)), path)
    found = lookback(read_rows(spark, path), datetime(2024, 1, 2), datetime(2024, 1, 3, 12), ("A",))
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert DATE in filters
    assert sum(1 for _ in found.inputFiles()) <= 8


def test_lookback_bounds_are_half_open(spark):
    rows = spark.createDataFrame([table_row(at(f"00:00:0{s}"), "A", 1) for s in range(4)], TABLE_DDL)
    found = lookback(rows, at("00:00:01"), at("00:00:03"))
    assert sorted(r[0].second for r in found.collect()) == [1, 2]


def test_serving_view_has_speed_rows_only_beyond_the_horizon(spark):
    batch = spark.createDataFrame([table_row(at("00:00:00"), "A", 1), table_row(at("00:00:01"), None, 2)], TABLE_DDL)
    speed = spark.createDataFrame(
        [
            table_row(at("00:00:00"), "A", 9),
            table_row(at("00:00:00"), "B", 3),
            table_row(at("00:00:02"), "A", 4),
        ],
        TABLE_DDL,
    )
    rows = serving_view(batch, speed, at("00:00:02"))
    assert sorted((str(r["product_id"]), r["num_trades"], r["layer"]) for r in rows.collect()) == [
        ("A", 1, "batch"),
        ("A", 4, "speed"),
        ("None", 2, "batch"),
    ]


def test_serving_view_reads_two_pruned_tables_without_a_join(spark, records, tmp_path):
    ticks = week(records)
    write_rows(batch_layer(ticks), str(tmp_path / "b"))
    write_rows(to_table_rows(tick_metrics(unique_ticks(ticks))), str(tmp_path / "s"))
    view = serving_view(read_rows(spark, str(tmp_path / "b")), read_rows(spark, str(tmp_path / "s")), date(2024, 1, 4))
    assert as_set(view.drop("layer")) == as_set(batch_layer(ticks))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("FileScan") == 2
    assert all(DATE in part.split("PushedFilters")[0] for part in plan.split("PartitionFilters")[1:])


def test_latest_rows_picks_the_newest_batch(spark):
    rows = [(*table_row(at("00:00:00"), "A", n), b) for n, b in ((1, 3), (2, 10), (3, 9))]
    found = latest_rows(spark.createDataFrame(rows, TABLE_DDL + ", batch_id bigint"))
    assert [r["num_trades"] for r in found.collect()] == [2]
    assert "batch_id" not in found.columns
