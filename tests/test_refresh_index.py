"""The index of first polls, and refreshes that read nothing else of the past."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tests.conftest import at, shift, trade
from tests.test_layers import as_set, refreshed, week
from tickloom.functions import parse_ticks
from tickloom.functions.times import utc_date
from tickloom.plans import batch_layer, build_batch_layer, polls, read_batch_layer, refresh_batch_layer
from tickloom.plans.layers import DATE
from tickloom.schemas import METRIC_FIELDS

FIRST_DAY = date(2024, 1, 1)


def landed(spark, ticks, path):
    ticks.withColumn(DATE, utc_date("api_call_timestamp")).write.partitionBy(DATE).parquet(path)
    return spark.read.parquet(path)


def spoil(path, days):
    """Make the ticks of some dates unreadable."""
    for day in days:
        for file in path.glob(f"{DATE}=2024-01-{day:02d}/*.parquet"):
            file.write_bytes(b"not a table")
        for check in path.glob(f"{DATE}=2024-01-{day:02d}/.*.crc"):
            check.unlink()


def test_refresh_reads_no_tick_of_another_date(spark, records, tmp_path):
    ticks = landed(spark, week(records), str(tmp_path / "ticks"))
    path = str(tmp_path / "layer")
    build_batch_layer(ticks, path)
    expected = as_set(batch_layer(ticks))
    spoil(tmp_path / "ticks", [1, 2, 4, 5, 6, 7, 8])
    assert refresh_batch_layer(ticks, path, date(2024, 1, 3), date(2024, 1, 4)) == [date(2024, 1, 3)]
    assert as_set(read_batch_layer(spark, path)) == expected


def test_lost_trades_are_looked_up_in_later_dates_only(spark, records, tmp_path):
    full = week(records)
    path = str(tmp_path / "layer")
    build_batch_layer(full, path)
    # The poll of the 3rd that had 2-5 first is gone; the 4th has its copy.
    less = full.where(~((F.col("trade_id") == "2-5") & (utc_date("api_call_timestamp") == F.lit("2024-01-03").cast("date"))))
    ticks = landed(spark, less, str(tmp_path / "ticks"))
    expected = as_set(batch_layer(ticks))
    spoil(tmp_path / "ticks", [1, 2])
    days = refresh_batch_layer(ticks, path, date(2024, 1, 3), date(2024, 1, 4))
    assert days == [date(2024, 1, 3), date(2024, 1, 4)]
    assert as_set(read_batch_layer(spark, path)) == expected


def test_base_is_read_in_place(spark, records, tmp_path):
    path = str(tmp_path / "layer")
    build_batch_layer(week(records), path, buckets=4)
    large = spark.newSession()  # one in which the tables here do not count as small
    large.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large.conf.set("spark.sql.shuffle.partitions", "4")
    asked = large.createDataFrame([("3:0-1", at("12:00:00"))], f"{polls.TRADE} string, {polls.POLL} timestamp")
    found = polls.looked_up(large, f"{path}/first-polls", asked).where(f"{polls.POLL} IS NOT NULL")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert [r[polls.WAS] for r in found.collect()] == [at("12:00:00").replace(tzinfo=None)]


def test_names_of_trades_are_unambiguous(spark):
    values = [("a", "bc"), ("ab", "c"), (None, "-"), ("-", None), ("", None), (None, ""), ("1:a", ""), (None, None)]
    rows = spark.createDataFrame(values, "x string, y string").select(polls.trade_name(["x", "y"])).collect()
    assert len({r[0] for r in rows}) == len(values)


def test_many_refreshes_equal_full_recomputes(spark, records, tmp_path, monkeypatch):
    """Polls come and go on random dates; the index folds its changes on the way."""
    monkeypatch.setattr(polls.add_changes, "__defaults__", (3,))
    rng = random.Random(8)
    ids = [None, *map(str, range(25))]

    def poll():
        return [trade(i, rng.choice("AB")) for i in rng.sample(ids, 4)]

    days = {d: [poll() for _ in range(3)] for d in range(6)}

    def ticks():
        pairs = [(shift(at(f"0{n}:00:00"), days=d), p) for d, found in days.items() for n, p in enumerate(found)]
        return parse_ticks(records(pairs), METRIC_FIELDS)

    path = str(tmp_path / "layer")
    build_batch_layer(ticks(), path, buckets=3)
    for _ in range(7):
        day = rng.randrange(6)
        width = rng.choice((1, 1, 2))
        for d in range(day, min(6, day + width)):
            days[d] = [poll() for _ in range(rng.randrange(0, 4))]
        if not any(days.values()):
            break
        refreshed(spark, ticks(), path, FIRST_DAY + timedelta(days=day), FIRST_DAY + timedelta(days=day + width))
    folders = sorted(p.name for p in (tmp_path / "layer" / "first-polls").iterdir())
    assert sum(f.startswith("base") for f in folders) == 2 and len(folders) <= 7


def test_an_interrupted_refresh_is_run_again(spark, records, tmp_path, monkeypatch):
    from tickloom.plans import layers

    path = str(tmp_path / "layer")
    build_batch_layer(week(records), path)
    ticks = week(records, [(shift(at("11:00:00"), days=1), [trade("5-0", "A")])])

    def fails(*_):
        raise OSError("lost")

    real = layers.add_changes
    monkeypatch.setattr(layers, "add_changes", fails)
    try:
        refresh_batch_layer(ticks, path, date(2024, 1, 2), date(2024, 1, 3))
    except OSError:
        pass
    monkeypatch.setattr(layers, "add_changes", real)
    assert refreshed(spark, ticks, path, date(2024, 1, 2), date(2024, 1, 3)) == [2, 6]
    assert refreshed(spark, ticks, path, date(2024, 1, 2), date(2024, 1, 3)) == [2]
