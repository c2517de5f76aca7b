import pytest
from pyspark.sql import functions as F

from tests.conftest import at, trade
from tickloom.functions import parse_messages, parse_ticks, to_messages, to_number
from tickloom.operators import per_second, tick_metrics, unique_ticks
from tickloom.plans import narrow_rows, to_relational_rows, to_table_rows, violations
from tickloom.plans.tables import assert_valid

SAMPLE = [
    ("71", "3.5", "0.25", "BUY"),
    ("72", "3.75", "12", "SELL"),
    ("73", "4.25", "0.5", "SELL"),
    ("74", "2.5", "1.125", "BUY"),
    ("75", "1", "2", "SELL"),
]


def sample(records, when="10:11:12.131415"):
    trades = [trade(i, "OAT-EUR", p, s, side) for i, p, s, side in SAMPLE]
    return parse_ticks(records([(at(when), trades)]))


def test_aggregates_of_the_sample(records):
    (row,) = tick_metrics(sample(records)).collect()
    assert (row["num_trades"], row["num_sell_trades"], row["num_buy_trades"]) == (5, 3, 2)
    assert (row["share_volume"], row["avg_share_price"]) == (15.875, 3.0)


def test_aggregate_types(records):
    types = {f.name: f.dataType.simpleString() for f in tick_metrics(sample(records)).schema}
    assert types == {
        "api_call_timestamp": "timestamp",
        "product_id": "string",
        "num_trades": "bigint",
        "num_sell_trades": "bigint",
        "num_buy_trades": "bigint",
        "share_volume": "double",
        "avg_share_price": "double",
    }


def test_unreadable_numbers_are_left_out(records):
    trades = [trade("1", size="", price="2"), trade("2", size="abc", price=""), trade("3", size="4")]
    (row,) = tick_metrics(parse_ticks(records([(at("00:00:00"), trades)]))).collect()
    assert (row["num_trades"], row["share_volume"], row["avg_share_price"]) == (3, 4.0, 1.5)


def test_all_sizes_unreadable_give_null_not_zero(records):
    (row,) = tick_metrics(parse_ticks(records([(at("00:00:00"), [trade("1", size="")])]))).collect()
    assert row["share_volume"] is None and row["num_trades"] == 1


def test_other_and_missing_sides_count_for_neither(records):
    trades = [trade("1", side="sell"), trade("2", side=None), trade("3", side="SELL"), trade("4")]
    (row,) = tick_metrics(parse_ticks(records([(at("00:00:00"), trades)]))).collect()
    assert (row["num_trades"], row["num_sell_trades"], row["num_buy_trades"]) == (4, 1, 1)


def test_null_ids_survive_once_and_count_zero(records):
    ticks = parse_ticks(records([(at("00:00:00"), [trade(None), trade(None)])]))
    unique = unique_ticks(ticks)
    assert unique.count() == 1
    assert tick_metrics(unique).first()["num_trades"] == 0


def test_decimal_sums_are_exact(records):
    trades = [trade("1", size="0.1"), trade("2", size="0.2")]
    ticks = parse_ticks(records([(at("00:00:00"), trades)]))
    assert tick_metrics(ticks).first()["share_volume"] == 0.30000000000000004
    assert str(tick_metrics(ticks, "decimal").first()["share_volume"]) == "0.300000000000000000"


def test_try_cast_is_null_for_text(spark):
    row = spark.range(1).select(to_number(F.lit("")).alias("a"), to_number(F.lit("1e2")).alias("b")).first()
    assert (row["a"], row["b"]) == (None, 100.0)


def test_per_second_groups_polls_of_one_second(records):
    ticks = parse_ticks(
        records([(at("00:00:01.1"), [trade("1")]), (at("00:00:01.9"), [trade("2")]), (at("00:00:02"), [trade("3")])])
    )
    rows = {r["second"].second: r["num_trades"] for r in per_second(ticks).collect()}
    assert rows == {1: 2, 2: 1}


def test_table_rows_keep_microseconds_and_add_the_hour(records):
    rows = to_table_rows(tick_metrics(sample(records)))
    row = rows.first()
    assert row["api_call_timestamp_utc"].microsecond == 131415
    assert row["api_call_timestamp_hour"].isoformat() == "2024-01-01T10:00:00"
    assert rows.columns == [
        "api_call_timestamp_utc",
        "api_call_timestamp_hour",
        "product_id",
        "num_trades",
        "num_sell_trades",
        "num_buy_trades",
        "share_volume",
        "avg_share_price",
    ]


def test_relational_rows_have_local_time_and_narrow_types(records):
    rows = narrow_rows(to_relational_rows(tick_metrics(sample(records)), "America/New_York"))
    assert rows.first()["api_call_timestamp_local"].isoformat() == "2024-01-01T05:11:12.131415"
    types = dict(rows.dtypes)
    assert types["num_trades"] == "int" and types["share_volume"] == "float"


def test_violations_count_each_broken_rule(records):
    trades = [trade("1", "A" * 16), trade("2", "B", size="")]
    rows = to_table_rows(tick_metrics(parse_ticks(records([(at("00:00:00"), trades)]))))
    found = {r["rule"]: r["rows"] for r in violations(rows.unionByName(rows)).collect()}
    assert found["key not unique"] == 2
    assert found["product_id too long"] == 2
    assert found["share_volume is null"] == 2
    assert found["num_trades is null"] == 0
    with pytest.raises(ValueError, match="product_id too long: 1 rows"):
        assert_valid(rows)


def test_no_rows_break_no_rule(records):
    rows = to_table_rows(tick_metrics(parse_ticks(records([]))))
    assert {r["rows"] for r in violations(rows).collect()} == {0}
    assert_valid(rows)


def test_messages_leave_out_nulls_and_stop_at_milliseconds(records):
    metrics = tick_metrics(parse_ticks(records([(at("02:35:40.784239"), [trade("1", size="")])])))
    (row,) = to_messages(metrics).collect()
    assert row["key"] is None
    assert row["value"].startswith('{"api_call_timestamp":"2024-01-01T02:35:40.784Z","product_id":"P"')
    assert "share_volume" not in row["value"]
    back = parse_messages(to_messages(metrics)).first()
    assert back["api_call_timestamp"].microsecond == 784000 and back["share_volume"] is None
    assert parse_messages(to_messages(metrics, lossless=True)).collect() == metrics.collect()
