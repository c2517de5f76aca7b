import random

from pyspark.sql import functions as F

from tests.conftest import at, shift, trade
from tickloom.functions import parse_ticks
from tickloom.operators import tick_metrics, unique_ticks


def test_first_poll_wins(records):
    ticks = parse_ticks(
        records(
            [
                (at("00:00:02"), [trade("a", price="9"), trade("c")]),
                (at("00:00:01"), [trade("a"), trade("b")]),
            ]
        )
    )
    rows = {r["trade_id"]: (r["api_call_timestamp"].second, r["price"]) for r in unique_ticks(ticks).collect()}
    assert rows == {"a": (1, "1.0"), "b": (1, "1.0"), "c": (2, "1.0")}


def test_missing_ids_are_one_trade_or_none(records):
    ticks = parse_ticks(records([(at("00:00:00"), [trade("a"), trade(None)]), (at("00:00:01"), [trade(None)])]))
    assert unique_ticks(ticks).count() == 2
    assert [r["trade_id"] for r in unique_ticks(ticks, null_ids="drop").collect()] == ["a"]
    assert unique_ticks(ticks).columns == ticks.columns


def test_key_of_product_and_trade(records):
    ticks = parse_ticks(records([(at("00:00:00"), [trade("1", "A"), trade("1", "B"), trade("1", "A")])]))
    assert unique_ticks(ticks).count() == 1
    assert unique_ticks(ticks, keys=("product_id", "trade_id")).count() == 2


def test_random_ticks_against_brute_force(records):
    rng = random.Random(7)
    polls = [(shift(at("00:00:00"), seconds=rng.randrange(40)), [trade(str(rng.randrange(60)), rng.choice("AB"), str(rng.randrange(9)), "2", rng.choice(["BUY", "SELL"])) for _ in range(5)]) for _ in range(120)]
    best = {}
    for when, trades in polls:
        for t in trades:
            rank = (when, t["product_id"], t["price"], t["size"], t["side"])
            best[t["trade_id"]] = min(best.get(t["trade_id"], rank), rank)
    expected = {}
    for when, product, price, size, side in best.values():
        group = expected.setdefault((when.replace(tzinfo=None), product), [0, 0, 0, 0.0, 0.0])
        group[0] += 1
        group[1] += side == "SELL"
        group[2] += side == "BUY"
        group[3] += float(size)
        group[4] += float(price)
    metrics = tick_metrics(unique_ticks(parse_ticks(records(polls), ("trade_id", "product_id", "price", "size", "side"))))
    found = {
        (r[0], r[1]): [r[2], r[3], r[4], r[5], r[6] * r[2]] for r in metrics.collect()
    }
    assert found.keys() == expected.keys()
    for key, group in expected.items():
        assert found[key][:4] == group[:4] and abs(found[key][4] - group[4]) < 1e-9


def test_hot_key_is_combined_before_the_shuffle(spark):
    """A third of the rows share one id; the shuffle carries it once per task."""
    ticks = spark.range(0, 90000, numPartitions=8).select(
        F.timestamp_seconds(F.col("id")).alias("api_call_timestamp"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("trade_id"),
        F.lit("P").alias("product_id"),
    )
    unique = unique_ticks(ticks)
    assert unique.count() == 60001
    plan = unique._jdf.queryExecution().executedPlan().toString()
    below_shuffle = plan[plan.index("Exchange hashpartitioning(trade_id") :]
    assert "partial_min" in below_shuffle
    assert unique.where("trade_id is null").first()["api_call_timestamp"].second == 0
