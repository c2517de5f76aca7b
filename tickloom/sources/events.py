"""Topic records derived from the ``events`` table.

Each event becomes a trade that one poll delivers. As real polls overlap, some
trades are delivered again: every seventh twice in the same message, every
third a second time ``LAG`` later. Some messages also arrive out of order.

One message carries the trades of one event, so no grouping is needed and no
message grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.params import state_width
from tickloom.workspace import children, make_folder, moved

# The mapping that the oracle SQL repeats.
POLL_SECONDS = 1800
LAG_DAYS = 10
LAG = f"{LAG_DAYS} days"
PRODUCTS = 5
# Events that one task turns into records, at most; more tasks come in whole rounds of the cores.
FILE_ROWS = 1_000_000


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def poll_time(seconds: int | None = POLL_SECONDS) -> Column:
    """Start of the ``seconds``-long poll an event falls in; None keeps its time."""
    at = F.col("ts").cast("timestamp")
    if seconds is None:
        return at
    whole = F.unix_seconds(at)
    return F.timestamp_seconds(whole - F.pmod(whole, F.lit(seconds)))


def trade(raw_numbers: bool = False, blank_sizes: bool = False) -> Column:
    """An event as a trade whose fields are all text.

    Prices are quoted in 64ths, sizes are whole: sums of such doubles are exact
    and do not depend on the order of rows. ``raw_numbers`` uses the event's
    value for both instead; ``blank_sizes`` leaves the size of errors empty.
    """
    price = F.col("value") if raw_numbers else F.floor(F.col("value") * 64) / F.lit(64.0)
    size = (
        F.col("value").cast("string")
        if raw_numbers
        else F.get_json_object("props", "$.k")
    )
    if blank_sizes:
        size = F.when(F.col("event_type") == "error", "").otherwise(size)
    side = (
        F.when(F.col("event_type") == "purchase", "BUY")
        .when(F.col("event_type") == "click", "SELL")
        .otherwise(F.col("event_type"))
    )
    return F.struct(
        F.col("event_id").cast("string").alias("trade_id"),
        F.concat(F.lit("P"), F.pmod("user_id", F.lit(PRODUCTS)).cast("string")).alias("product_id"),
        price.cast("string").alias("price"),
        size.alias("size"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        side.alias("side"),
        F.lit("").alias("bid"),
        F.lit("").alias("ask"),
    )


def deliveries(events: DataFrame, poll_seconds: int | None = POLL_SECONDS) -> DataFrame:
    """Events with the polls that deliver them, and the ``wave`` each of these arrives in.

    ``nth`` is 0 for the first ``poll`` and 1 for the second.
    """
    again = F.col("event_id") % 3 == 0
    first = poll_time(poll_seconds)
    delayed = (F.col("event_id") % 6 == 1).cast("bigint")
    return (
        events.select("*", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth"))
        .withColumn("poll", F.when(F.col("nth") == 0, first).otherwise(first + F.expr(f"interval {LAG}")))
        .withColumn("wave", F.floor(F.unix_date(F.col("poll").cast("date")) / LAG_DAYS) + delayed)
    )


def event_records(
    events: DataFrame,
    poll_seconds: int | None = POLL_SECONDS,
    raw_numbers: bool = False,
    blank_sizes: bool = False,
    enveloped: bool = False,
    broken_errors: bool = False,
) -> DataFrame:
    """Topic records of the events, and the ``wave`` each of them arrives in.

    A wave is a ``LAG``-long stretch of arrival. Messages arrive in the wave of
    their poll, except those of every sixth event, which arrive one wave late.
    ``enveloped`` keeps the poll response around the trades; ``broken_errors``
    replaces the payload of errors by text that is not JSON.
    """
    # Only what a wave is found by comes before its filter; trades are built after that.
    return _records(deliveries(events, poll_seconds), raw_numbers, blank_sizes, enveloped, broken_errors)


def _records(
    delivered: DataFrame,
    raw_numbers: bool = False,
    blank_sizes: bool = False,
    enveloped: bool = False,
    broken_errors: bool = False,
) -> DataFrame:
    """A topic record for each delivery."""
    twice = (F.col("nth") == 0) & (F.col("event_id") % 7 == 0)
    body = F.array_repeat(trade(raw_numbers, blank_sizes), F.when(twice, 2).otherwise(1))
    if enveloped:
        body = F.struct(body.alias("trades"), F.lit("1.5").alias("best_bid"), F.lit("2.5").alias("best_ask"))
    text = F.to_json(body)
    if broken_errors:
        text = F.when(F.col("event_type") == "error", "not json").otherwise(text)
    return delivered.select(
        F.lit(None).cast("binary").alias("key"),
        text.cast("binary").alias("value"),
        F.lit("trades").alias("topic"),
        F.lit(0).alias("partition"),
        (F.col("event_id") * 2 + F.col("nth")).alias("offset"),
        F.col("poll").alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
        "wave",
    )


def write_waves(spark: SparkSession, sf_dir: str, topic: str):
    """Write the records to ``topic`` wave by wave, yielding after each one.

    The caller runs its stream in between, so arrival order is known without
    sorting: all of one wave comes before all of the next. The events are read
    once, however many waves they make, and dealt out evenly over the tasks:
    where the table is in order of time a wave lies in few of its splits, whose
    tasks, and those that read their files back, would work alone. The records
    wait beside the topic; a wave arrives there by a rename of its folder.
    """
    events, waiting = read_events(spark, sf_dir), f"{topic}-waiting"
    dealt = events.repartition(state_width(spark, events.count(), FILE_ROWS), "event_id")
    delivered = deliveries(dealt).where(F.col("wave").isNotNull())
    # In order of waves before the trades are built, so that the write need not sort those.
    _records(delivered.sortWithinPartitions("wave")).write.partitionBy("wave").parquet(waiting)
    make_folder(spark, topic)
    names = [name for name in children(spark, waiting) if name.startswith("wave=")]
    for wave in sorted(int(name.partition("=")[2]) for name in names):
        if not moved(spark, f"{waiting}/wave={wave}", f"{topic}/wave-{wave}"):
            raise RuntimeError(f"wave {wave} has arrived before")
        yield wave
