"""Recent volume and price change over aggregate rows.

A window per product alone would put a busy product's whole history into one
task. Both operators cut time into blocks and window per (product, block), so
that the size of a group depends on the block and not on the length of history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions.times import block_of, micros_of
from tickloom.operators.rolling_state import recent_volume_stream

EVENT_TIME = "api_call_timestamp"


def recent_volume(
    metrics: DataFrame,
    span: str = "1 hour",
    spans_per_block: int = 8,
    time: str = EVENT_TIME,
) -> DataFrame:
    """Adds ``recent_volume``: volume of the product in the last ``span``.

    The span includes the row itself and a row exactly ``span`` earlier. Rows
    in the last ``span`` of a block are copied into the next block, where they
    only feed the sums; about one row in ``spans_per_block`` is copied.

    A stream keeps the last span of a product as state instead, see
    :func:`~tickloom.operators.rolling_state.recent_volume_stream`.
    """
    width = micros_of(span)
    if metrics.isStreaming:
        return recent_volume_stream(metrics, width, time)
    length = width * spans_per_block
    at = F.unix_micros(time)
    home = block_of(time, f"{length} microseconds")
    following = home + F.lit(length)
    reaches = at + F.lit(width) >= following
    blocks = F.when(reaches, F.array(home, following)).otherwise(F.array(home))
    window = (
        Window.partitionBy("product_id", "_block").orderBy("_at").rangeBetween(-width, 0)
    )
    return (
        metrics.withColumn("_at", at)
        .withColumn("_home", home)
        .withColumn("_block", F.explode(blocks))
        .withColumn("recent_volume", F.sum("share_volume").over(window))
        .where(F.col("_block").eqNullSafe(F.col("_home")))
        .drop("_at", "_home", "_block")
    )


def price_change(
    metrics: DataFrame, block: str = "1 day", time: str = EVENT_TIME
) -> DataFrame:
    """Adds ``price_change``: price / previous price of the product - 1.

    Null for a product's first row and after a price of zero. The previous
    price lies in the same block for all rows but a block's first. Those first
    rows, one per (product, block), carry their block's closing price and look
    it up among themselves. Both parts read the same shuffle.
    """
    in_block = Window.partitionBy("product_id", "_block").orderBy(time)
    whole_block = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_product = Window.partitionBy("product_id").orderBy("_block")
    placed = metrics.withColumn("_block", block_of(time, block)).withColumns(
        {
            "_opens": F.lag(F.lit(True)).over(in_block).isNull(),
            "_previous": F.lag("avg_share_price").over(in_block),
            "_closing": F.last("avg_share_price").over(whole_block),
        }
    )
    inside = placed.where(~F.col("_opens"))
    opening = placed.where("_opens").withColumn("_previous", F.lag("_closing").over(of_product))
    change = F.try_divide("avg_share_price", "_previous") - F.lit(1.0)
    return (
        inside.unionByName(opening)
        .withColumn("price_change", change)
        .select(*metrics.columns, "price_change")
    )


def rolling_metrics(
    metrics: DataFrame, span: str = "1 hour", time: str = EVENT_TIME
) -> DataFrame:
    """Recent volume and price change together.

    The price change comes first: it reads its input twice, which is cheapest
    straight above the aggregates, whose shuffle both readers share.
    """
    return recent_volume(price_change(metrics, time=time), span, time=time)
