"""Aggregates per poll and product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numbers import to_number


def measures(numbers: str = "double") -> list[Column]:
    """The five aggregates over a group of ticks.

    Counting ids leaves out rows without one. A side other than the two
    counted ones, or none, counts for neither. The price mean is unweighted.
    Numbers that cannot be read are left out.
    """
    # The names of the columns and of the two sides.
    return [
        F.count("trade_id").alias("num_trades"),
        F.count_if(F.col("side") == F.lit("SELL")).alias("num_sell_trades"),
        F.count_if(F.col("side") == F.lit("BUY")).alias("num_buy_trades"),
        F.sum(to_number("size", numbers)).alias("share_volume"),
        F.avg(to_number("price", numbers)).alias("avg_share_price"),
    ]


def tick_metrics(ticks: DataFrame, numbers: str = "double") -> DataFrame:
    """Aggregates per exact poll time and product.

    On a stream a group is final, and emitted in append mode, once the
    watermark reaches its poll time.
    """
    return ticks.groupBy("api_call_timestamp", "product_id").agg(*measures(numbers))


def per_second(ticks: DataFrame, numbers: str = "double") -> DataFrame:
    """The same aggregates per whole second and product."""
    second = F.window("api_call_timestamp", "1 second")
    return (
        ticks.groupBy(second.alias("second"), "product_id")
        .agg(*measures(numbers))
        .withColumn("second", F.col("second.start"))
    )
