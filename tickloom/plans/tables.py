"""Rows of the target tables and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.times import hour_bucket, local_time
from tickloom.schemas import (
    COUNT_COLUMNS,
    MEASURE_COLUMNS,
    PRODUCT_ID_LENGTH,
    TABLE_KEY,
)


def to_table_rows(metrics: DataFrame) -> DataFrame:
    """The eight columns of the keyed table, in table order."""
    polled = F.col("api_call_timestamp")
    return metrics.select(
        polled.alias("api_call_timestamp_utc"),
        hour_bucket(polled).alias("api_call_timestamp_hour"),
        "product_id",
        *COUNT_COLUMNS,
        *MEASURE_COLUMNS,
    )


def to_relational_rows(metrics: DataFrame, zone: str = "UTC") -> DataFrame:
    """The relational variant: local poll time instead of the hour."""
    polled = F.col("api_call_timestamp")
    return metrics.select(
        polled.alias("api_call_timestamp_utc"),
        local_time(polled, zone).alias("api_call_timestamp_local"),
        "product_id",
        *COUNT_COLUMNS,
        *MEASURE_COLUMNS,
    )


def narrow_rows(rows: DataFrame) -> DataFrame:
    """Cast to the 32-bit types the external tables declare."""
    return rows.withColumns(
        {c: F.col(c).cast("int") for c in COUNT_COLUMNS}
        | {c: F.col(c).cast("float") for c in MEASURE_COLUMNS}
    )


def violations(rows: DataFrame) -> DataFrame:
    """``rule, rows``: how many rows break each rule of the relational table.

    Rules without offenders are listed with 0. One pass over the rows and one
    grouping by key.
    """
    required = [*TABLE_KEY, *COUNT_COLUMNS, *MEASURE_COLUMNS]
    counts = {f"{c} is null": F.count_if(F.col(c).isNull()) for c in required}
    counts["product_id too long"] = F.count_if(F.length("product_id") > PRODUCT_ID_LENGTH)
    per_key = rows.groupBy(*TABLE_KEY).agg(
        F.count(F.lit(1)).alias("_copies"),
        *[c.alias(rule) for rule, c in counts.items()],
    )
    totals = per_key.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("key not unique"),
        *[F.coalesce(F.sum(f"`{rule}`"), F.lit(0)).alias(rule) for rule in counts],
    )
    rules = ["key not unique", *counts]
    return totals.unpivot([], rules, "rule", "rows")


def assert_valid(rows: DataFrame) -> None:
    """Raise when any rule of :func:`violations` is broken."""
    broken = violations(rows).where("rows > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['rows']} rows" for r in broken))
