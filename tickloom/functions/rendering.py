"""Aggregate rows to JSON messages and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.schemas import METRICS_DDL

# Fixed value: ISO-8601 with microseconds; the default writer stops at millis.
LOSSLESS_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def to_messages(metrics: DataFrame, lossless: bool = False) -> DataFrame:
    """``key`` (always null) and ``value`` (the row as JSON, nulls left out).

    Timestamps carry milliseconds, as consumers expect; ``lossless`` keeps
    microseconds.
    """
    options = {"timestampFormat": LOSSLESS_TIME} if lossless else {}
    return metrics.select(
        F.lit(None).cast("string").alias("key"),
        F.to_json(F.struct("*"), options).alias("value"),
    )


def echo_rows(records: DataFrame) -> DataFrame:
    """``timestamp`` and the message text of topic records."""
    return records.select("timestamp", F.col("value").cast("string").alias("value"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Aggregate rows back from message text."""
    text = F.col("value").cast("string")
    return messages.select(F.from_json(text, METRICS_DDL).alias("row")).select("row.*")
