"""Message bytes to tick rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.schemas import TRADE_FIELDS, envelope_ddl, payload_ddl


# Name under which a stream reports how many messages came and were rejected.
ARRIVED = "arrived"


def trades_of(value: Column, fields=TRADE_FIELDS, enveloped: bool = False) -> Column:
    """Parse message text to an array of trades.

    Lenient: single-quoted text is accepted, text that is no JSON gives null,
    missing fields give null, a bare object counts as an array of one.
    """
    text = value.cast("string")
    if enveloped:
        return F.from_json(text, envelope_ddl(fields))["trades"]
    return F.from_json(text, payload_ddl(fields))


def parse_ticks(
    records: DataFrame,
    fields=TRADE_FIELDS,
    enveloped: bool = False,
    products=(),
    counted: bool = False,
    one_missing: str | None = None,
) -> DataFrame:
    """One row per trade: ``api_call_timestamp`` and the trade's text fields.

    Works on batch and stream. Null and empty arrays give no row.
    ``products`` keeps only those products. ``counted`` makes the plan report,
    as the observed metrics ``arrived``, its messages and those rejected: there,
    but not to be parsed. ``one_missing`` names a field: of the trades of one
    message that lack it only the first gives a row, so that a dedup by that
    field gets one such row per message. They share their poll time, so a
    watermark drops all of them or none.
    """
    trades = trades_of(F.col("value"), fields, enveloped)
    polled = F.col("timestamp").alias("api_call_timestamp")
    if counted:
        parsed = records.select(polled, F.col("value").isNotNull().alias("there"), trades.alias("trades"))
        rejected = F.count_if(F.col("there") & F.col("trades").isNull())
        parsed = parsed.observe(ARRIVED, F.count(F.lit(1)).alias("messages"), rejected.alias("rejected"))
    else:
        parsed = records.select(polled, trades.alias("trades"))
    if one_missing:
        # The products come first: what is left out must not stand for what is kept.
        wanted = F.filter("trades", lambda t: t["product_id"].isin(*products)) if products else F.col("trades")
        there = F.filter(wanted, lambda t: t[one_missing].isNotNull())
        missing = F.slice(F.filter(wanted, lambda t: t[one_missing].isNull()), 1, 1)
        return parsed.select("api_call_timestamp", F.inline(F.concat(there, missing)))
    ticks = parsed.select("api_call_timestamp", F.inline("trades"))
    return select_products(ticks, products) if products else ticks


def select_products(ticks: DataFrame, products) -> DataFrame:
    """Ticks of the chosen products, before any shuffle."""
    return ticks.where(F.col("product_id").isin(*products))


def rejected_records(records: DataFrame, enveloped: bool = False) -> DataFrame:
    """Records whose payload is there but cannot be parsed.

    Such a message yields no tick at all, so it would vanish silently.
    """
    value = F.col("value")
    return records.where(value.isNotNull() & trades_of(value, ("trade_id",), enveloped).isNull())
