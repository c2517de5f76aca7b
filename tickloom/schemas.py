"""Declared schemas. Nothing is inferred and nothing evolves at run time."""

# Field names and column types that other systems agree on.
TRADE_FIELDS = (
    "trade_id",
    "product_id",
    "price",
    "size",
    "time",
    "side",
    "bid",
    "ask",
)

RECORD_DDL = (
    "key binary, value binary, topic string, partition int, offset bigint, "
    "timestamp timestamp, timestampType int, "
    "headers array<struct<key:string,value:binary>>"
)

METRICS_DDL = (
    "api_call_timestamp timestamp, product_id string, num_trades bigint, "
    "num_sell_trades bigint, num_buy_trades bigint, share_volume double, "
    "avg_share_price double"
)

TABLE_DDL = (
    "api_call_timestamp_utc timestamp, api_call_timestamp_hour timestamp, "
    "product_id string, num_trades bigint, num_sell_trades bigint, "
    "num_buy_trades bigint, share_volume double, avg_share_price double"
)

TABLE_KEY = ("api_call_timestamp_utc", "product_id")
COUNT_COLUMNS = ("num_trades", "num_sell_trades", "num_buy_trades")
MEASURE_COLUMNS = ("share_volume", "avg_share_price")
PRODUCT_ID_LENGTH = 15

# The five fields the aggregates read; parsing only these skips the rest of
# every payload, because Catalyst does not narrow a from_json schema under
# inline by itself.
METRIC_FIELDS = ("trade_id", "product_id", "price", "size", "side")


def payload_ddl(fields=TRADE_FIELDS):
    """DDL of one message: an array of trades whose fields are all text."""
    columns = ",".join(f"{name}:string" for name in fields)
    return f"array<struct<{columns}>>"


def envelope_ddl(fields=TRADE_FIELDS):
    """DDL of one poll response: the trades array under the key ``trades``."""
    return f"struct<trades:{payload_ddl(fields)}>"
