from tickloom.functions.numbers import to_number
from tickloom.functions.parsing import parse_ticks, rejected_records
from tickloom.functions.rendering import echo_rows, parse_messages, to_messages
from tickloom.functions.times import block_of, hour_bucket, instant, local_time, micros_of, utc_date

__all__ = [
    "block_of",
    "echo_rows",
    "hour_bucket",
    "instant",
    "local_time",
    "micros_of",
    "parse_messages",
    "parse_ticks",
    "rejected_records",
    "to_messages",
    "to_number",
    "utc_date",
]
