"""Trade-tick analytics on Spark: one chain of DataFrame functions for batch
and stream, with the storage at its two ends."""

from tickloom.functions import (
    echo_rows,
    parse_messages,
    parse_ticks,
    rejected_records,
    to_messages,
)
from tickloom.operators import (
    per_second,
    price_change,
    recent_volume,
    rolling_metrics,
    tick_metrics,
    unique_ticks,
)
from tickloom.params import JobParams, build_session
from tickloom.plans import (
    batch_layer,
    build_batch_layer,
    lookback,
    read_batch_layer,
    refresh_batch_layer,
    serving_view,
    to_relational_rows,
    to_table_rows,
)
from tickloom.sources import read_records, stream_records, unwrap_envelope
from tickloom.streaming import land_ticks, start_message_echo, start_speed_layer

__all__ = [
    "JobParams",
    "batch_layer",
    "build_batch_layer",
    "build_session",
    "echo_rows",
    "land_ticks",
    "lookback",
    "parse_messages",
    "parse_ticks",
    "per_second",
    "price_change",
    "read_batch_layer",
    "read_records",
    "recent_volume",
    "refresh_batch_layer",
    "rejected_records",
    "rolling_metrics",
    "serving_view",
    "start_message_echo",
    "start_speed_layer",
    "stream_records",
    "tick_metrics",
    "to_messages",
    "to_relational_rows",
    "to_table_rows",
    "unique_ticks",
    "unwrap_envelope",
]
