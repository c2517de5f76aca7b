from tickloom.streaming.jobs import (
    await_any,
    land_ticks,
    run_to_end,
    speed_metrics,
    start_message_echo,
    start_recent_volume,
    start_speed_layer,
    tick_stream,
)
from tickloom.streaming.progress import dropped_late, state_rows
from tickloom.streaming.sinks import (
    compact_table,
    fold_table,
    read_landed_ticks,
    read_recent_volume,
    read_revisions,
    read_table,
    write_relational,
    write_store,
)

__all__ = [
    "await_any",
    "compact_table",
    "dropped_late",
    "fold_table",
    "land_ticks",
    "read_landed_ticks",
    "read_recent_volume",
    "read_revisions",
    "read_table",
    "run_to_end",
    "speed_metrics",
    "start_message_echo",
    "start_recent_volume",
    "start_speed_layer",
    "state_rows",
    "tick_stream",
    "write_relational",
    "write_store",
]
