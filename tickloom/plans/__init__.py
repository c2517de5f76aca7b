from tickloom.plans.layers import (
    batch_layer,
    build_batch_layer,
    land_batch,
    latest_rows,
    lookback,
    read_batch_layer,
    refresh_batch_layer,
    serving_view,
    write_rows,
)
from tickloom.plans.tables import (
    narrow_rows,
    to_relational_rows,
    to_table_rows,
    violations,
)

__all__ = [
    "batch_layer",
    "build_batch_layer",
    "land_batch",
    "latest_rows",
    "lookback",
    "narrow_rows",
    "read_batch_layer",
    "refresh_batch_layer",
    "serving_view",
    "to_relational_rows",
    "to_table_rows",
    "violations",
    "write_rows",
]
