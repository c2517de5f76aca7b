from tickloom.operators.dedup import first_polls, unique_ticks
from tickloom.operators.metrics import per_second, tick_metrics
from tickloom.operators.rolling import price_change, recent_volume, rolling_metrics

__all__ = [
    "first_polls",
    "per_second",
    "price_change",
    "recent_volume",
    "rolling_metrics",
    "tick_metrics",
    "unique_ticks",
]
