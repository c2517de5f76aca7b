"""Removing trades that overlapping polls delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EVENT_TIME = "api_call_timestamp"


def unique_ticks(
    ticks: DataFrame,
    keys=("trade_id",),
    delay: str = "1 minute",
    mode: str = "bounded",
    null_ids: str = "dedup",
) -> DataFrame:
    """One row per trade, attributed to the first poll that returned it.

    A stream keeps the row that arrives first and drops rows later than the
    watermark. ``forever`` remembers every id, so its state only grows;
    ``bounded`` forgets an id ``delay`` after its first poll. A batch has no
    watermark and keeps the earliest poll, see :func:`first_polls`.

    A stateful dedup sends all copies of an id to one task. Genuine ids repeat
    as often as polls overlap; a missing id can be in any share of the rows.
    ``null_ids="drop"`` leaves rows without a key out before that shuffle.
    """
    keys = list(keys)
    if null_ids == "drop":
        ticks = ticks.dropna(subset=keys)
    if not ticks.isStreaming:
        return first_polls(ticks, keys)
    marked = ticks.withWatermark(EVENT_TIME, delay)
    if mode == "forever":
        return marked.dropDuplicates(keys)
    return marked.dropDuplicatesWithinWatermark(keys)


def first_polls(ticks: DataFrame, keys=("trade_id",)) -> DataFrame:
    """Batch dedup with a deterministic survivor: the smallest row per key.

    Rows compare by poll time first and by the remaining columns after it.
    The minimum is combined before the shuffle, so a key that holds a large
    share of the rows sends one row per map task. Null keys form one group.
    """
    keys = list(keys)
    rest = [c for c in ticks.columns if c not in keys and c != EVENT_TIME]
    first = F.min(F.struct(EVENT_TIME, *rest)).alias("first")
    return (
        ticks.groupBy(*keys)
        .agg(first)
        .select(*keys, "first.*")
        .select(*ticks.columns)
    )
