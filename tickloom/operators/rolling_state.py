"""Recent volume over a stream: the last span of each product as keyed state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

AT = "_at"


def frame_sums(times: list[int], values: list, width: int, first: int) -> list:
    """For each row from ``first`` on the sum of the values in ``[time - width, time]``.

    Times ascend; rows of one time see each other. Nothing is subtracted, so
    that doubles do not drift: sums from a row up to a middle, and from there on.
    A null counts for nothing, a frame of nulls has null.
    """
    known = [0, *accumulate(v is not None for v in values)]
    values = [v or 0 for v in values]
    sums, low, middle, high = [], 0, 0, 0
    before, after = {}, 0
    for at in times[first:]:
        while high < len(times) and times[high] <= at:
            after += values[high]
            high += 1
        low = bisect_left(times, at - width, low, high)
        if low >= middle:
            suffixes = accumulate(reversed(values[low:high]))
            before = dict(zip(range(high - 1, low - 1, -1), suffixes))
            middle, after = high, 0
        sums.append(before[low] + after if known[high] > known[low] else None)
    return sums


def _due(at: int) -> int:
    """The timer, in ms, that fires once the watermark has reached ``at``, in us."""
    return -(-at // 1000) - 1


class LastSpan(StatefulProcessor):
    """Rows of a product wait until the watermark has reached them, then leave with their sum.

    State is the rows that wait and, of those that left, time and volume for as
    long as a later row can reach back to them. A product without rows for a
    span has no state.
    """

    def __init__(self, waiting: StructType, recent: StructType, width: int):
        self.schemas, self.width = (waiting, recent), width
        self.time, self.volume = waiting.names.index(AT), waiting.names.index("share_volume")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.recent = handle.getListState("recent", self.schemas[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schemas[0].names
        came = [tuple(row[name] for name in names) for row in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(_due(min(row[self.time] for row in came)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(map(tuple, self.waiting.get()), key=lambda row: row[self.time])
        final = [row for row in held if row[self.time] <= reached]
        recent = [tuple(row) for row in self.recent.get()]
        times = [at for at, _ in recent] + [row[self.time] for row in final]
        values = [volume for _, volume in recent] + [row[self.volume] for row in final]
        sums = frame_sums(times, values, self.width, len(recent))
        self._keep(self.waiting, held[len(final) :], lambda row: row[self.time])
        still = [(at, v) for at, v in zip(times, values) if at > reached - self.width]
        self._keep(self.recent, still, lambda row: row[0] + self.width)
        out = Row(*self.schemas[0].names, "recent_volume")
        return (out(*row, total) for row, total in zip(final, sums))

    def _keep(self, state, rows: list[tuple], due) -> None:
        """Replace a list; a timer comes back for the first of its rows that is due."""
        if rows:
            state.put(rows)
            self.handle.registerTimer(_due(due(rows[0])))
        else:
            state.clear()

    def close(self) -> None:
        pass


def recent_volume_stream(metrics: DataFrame, width: int, time: str) -> DataFrame:
    """Adds ``recent_volume``, the volume of the last ``width`` microseconds, to a stream.

    In append mode a row is out once the watermark, which ``metrics`` must have
    on ``time``, has reached it; by then all rows of its span are there. Rows
    later than the watermark are dropped, and so are rows without a time. A
    product is one key: its state grows with the rows of a span, not with its
    trades. Needs the RocksDB state store.
    """
    fields = [f for f in metrics.schema if f.name != time]
    waiting = StructType([StructField(AT, LongType()), *fields])
    volume = metrics.schema["share_volume"].dataType
    recent = StructType([StructField(AT, LongType()), StructField("volume", volume)])
    out = StructType([*waiting, StructField("recent_volume", volume)])
    marked = metrics.where(F.col(time).isNotNull()).withColumn(AT, F.unix_micros(time))
    sums = marked.groupBy("product_id").transformWithState(
        LastSpan(waiting, recent, width), out, "append", "eventTime"
    )
    return sums.withColumn(time, F.timestamp_micros(AT)).select(*metrics.columns, "recent_volume")
