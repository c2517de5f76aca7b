"""What a query reports about its state."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery


def _operators(query: StreamingQuery):
    for progress in query.recentProgress:
        for operator in progress.stateOperators:
            yield progress.batchId, operator


def dropped_late(query: StreamingQuery) -> int:
    """Rows the stateful operators dropped as later than the watermark."""
    return sum(op.numRowsDroppedByWatermark for _, op in _operators(query))


def state_rows(query: StreamingQuery, operator: str) -> list[int]:
    """Rows held by the named stateful operator after each batch.

    Names are Spark's: ``dedupe``, ``dedupeWithinWatermark``, ``stateStoreSave``.
    """
    return [op.numRowsTotal for _, op in _operators(query) if op.operatorName == operator]
