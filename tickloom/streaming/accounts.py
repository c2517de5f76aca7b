"""Accounts of a running stream: what each micro-batch read, and what vanished in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tickloom.functions.parsing import ARRIVED
from tickloom.workspace import children

ACCOUNTS_DDL = (
    "query string, batch_id bigint, began string, messages bigint, rejected bigint, late_rows bigint, state_rows bigint"
)


class Accounts(StreamingQueryListener):
    """Writes one row for each micro-batch below ``folder``.

    ``messages`` arrived, of which ``rejected`` could not be parsed and gave no
    tick; ``late_rows`` were dropped by the stateful operators as later than the
    watermark; ``state_rows`` are held by them. A batch that is reported again
    replaces its row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        counted = progress.observedMetrics.get(ARRIVED)
        name = progress.name or str(progress.id)
        row = (
            name,
            progress.batchId,
            progress.timestamp,
            counted["messages"] if counted else 0,
            counted["rejected"] if counted else 0,
            sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
            sum(op.numRowsTotal for op in progress.stateOperators),
        )
        rows = self.spark.createDataFrame([row], ACCOUNTS_DDL).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}-{progress.batchId}")


def read_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """All accounts written below a folder; none if there is no such folder yet."""
    done = [name for name in children(spark, folder) if "_SUCCESS" in children(spark, f"{folder}/{name}")]
    if not done:
        return spark.createDataFrame([], ACCOUNTS_DDL)
    return spark.read.schema(ACCOUNTS_DDL).parquet(*[f"{folder}/{name}" for name in done])
