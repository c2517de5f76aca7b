"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import written

PLACE = "place_"


def ordered(df: DataFrame, path: str, *keys) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, written to ``path``.

    The column ``place_`` holds the partition in its upper bits and the row's
    place in that partition below. Rows of one leading key are split by the
    keys that follow, so a common one does not land in one task.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn(PLACE, F.monotonically_increasing_id()), path)


def runs(rows: DataFrame, *by) -> list:
    """``part``, the columns of ``by``, ``first`` place and ``n`` rows, in order.

    One row for each partition and each value of ``by`` in it: as rows are
    sorted by ``by``, at most the partitions plus the distinct values.
    """
    part = F.shiftright(PLACE, 33).alias("part")
    found = rows.groupBy(part, *by).agg(F.min(PLACE).alias("first"), F.count("*").alias("n"))
    return sorted(found.collect(), key=lambda r: r["first"])


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` of :func:`ordered` with their number, from 1, in ``column``."""
    base, total = [], 0
    for run in runs(rows):
        base.append((run["part"], total - run["first"] + 1))
        total += run["n"]
    offsets = rows.sparkSession.createDataFrame(base, "part_ bigint, shift_ bigint")
    own = F.shiftright(PLACE, 33)
    joined = rows.join(F.broadcast(offsets), own == F.col("part_"))  # a row for each partition
    return joined.withColumn(column, F.col(PLACE) + F.col("shift_")).drop("part_", "shift_", PLACE)
