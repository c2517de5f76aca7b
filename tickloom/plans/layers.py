"""Batch layer, keyed tables, look-back and the serving view."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.times import instant, utc_date
from tickloom.operators.dedup import first_polls
from tickloom.operators.metrics import tick_metrics
from tickloom.plans.polls import FIRST, POLL, TRADE, WAS, add_changes, looked_up, trade_name, write_base
from tickloom.plans.tables import to_table_rows
from tickloom.schemas import TABLE_DDL, TABLE_KEY
from tickloom.workspace import remove

DATE = "api_call_date"
BATCH = "batch_id"


def with_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DATE, utc_date("api_call_timestamp_utc"))


def batch_layer(ticks: DataFrame, keys=("trade_id",), numbers: str = "double") -> DataFrame:
    """Accurate table rows from all ticks: exact dedup, then the aggregates."""
    return to_table_rows(tick_metrics(first_polls(ticks, keys), numbers))


def write_rows(rows: DataFrame, path: str) -> None:
    """Write table rows partitioned by date, replacing only the dates present.

    The rebalance hint lets adaptive execution merge small dates into fewer
    files and split a heavy date over several tasks. Sorting inside the files
    makes their row-group statistics useful for hour filters.
    """
    (
        with_date(rows)
        .hint("rebalance", DATE)
        .sortWithinPartitions(DATE, "api_call_timestamp_utc", "product_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE)
        .parquet(path)
    )


def land_batch(ticks: DataFrame, path: str) -> DataFrame:
    """Write ticks by the date of their poll and return the table, its date last.

    Building and refreshing the batch layer read their ticks several times.
    Where these come from messages, each time would parse all messages again;
    landed ticks are parsed once, and a read of some dates takes no other files.
    """
    dated = ticks.withColumn(DATE, utc_date("api_call_timestamp"))
    dated.hint("rebalance", DATE).write.partitionBy(DATE).parquet(path)
    return ticks.sparkSession.read.schema(dated.schema).parquet(path)


def _whole_date(bound: date | datetime) -> date:
    """A date, or the UTC midnight it starts at."""
    if not isinstance(bound, datetime):
        return bound
    if bound.utcoffset():
        raise ValueError(f"{bound} is not in UTC")
    if (bound.hour, bound.minute, bound.second, bound.microsecond) != (0, 0, 0, 0):
        raise ValueError("start and end must be midnights")
    return bound.date()


def _places(path: str) -> tuple[str, str]:
    return f"{path}/rows", f"{path}/first-polls"


def build_batch_layer(
    ticks: DataFrame, path: str, keys=("trade_id",), numbers: str = "double", buckets: int | None = None
) -> None:
    """Write the batch layer under ``path``: its rows, and the index of first polls.

    The index is what lets a refresh tell which dates gain or lose a trade. Reads
    ``ticks`` twice, the second time its keys and times only.
    """
    rows, index = _places(path)
    write_rows(batch_layer(ticks, keys, numbers), rows)
    firsts = ticks.groupBy(trade_name(list(keys)).alias(TRADE)).agg(F.min("api_call_timestamp").alias(FIRST))
    write_base(firsts, index, 0, buckets)


def read_batch_layer(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by :func:`build_batch_layer`, with their date."""
    return spark.read.schema(f"{TABLE_DDL}, {DATE} date").parquet(_places(path)[0])


def _of_dates(ticks: DataFrame, dates: list[date]) -> DataFrame:
    """Ticks polled on some UTC dates; prunes a table partitioned by date."""
    if not dates:
        return ticks.where("false")
    polled = F.col("api_call_timestamp")
    day = timedelta(days=1)
    spans = [(polled >= instant(d)) & (polled < instant(d + day)) for d in dates]
    found = ticks.where(reduce(lambda a, b: a | b, spans))
    return found.where(F.col(DATE).isin(dates)) if DATE in ticks.columns else found


_CHANGED = f"NOT ({FIRST} <=> {WAS})"


def _told(moves: DataFrame):
    """How many trades are lost or changed, and on which dates: one value a day."""
    changed = F.expr(_CHANGED)
    days = F.flatten(F.collect_set(F.when(changed, F.array_compact(F.array(utc_date(FIRST), utc_date(WAS))))))
    return moves.agg(
        F.count_if(F.col(FIRST).isNull()).alias("lost"),
        F.count_if(changed).alias("changed"),
        days.alias("changed_dates"),
        F.collect_set(utc_date(FIRST)).alias("dates"),
    ).first()


def refresh_batch_layer(
    ticks: DataFrame,
    path: str,
    start: date | datetime,
    end: date | datetime,
    keys=("trade_id",),
    numbers: str = "double",
) -> list[date]:
    """Bring the dates of ``[start, end)`` up to date; returns the dates rewritten.

    ``ticks`` are all ticks there are; only those polled on the dates given may
    have changed since the table was written. The trades concerned are those
    polled on these dates and those counted there before. The index says when
    they were polled first. Only for a trade that is gone from its first date are
    ticks of later dates read, and only if there is such a trade. A trade that
    moves to another date, in or out, has both dates rewritten; dates left
    without a row lose their old ones. The result equals a full recompute.

    The index changes last, so a refresh that fails is simply run again. Ticks
    with the column ``api_call_date`` are pruned by it.
    """
    spark, keys = ticks.sparkSession, list(keys)
    first_date, end_date = _whole_date(start), _whole_date(end)
    asked = [first_date + timedelta(days=n) for n in range((end_date - first_date).days)]
    if not asked:
        return []
    rows_path, index = _places(path)
    stage = f"{path}/refresh-{uuid.uuid4().hex}"
    polled_at = F.col("api_call_timestamp")
    named = ticks.withColumn(TRADE, trade_name(keys))

    def polls_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(TRADE).agg(F.min(polled_at).alias(POLL))

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{stage}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{stage}/{name}")

    inside = (F.col(WAS) >= instant(first_date)) & (F.col(WAS) < instant(end_date))
    concerned = looked_up(spark, index, polls_of(_of_dates(named, asked)))
    # What was first on these dates has no other poll before their end.
    now = F.when(F.col(WAS).isNull() | inside, F.col(POLL)).otherwise(F.least(WAS, POLL))
    concerned = concerned.where(F.col(POLL).isNotNull() | inside)
    moves = kept(concerned.select(TRADE, WAS, now.alias(FIRST)), "seen")
    told = _told(moves)
    if told["lost"]:
        lost = moves.where(f"{FIRST} IS NULL")
        later = named.where(polled_at >= instant(end_date))
        later = later.where(F.col(DATE) >= F.lit(end_date)) if DATE in ticks.columns else later
        again = polls_of(later.join(lost.select(TRADE), TRADE, "left_semi")).withColumnRenamed(POLL, FIRST)
        found = lost.select(TRADE, WAS).join(again, TRADE, "left").select(TRADE, WAS, FIRST)
        moves = kept(moves.where(f"{FIRST} IS NOT NULL").unionByName(found), "moves")
        told = _told(moves)
    touched = sorted({*asked, *told["changed_dates"]})

    firsts, held = moves.select(TRADE, FIRST).where(f"{FIRST} IS NOT NULL"), set(told["dates"])
    further = [d for d in touched if d not in set(asked)]
    if further:
        others = polls_of(_of_dates(named, further)).join(moves, TRADE, "left_anti")
        known = looked_up(spark, index, others).where(F.col(POLL).isNotNull())
        firsts = kept(firsts.unionByName(known.select(TRADE, F.col(WAS).alias(FIRST))), "firsts")
        held = {r[0] for r in firsts.select(utc_date(FIRST)).distinct().collect()}  # one value a day
    window = _of_dates(named, touched).drop(DATE)
    marks = firsts.select(F.col(TRADE).alias("own_"), FIRST)
    own = window.join(marks, (F.col(TRADE) == F.col("own_")) & (polled_at == F.col(FIRST)), "left_semi")
    write_rows(batch_layer(own.drop(TRADE), keys, numbers), rows_path)
    for day in set(touched) - held:
        remove(spark, f"{rows_path}/{DATE}={day}")
    if told["changed"]:
        add_changes(moves.where(_CHANGED), index)
    remove(spark, stage)
    return touched


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Table rows written by :func:`write_rows`, with their date column."""
    return spark.read.parquet(path)


def latest_rows(revisions: DataFrame, keys=TABLE_KEY) -> DataFrame:
    """The newest revision of every key: what an upserting store would hold.

    ``revisions`` carries ``batch_id``. The maximum is combined before the
    shuffle, so a key with many revisions stays cheap. The date follows from
    the key; grouping by it as well lets a date filter prune partitions.
    """
    keys = [*keys, *([DATE] if DATE in revisions.columns else [])]
    rest = [c for c in revisions.columns if c not in (*keys, BATCH)]
    newest = F.max_by(F.struct(*rest), BATCH).alias("newest")
    columns = [c for c in revisions.columns if c != BATCH]
    return revisions.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*columns)


def lookback(rows: DataFrame, start: date | datetime, end: date | datetime, products=()) -> DataFrame:
    """Table rows of ``[start, end)``, UTC times, optionally of some products only.

    The date bounds prune partitions, the time bounds reach the row groups.
    """
    polled = F.col("api_call_timestamp_utc")
    found = rows.where((polled >= instant(start)) & (polled < instant(end)))
    if DATE in rows.columns:
        found = found.where(F.col(DATE).between(utc_date(instant(start)), utc_date(instant(end))))
    if products:
        found = found.where(F.col("product_id").isin(*products))
    return found


def serving_view(batch: DataFrame, speed: DataFrame, horizon: date | datetime) -> DataFrame:
    """Batch rows before the horizon, speed rows from it on.

    Up to ``horizon``, a UTC time, the batch layer is complete: what the speed
    layer has there and the batch layer lacks was rightly corrected away.
    ``layer`` says where a row comes from. No join; each table is read once,
    and a table with the date column is pruned by it.
    """
    polled, split = F.col("api_call_timestamp_utc"), instant(horizon)
    accurate, newer = batch.where(polled < split), speed.where(polled >= split)
    if DATE in batch.columns:
        accurate = accurate.where(F.col(DATE) <= utc_date(split))
    if DATE in speed.columns:
        newer = newer.where(F.col(DATE) >= utc_date(split))
    return accurate.withColumn("layer", F.lit("batch")).unionByName(newer.withColumn("layer", F.lit("speed")))
