"""What the job does beside its streams: fold the table, correct it, move the horizon.

Streams write one folder a micro-batch. A pass of upkeep takes the batches that
are complete by then, folds those of the keyed table into its copy, and brings
the batch layer up to date: the dates that new landed batches have are the only
ones that can have changed, and their folders say which these are. Then the
horizon moves, up to which the batch layer is complete and the view shows it.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.times import micros_of
from tickloom.params import JobParams
from tickloom.plans.layers import BATCH, DATE, build_batch_layer, read_batch_layer, refresh_batch_layer, serving_view
from tickloom.streaming.sinks import fold_table, read_landed_ticks, read_table
from tickloom.workspace import children, moved

_EPOCH = datetime(1970, 1, 1)
_STATE = "upto bigint, newest bigint, horizon bigint"


def complete_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches of a table whose write has been committed."""
    names = [n for n in children(spark, path) if n.startswith(f"{BATCH}=")]
    return sorted(int(n.partition("=")[2]) for n in names if "_SUCCESS" in children(spark, f"{path}/{n}"))


def changed_dates(spark: SparkSession, path: str, batches: list[int]) -> list[date]:
    """The dates that some batches of a table have, by the names of their folders."""
    found = set()
    for batch in batches:
        names = children(spark, f"{path}/{BATCH}={batch}")
        found |= {n.partition("=")[2] for n in names if n.startswith(f"{DATE}=")}
    return sorted(date.fromisoformat(d) for d in found)


def stretches(dates: list[date]) -> list[tuple[date, date]]:
    """Days in a row as (first, day after the last)."""
    found: list[tuple[date, date]] = []
    for day in dates:
        if found and found[-1][1] == day:
            found[-1] = (found[-1][0], day + timedelta(days=1))
        else:
            found.append((day, day + timedelta(days=1)))
    return found


def _passes(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in children(spark, f"{folder}/upkeep") if n.isdigit())


def last_pass(spark: SparkSession, folder: str) -> tuple[int, int, int] | None:
    """Last batch, newest poll and horizon (microseconds) of the last pass that ended."""
    done = _passes(spark, folder)
    return tuple(spark.read.schema(_STATE).parquet(f"{folder}/upkeep/{done[-1]}").first()) if done else None


def _newest(known: int | None, ticks: DataFrame) -> int | None:
    """The newest poll, in microseconds, of what is known and some ticks."""
    found = ticks.agg(F.max(F.unix_micros("api_call_timestamp"))).first()[0]
    return max((n for n in (known, found) if n is not None), default=None)


def correct(spark: SparkSession, params: JobParams, folder: str) -> list[date]:
    """Bring the batch layer up to the landed batches; returns the dates rewritten.

    A micro-batch drops what is older than the watermark that the batch before it
    began with. So the next one admits no poll before the horizon: the newest
    landed poll, that of the last batch not counted, less the watermark's delay.
    It gets its new value, in one rename, when the layer is written; a pass that
    fails is made up for by the next one.
    """
    ticks_path, layer = f"{folder}/ticks", f"{folder}/batch"
    before = last_pass(spark, folder)
    since, newest = (before[0], before[1]) if before else (-1, None)
    added = [b for b in complete_batches(spark, ticks_path) if b > since]
    if not added:
        return []
    upto, dates = added[-1], changed_dates(spark, ticks_path, added)
    if not dates:
        return []
    ticks = read_landed_ticks(spark, ticks_path, upto=upto)
    keys, touched = params.dedup_keys, set(dates)
    if before is None:
        build_batch_layer(ticks, layer, keys, params.numbers)
    else:
        for start, end in stretches(dates):
            touched |= set(refresh_batch_layer(ticks, layer, start, end, keys, params.numbers))
    settled = _newest(newest, read_landed_ticks(spark, ticks_path, upto=upto - 1, since=since))
    newest = _newest(settled, read_landed_ticks(spark, ticks_path, upto=upto, since=upto - 1))
    row = [(upto, newest, max(0, settled - micros_of(params.delay)) if settled is not None else 0)]
    waiting = f"{folder}/upkeep/_{uuid.uuid4().hex}"
    spark.createDataFrame(row, _STATE).coalesce(1).write.parquet(waiting)
    if not moved(spark, waiting, f"{folder}/upkeep/{len(_passes(spark, folder))}"):
        raise RuntimeError("another pass of upkeep has ended first")
    return sorted(touched)


def upkeep(spark: SparkSession, params: JobParams, folder: str) -> list[date]:
    """One pass: fold the keyed table, then correct the batch layer."""
    batches = complete_batches(spark, f"{folder}/table")
    if batches:
        fold_table(spark, f"{folder}/table", batches[-1], drop=True)
    return correct(spark, params, folder)


def horizon(spark: SparkSession, folder: str) -> datetime | None:
    """The UTC time up to which the batch layer is complete; None before the first pass."""
    found = last_pass(spark, folder)
    return _EPOCH + timedelta(microseconds=found[2]) if found else None


def view(spark: SparkSession, folder: str) -> DataFrame:
    """The table as users see it: corrected up to the horizon, streamed from there on."""
    speed, split = read_table(spark, f"{folder}/table"), horizon(spark, folder)
    if split is None:
        return speed.withColumn("layer", F.lit("speed"))
    return serving_view(read_batch_layer(spark, f"{folder}/batch"), speed, split)
