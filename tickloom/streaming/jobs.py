"""Starting, running and watching the streaming jobs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.parsing import parse_ticks
from tickloom.functions.rendering import echo_rows
from tickloom.operators.dedup import unique_ticks
from tickloom.operators.metrics import per_second, tick_metrics
from tickloom.operators.rolling import recent_volume
from tickloom.params import JobParams, require_utc, stream_session
from tickloom.schemas import METRIC_FIELDS, TRADE_FIELDS
from tickloom.sources.records import stream_records
from tickloom.streaming.accounts import Accounts
from tickloom.streaming.sinks import land_writer, speed_writer, volume_writer


def tick_stream(
    spark: SparkSession,
    params: JobParams,
    path: str | None = None,
    fields=METRIC_FIELDS,
    counted: bool = False,
) -> DataFrame:
    """Ticks of the raw topic, of the chosen products, duplicates included.

    Where the dedup has one key, trades of one message that lack it are one
    trade already here, before the shuffle that would send them to one task.
    """
    records = stream_records(spark, params, path)
    one = params.dedup_keys[0] if len(params.dedup_keys) == 1 and params.null_ids == "dedup" else None
    return parse_ticks(records, fields, products=params.products, counted=counted, one_missing=one)


def _unique(ticks: DataFrame, params: JobParams) -> DataFrame:
    return unique_ticks(ticks, params.dedup_keys, params.delay, params.dedup, params.null_ids)


def speed_metrics(ticks: DataFrame, params: JobParams, grain: str = "poll") -> DataFrame:
    """Watermark, dedup and aggregates: the speed layer's whole computation.

    Groups are exact poll times, or whole ``second``s, named by their start: a
    window on event time, final once the watermark has passed its end.
    """
    unique = _unique(ticks, params)
    if grain == "second":
        return per_second(unique, params.numbers).withColumnRenamed("second", "api_call_timestamp")
    return tick_metrics(unique, params.numbers)


def _start(writer, params: JobParams, checkpoint: str, name: str | None) -> StreamingQuery:
    """Start with the job's trigger: live, unless it is to process what is there."""
    if params.trigger_interval:
        writer = writer.trigger(processingTime=params.trigger_interval)
    elif params.available_now:
        writer = writer.trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    return writer.option("checkpointLocation", checkpoint).start()


def start_speed_layer(
    spark: SparkSession,
    params: JobParams,
    checkpoint: str,
    table: str,
    raw: str | None = None,
    messages: str | None = None,
    name: str | None = None,
    grain: str = "poll",
    accounts: str | None = None,
) -> StreamingQuery:
    """Raw topic to keyed table, message topic and external store.

    The last two are optional: messages go out when a folder or a broker topic
    is named, the store is written when its table is. One query feeds all of
    them, so parsing, dedup and aggregation happen once. Append mode publishes
    a group once it is final; update mode publishes every revision and the
    keyed table shows the newest. ``grain`` is that of :func:`speed_metrics`.
    Below ``accounts``, if named, every batch leaves a row of what it read and
    what vanished in it.
    """
    session = stream_session(spark, params)
    require_utc(session)
    if accounts:
        session.streams.addListener(Accounts(session, accounts))
    metrics = speed_metrics(tick_stream(session, params, raw, counted=bool(accounts)), params, grain)
    callback = speed_writer(table, params, messages)
    writer = metrics.writeStream.outputMode(params.output_mode).foreachBatch(callback)
    return _start(writer, params, checkpoint, name)


def land_ticks(
    spark: SparkSession,
    params: JobParams,
    checkpoint: str,
    target: str,
    raw: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Raw topic to a dated table of deduplicated ticks for the batch layer."""
    session = stream_session(spark, params)
    require_utc(session)
    ticks = _unique(tick_stream(session, params, raw, TRADE_FIELDS), params)
    writer = ticks.writeStream.outputMode("append").foreachBatch(land_writer(target, params))
    return _start(writer, params, checkpoint, name)


def start_recent_volume(
    spark: SparkSession,
    params: JobParams,
    checkpoint: str,
    target: str,
    span: str = "1 hour",
    raw: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Raw topic to a dated table of aggregates with the volume of their last ``span``.

    A row is written once, when it is final, by one query: dedup, aggregates and
    the sums over them are three stateful steps behind one watermark.
    """
    if not params.rocksdb or params.output_mode != "append":
        raise ValueError("recent volume of a stream needs RocksDB state and append mode")
    session = stream_session(spark, params)
    require_utc(session)
    metrics = speed_metrics(tick_stream(session, params, raw), params)
    writer = recent_volume(metrics, span).writeStream.outputMode("append").foreachBatch(volume_writer(target, params))
    return _start(writer, params, checkpoint, name)


def start_message_echo(
    spark: SparkSession,
    params: JobParams,
    checkpoint: str,
    messages: str | None = None,
    target: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Message topic back to the console, or to files under ``target``."""
    session = stream_session(spark, params)
    records = stream_records(session, params, messages, params.message_topic, strict=True)
    writer = echo_rows(records).writeStream.outputMode("append")
    if target:
        writer = writer.format("parquet").option("path", target)
    else:
        writer = writer.format("console").option("truncate", "false")
    return _start(writer, params, checkpoint, name)


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query that ends by itself; its failure is raised here."""
    query.awaitTermination()
    return query


def await_any(queries, every: float | None = None, work=None) -> None:
    """Wait until one of the queries ends, then stop the others.

    The failure of any query is raised, not only that of the last one. Every
    so many seconds ``work`` is called; what it raises stops the queries too.
    """
    queries = list(queries)
    due = time.monotonic() + every if every else None
    try:
        while all(q.isActive for q in queries):
            for q in queries:
                if q.awaitTermination(1):
                    break
            if due and time.monotonic() >= due:
                work()
                due = time.monotonic() + every
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    for q in queries:
        if q.exception() is not None:
            raise q.exception()
