"""Sinks of the speed layer.

A keyed table is a folder with one sub-folder per micro-batch. A batch that is
run again replaces its own folder, so a retry changes nothing. A table belongs
to the checkpoint that numbers its batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.rendering import to_messages
from tickloom.functions.times import utc_date
from tickloom.params import JobParams
from tickloom.plans.layers import BATCH, DATE, latest_rows, with_date, write_rows
from tickloom.plans.tables import assert_valid, narrow_rows, to_table_rows
from tickloom.schemas import MEASURE_COLUMNS, METRICS_DDL, TABLE_DDL, TRADE_FIELDS
from tickloom.workspace import children, moved, remove

# Below a table, in names that readers of its batches pass over: the rows of
# folded batches, a folder for each fold with the dates it has written, and a
# manifest for each fold, named by its last batch.
FOLDED = "_folded"
MANIFESTS = "_folds"
FOLD = "fold"


def _write_batch(rows: DataFrame, path: str, batch_id: int, tasks: int | None) -> str:
    """Write one batch to its folder, by ``tasks`` tasks if that is set.

    The shuffle this costs carries finished rows only. Without it every state
    partition writes its own files, which get small when there are many.
    """
    folder = f"{path}/{BATCH}={batch_id}"
    if tasks:
        rows = rows.repartition(tasks, *rows.columns)
    # Static: a retry replaces the whole folder, also the dates it no longer has.
    overwrite = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    overwrite.partitionBy(DATE).parquet(folder)
    return folder


def _table_rows(metrics: DataFrame) -> DataFrame:
    """Table rows in the table's types, also when the sums were decimals."""
    rows = to_table_rows(metrics)
    return with_date(rows.withColumns({c: F.col(c).cast("double") for c in MEASURE_COLUMNS}))


def speed_writer(path: str, params: JobParams, messages: str | None = None):
    """Batch callback of the speed layer.

    It adds the batch to the keyed table under ``path`` and then feeds the
    other outputs, the message topic and the external store, from the rows just
    written rather than from the streaming plan. So the stateful plan runs
    once, all outputs agree, and nothing has to stay cached on executors that
    may be lost in between.
    """
    sends = bool(messages) or (params.source == "kafka" and bool(params.message_topic))

    def write(metrics: DataFrame, batch_id: int) -> None:
        folder = _write_batch(_table_rows(metrics), path, batch_id, params.write_tasks)
        if not sends and not params.store_table:
            return
        written = metrics.sparkSession.read.schema(f"{TABLE_DDL}, {DATE} date").parquet(folder)
        if sends:
            back = written.withColumnRenamed("api_call_timestamp_utc", "api_call_timestamp")
            send_messages(back.select(*metrics.columns), f"{messages}/batch-{batch_id}", params)
        if params.store_table:
            write_store(written.drop(DATE), params)

    return write


def send_messages(metrics: DataFrame, folder: str, params: JobParams) -> None:
    """Rows as messages to the broker, or as topic records to ``folder``."""
    messages = to_messages(metrics)
    if params.source == "kafka":
        (
            messages.write.format("kafka")
            .option("kafka.bootstrap.servers", params.broker)
            .option("topic", params.message_topic)
            .save()
        )
        return
    (
        messages.select(
            F.col("key").cast("binary"),
            F.col("value").cast("binary"),
            F.lit(params.message_topic).cast("string").alias("topic"),
            F.current_timestamp().alias("timestamp"),
        )
        .write.mode("overwrite")
        .format(params.file_format)
        .save(folder)
    )


def land_writer(path: str, params: JobParams):
    """Batch callback that lands ticks, partitioned by the date of their poll."""

    def write(ticks: DataFrame, batch_id: int) -> None:
        dated = ticks.withColumn(DATE, utc_date("api_call_timestamp"))
        _write_batch(dated, path, batch_id, params.write_tasks)

    return write


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """All rows ever written to a keyed table, with their ``batch_id``."""
    return spark.read.schema(f"{TABLE_DDL}, {DATE} date, {BATCH} bigint").parquet(path)


def read_table(
    spark: SparkSession, path: str, base: str | None = None, upto: int | None = None
) -> DataFrame:
    """The keyed table as an upserting store would show it.

    Batches that :func:`fold_table` has folded are read from its copy. ``base``
    names another copy instead, of the batches up to ``upto``.
    """
    if base is not None:
        folded = spark.read.schema(f"{TABLE_DDL}, {DATE} date").parquet(base)
    else:
        upto = folded_upto(spark, path)
        folded = _folded(spark, path, _manifest(spark, path, upto)) if upto >= 0 else None
    if not any(_batch(name) > upto for name in children(spark, path)) and folded is not None:
        return folded
    revisions = read_revisions(spark, path).where(F.col(BATCH) > upto)
    if folded is not None:
        revisions = revisions.unionByName(folded.withColumn(BATCH, F.lit(upto).cast("bigint")))
    return latest_rows(revisions)


def _batch(name: str) -> int:
    """Number of the batch whose folder this is; -1 for another folder."""
    return int(name.partition("=")[2]) if name.startswith(f"{BATCH}=") else -1


def folded_upto(spark: SparkSession, path: str) -> int:
    """The last batch that is in the folded copy, -1 without one."""
    return max(_folds(spark, path), default=-1)


def _folds(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in children(spark, f"{path}/{MANIFESTS}") if name.isdigit())


def _manifest(spark: SparkSession, path: str, upto: int) -> dict:
    """By date: the fold that holds its rows. One row a date."""
    rows = spark.read.schema(f"{DATE} date, {FOLD} string").parquet(f"{path}/{MANIFESTS}/{upto}")
    return {r[DATE]: r[FOLD] for r in rows.collect()}


def _folded(spark: SparkSession, path: str, manifest: dict, dates=None) -> DataFrame:
    """Rows of the folded copy, of some dates or all that the manifest names."""
    base = f"{path}/{FOLDED}"
    named = [(d, f) for d, f in sorted(manifest.items()) if dates is None or d in dates]
    reader = spark.read.schema(f"{TABLE_DDL}, {FOLD} string, {DATE} date").option("basePath", base)
    if not named:
        return spark.createDataFrame([], f"{TABLE_DDL}, {DATE} date")
    return reader.parquet(*[f"{base}/{FOLD}={f}/{DATE}={d}" for d, f in named]).drop(FOLD)


def fold_table(spark: SparkSession, path: str, upto: int, drop: bool = False) -> list:
    """Fold the batches up to ``upto`` into the table's copy; returns the dates touched.

    Dates that the new batches have are written to a folder of this fold, beside
    what earlier folds have written, which stays as it is. Then a manifest, which
    names for every date the fold to read, gets its final name in one rename.
    Until that the batches are read, which give the same rows; so a fold that
    fails is simply run again. A reader keeps what it has opened for one more fold:
    ``drop`` removes what the manifest before this one did not need any more.
    """
    since, target = folded_upto(spark, path), f"{path}/{MANIFESTS}"
    if not any(since < _batch(name) <= upto for name in children(spark, path)):
        return []
    before = _manifest(spark, path, since) if since >= 0 else {}
    fold = f"{upto}-{uuid.uuid4().hex}"
    added = read_revisions(spark, path).where(F.col(BATCH).between(since + 1, upto))
    dates = sorted(r[0] for r in added.select(DATE).distinct().collect())  # one value a day
    if not dates and since < 0:
        return []
    if dates:
        held = _folded(spark, path, before, set(dates)).withColumn(BATCH, F.lit(since).cast("bigint"))
        write_rows(latest_rows(added.unionByName(held)).drop(DATE), f"{path}/{FOLDED}/{FOLD}={fold}")
    now = {**before, **dict.fromkeys(dates, fold)}
    named = spark.createDataFrame(sorted(now.items()), f"{DATE} date, {FOLD} string")
    waiting = f"{target}/_{fold}"
    named.coalesce(1).write.parquet(waiting)
    if not moved(spark, waiting, f"{target}/{upto}"):
        raise RuntimeError(f"another fold up to batch {upto} has ended first")
    if drop:
        _drop_unneeded(spark, path, since, {*before.items(), *now.items()})
    return dates


def _drop_unneeded(spark: SparkSession, path: str, upto: int, needed: set) -> None:
    """Remove batches up to ``upto``, manifests before it and what is not ``needed`` (date, fold)."""
    for name in children(spark, path):
        if 0 <= _batch(name) <= upto:
            remove(spark, f"{path}/{name}")
    places = {(f"{FOLD}={fold}", f"{DATE}={day}") for day, fold in needed}
    for name in children(spark, f"{path}/{FOLDED}"):
        if name not in {fold for fold, _ in places}:
            remove(spark, f"{path}/{FOLDED}/{name}")
            continue
        for day in children(spark, f"{path}/{FOLDED}/{name}"):
            if day.startswith(f"{DATE}=") and (name, day) not in places:
                remove(spark, f"{path}/{FOLDED}/{name}/{day}")
    for name in children(spark, f"{path}/{MANIFESTS}"):
        if name.startswith("_") or int(name) < upto:
            remove(spark, f"{path}/{MANIFESTS}/{name}")


def read_landed_ticks(
    spark: SparkSession, path: str, fields=TRADE_FIELDS, upto: int | None = None, since: int = -1
) -> DataFrame:
    """Ticks landed by the speed layer for the batch layer, of all batches or those after ``since`` up to ``upto``."""
    columns = ", ".join(f"{f} string" for f in fields)
    schema = f"api_call_timestamp timestamp, {columns}, {DATE} date, {BATCH} bigint"
    ticks = spark.read.schema(schema).parquet(path)
    return (ticks if upto is None else ticks.where(F.col(BATCH).between(since + 1, upto))).drop(BATCH)


def volume_writer(path: str, params: JobParams):
    """Batch callback that writes aggregates with their recent volume, in the table's types, by date."""
    land = land_writer(path, params)

    def write(rows: DataFrame, batch_id: int) -> None:
        land(rows.withColumns({c: F.col(c).cast("double") for c in (*MEASURE_COLUMNS, "recent_volume")}), batch_id)

    return write


def read_recent_volume(spark: SparkSession, path: str) -> DataFrame:
    """Aggregates of a stream with the volume of the span up to each of them."""
    schema = f"{METRICS_DDL}, recent_volume double, {DATE} date, {BATCH} bigint"
    return spark.read.schema(schema).parquet(path).drop(BATCH)


def compact_table(
    spark: SparkSession, path: str, target: str, upto: int, base: str | None = None, since: int = -1
) -> None:
    """Fold the batches up to ``upto`` into ``target``, files merged by date.

    ``base`` and ``since`` name an earlier fold to start from. ``target`` is a
    new folder, a plain dated table as :func:`~tickloom.plans.write_rows`
    leaves it; readers name it once the write is complete.
    """
    kept = read_revisions(spark, path).where(F.col(BATCH).between(since + 1, upto))
    if base:
        folded = spark.read.schema(f"{TABLE_DDL}, {DATE} date").parquet(base)
        kept = kept.unionByName(folded.withColumn(BATCH, F.lit(since).cast("bigint")))
    write_rows(latest_rows(kept).drop(DATE), target)


def write_store(rows: DataFrame, params: JobParams) -> None:
    """Append to the wide-column store; its primary key makes that an upsert.

    Needs the store's Spark connector on the classpath. With a catalog the
    table is addressed through it.
    """
    if params.store_catalog:
        name = f"{params.store_catalog}.{params.store_keyspace}.{params.store_table}"
        narrow_rows(rows).writeTo(name).append()
        return
    (
        narrow_rows(rows)
        .write.format("org.apache.spark.sql.cassandra")
        .mode("append")
        .options(table=params.store_table, keyspace=params.store_keyspace)
        .save()
    )


def write_relational(rows: DataFrame, url: str, table: str, properties=None) -> None:
    """Append to a relational table. Needs the database's JDBC driver.

    Rows that break a rule of the table stop the write before it begins.
    """
    assert_valid(rows)
    narrow_rows(rows).write.jdbc(url, table, mode="append", properties=properties or {})
