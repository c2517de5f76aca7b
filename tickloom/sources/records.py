"""Topic records, from a message broker or from files of the same shape.

The file source is the tested one. The broker source needs Spark's Kafka
connector on the classpath.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.params import JobParams
from tickloom.schemas import RECORD_DDL


def kafka_options(params: JobParams, topic: str, strict: bool | None = None) -> dict[str, str]:
    """Options of the broker source. ``strict`` fails on lost data."""
    strict = params.strict_source if strict is None else strict
    options = {
        "kafka.bootstrap.servers": params.broker,
        "subscribe": topic,
        "includeHeaders": "true",
        "failOnDataLoss": str(strict).lower(),
        "startingOffsets": params.starting_offsets,
    }
    if params.min_partitions:
        options["minPartitions"] = str(params.min_partitions)
    return options


def file_options(params: JobParams, strict: bool | None = None) -> dict[str, str]:
    """Options of the file source; lost data means missing or broken files."""
    strict = params.strict_source if strict is None else strict
    tolerant = str(not strict).lower()
    options = {
        "ignoreMissingFiles": tolerant,
        "ignoreCorruptFiles": tolerant,
        "recursiveFileLookup": "true",
    }
    if params.max_files_per_trigger:
        options["maxFilesPerTrigger"] = str(params.max_files_per_trigger)
    if params.max_bytes_per_trigger:
        options["maxBytesPerTrigger"] = str(params.max_bytes_per_trigger)
    return options


def stream_records(
    spark: SparkSession,
    params: JobParams,
    path: str | None = None,
    topic: str | None = None,
    strict: bool | None = None,
) -> DataFrame:
    """Unbounded topic records: of ``topic``, or of the files under ``path``."""
    if params.source == "kafka":
        options = kafka_options(params, topic or params.raw_topic, strict)
        return spark.readStream.format("kafka").options(**options).load()
    return (
        spark.readStream.schema(RECORD_DDL)
        .format(params.file_format)
        .options(**file_options(params, strict))
        .load(path)
    )


def read_records(
    spark: SparkSession,
    params: JobParams,
    path: str | None = None,
    topic: str | None = None,
) -> DataFrame:
    """The same records as a bounded table, for the batch layer.

    Always strict: a broken or missing file fails the read.
    """
    if params.source == "kafka":
        options = kafka_options(params, topic or params.raw_topic, strict=True)
        options.pop("startingOffsets")
        return spark.read.format("kafka").options(**options).load()
    options = file_options(params, strict=True)
    options.pop("maxFilesPerTrigger", None)
    options.pop("maxBytesPerTrigger", None)
    return spark.read.schema(RECORD_DDL).format(params.file_format).options(**options).load(path)
