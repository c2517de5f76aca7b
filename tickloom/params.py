"""Job parameters and the session they ask for."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

# Environment variables a deployment already exports.
ENVIRONMENT = {
    "raw_topic": "RAW_TRADES_KAFKA_TOPIC",
    "message_topic": "AGG_TRADES_KAFKA_TOPIC",
    "broker": "KAFKA_BROKER",
    "store_catalog": "CASSANDRA_DB_SPEED_LAYER_CATALOG",
    "store_keyspace": "CASSANDRA_DB_SPEED_LAYER_KEYSPACE",
    "store_table": "CASSANDRA_DB_SPEED_LAYER_TABLE",
    "store_host": "CASSANDRA_DB_HOST",
    "store_port": "CASSANDRA_DB_PORT",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


@dataclass(frozen=True)
class JobParams:
    """Everything a job can be told.

    ``dedup``            ``bounded`` forgets an id once the watermark has passed
                         it; ``forever`` never forgets one.
    ``null_ids``         ``dedup`` treats trades without an id as one trade;
                         ``drop`` leaves them out, so that they cannot all meet
                         in one state task.
    ``state_partitions`` width of the stateful shuffles. A checkpoint pins it.
                         None takes the session's shuffle width.
    ``write_tasks``      tasks that write one micro-batch; None leaves one per
                         state partition.
    ``max_bytes_per_trigger``, ``max_files_per_trigger``
                         how much of a file source one micro-batch takes.
    ``strict_source``    fail when the source lost data; False lets a stream go
                         on without it. Batch reads are always strict.
    ``available_now``    process what is there and end. Otherwise the job is
                         live: a batch as soon as the last one ended, or every
                         ``trigger_interval``.
    """

    raw_topic: str | None = None
    message_topic: str | None = None
    broker: str | None = None
    store_catalog: str | None = None
    store_keyspace: str | None = None
    store_table: str | None = None
    store_host: str | None = None
    store_port: str | None = None
    source: str = "files"
    file_format: str = "parquet"
    products: tuple[str, ...] = ()
    delay: str = "1 minute"
    dedup: str = "bounded"
    dedup_keys: tuple[str, ...] = ("trade_id",)
    null_ids: str = "dedup"
    numbers: str = "double"
    output_mode: str = "append"
    state_partitions: int | None = None
    rocksdb: bool = True
    count_state: bool = True
    strict_source: bool = True
    starting_offsets: str = "latest"
    min_partitions: int | None = None
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int | None = None
    write_tasks: int | None = None
    trigger_interval: str | None = None
    available_now: bool = False
    app_name: str = "tickloom"

    def __post_init__(self):
        if self.dedup not in ("bounded", "forever"):
            raise ValueError(f"dedup is 'bounded' or 'forever', not {self.dedup!r}")
        if self.source not in ("files", "kafka"):
            raise ValueError(f"source is 'files' or 'kafka', not {self.source!r}")
        if self.null_ids not in ("dedup", "drop"):
            raise ValueError(f"null_ids is 'dedup' or 'drop', not {self.null_ids!r}")

    @classmethod
    def from_env(cls, environ=None, **overrides) -> "JobParams":
        """Read the deployment's variables; keyword arguments win over them."""
        environ = os.environ if environ is None else environ
        found = {
            name: environ[variable]
            for name, variable in ENVIRONMENT.items()
            if environ.get(variable)
        }
        return cls(**{**found, **overrides})

    def require_names(self) -> None:
        """Refuse to start a broker job that does not say where to read and write."""
        needed = ("broker", "raw_topic", "message_topic") if self.source == "kafka" else ()
        missing = [ENVIRONMENT[name] for name in needed if not getattr(self, name)]
        if missing:
            raise ValueError(f"set {', '.join(missing)}")

    def but(self, **changes) -> "JobParams":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def session_settings(params: JobParams) -> dict[str, str]:
    """Session settings the parameters imply."""
    settings = {"spark.sql.session.timeZone": "UTC"}
    if params.state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(params.state_partitions)
    if params.rocksdb:
        settings["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB_PROVIDER
        rocksdb = "spark.sql.streaming.stateStore.rocksdb"
        # Upload only what a batch changed; full snapshots follow in the background. A job that
        # takes what is there and ends has few large batches and no background: each run would
        # read the changes of all runs before it again. It uploads the store's new files instead.
        settings[f"{rocksdb}.changelogCheckpointing.enabled"] = str(not params.available_now).lower()
        # The count of rows in state costs a look-up for every row put or removed.
        settings[f"{rocksdb}.trackTotalNumberOfRows"] = str(params.count_state).lower()
        # One memory budget per executor, however many state partitions it holds.
        settings[f"{rocksdb}.boundedMemoryUsage"] = "true"
    return settings


def state_width(spark: SparkSession, rows: int, rows_each: int = 4_000_000) -> int:
    """State partitions of a stream that is to take ``rows`` rows in all.

    Every state partition has a price in every batch, however few rows it gets: a
    store to open and to commit for each stateful step, and files for each date it
    writes. So there are no more than cores to work on them, or some multiple of that, so that no
    round leaves cores idle, if each would get more than ``rows_each`` rows; the session's shuffle width, made for batches whose
    partitions are merged while they run, is no measure of that.
    """
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    round_ = max(1, min(cores, session))
    return round_ * max(1, -(-rows // (rows_each * round_)))


def build_session(params: JobParams, log_level: str = "WARN") -> SparkSession:
    """Session of a stand-alone job. Master and jars come from spark-submit."""
    builder = SparkSession.builder.appName(params.app_name)
    for key, value in session_settings(params).items():
        builder = builder.config(key, value)
    if params.store_host:
        builder = builder.config("spark.cassandra.connection.host", params.store_host)
    if params.store_port:
        builder = builder.config("spark.cassandra.connection.port", params.store_port)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    return spark


def stream_session(spark: SparkSession, params: JobParams) -> SparkSession:
    """A sibling session with the stream's settings; ``spark`` stays untouched.

    It keeps every setting of ``spark`` that can be set at run time.
    """
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and sibling.conf.isModifiable(key):
            sibling.conf.set(key, value)
    for key, value in session_settings(params).items():
        sibling.conf.set(key, value)
    return sibling


def require_utc(spark: SparkSession) -> None:
    """Hour buckets and dates are UTC; refuse a session that would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")
