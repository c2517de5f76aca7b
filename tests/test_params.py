import pytest

from tickloom.params import (
    JobParams,
    build_session,
    require_utc,
    session_settings,
    stream_session,
)
from tickloom.sources import kafka_options, stream_records
from tickloom.sources.records import file_options
from tickloom.workspace import new_folder, shared_root


def test_environment_and_overrides():
    environ = {
        "RAW_TRADES_KAFKA_TOPIC": "raw",
        "AGG_TRADES_KAFKA_TOPIC": "agg",
        "KAFKA_BROKER": "broker:9092",
        "CASSANDRA_DB_SPEED_LAYER_TABLE": "speed_layer",
        "CASSANDRA_DB_HOST": "",
    }
    params = JobParams.from_env(environ, message_topic="other", products=("BTC-USD",))
    assert (params.raw_topic, params.message_topic, params.broker) == ("raw", "other", "broker:9092")
    assert params.store_table == "speed_layer" and params.store_host is None
    assert params.products == ("BTC-USD",)


def test_defaults():
    params = JobParams()
    assert (params.delay, params.dedup, params.dedup_keys) == ("1 minute", "bounded", ("trade_id",))
    assert (params.output_mode, params.strict_source, params.starting_offsets) == ("append", True, "latest")


@pytest.mark.parametrize("wrong", [{"dedup": "never"}, {"source": "socket"}, {"null_ids": "keep"}])
def test_wrong_values_are_refused(wrong):
    with pytest.raises(ValueError):
        JobParams(**wrong)


def test_parameters_are_frozen():
    with pytest.raises(AttributeError):
        JobParams().delay = "2 minutes"


def test_broker_options():
    params = JobParams(broker="b:1", raw_topic="raw", min_partitions=64, strict_source=False)
    assert kafka_options(params, "raw") == {
        "kafka.bootstrap.servers": "b:1",
        "subscribe": "raw",
        "includeHeaders": "true",
        "failOnDataLoss": "false",
        "startingOffsets": "latest",
        "minPartitions": "64",
    }
    assert kafka_options(params, "agg", strict=True)["failOnDataLoss"] == "true"
    assert kafka_options(params.but(strict_source=True), "raw")["failOnDataLoss"] == "true"


def test_file_options_follow_strictness():
    assert file_options(JobParams(strict_source=False))["ignoreMissingFiles"] == "true"
    assert file_options(JobParams())["ignoreMissingFiles"] == "false"
    assert file_options(JobParams())["ignoreCorruptFiles"] == "false"
    assert file_options(JobParams(max_files_per_trigger=3))["maxFilesPerTrigger"] == "3"


def test_broker_source_without_its_connector_says_so(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        stream_records(spark, JobParams(source="kafka", broker="b:1", raw_topic="raw"))


def test_session_settings():
    settings = session_settings(JobParams(state_partitions=64))
    assert settings["spark.sql.shuffle.partitions"] == "64"
    assert settings["spark.sql.session.timeZone"] == "UTC"
    assert "RocksDB" in settings["spark.sql.streaming.stateStore.providerClass"]
    assert list(session_settings(JobParams(rocksdb=False))) == ["spark.sql.session.timeZone"]


def test_stream_session_width(spark):
    width = "spark.sql.shuffle.partitions"
    wide = spark.newSession()
    wide.conf.set(width, "40")
    assert stream_session(wide, JobParams()).conf.get(width) == "40"
    assert stream_session(spark, JobParams(state_partitions=37)).conf.get(width) == "37"
    assert spark.conf.get(width) == "4"


def test_build_session_reuses_the_running_context(spark):
    assert build_session(JobParams(rocksdb=False), "ERROR").sparkContext is spark.sparkContext


def test_a_session_outside_utc_is_refused(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    with pytest.raises(ValueError, match="UTC"):
        require_utc(other)
    require_utc(spark)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_a_broker_job_needs_its_names():
    with pytest.raises(ValueError, match="KAFKA_BROKER, RAW_TRADES_KAFKA_TOPIC"):
        JobParams(source="kafka", message_topic="m").require_names()
    JobParams(source="kafka", broker="b", raw_topic="r", message_topic="m").require_names()
    JobParams().require_names()
