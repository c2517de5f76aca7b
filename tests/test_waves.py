"""Waves of a replay: built in one pass, dealt evenly, none for a stretch without messages."""

import pytest
from pyspark.sql import functions as F

from tickloom.sources.events import event_records, read_events, write_waves
from tests.test_oracle import SF_DIR


@pytest.fixture
def copy(spark, tmp_path):
    """Writes events as the table of a folder, one file in order of time."""

    def make(events):
        events.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/sf/events.parquet")
        return f"{tmp_path}/sf"

    return make


def _rows(records):
    return sorted(map(tuple, records.select("offset", "timestamp", F.col("value").cast("string")).collect()))


def test_files_of_a_wave_are_even(spark, copy, tmp_path):
    """Before, tasks whose splits held no event of a wave wrote nothing, and one wrote it all."""
    topic, cores = f"{tmp_path}/raw", spark.sparkContext.defaultParallelism
    for wave in write_waves(spark, copy(read_events(spark, SF_DIR)), topic):
        held = spark.read.parquet(f"{topic}/wave-{wave}").groupBy(F.input_file_name()).count()
        counts = [r["count"] for r in held.collect()]
        if sum(counts) > 50 * cores:
            assert len(counts) == cores and max(counts) < 2 * min(counts)


def test_waves_are_those_of_the_records(spark, copy, tmp_path):
    """Before, each wave of a gap of 400 days was a job and a run of the stream, without a message."""
    events = read_events(spark, SF_DIR).where("event_id < 200")
    late = events.withColumns({"event_id": F.col("event_id") + 420, "ts": F.expr("ts + INTERVAL 400 DAYS")})
    none = events.limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")})
    folder, topic = copy(events.unionByName(late).unionByName(none)), f"{tmp_path}/raw"
    wanted = event_records(read_events(spark, folder)).where("wave IS NOT NULL").cache()
    waves = []
    for wave in write_waves(spark, folder, topic):
        waves.append(wave)
        arrived = spark.read.option("recursiveFileLookup", True).parquet(topic)
        assert _rows(arrived) == _rows(wanted.where(F.col("wave") <= wave))
    assert waves == sorted(r[0] for r in wanted.select("wave").distinct().collect())


def test_no_events_no_waves(spark, copy, tmp_path):
    assert not list(write_waves(spark, copy(read_events(spark, SF_DIR).where("false")), f"{tmp_path}/raw"))
