"""Streams of the queries keep as many state partitions as their input and the cores ask for."""

import glob

import __spark_entry__ as registry
from tests.test_oracle import SF_DIR
from tickloom.params import state_width
from tickloom.workspace import shared_root


def test_width_follows_rows_and_cores(spark):
    cores, wide = spark.sparkContext.defaultParallelism, spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "200")
    assert state_width(wide, 0) == state_width(wide, 1_000) == cores
    assert state_width(wide, 1_000 * (cores + 3) + 1, 1_000) == 2 * cores
    wide.conf.set("spark.sql.shuffle.partitions", "2")
    assert state_width(wide, 1_000) == 2


def test_a_replay_does_not_take_the_width_of_batches(spark):
    """Before, each of 48 shuffle partitions had its stores and files in every batch."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "48")
    pattern = f"{shared_root(spark)}/tickloom/replay-*/checkpoint/state/0/[0-9]*"
    before = set(glob.glob(pattern))
    assert registry.speed_layer_append(wide, SF_DIR).count() > 0
    assert 0 < len(set(glob.glob(pattern)) - before) <= spark.sparkContext.defaultParallelism


def test_width_stays_at_the_cores_for_some_million_rows_each(spark):
    """Before, every 1,000,000 events had a state partition, with its stores and files in every batch."""
    cores, wide = spark.sparkContext.defaultParallelism, spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "200")
    assert state_width(wide, 3_000_000 * cores) == cores
    assert state_width(wide, 5_000_000 * cores) == 2 * cores
