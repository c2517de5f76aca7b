"""A job that is stopped and resumed opens its state, it does not read all its changes again."""

import glob

import pytest

import __spark_entry__ as registry
from tests.conftest import at, trade
from tests.test_oracle import SF_DIR
from tickloom.params import JobParams
from tickloom.sources.events import event_records, read_events
from tickloom.streaming import read_table, run_to_end, start_speed_layer
from tickloom.workspace import shared_root


@pytest.mark.parametrize("name", ["speed_layer_compacted", "speed_layer_readmission"])
def test_a_replay_keeps_its_state_as_files_of_the_store(spark, name):
    """Before, each wave's run put the changes of all waves before it into an empty store."""
    pattern = f"{shared_root(spark)}/tickloom/replay-*/checkpoint/state/0/*/**/*."
    before = {kind: set(glob.glob(pattern + kind, recursive=True)) for kind in ("changelog", "sst")}
    assert registry.queries()[name](spark, SF_DIR).count() > 0
    new = {kind: set(glob.glob(pattern + kind, recursive=True)) - old for kind, old in before.items()}
    assert new["sst"] and not new["changelog"]


def test_live_runs_and_runs_to_the_end_share_a_checkpoint(spark, topic, tmp_path):
    """Changes are uploaded live, files at the end; either reads what the other has left."""
    paths = str(tmp_path / "c"), str(tmp_path / "t"), topic.path
    ending = JobParams(available_now=True, state_partitions=2, output_mode="update", dedup="forever")
    sent = []
    for minute, params in enumerate([ending, ending.but(available_now=False)] * 2):
        sent.append(trade(f"id-{minute}"))
        topic.add([(at(f"00:0{minute}:00"), sent)])
        query = start_speed_layer(spark, params, *paths)
        if params.available_now:
            run_to_end(query)
        else:
            query.processAllAvailable()
            query.stop()
    assert [r["num_trades"] for r in read_table(spark, paths[1]).collect()] == [1, 1, 1, 1]


def test_trades_are_built_for_one_wave_only(spark):
    """Before, the trades of two waves' events were built and then passed over."""
    records = event_records(read_events(spark, SF_DIR)).where("wave = 1972")
    plan = records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "Filter" in line):]
    assert any("Generate" in line for line in below)
    assert not any("date_format" in line or "get_json_object" in line for line in below)
