"""The batch layer's queries parse the messages once and build from landed ticks."""

from datetime import date

import pytest

import __spark_entry__ as registry
from tests.conftest import at, shift, trade
from tests.test_oracle import SF_DIR
from tickloom.functions import parse_ticks
from tickloom.plans import land_batch
from tickloom.plans.layers import DATE


def test_landed_ticks_are_the_same_with_their_date(spark, records, tmp_path):
    pairs = [(at("00:00:00"), [trade("a"), trade("a")]), (shift(at("00:00:00"), days=1), [trade("b")]), (None, [trade("c")])]
    ticks = parse_ticks(records(pairs))
    landed = land_batch(ticks, str(tmp_path / "ticks"))
    assert sorted(map(str, landed.drop(DATE).collect())) == sorted(map(str, ticks.collect()))
    days = {r["trade_id"]: r[DATE] for r in landed.collect()}
    assert days == {"a": date(2024, 1, 1), "b": date(2024, 1, 2), "c": None}


@pytest.mark.parametrize("name", ["batch_layer", "batch_refresh", "batch_refresh_lost_ids"])
def test_messages_are_not_parsed_again(spark, monkeypatch, name):
    """Before, the build parsed all messages twice and the refresh two or three times more."""
    plans = []

    def noted(step):
        def run(ticks, *arguments):
            plans.append(ticks._jdf.queryExecution().executedPlan().toString())
            return step(ticks, *arguments)

        return run

    for step in ("build_batch_layer", "refresh_batch_layer"):
        monkeypatch.setattr(registry, step, noted(getattr(registry, step)))
    assert registry.queries()[name](spark, SF_DIR).count() > 0
    assert len(plans) >= 2 and not any("from_json" in plan for plan in plans)
