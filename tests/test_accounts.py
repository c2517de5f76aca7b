"""What a running job says about messages and rows that vanish."""

import time

from tests.conftest import at, trade
from tests.test_streaming import PARAMS
from tickloom import job
from tickloom.streaming import read_table
from tickloom.streaming.accounts import read_accounts


def test_rejected_messages_and_late_rows_are_counted(spark, topic, tmp_path):
    folder = str(tmp_path / "job")
    topic.add([(at("00:00:00"), [trade("a"), trade("b")]), (at("00:00:01"), "no json"), (at("00:00:02"), None), (at("00:00:03"), [])])
    topic.add([(at("00:10:00"), [trade("c")]), (at("00:10:01"), "{broken")])
    topic.add([(at("00:10:02"), [trade("d")])])
    topic.add([(at("00:00:05"), [trade("late")]), (at("00:20:00"), [trade("e")])])
    params = PARAMS.but(message_topic="metrics")
    job.run_through(spark, params, folder, topic.path, str(tmp_path / "echo"))

    def sums():
        rows = read_accounts(spark, f"{folder}/accounts").where("query = 'speed'").collect()
        return {c: sum(r[c] for r in rows) for c in ("messages", "rejected", "late_rows")}

    limit = time.time() + 60  # progress is reported beside the query
    while sums()["messages"] < 9 and time.time() < limit:
        time.sleep(1)
    assert sums() == {"messages": 9, "rejected": 2, "late_rows": 1}
    rows = read_accounts(spark, f"{folder}/accounts").where("messages > 0").collect()
    assert len({r["batch_id"] for r in rows}) == len(rows) == 4 and max(r["state_rows"] for r in rows) > 0
    assert read_table(spark, f"{folder}/table").count() >= 3
