import pytest
from pyspark.sql import functions as F

from tests.conftest import at, trade
from tickloom.functions import parse_ticks, rejected_records
from tickloom.schemas import METRIC_FIELDS
from tickloom.sources import unwrap_envelope

SINGLE_QUOTED = (
    "[{'trade_id': '71', 'product_id': 'OAT-EUR', 'price': '3.5', 'size': '0.25', "
    "'time': '2031-05-04T10:11:12.131415Z', 'side': 'BUY', 'bid': '', 'ask': ''}, "
    "{'trade_id': '72', 'product_id': 'OAT-EUR', 'price': '3.75', 'size': '12', "
    "'time': '2031-05-04T10:11:13.5Z', 'side': 'SELL', 'bid': '', 'ask': ''}]"
)


def test_single_quoted_payload_gives_all_fields(records):
    rows = parse_ticks(records([(at("00:00:01"), SINGLE_QUOTED)])).collect()
    assert [r["trade_id"] for r in rows] == ["71", "72"]
    assert rows[0].asDict() == {
        "api_call_timestamp": at("00:00:01").replace(tzinfo=None),
        "trade_id": "71",
        "product_id": "OAT-EUR",
        "price": "3.5",
        "size": "0.25",
        "time": "2031-05-04T10:11:12.131415Z",
        "side": "BUY",
        "bid": "",
        "ask": "",
    }


@pytest.mark.parametrize(
    "value, ids",
    [
        ("[{'trade_id': '1'}]", ["1"]),
        ("[{'trade_id': '3', 'product_id': None}]", []),
        ('[{"trade_id":5,"price":1.50}]', ["5"]),
        ("[{'trade_id': \"6'x\"}]", ["6'x"]),
        ("not json", []),
        ("[]", []),
        (None, []),
        ('{"trade_id":"7"}', ["7"]),
        ('{"trades":[{"trade_id":"8"}]}', [None]),
    ],
)
def test_lenient_payloads(records, value, ids):
    ticks = parse_ticks(records([(at("00:00:00"), value)]))
    assert [r["trade_id"] for r in ticks.collect()] == ids


def test_numbers_become_text_and_missing_fields_null(records):
    row = parse_ticks(records([(at("00:00:00"), '[{"trade_id":5,"price":1.50}]')])).first()
    assert (row["price"], row["size"]) == ("1.5", None)


def test_narrow_fields_parse_to_the_same_values(records):
    source = records([(at("00:00:00"), SINGLE_QUOTED)])
    narrow = parse_ticks(source, METRIC_FIELDS)
    assert narrow.columns == ["api_call_timestamp", *METRIC_FIELDS]
    assert narrow.collect() == parse_ticks(source).select(narrow.columns).collect()


def test_rejected_records_are_those_that_vanish(records):
    source = records(
        [
            (at("00:00:00"), "not json"),
            (at("00:00:01"), "[{'trade_id': None}]"),
            (at("00:00:02"), "[]"),
            (at("00:00:03"), None),
            (at("00:00:04"), SINGLE_QUOTED),
        ]
    )
    assert [r["offset"] for r in rejected_records(source).orderBy("offset").collect()] == [0, 1]


def test_envelope_is_unwrapped_to_text(records):
    body = {"trades": [trade("1"), {"trade_id": "2", "product_id": None}], "best_bid": "3"}
    source = records([(at("00:00:00"), body), (at("00:00:01"), "not json")])
    texts = [
        r["value"] for r in unwrap_envelope(source).select(F.col("value").cast("string")).collect()
    ]
    assert texts[0].startswith('[{"trade_id":"1"') and "best_bid" not in texts[0]
    assert texts[1] is None
    in_two = parse_ticks(unwrap_envelope(source)).collect()
    assert in_two == parse_ticks(source, enveloped=True).collect()
    # A null field costs nothing but itself.
    assert [(r["trade_id"], r["product_id"]) for r in in_two] == [("1", "P"), ("2", None)]


def test_product_selection(records):
    source = records([(at("00:00:00"), [trade("1", "A"), trade("2", "B"), trade("3", "C")])])
    kept = parse_ticks(source, products=("A", "C")).collect()
    assert [r["trade_id"] for r in kept] == ["1", "3"]


@pytest.mark.parametrize("products", [(), ("A",)])
@pytest.mark.parametrize("counted", [False, True])
def test_trades_without_id_leave_a_message_as_one(records, products, counted):
    """Half of all trades have no id; products are chosen before one of them stands for the rest."""
    polls = [
        (at(f"00:00:{m:02d}"), [trade(None if i % 2 else f"{m}-{i}", "BA"[i % 4 == 3], size=str(i)) for i in range(40)])
        for m in range(20)
    ]
    polls += [(at("00:01:00"), []), (at("00:01:01"), "no json"), (at("00:01:02"), None), (at("00:01:03"), [trade(None, "C")])]
    fields = ("trade_id", "product_id", "size")
    every = parse_ticks(records(polls), fields, products=products).collect()
    ticks = parse_ticks(records(polls), fields, products=products, counted=counted, one_missing="trade_id")
    rows = ticks.collect()
    assert {r for r in every if r["trade_id"]} == {r for r in rows if r["trade_id"]}
    firsts = {}
    for r in every:
        if r["trade_id"] is None:
            firsts.setdefault(r["api_call_timestamp"], r)
    assert sorted(r for r in rows if r["trade_id"] is None) == sorted(firsts.values())
    assert len(firsts) == (20 if products else 21)
    plan = ticks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
