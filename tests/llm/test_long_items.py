"""Edited copies of long benchmark items."""

import random

from tickloom.llm.decontaminate import Settings, budget_of, matches


def test_budget_grows_with_the_item(spark, documents):
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(286))
    assert budget_of(item, Settings()) == len(item) // 20 - 1 > 90
    copies = []
    for changes in (17, 60, 90, 300):
        chars = list(item)
        for at in rng.sample(range(len(chars)), changes):
            chars[at] = "x"
        copies.append("before " + "".join(chars) + " after")
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = {r["doc_id"]: r["distance"] for r in matches(documents(copies), benchmark).collect()}
    assert found == {0: 17, 1: 60, 2: 90}
