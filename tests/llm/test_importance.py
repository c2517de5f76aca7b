"""Importance resampling: exact parts against plain versions, the rest held out."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm.importance import Settings, buckets, fit, log_ratios, resample, sample
from tickloom.llm.topk import kth_largest

SMALL = Settings(bits=14, z=2.0, slack=0.2)


def test_kth_largest_equals_sorting(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(10**12), 10**12) for _ in range(500)] + [5] * 40 + [None] * 3
    values += [-(1 << 62), (1 << 62)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 17, 250, 300, len(ordered)):
        assert kth_largest(df, "v", k) == ordered[k - 1]
    assert kth_largest(df, "v", 0) is None
    assert kth_largest(df, "v", len(values)) is None


def test_buckets_are_those_of_the_words():
    found = buckets("a bc  é\na bc".encode(), 12)
    words = [xxhash.xxh3_64_intdigest(w.encode()) >> 52 for w in ("a", "bc", "é", "a", "bc")]
    assert found[0].tolist() == words
    assert len(found[1]) == 4 and found[1][0] == found[1][3] != found[1][1]
    assert [len(b) for b in buckets(None, 12)] == [0, 0]
    assert [len(b) for b in buckets(b"one", 12)] == [1, 0]


def test_ratios_are_zero_where_nothing_is_evident():
    target, raw = np.array([100.0, 0.0, 3.0, 100.0]), np.array([200.0, 200.0, 5.0, 200.0])
    ratio = log_ratios(target, raw, Settings())
    assert ratio[0] == ratio[2] == ratio[3] == 0 and ratio[1] < -2


def corpus(documents, spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(("good", "good", "good", "junk", "toxic"))
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if kind == "junk":
            text = [w + "!!" for w in text]
        if kind == "toxic":
            text[3:3] = ["awful", "nasty", "awful"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic"), kind))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, kind string")


def test_held_out_documents_are_told_apart(spark, documents):
    docs, labels = corpus(documents, spark)
    weights = fit(docs, labels.where("doc_id < 300"), SMALL)
    kept = {r["doc_id"] for r in sample(docs, weights).collect()}
    rest = [(r["doc_id"], r["kind"]) for r in labels.where("doc_id >= 300").collect()]
    share = Counter(k for i, k in rest if i in kept)
    total = Counter(k for _, k in rest)
    assert share["good"] > 0.97 * total["good"]
    assert share["junk"] < 0.05 * total["junk"]
    assert share["toxic"] < 0.3 * total["toxic"]
    assert {r["doc_id"] for r in resample(docs, weights).collect()} == kept


def test_sample_is_the_top_k_of_the_keys(spark, documents):
    docs, labels = corpus(documents, spark)
    weights = fit(docs, labels, SMALL)
    from tickloom.llm.importance import weighed

    rows = weighed(docs, weights).collect()
    k = sum(r["log_weight"] >= 0 for r in rows)
    best = sorted(rows, key=lambda r: -r["sample_key"])[:k]
    assert {r["doc_id"] for r in sample(docs, weights).collect()} == {r["doc_id"] for r in best}


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows_are_kept_apart(spark, documents, labelled):
    docs, labels = corpus(documents, spark)
    odd = documents([(None, "w1 w2"), (None, "w1 w2"), (9001, None), (9002, ""), (9003, " \n"), (9004, "w1 " * 50000)])
    docs = docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("role", "importance_", "model", "labelled_id", "n_words")})
    if not labelled:
        labels = labels.where("false")
    rows = sample(docs, fit(docs, labels.unionByName(labels.limit(5)), SMALL)).collect()
    ids = [r["doc_id"] for r in rows]
    assert not {9001, 9002, 9003} & set(ids)
    if labelled:
        assert ids.count(None) in (0, 2)
    empty = docs.where("false")
    assert sample(empty, fit(empty, labels, SMALL)).count() == 0
    assert resample(docs, fit(docs, labels, SMALL)).columns == docs.columns
