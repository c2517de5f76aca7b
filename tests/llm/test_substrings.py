"""Substring dedup against a dictionary of all windows."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.substrings import Settings, dedup_substrings, lowest, rolling

SPACE = "".join(map(chr, (0x20, *range(9, 14))))


def split(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def slow(rows, window):
    first = {}
    for doc_id, text in rows:
        words = split(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words, gone = split(text), set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, settings=Settings()):
    rows = dedup_substrings(docs, settings).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, rows.collect()), key=str)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["é", "a\x1cb", "W0"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [say(n) for n in (50, 51, 49, 70, 200)]
    rows = []
    for i in range(60):
        text = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(passages) + say(rng.randrange(0, 3))
        if rng.random() < 0.1:
            text += ["ha"] * 120
        rows.append((i * 3, rng.choice((" ", "\n", " \t")).join(text)))
    rows += [(200, rows[4][1]), (200, rows[5][1]), (200, rows[4][1]), (1, None), (2, ""), (4, " \n "), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(500, " ".join(["x"] * 50)), (501, " ".join(["x"] * 5000)), (502, " ".join(say(20000)))]
    return rows


def test_rolling_hash_and_minimum():
    values = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    found = rolling(np.concatenate((values, values)), 17, 0x9E3779B97F4A7C15)
    assert (found[:284] == found[300:584]).all() and len(set(found[:300].tolist())) == 300
    for size in (1, 2, 3, 8, 41):
        assert lowest(values, size).tolist() == [values[i : i + size].min() for i in range(301 - size)]
    assert len(rolling(values[:5], 17, 3)) == 0


@pytest.mark.parametrize("settings", [Settings(), Settings(least_bits=16, most_bits=16, cells_per_anchor=1)])
def test_result_equals_brute_force(spark, documents, settings):
    rows = corpus()
    found = run(documents(rows).repartition(7), settings)
    assert found == slow(rows, 50)
    assert sum(r[2] > 0 for r in found) > 20


def test_odd_tables(spark, documents):
    docs = documents(corpus()[:30])
    clash = docs.withColumns({c: F.lit(1) for c in ("row", "start", "h1", "h2", "first", "n_words", "owner")})
    assert run(clash) == run(docs)
    assert run(docs.where("false")) == []
    assert run(documents([None, None])) == slow([(0, None), (1, None)], 50)


def test_registered_query_equals_brute_force(spark):
    from tickloom.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op7_substring_dedup"](spark, folder).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=str) == slow(docs, 50)
