"""Target resampling against a plain version over all rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tickloom.llm import target_sampling
from tickloom.llm.registry import QUERIES
from tickloom.llm.target_sampling import Settings, bucket_parts, cutoff, resample

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    text = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    words = WORD.findall(text)
    return words, words + [" ".join(p) for p in zip(words, words[1:])]


def slow(docs, target, buckets=10000, seed=7, percent=25, shortest=20):
    """(id, features, weight, score, rank) of every (id, text)."""
    place = lambda f: crc32(f.encode()) % buckets
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(map(place, features(text)[1]))
    for text in target:
        want.update(map(place, features(text)[1]))
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = [
        math.floor(1000 * math.log((want[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[place(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = [i for i, r in enumerate(rows) if r[1] >= shortest]
    able.sort(key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0))
    ranks = {i: n for n, i in enumerate(able[: percent * len(able) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], ranks.get(i)) for i, r in enumerate(rows)]


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_registered_query_equals_the_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_target_resampling"](spark, FOLDER)) == sorted(slow(docs, target), key=str)


def test_parts_of_a_long_text_have_the_buckets_of_the_whole(monkeypatch):
    text = ("Ab é9 x_y, " * 400).encode()
    whole = [crc32(f.encode()) % 97 for f in features(text.decode())[1]]
    monkeypatch.setattr(target_sampling, "_CHUNK", 50)
    parts = list(bucket_parts(text, 97))
    assert len(parts) > 10
    assert Counter(whole) == sum((Counter(b.tolist()) for _, b in parts), Counter())


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_odd_rows_and_ties(spark, documents, percent):
    rows = [(i, f"word{i % 3} " * 21) for i in range(30)]
    rows += [(None, "aa bb " * 12), (None, "aa bb " * 12), (7, "word1 " * 21), (7, "word1 " * 21), (100, None), (101, ""), (102, " ,"), (103, "w " * 60000)]
    docs = documents(rows).withColumns({c: F.lit(3) for c in ("n_words", "weight", "score", "rank", "place_", "part_", "bucket")})
    target = spark.createDataFrame([("aa bb word1",), (None,), ("",)], "text string")
    settings = Settings(percent=percent)
    found, wanted = got(resample(docs, target, settings)), slow(rows, ["aa bb word1", None, ""], percent=percent)
    # Rows of one id and score are interchangeable; here they are equal in all but the text's name.
    assert found == sorted(wanted, key=str)


def test_empty_tables(spark, documents):
    none = documents([]).where("false")
    target = spark.createDataFrame([], "text string")
    assert resample(none, target).count() == 0
    assert got(resample(documents([(1, "a " * 30)]), target)) == slow([(1, "a " * 30)], [])


def test_cutoff_among_ties(spark):
    scores = spark.createDataFrame([(i, 5) for i in (4, 9, 2, 7)] + [(1, 3), (8, 9), (None, 5)], "doc_id bigint, score bigint")
    assert [cutoff(scores, k) for k in range(8)] == [None, (9, 8), (5, 2), (5, 4), (5, 7), (5, 9), (5, None), (3, 1)]
