"""Line dedup of lines too short for an edit: exact repeats against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_lines import slow
from tickloom.llm.lines import dedup_lines, judge


def expected(rows, hashes):
    root = slow(rows)
    first, out = {}, []
    places = []
    for (doc_id, text), text_hash in zip(rows, hashes):
        for i, x in enumerate(text.split("\n") if text is not None else []):
            if x.strip(" \t\n\x0b\f\r"):
                place = (doc_id is None, doc_id or 0, text_hash, i)
                name = root(x) if len(x) >= 20 else x
                places.append((name, place))
                first[name] = min(first.get(name, place), place)
    for (doc_id, text), text_hash in zip(rows, hashes):
        gone = [p[3] for name, p in places if p[:3] == (doc_id is None, doc_id or 0, text_hash) and p > first[name]]
        out.append((doc_id, text_hash, sorted(set(gone))))
    return sorted(out, key=str)


def test_exact_repeats_of_short_lines_are_removed(spark, documents):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    rows = [(i, "\n".join(say(rng.choice((0, 1, 2, 3, 18, 19, 20, 21))) for _ in range(rng.randrange(0, 8)))) for i in range(120)]
    rows += [(500, "a" * 19), (501, "a" * 18 + "b"), (502, "a" * 20), (503, "a" * 19), (504, " \t\n \t"), (None, "a" * 19), (505, None)]
    docs = documents(rows)
    hashes = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()}
    found = sorted(((r["doc_id"], r["text_hash"], r["removed"]) for r in judge(docs).collect()), key=str)
    assert found == expected(rows, [hashes[row] for row in rows])
    assert sum(len(r[2]) for r in found) > 80


@pytest.mark.parametrize("other", ["short", "short "])
def test_texts_lose_short_repeats(spark, documents, other):
    out = {r["doc_id"]: r["text"] for r in dedup_lines(documents([(1, "short\n\nkept"), (2, f"{other}\n\nnew"), (3, "short")])).collect()}
    assert out == {1: "short\n\nkept", 2: "\nnew" if other == "short" else "short \n\nnew"}
