"""Spelling variants against brute force over all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import spelling
from tickloom.llm.spelling import Settings, grown, letters, one_edit, reached, variants, vectors

FOLDER = "/root/testdata/sf0.01"


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(0x41, 0x5B)})
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def distance_is_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_deletions(known):
    """Near pairs by brute force over shared deletions, each compared letter by letter."""
    keys = {}
    for w in known:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys.setdefault(k, []).append(w)
    pairs = {(a, b) for group in keys.values() for a in group for b in group if a != b}
    return {p for p in pairs if distance_is_one(*p)}


def slow(docs, pairs=by_deletions):
    known = counted(docs)
    near = {w: [] for w in known}
    for a, b in pairs(known):
        near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-known[o], o), default=None)
        form[w] = best if best and known[best] >= 2 * known[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], known[form[w]] if form[w] else None, root(w)) for w, n in known.items())


def got(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def all_pairs(known):
    return {(a, b) for a in known for b in known if a != b and distance_is_one(a, b)}


def corpus(seed, n=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "ÿ", "b"])
            words.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("settings", [Settings(), Settings(leaf=20, least=2, bucket=3), Settings(leaf=20, least=2, sample=60, bucket=1)])
def test_variants_equal_brute_force(spark, documents, settings):
    rows = corpus(4, 500)
    found = slow(rows, all_pairs)
    assert found == slow(rows) and sum(r[2] for r in found) > 200
    assert got(variants(documents(rows), settings)) == found


@pytest.mark.parametrize("leaf", [16_384, 300])
def test_registered_query_equals_brute_force(spark, leaf):
    from tickloom.llm.registry import QUERIES

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = QUERIES["op13_spelling_variants"](spark, FOLDER) if leaf > 1000 else variants(docs, Settings(leaf=leaf))
    assert got(rows) == slow([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_boxes_lose_no_row_within_reach():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (400, spelling.DIMENSIONS)).astype(np.int32) * (rng.random((400, spelling.DIMENSIONS)) < 0.2)
    tree, leaves = grown(points, 5)
    assert leaves > 40
    own = {int(i): leaf for leaf, rows in reached(tree, points, 0, 0) for i in rows}
    assert len(own) == 400
    asked = points + 0
    asked[:, 3] += 1
    asked[:, 5] = np.maximum(asked[:, 5] - 1, 0)
    for leaf, rows in (found := list(reached(tree, asked, 1, 1))):
        assert len(set(rows.tolist())) == len(rows)
    reach = {(int(i), leaf) for leaf, rows in found for i in rows}
    for i in range(400):
        apart = points - asked[i]
        near = (np.maximum(apart, 0).sum(axis=1) <= 1) & (np.maximum(-apart, 0).sum(axis=1) <= 1)
        assert all((i, own[int(j)]) in reach for j in np.flatnonzero(near))
    assert len(reach) < 400 * leaves / 3


def test_one_edit_equals_its_definition():
    rng = random.Random(3)
    for extra in (0, 1):
        left = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(500)]
        right = ["".join(rng.choice("ab") for _ in range(6 + extra)) for _ in range(500)]
        expected = [distance_is_one(a, b) for a, b in zip(left, right)]
        assert one_edit(letters(left), letters(right)).tolist() == expected
        assert any(expected)
    assert np.abs(np.diff(vectors(letters(["abcdé", "abcdê"])), axis=0)).sum() <= 2


def test_odd_rows(spark, documents):
    rows = [(None, "kitten kitten kitten mitten"), (None, "Mitten mitten"), (1, None), (2, ""), (3, "1 _ 2")]
    rows += [(4, "kittens kittens kittens"), (4, "kittens kittens kittens"), (5, "x" * 70000 + " " + "y" * 69999 + " "), (6, "kitteñ " * 3)]
    rows += [(i, "x" * 70000) for i in (7, 8)] + [(i, "x" * 70001) for i in (9, 10, 11)]
    docs = documents(rows).withColumns({c: F.lit("w") for c in ("word", "n", "other", "role", "leaf", "length", "root", "form")})
    assert got(variants(docs)) == slow(rows, all_pairs)
    assert variants(documents([])).count() == 0
    assert variants(docs.where("doc_id = 1")).count() == 0


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(t for _, t in corpus(9, 20))
    whole = spelling.word_counts(3, text.encode(), Settings())
    monkeypatch.setattr(spelling, "_CHUNK", 100)
    assert spelling.word_counts(3, text.encode(), Settings()) == whole
