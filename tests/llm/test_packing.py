"""Packing: ids against the tokenizer, plans against brute force, places exactly."""

import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import packing
from tickloom.llm.packing import Encoder, Settings, best_plan, fullest, pack, plan, sequences, slots, vocabulary_path
from tickloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
VOCABULARY = vocabulary_path("byte_bpe_50k.json")
RANKS = vocabulary_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def pieces_of(ids, capacity=2048):
    """(piece, start, ids): cut from the end."""
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(i, a, ids[a:b]) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("chunk", [16, 1 << 19])
def test_ids_are_those_of_the_whole_text(tokenizer, monkeypatch, chunk):
    monkeypatch.setattr(packing, "_CHUNK", chunk)
    rng = random.Random(1)
    letters = "ab1 \n\t'!.é½—\xa0'sx  ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["<|endoftext|> a  b<|endoftext|>", "a\x1cb \x85 c", "١٢ 𝔘 中文  \n\n x", "", "   ", "x" * 5000, "it's we'll 'S"]
    texts += [" " * 300_000 + "x", "a" * 20_000, "\n \n" * 2000, "!" * 20_000, "a b " * 5000]
    texts += [chr(c) + "a " + chr(c) for c in [*range(0x250), *range(0x2000, 0x2030), 0x20AC] if c != 0]
    for encoder in (Encoder(VOCABULARY, RANKS), Encoder(VOCABULARY)):
        assert [encoder.encode(t) for t in texts] == [raw(ids_of(tokenizer, t)[:-1]) for t in texts]


def brute(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
    return max(s for s in sums if s <= room)


def test_fullest_combination_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(1, 60)
        found = fullest(counts, room)
        assert all(0 < k <= counts[x] for x, k in found.items())
        assert sum(x * k for x, k in found.items()) == brute(counts, room)


@pytest.mark.parametrize("seeded", [True, False])
def test_plans_use_every_piece_once(seeded):
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randrange(1, 65): rng.randrange(1, 2000) for _ in range(rng.randrange(0, 40))}
        steps = plan(counts, 64, seeded)
        used = Counter()
        for times, combination in steps:
            assert sum(x * k for x, k in combination.items()) <= 64
            used.update({x: k * times for x, k in combination.items()})
        assert used == Counter(counts)
        places = slots(steps)
        for length, found in places.items():
            assert [a for a, *_ in found] == [0, *(b for _, b, *_ in found[:-1])]
            assert found[-1][1] == counts[length]
        assert len(steps) <= 64 * 7  # depends on the lengths, not on the counts


def test_each_combination_is_the_fullest_left():
    counts = {9: 3, 7: 4, 5: 1, 2: 5}
    left = dict(counts)
    for times, combination in plan(counts, 16, seeded=False):
        for _ in range(times):
            assert sum(x * k for x, k in combination.items()) == brute({x: n for x, n in left.items() if n}, 16)
            left = {x: n - combination.get(x, 0) for x, n in left.items()}


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in by_sequence.values():
        inside.sort()
        ends = [o + n for o, n in inside]
        assert [o for o, _ in inside] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(by_sequence)


def test_registered_query_packs_whole_tables(spark, tokenizer):
    rows = QUERIES["op11_best_fit_packing"](spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    expected = {
        (doc_id, piece, start, len(ids), zlib.crc32(raw(ids)))
        for doc_id, text in docs.items()
        for piece, start, ids in pieces_of(ids_of(tokenizer, text))
    }
    assert len(rows) == len(expected)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    tokens = sum(r["length"] for r in rows)
    assert check_places(rows, 2048) <= -(-tokens // 2048) * 1.01


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows(spark, documents, tokenizer, partitions):
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    texts += [(None, "a b"), (None, "a b"), (3, "x y"), (3, "x y"), (500, None), (501, ""), (502, "long " * 40000), (503, "z" * 3000)]
    docs = documents(texts).repartition(partitions).withColumns({c: F.lit(2) for c in ("piece", "length", "ids", "place_", "offset", "part_")})
    settings = Settings(VOCABULARY, RANKS, capacity=64)
    packed = pack(docs, settings)
    rows = packed.collect()
    key = lambda r: (str(r[0]), r[1], r[2], bytes(r[3]))
    expected = [(d, p, s, raw(ids)) for d, t in texts for p, s, ids in pieces_of(ids_of(tokenizer, t), 64)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows), key=key) == sorted(expected, key=key)
    n = check_places(rows, 64)
    counts = Counter(len(i) // 4 for _, _, _, i in expected)
    assert n == sum(times for times, _ in best_plan(counts, 64))
    whole = sequences(packed).collect()
    assert len(whole) == n and sum(r["n_ids"] for r in whole) == sum(r["length"] for r in rows)
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in whole}
    assert all(joined[r["sequence_id"]][4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"]) for r in rows)


def test_empty_table(spark, documents):
    assert pack(documents([]), Settings(VOCABULARY)).count() == 0
