"""SimHash against a word-for-word version of its rule."""

import random

import xxhash

from tickloom.llm.components import connected_components
from tickloom.llm.simhash import fingerprint, linked_pairs, near_duplicates

MASK = (1 << 64) - 1


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in lowered).split(" ") if w]
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    found = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and found[a] != found[b]:
                    found[a] = found[b] = min(found[a], found[b])
                    changed = True
    return found


def test_fingerprints_equal_the_slow_ones():
    texts = ["", None, " \t\n", "One", "one TWO", "a b c", "É é\x0bx y z w", "a b c d " * 40, "x\x1cy z w v"]
    for text in texts:
        encoded = None if text is None else text.encode()
        assert fingerprint(encoded) & MASK == slow_fingerprint(text), text


def test_spark_hashes_shingles_the_same_way(spark):
    value = spark.range(1).selectExpr("xxhash64('ein zwei drei') AS h").first()["h"]
    assert value & MASK == xxhash.xxh64_intdigest(b"ein zwei drei", 42)


def test_every_pair_within_two_bits_is_found(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for flips in (0, 1, 2, 2, 3, 4):
            value = base
            for bit in rng.sample(range(64), flips):
                value ^= 1 << bit
            values.add(value)
    values |= {0, 1, 3, MASK, MASK ^ (1 << 63), 1 << 63}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = linked_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    found = {frozenset((p["a"] & MASK, p["b"] & MASK)) for p in pairs}
    expected = {frozenset((a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 2}
    assert found == expected


def test_classes_equal_brute_force(spark, documents):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((3, 40, 300)))]
        texts.append(" ".join(words))
        for _ in range(3):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("  ".join(near).upper())
    texts += ["", None, " \n", texts[0], texts[0], "alone", "word " * 30000]
    rows = {r["doc_id"]: r for r in near_duplicates(documents(texts)).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    expected = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r["fp"] & MASK for i, r in rows.items()} == prints
    assert {i: r["component_id"] for i, r in rows.items()} == expected


def test_null_ids_extra_columns_and_empty_tables(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(None, "a b c"), (7, "a b c"), (None, "quite another one")])
    docs = docs.withColumns({c: F.lit("x") for c in ("fp", "node", "component", "key", "bit")})
    rows = sorted(near_duplicates(docs).collect(), key=str)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [
        ("7", "7"),
        ("None", "7"),
        ("None", "None"),
    ]
    assert near_duplicates(documents([])).count() == 0


def test_components_of_paths_stars_and_nulls(spark):
    path = [(i + 1, i) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 300)]
    edges = spark.createDataFrame(path + star + star + [(9, 9), (None, 3), (400, None)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(200, 300)} == {5}
    assert (found[9], found[3], found[400]) == (9, 3, 400)
