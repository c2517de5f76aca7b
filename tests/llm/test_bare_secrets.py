"""Bare credentials that the base kinds' alphabet and lengths allow."""

import random

import pytest

from tickloom.llm.secrets import candidates, find_secrets

FORMATS = {
    "short": lambda rng: "".join(rng.choice("0123456789abcdef") for _ in range(10)),
    "letters": lambda rng: "qz" + "".join(rng.choice("qxzjkvw") for _ in range(16)),
    "digits": lambda rng: "".join(rng.choice("0123456789") for _ in range(18)),
    "dotted": lambda rng: ".".join("".join(rng.choice("QXZJ0123") for _ in range(9)) for _ in range(3)),
}


@pytest.mark.parametrize("name", FORMATS)
def test_bare_credentials_are_found_in_one_piece(spark, documents, name):
    rng = random.Random(9)
    bare = [FORMATS[name](rng) for _ in range(30)]
    words = "thereupon the commonwealthiness of everything mentioned."
    rows = [(i, f"{words} password={FORMATS[name](rng)} {words}") for i in range(300)]
    rows += [(1000 + i, f"{words} {b}{end} {words}") for i, b in enumerate(bare) for end in [("", ".")[i % 2]]]
    found = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in find_secrets(documents(rows)).collect()}
    assert sum(found[1000 + i] == [b] for i, b in enumerate(bare)) >= 27
    assert all(len(found[i]) == 1 for i in range(300))


def test_dotted_runs_also_come_in_parts():
    assert [c[3] for c in candidates("..abcdefgh.12345678x. tiny word.", [])] == [
        "..abcdefgh.12345678x.", "abcdefgh.12345678x", "abcdefgh", "12345678x",
    ]
    assert [c[1:] for c in candidates("..abcdefgh.12345678x.", [("", 0, 5, "")])] == [(11, 20, "12345678x")]


def planted(seed, many):
    """Texts with named credentials of three formats, and bare runs of them or of other things."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    formats = [lambda: some("0123456789abcdef", 40), lambda: some("0123456789abcdef", 40), lambda: "tk_" + some("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 24)]
    others = [
        lambda: some("0123456789", 16),
        lambda: "4" + some("0123456789", 15),
        lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        lambda: f"2024-{rng.randrange(10, 13)}-{rng.randrange(10, 28)}T{rng.randrange(10, 24)}.{rng.randrange(10, 60)}",
        lambda: ".".join(str(rng.randrange(100, 256)) for _ in range(4)),
        lambda: some("bdklmnprst", 1) + "".join(rng.choice(("ation", "er", "un", "lich", "keit", "ment")) for _ in range(4)),
        lambda: f"order-{rng.randrange(10**7, 10**8)}",
        lambda: f"mail{rng.randrange(99)}.example.com",
    ]
    words = lambda n: " ".join(rng.choice(("wherever", "of", "the", "everything", "something.", "a", "transportation")) for _ in range(n))
    rows = [(i, f"{words(30)} token={rng.choice(formats)()} {words(9)}") for i in range(many)]
    good = {10**6 + i: rng.choice(formats)() for i in range(max(12, many // 6))}
    bad = {2 * 10**6 + i: rng.choice(others)() for i in range(600)}
    rows += [(i, f"{words(20)} {v} {words(20)}") for part in (good, bad) for i, v in part.items()]
    return rows, good, bad


@pytest.mark.parametrize("many, least", [(400, 0.95), (45, 0.85)])
def test_planted_credentials_next_to_numbers_dates_and_long_words(spark, documents, many, least):
    """``many`` named ones are learned from; the share of the bare ones that is found, and false findings."""
    rows, good, bad = planted(3, many)
    found = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"].startswith("like_")] for r in find_secrets(documents(rows)).collect()}
    right = sum(found[i] == [v] or (len(v) == 40 and found[i] == []) for i, v in good.items())
    token = [i for i, v in good.items() if v.startswith("tk_")]
    assert len(token) > 3 and right >= least * len(good)
    assert sum(found[i] == [good[i]] for i in token) >= least * len(token)
    assert sum(bool(found[i]) for i in bad) <= 1


def test_formats_are_learned_and_numbers_left_at_every_size(spark):
    from tickloom.llm.common import new_folder, written
    from tickloom.llm.secrets import infer, scanned

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spans = written(scanned(docs), new_folder(spark, "secrets"))
    models, ordinary = infer(spans)
    assert {kind for kind, _, _ in models} == {"assign", "hex"}
    rng = random.Random(2)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    fits = lambda v: any(m.likelihood(v) - ordinary.likelihood(v) >= least for _, m, least in models)
    assert sum(fits(some("0123456789abcdef", 40)) for _ in range(200)) >= 150
    assert not any(fits(some("0123456789", 16)) for _ in range(200))
    # Of another length, short hexadecimal runs do not pass; long ones are no ordinary runs either way.
    assert not any(fits(some("0123456789abcdef", n)) for n in range(8, 13) for _ in range(20))
    added = [s["value"] for r in find_secrets(docs).collect() for s in r["spans"] if s["kind"].startswith("like_")]
    assert not [v for v in added if v.isdigit()]
