"""Secret spans against the patterns applied one by one; inferred ones held out."""

import random
from hashlib import sha256
from math import log

import regex
from pyspark.sql import functions as F

from tickloom.llm.grammar import Automaton
from tickloom.llm.secrets import Settings, base_spans, find_secrets

PLAIN = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def slow_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in regex.finditer(pattern, text, flags=regex.ASCII):
            least, value = {"assign": (8, m[2] if kind == "assign" else ""), "access": (16, m[0]), "hex": (32, m[0])}[kind]
            if len(value) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, stop) for start, _, kind, stop in sorted(found)]


def texts():
    rng = random.Random(4)
    parts = [
        "password=", "PassWord : ", "passwd'=\"", "secret: token : abcdefghij", "api_key=", "APIKEY:", "token = \"",
        "AKIA", "AKIAAKIAAKIA", "ABCDEFGHIJ12", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ſecret=", "=", "xyz-_./", "the ",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]


def test_base_spans_equal_the_plain_patterns():
    assert sum(bool(slow_spans(t)) for t in texts()) > 300
    for text in texts():
        assert [s[:3] for s in base_spans(text)] == slow_spans(text), text


def test_merging_recovers_a_small_language():
    rng = random.Random(1)
    say = lambda: "k-" + "".join(rng.choice("01") for _ in range(12))
    automaton = Automaton([say() for _ in range(400)]).merge_all(0.01)
    reached, pending = {0}, [0]
    while pending:
        for after in automaton.steps[pending.pop()].values():
            if after not in reached:
                reached.add(after)
                pending.append(after)
    assert len(reached) < 20
    assert automaton.likelihood(say()) > log(0.4)
    for other in ("01" * 7, "the word", "k-0101010a0101", ""):
        assert automaton.likelihood(other) < automaton.likelihood(say()) - 0.2


def test_unnamed_credentials_of_a_known_format_are_found(spark, documents):
    rng = random.Random(6)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18))
    words = lambda n: " ".join(rng.choice(("thereupon", "of", "commonwealthiness", "4111", "a")) for _ in range(n))
    rows = [(i, f"{words(8)} password={secret()} {words(5)}") for i in range(300)]
    bare = [secret() for _ in range(60)]
    rows += [(1000 + i, f"{words(5)} {s} {words(5)}") for i, s in enumerate(bare)]
    clean = ["ISO9001-Certificate-For-All", "antidisestablishmentarianism2", "Windows-Server-2019-R2", words(300)]
    rows += [(2000 + i, c) for i, c in enumerate(clean)]
    found = {r["doc_id"]: r for r in find_secrets(documents(rows)).collect()}
    hits = [found[1000 + i]["spans"] for i in range(60)]
    assert sum([s["value"] for s in spans] == [b] for spans, b in zip(hits, bare)) >= 54
    assert all(s["kind"] == "like_assign" for spans in hits for s in spans)
    assert not any(found[2000 + i]["spans"] for i in range(len(clean)))
    assert all([s["kind"] for s in found[i]["spans"]] == ["assign"] for i in range(300))


def test_odd_rows(spark, documents):
    rows = [(None, "token=abcdefgh1"), (None, "token=abcdefgh1"), (1, None), (2, ""), (3, "x " * 200000 + "AKIA" + "Z9" * 6)]
    docs = documents(rows).withColumns({c: F.lit(0) for c in ("base", "spans", "candidates", "liked")})
    found = sorted(find_secrets(docs).collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]]) for r in found] == [
        (1, []),
        (2, []),
        (3, [("access", 400000, 400016)]),
        (None, [("assign", 0, 15)]),
        (None, [("assign", 0, 15)]),
    ]
    assert find_secrets(docs.where("false")).count() == 0


def test_registered_query_equals_brute_force(spark):
    from tickloom.llm.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op6_secret_scan"](spark, folder).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    there = {kind for text in docs.values() for kind, _, _ in slow_spans(text)}
    assert there and there == {kind for kind in PLAIN if any(r[f"n_{kind}"] for r in rows)}
    for r in rows:
        spans = slow_spans(docs[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_settings_bound_the_examples(spark, documents):
    rows = [f"password=abc{i:06d}" for i in range(200)]
    few = find_secrets(documents(rows), Settings(examples=10))
    assert few.where("size(spans) = 1").count() == 200
