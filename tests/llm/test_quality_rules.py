"""Base counts against a word-for-word version; learned rules on held-out rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm.quality_rules import Condition, decision, judge, prune, Settings, statistics

SPACE = "".join(map(chr, (0x20, *range(9, 14))))


def split(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def slow(text):
    words = split(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [line for line in (text or "").split("\n") if split(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def texts():
    rng = random.Random(11)
    words = ["a", "b", "c", "d", "É", "x\x1cy", "#$", "<p>", "w1", "w2", "w3", "𝒳𝒴", "Z|"]
    out = []
    for _ in range(300):
        parts = [rng.choice(words[: rng.choice((2, 4, 13))]) for _ in range(rng.randrange(0, 90))]
        out.append("".join(p + rng.choice((" ", " ", "  ", "\n", "\t", " \n\n", "\x0b")) for p in parts))
    same = "one line again\n"
    return out + [None, "", " \n", "a", "a b", "a b c", "a a a a", "a a a", same * 30, " " + same, "q " * 30000, " ".join(f"w{i}" for i in range(20000))]


def test_base_counts_equal_brute_force(spark, documents):
    given = texts()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = {r["doc_id"]: tuple(r[n] for n in names) for r in statistics(documents(given)).collect()}
    assert rows == {i: slow(t) for i, t in enumerate(given)}


def corpus():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        low = rng.random() < 0.3
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        kind = rng.choice(("caps", "symbols")) if low else "good"
        if kind == "caps":
            words = [w.upper() for w in words]
        if kind == "symbols":
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not low), 0, "x"))
    return rows, labels


def test_learned_rules_hold_on_other_documents(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, rule string")
    out = {r["doc_id"]: r for r in judge(documents(rows), table.where("doc_id < 600")).collect()}
    held = [(i, bool(q)) for i, q, _, _ in labels if i >= 600]
    assert all(out[i]["kept"] == good for i, good in held)
    assert not any(r["base_failed"] for r in out.values())
    assert len({r["rule"] for r in out.values()}) == 3


def test_pruning_takes_the_shortest_best_head(spark):
    rows = spark.createDataFrame([(float(i), 1.0, i >= 50) for i in range(100)], "words double, upper_share double, low boolean")
    head, tail = Condition("words", True, 49.0), Condition("upper_share", True, 0.5)
    assert prune(rows, (head, tail), Settings()) == (head,)
    assert prune(rows, (tail,), Settings()) == ()


def test_list_is_in_order_and_stops_without_low_rows(spark):
    rows = spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "words double")
    rules = [(Condition("words", True, 8.0),), (Condition("words", True, 3.0),)]
    assert [r[0] for r in rows.select(decision(rules)).collect()] == [None, "words > 3", "words > 8"]
    assert [r[0] for r in rows.select(decision([])).collect()] == [None] * 3


def test_odd_rows_and_tables(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + labels[:9] + [(None, 0, 0, ""), (5, None, None, "")], "doc_id bigint, quality int, toxic int, rule string")
    docs = documents(rows + [(None, "a b"), (None, "a b"), (950, None)]).withColumns({c: F.lit(1) for c in ("w", "l", "kept", "n_words", "low")})
    found = judge(docs, table)
    assert found.count() == len(rows) + 3
    assert [r["kept"] for r in found.where("doc_id IS NULL OR doc_id = 950").collect()] == [False] * 3
    alone = judge(docs, table.where("false"))
    assert alone.where("kept = base_failed").count() == 0 and alone.where("rule IS NOT NULL").count() == 0
    assert judge(docs.where("false"), table).count() == 0


def test_registered_query_has_the_base_of_every_document(spark):
    from tickloom.llm.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality_rules"](spark, folder).collect()}
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words, *rest = slow(text)
        r = rows.pop(doc_id)
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [words, *rest]
        assert r["base_failed"] == (words < 50 or 100 * rest[-1] > 50 * words)
        assert not (r["kept"] and r["base_failed"])
    assert not rows
