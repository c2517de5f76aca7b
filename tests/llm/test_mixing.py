"""Posteriors against a plain classifier, rates against the targets."""

import random
from math import exp, log

import pytest
from pyspark.sql import functions as F

from tickloom.llm.mixing import DOMAINS, PARTS, Settings, fit, memberships, mix, rates

LABELS = "doc_id bigint, quality int, toxic int, rate string"


def corpus():
    rng = random.Random(41)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice(("clean", "clean", "clean", "toxic", "low", "mixed"))
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(3, 60))]
        if kind in ("toxic", "mixed"):
            words += ["awful", "nasty"]
        if kind in ("low", "mixed"):
            words += ["##", "|", "##"]
        rows.append((i, " ".join(words)))
        if kind != "mixed":
            labels.append((i, int(kind != "low"), int(kind == "toxic"), "x"))
    return rows, labels


def test_posteriors_equal_a_plain_classifier(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    settings = Settings(bits=12)
    bucket = {
        r["w"]: r["b"]
        for r in docs.select(F.explode(F.split("text", " ")).alias("w")).distinct().selectExpr("w", "pmod(xxhash64(w), 4096) b").collect()
    }
    domain = {i: 1 if t else 0 if q else 2 for i, q, t, _ in labels}
    counts = [{}, {}, {}]
    for i, text in rows:
        for w in text.split() if i in domain else ():
            counts[domain[i]][bucket[w]] = counts[domain[i]].get(bucket[w], 0) + 1
    found = {r["doc_id"]: r for r in memberships(docs, spark.createDataFrame(labels, LABELS), settings).collect()}
    for i, text in rows:
        scores = []
        for k in range(3):
            below = sum(counts[k].values()) + 0.1 * 4096
            prior = log((sum(d == k for d in domain.values()) + 1) / (len(domain) + 3))
            scores.append(prior + sum(log((counts[k].get(bucket[w], 0) + 0.1) / below) for w in text.split()))
        total = sum(exp(s - max(scores)) for s in scores)
        shares = [PARTS * exp(s - max(scores)) / total for s in scores]
        r = found[i]
        assert r["tokens"] == len(text.split()) and r["p0"] + r["p1"] + r["p2"] == PARTS
        assert all(abs(r[f"p{k}"] - s) <= 1.01 for k, s in enumerate(shares))


def test_broadcast_weights_are_blocks_of_buckets(spark, documents):
    """A row for each bucket took some 80 MB of the driver when it was broadcast."""
    rows, labels = corpus()
    docs = documents(rows)
    weights, _, defaults = fit(docs, spark.createDataFrame(labels, LABELS), Settings(bits=12))
    assert weights.count() <= 4096 // 64
    held = {r["block"]: r for r in weights.collect()}
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).distinct()
    bucket = {r["w"]: r["b"] for r in words.selectExpr("w", "pmod(xxhash64(w), 4096) b").collect()}
    domain = {i: 1 if t else 0 if q else 2 for i, q, t, _ in labels}
    for k in range(len(DOMAINS)):
        told = [bucket[w] for i, text in rows if domain.get(i) == k for w in text.split()]
        below = len(told) + 0.1 * 4096
        assert defaults[k] == log(0.1 / below)
        for b in range(4096):
            found = held[b // 64][f"w{k}"][b % 64] if b // 64 in held else defaults[k]
            assert found == pytest.approx(log((told.count(b) + 0.1) / below))


@pytest.mark.parametrize("targets,budget", [((0.9, 0.06, 0.04), 1.0), ((0.5, 0.5, 0.0), 2.0), ((1.0, 0.0, 0.0), 1.0)])
def test_rates_meet_the_targets(spark, documents, targets, budget):
    rows, labels = corpus()
    out = rates(documents(rows), spark.createDataFrame(labels, LABELS), Settings(targets=targets, budget=budget, steps=100)).collect()
    everything = sum(r["tokens"] for r in out)
    assert min(r["rate"] for r in out) >= 0
    for name, target in zip(("clean", "toxic", "low"), targets):
        met = sum(r["rate"] * r["tokens"] * r[f"p_{name}"] for r in out) / everything
        assert met == pytest.approx(budget * target, abs=2e-3)


def test_rates_are_those_of_a_plain_descent(spark, documents):
    rows, labels = corpus()
    settings = Settings(steps=25)
    out = rates(documents(rows), spark.createDataFrame(labels, LABELS), settings).collect()
    n, p = [r["tokens"] for r in out], [(r["p_clean"], r["p_toxic"], r["p_low"]) for r in out]
    everything = sum(n)
    weight = [everything / sum(a * b[k] for a, b in zip(n, p)) for k in range(3)]
    gram = [[sum(a * b[i] * b[j] for a, b in zip(n, p)) / everything * weight[j] for j in range(3)] for i in range(3)]
    v = [1.0] * 3
    for _ in range(300):
        v = [sum(gram[i][j] * v[j] for j in range(3)) for i in range(3)]
        top = max(v)
        v = [x / top for x in v]
    rate = [1.0] * len(n)
    for _ in range(settings.steps):
        gap = [sum(r * a * b[k] for r, a, b in zip(rate, n, p)) / everything - settings.targets[k] for k in range(3)]
        if max(map(abs, gap)) <= settings.tolerance:
            break
        rate = [max(0.0, r - sum(gap[k] * weight[k] * b[k] for k in range(3)) / top) for r, b in zip(rate, p)]
    assert [r["rate"] for r in out] == pytest.approx(rate, abs=1e-6)


def test_mix_keeps_columns_and_drops_only_zero_rates(spark, documents):
    rows, labels = corpus()
    rows += [(None, "w1 w2"), (None, "w1 w2"), (500, None), (501, ""), (502, "w3 " * 40000), (7, rows[7][1])]
    docs = documents(rows).withColumns({c: F.lit("c") for c in ("row", "bucket", "doc", "hash", "known", "rated_id", "domain")})
    table = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1, ""), (3, None, None, "")], LABELS)
    settings = Settings(targets=(1.0, 0.0, 0.0), steps=15)
    out = mix(docs, table, settings)
    assert out.columns == docs.columns + ["rate"]
    expected = rates(docs, table, settings).where("rate > 0").count()
    assert out.count() == expected and len(rows) > expected > 0
    kept = {r["doc_id"] for r in out.collect()}
    clean = [i for i, q, t, _ in labels if q and not t]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert mix(docs.where("false"), table).count() == 0
    assert mix(docs, table.where("false")).count() > 0
