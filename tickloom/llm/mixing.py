"""Mixing to target weights with soft membership in domains.

A naive Bayes classifier over hashed words, made from a bounded sample of
labelled rows, gives each document its posterior share in each domain. Rates
``r >= 0`` of documents are then fitted so that the expected tokens of each
domain, ``sum(r * tokens * posterior)``, match its target: least squares,
weighted by the inverse of the domain's present tokens, by projected gradient
from ``r = 1`` in the metric of the tokens.

Posteriors are stated in thousandths. Documents with equal posteriors keep equal
rates all along, so the descent runs on the sums of tokens by posterior: a table
whose size does not grow with the documents. Each step is one aggregation over
it; only one number a domain reaches the driver. SQL expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import new_folder, words_of, written

# The domains of the labels table.
DOMAINS = ("clean", "toxic", "low")
PARTS = 1000
BLOCK_BITS = 6


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled documents. ``targets`` are shares of all
    tokens, ``budget`` is the tokens asked for as a share of those there are."""

    targets: tuple[float, ...] = (0.95, 0.03, 0.02)
    budget: float = 1.0
    fit_rows: int = 20_000
    bits: int = 18
    smoothing: float = 0.1
    steps: int = 60
    tolerance: float = 1e-6


def domain_of(labels: DataFrame) -> DataFrame:
    """``labelled_id`` and ``domain`` of labelled documents; the worst label counts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min("quality").alias("quality")
    )
    domain = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0)
    return each.select("labelled_id", domain.alias("domain"))


def _tokens(docs: DataFrame, *keep: str, bits: int) -> DataFrame:
    word = F.explode(words_of(F.col("text").cast("string"))).alias("word")
    bucket = F.pmod(F.xxhash64("word"), F.lit(1 << bits)).alias("bucket")
    return docs.select(*keep, word).select(*keep, bucket)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings, domains=DOMAINS):
    """(weights, priors, defaults): log weights by bucket, in the form of :func:`_blocks`.

    ``weights`` stands for at most ``2 ** bits`` buckets whatever the data.
    """
    chosen = domain_of(labels).orderBy(F.xxhash64("labelled_id", F.lit("mixing")), "labelled_id").limit(settings.fit_rows)
    texts = docs.select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "domain")
    n = range(len(domains))
    folder = new_folder(docs.sparkSession, "mixing-model")
    counts = _tokens(rows, "domain", bits=settings.bits).groupBy("bucket").agg(
        *[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in n]
    )
    counts = written(counts, f"{folder}/counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in n]).first()
    sizes = chosen.agg(*[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in n]).first()
    spread = settings.smoothing * (1 << settings.bits)
    below = [float(totals[k] + spread) for k in n]
    weight = lambda k: F.log((F.col(f"c{k}") + F.lit(settings.smoothing)) / F.lit(below[k]))
    weights = counts.select(F.col("bucket").alias("known"), *[weight(k).alias(f"w{k}") for k in n])
    defaults = [log(settings.smoothing / below[k]) for k in n]
    priors = [log((sizes[k] + 1) / (sum(sizes) + len(domains))) for k in n]
    return written(_blocks(weights, defaults), f"{folder}/weights"), priors, defaults


def _blocks(weights: DataFrame, defaults: list[float]) -> DataFrame:
    """The weights as ``block`` and an array a domain, one row for ``2 ** BLOCK_BITS`` buckets.

    A broadcast is collected and hashed in the driver: a row for each bucket
    takes several times the memory of its numbers there. Buckets without a row
    have the default, as have blocks without one.
    """
    slot = F.col("known").bitwiseAND((1 << BLOCK_BITS) - 1).alias("slot")
    found = weights.select(F.shiftright("known", BLOCK_BITS).alias("block"), slot, *[f"w{k}" for k in range(len(defaults))])
    by_slot = lambda k: F.map_from_entries(F.collect_list(F.struct("slot", f"w{k}"))).alias(f"w{k}")
    maps = found.groupBy("block").agg(*[by_slot(k) for k in range(len(defaults))])
    slots = F.expr(f"sequence(0L, {(1 << BLOCK_BITS) - 1}L)")

    def dense(k: int) -> Column:
        return F.transform(slots, lambda i: F.coalesce(F.element_at(f"w{k}", i), F.lit(defaults[k]))).alias(f"w{k}")

    return maps.select("block", *[dense(k) for k in range(len(defaults))])


def memberships(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), domains=DOMAINS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``tokens`` and ``p0``, ``p1``, ...: thousandths.

    One row for each row of ``docs``. Texts without a word have the priors.
    """
    weights, priors, defaults = fit(docs, labels, settings, domains)
    n = range(len(domains))
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    word = F.explode_outer(words_of(F.col("text"))).alias("word")
    bucket = F.pmod(F.xxhash64("word"), F.lit(1 << settings.bits))
    tokens = rows.select("row", "doc_id", "text_hash", word).select(
        "row", "doc_id", "text_hash", F.when(F.col("word").isNotNull(), bucket).alias("bucket")
    )
    known = tokens.join(F.broadcast(weights), F.shiftright("bucket", BLOCK_BITS) == F.col("block"), "left")
    slot = F.col("bucket").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    weight = lambda k: F.coalesce(F.get(f"w{k}", slot), F.lit(defaults[k]))
    score = lambda k: F.when(F.col("bucket").isNotNull(), weight(k)).otherwise(0.0)
    summed = known.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.count("bucket").alias("tokens"),
        *[F.sum(score(k)).alias(f"s{k}") for k in n],
    )
    return summed.select("doc_id", "text_hash", "tokens", *_posteriors([F.col(f"s{k}") + F.lit(priors[k]) for k in n]))


def _posteriors(scores: list[Column]) -> list[Column]:
    """Shares in thousandths that add up to all of them; the first one takes the rest."""
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    shares = [F.round(PARTS * part / total).cast("int") for part in parts[1:]]
    rest = F.lit(PARTS)
    for share in shares:
        rest = rest - share
    return [rest.alias("p0"), *[s.alias(f"p{k}") for k, s in enumerate(shares, 1)]]


def _rate(steps: list[list[float]], n: range) -> Column:
    """The rate after the steps taken, from the posteriors of a row."""
    shares = [F.col(f"p{k}") / F.lit(float(PARTS)) for k in n]
    if not steps:
        return F.lit(1.0)
    moves = F.expr("array(" + ", ".join(f"array({', '.join(f'{x!r}D' for x in step)})" for step in steps) + ")")

    def moved(rate: Column, step: Column) -> Column:
        for k in n:
            rate = rate - F.get(step, k) * shares[k]
        return F.greatest(F.lit(0.0), rate)

    return F.aggregate(moves, F.lit(1.0), moved)


def _largest_root(matrix: list[list[float]]) -> float:
    """Largest eigenvalue of a small matrix without negative entries."""
    vector = [1.0] * len(matrix)
    value = 0.0
    for _ in range(200):
        image = [sum(a * v for a, v in zip(row, vector)) for row in matrix]
        value = max(image)
        if value <= 0:
            return 1.0
        vector = [x / value for x in image]
    return value


def solve(cells: DataFrame, settings: Settings, n: range) -> list[list[float]]:
    """Steps of the descent, each one number a domain; see :func:`_rate`."""
    share = lambda k: F.col(f"p{k}") / F.lit(float(PARTS))
    gram = cells.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("all"),
        *[F.sum(F.col("tokens") * share(i) * share(j)).alias(f"g{i}_{j}") for i in n for j in n],
        *[F.sum(F.col("tokens") * share(k)).alias(f"t{k}") for k in n],
    ).first()
    everything = gram["all"]
    if not everything:
        return []
    weight = [everything / gram[f"t{k}"] if gram[f"t{k}"] else 0.0 for k in n]
    # With weights w the step matrix is G * W; its largest root bounds the step.
    matrix = [[gram[f"g{i}_{j}"] / everything * weight[j] for j in n] for i in n]
    length = 1.0 / _largest_root(matrix)
    steps: list[list[float]] = []
    for _ in range(settings.steps):
        rate = _rate(steps, n)
        totals = cells.select(rate.alias("rate"), "tokens", *[f"p{k}" for k in n]).agg(
            *[F.sum(F.col("rate") * F.col("tokens") * share(k)).alias(f"t{k}") for k in n]
        ).first()
        gaps = [totals[k] / everything - settings.budget * settings.targets[k] for k in n]
        if max(abs(g) for g, w in zip(gaps, weight) if w) <= settings.tolerance:
            break
        steps.append([length * weight[k] * gaps[k] for k in n])
    return steps


def rates(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), domains=DOMAINS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``tokens``, ``p_<domain>`` and ``rate``, a row for each row.

    ``rate`` is how often a document is to be drawn on average. Null and blank
    texts have no token and count for nothing; their rate follows their priors.
    A domain that no document belongs to cannot be filled and is left out of the
    fit. Without labelled rows all domains are equally likely for all documents.
    """
    n = range(len(domains))
    spark = docs.sparkSession
    folder = new_folder(spark, "mixing")
    found = written(memberships(docs, labels, settings, domains), f"{folder}/memberships")
    shares = [f"p{k}" for k in n]
    cells = written(found.groupBy(*shares).agg(F.sum("tokens").alias("tokens")), f"{folder}/cells")
    rate = _rate(solve(cells, settings, n), n)
    return found.select(
        "doc_id", "text_hash", "tokens",
        *[(F.col(f"p{k}") / F.lit(float(PARTS))).alias(f"p_{name}") for k, name in enumerate(domains)],
        rate.alias("rate"),
    )


def mix(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), domains=DOMAINS) -> DataFrame:
    """``docs`` with ``rate``; documents whose rate is zero go.

    Rows with equal id and text have one rate. An own column ``rate`` of
    ``docs`` is replaced.
    """
    columns = [c for c in docs.columns if c != "rate"]
    found = rates(docs, labels, settings, domains).select(
        F.col("doc_id").alias("rated_id"), F.col("text_hash").alias("rated_hash"), "rate"
    )
    found = found.groupBy("rated_id", "rated_hash").agg(F.max("rate").alias("rate")).where("rate > 0")
    marked = docs.select(F.struct(*columns).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    same = (F.col("hash") == F.col("rated_hash")) & F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("rated_id"))
    return marked.join(found, same).select("doc.*", "rate")
