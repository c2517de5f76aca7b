"""Quality by importance resampling with hashed n-gram models.

Two generative models are counted, one on labelled target text (good and not
toxic) and one on the raw text of all documents, for single words and for word
pairs, each hashed to ``2 ** bits`` buckets. A document's log weight is the sum
of ``log(p_target / p_raw)`` over its n-grams. A Gumbel draw is added to each
log weight and the ``k`` largest sums are the sample: that draws ``k`` documents
without replacement, in proportion to their weights.

Three settings keep the sample close to the target text:

* a ratio counts only as far as it is evident: it is 0 within ``z`` standard
  errors of the usual ratio of clean text, and shrunk by ``slack`` beyond;
* a sum is scaled by ``sqrt(reference / n)``, else noise would let the length
  of a document decide;
* the weight of a document is its smaller weight under the two models, each
  measured from the level that ``recall`` of held-out target documents reach,
  and ``k`` is the number of documents at or above that level. The lowest of
  few held-out documents are not yet the lowest of many: of ``n`` of them, the
  level goes down by ``z / sqrt(n)`` of its distance to the labelled others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import new_folder, split_by, written
from tickloom.llm.topk import kth_largest

ORDERS = 2
_BLOCK = 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEY_SCALE = 1e6
_SLICE = 256


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled documents the target model is made of."""

    fit_rows: int = 40_000
    bits: int = 20
    smoothing: float = 1.0
    z: float = 3.0
    slack: float = 0.7
    reference: int = 1000
    recall: float = 0.995
    seed: int = 7


@dataclass
class Weights:
    """Log ratios by bucket, one row per order, as a broadcast; and the cuts."""

    ratios: object
    settings: Settings
    cuts: tuple[float, ...] = field(default=(0.0,) * ORDERS)


def buckets(text: bytes | None, bits: int) -> list[np.ndarray]:
    """Bucket of every word and of every pair of neighbouring words."""
    words = (text or b"").split()
    if not words:
        return [np.zeros(0, np.int64)] * ORDERS
    digests = b"".join(map(xxhash.xxh3_64_digest, words))
    one = np.frombuffer(digests, ">u8").astype(np.uint64)
    two = one[:-1] * _MIX + one[1:]
    two = (two ^ (two >> np.uint64(29))) * _MIX
    shift = np.uint64(64 - bits)
    return [(h >> shift).astype(np.int64) for h in (one, two)]


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id`` and ``role`` of at most ``rows`` labelled documents.

    Chosen by hash of their id. Three of four target documents fit the target
    model (role 1), the fourth is held out (role 2); others have role 0. A
    document with several label rows is a target only if all of them say so.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target")
    )
    mixed = F.xxhash64("doc_id", F.lit("labelled sample"))
    chosen = each.orderBy(mixed, "doc_id").limit(rows)
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(4)) == 0
    role = F.when(~F.col("target"), 0).when(held, 2).otherwise(1)
    return chosen.select(F.col("doc_id").alias("labelled_id"), role.alias("role"))


def _counted(bits: int):
    """One task's sparse counts: rows (model, part, offsets, counts)."""

    def run(batches):
        size = 1 << bits
        counts = np.zeros((2, ORDERS, size), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                some = batch.slice(at, _SLICE)
                for text, role in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    for order, found in enumerate(buckets(text, bits)):
                        np.add.at(counts[0, order], found, 1)
                        if role == 1:
                            np.add.at(counts[1, order], found, 1)
        rows = []
        for model in range(2):
            flat = counts[model].reshape(-1, min(_BLOCK, size))
            for part in np.flatnonzero(flat.any(axis=1)).tolist():
                at = np.flatnonzero(flat[part])
                rows.append((model, part, at.astype("<u2").tobytes(), flat[part, at].astype("<i8").tobytes()))
        for start in range(0, len(rows), 256):
            columns = list(zip(*rows[start : start + 256]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32())]
                + [pa.array(c, pa.binary()) for c in columns[2:]],
                names=["model", "part", "at", "n"],
            )

    return run


def _merged(block: int):
    """Sums of a part over all tasks, as a stream: memory is that of the model."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, part, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault((model, part), np.zeros(block, np.int64))
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        for (model, part), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["model", "part", "n"],
            )

    return run


def log_ratios(target: np.ndarray, raw: np.ndarray, settings: Settings) -> np.ndarray:
    """Shrunken log ratios of one order, from its counts by bucket."""
    expected = target.sum() * raw / max(raw.sum(), 1)
    usual = expected > 50
    level = float(np.median(target[usual] / expected[usual])) if usual.any() else 1.0
    expected = expected * level
    ratio = np.log((target + settings.smoothing) / (expected + settings.smoothing))
    ratio[np.abs(target - expected) < settings.z * np.sqrt(expected + 1)] = 0
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - settings.slack, 0)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Weights:
    """Count both models over all documents and set the cuts.

    The driver receives the merged counts, whose size is that of the model.
    """
    spark = docs.sparkSession
    roles = labelled_sample(labels, settings.fit_rows)
    table = roles.sparkSession.createDataFrame(roles.collect(), roles.schema)  # at most fit_rows ids
    texts = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = texts.join(F.broadcast(table), texts["doc_id"] == table["labelled_id"], "left")
    size = 1 << settings.bits
    block = min(_BLOCK, size)
    counts = (
        marked.select("text", "role")
        .mapInArrow(_counted(settings.bits), "model int, part int, at binary, n binary")
        .repartition("model", "part")
        .mapInArrow(_merged(block), "model int, part int, n binary")
    )
    totals = np.zeros((2, ORDERS * size // block, block), np.int64)
    for row in counts.toLocalIterator():
        totals[row["model"], row["part"]] = np.frombuffer(row["n"], np.int64)
    totals = totals.reshape(2, ORDERS, size)
    ratios = np.stack([log_ratios(*(totals[m, o].astype(float) for m in (1, 0)), settings) for o in range(ORDERS)])
    del totals
    weights = Weights(spark.sparkContext.broadcast(ratios), settings)

    labelled = measured(marked.where("role != 1"), weights, "role").where("n_words > 0")
    labelled = written(labelled, new_folder(spark, "importance"))
    level = labelled.where("role = 2").agg(
        F.count("*").alias("n"), *[F.percentile(f"w{o + 1}", 1 - settings.recall).alias(f"c{o}") for o in range(ORDERS)]
    ).first()
    if not level["n"]:
        return weights
    low = [level[f"c{o}"] for o in range(ORDERS)]
    beyond = F.least(*[F.col(f"w{o + 1}") - F.lit(c) for o, c in enumerate(low)])
    others = labelled.where("role = 0").agg(F.percentile(beyond, 0.95)).first()[0]
    margin = max(0.0, -(others or 0.0)) * min(0.5, settings.z / level["n"] ** 0.5)
    return Weights(weights.ratios, settings, tuple(c - margin for c in low))


def measured(docs: DataFrame, weights: Weights, *columns: str) -> DataFrame:
    """``columns``, ``n_words`` and the log weights ``w1``, ``w2`` under each order's model.

    Only these columns and the text go to Python, and a slice of each batch at
    a time becomes Python objects.
    """
    ratios, bits, reference = weights.ratios, weights.settings.bits, weights.settings.reference

    def run(batches):
        table = ratios.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                some = batch.slice(at, _SLICE)
                rows = []
                for text in some.column(0).to_pylist():
                    found = buckets(text, bits)
                    scale = (reference / max(1, len(found[0]))) ** 0.5
                    sums = [float(table[o][b].sum(dtype=np.float64)) * scale for o, b in enumerate(found)]
                    rows.append((len(found[0]), *sums))
                n, one, two = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], pa.array(n, pa.int64()), pa.array(one, pa.float64()), pa.array(two, pa.float64())],
                    names=[*columns, "n_words", "w1", "w2"],
                )

    chosen = docs.select(F.col("text").cast("binary").alias("text"), *columns)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]]
    return chosen.mapInArrow(run, ", ".join([*kept, "n_words bigint", "w1 double", "w2 double"]))


def weighed(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_weight``, ``sample_key`` and two hashes of every row.

    ``sample_key`` is the log weight plus a Gumbel draw that the seed, the id
    and the text determine, in millionths. Documents without a word have
    neither weight nor key and are never sampled. The hashes, of id and text,
    are those of :func:`identity`.
    """
    mixed = F.xxhash64(F.lit(weights.settings.seed), F.col("doc_id"), F.col("text"))
    told = docs.select("doc_id", "text", mixed.alias("draw"), *identity())
    cuts = [F.lit(c) for c in weights.cuts]
    weight = F.when(F.col("n_words") > 0, F.least(F.col("w1") - cuts[0], F.col("w2") - cuts[1]))
    uniform = (F.shiftrightunsigned("draw", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    gumbel = -F.log(-F.log(uniform))
    key = F.round((weight + gumbel) * _KEY_SCALE).cast("bigint")
    return measured(told, weights, "doc_id", "draw", *_IDENTITY).select(
        "doc_id", "n_words", weight.alias("log_weight"), key.alias("sample_key"), *_IDENTITY
    )


_IDENTITY = ("hash_1", "hash_2")


def identity() -> list[Column]:
    """128 bits that tell rows apart by id and text: on what a row's draw depends."""
    return [F.xxhash64(F.lit(name), F.col("doc_id"), F.col("text")).alias(name) for name in _IDENTITY]


def sample(docs: DataFrame, weights: Weights) -> DataFrame:
    """The sampled documents: ``doc_id``, ``n_words``, ``log_weight`` and ``sample_key``.

    As many as reach the level of target text; rows that tie with the last one
    are all kept.
    """
    scores, last = _scored(docs, weights)
    return scores.where(F.col("sample_key") >= last).drop(*_IDENTITY)


def resample(docs: DataFrame, weights: Weights) -> DataFrame:
    """The sampled rows of ``docs``, with their columns as they are.

    Rows are weighed once. Whole rows stay in the JVM, where those that are not
    sampled are told by the hashes of their id and text; only rows that may be
    among them are moved.
    """
    scores, last = _scored(docs, weights)
    gone = scores.where(~F.coalesce(F.col("sample_key") >= last, F.lit(False)))
    gone = gone.select(*[F.col(name).alias(f"gone_{i}") for i, name in enumerate(_IDENTITY)]).distinct()
    gone = written(gone, new_folder(docs.sparkSession, "importance"))
    own = F.struct(*docs.columns).alias("doc")
    told = docs.select(own, *identity())
    touched, untouched = split_by(told, _IDENTITY[0], gone, "gone_0")
    same = [F.col(name) == F.col(f"gone_{i}") for i, name in enumerate(_IDENTITY)]
    stay = touched.join(gone, same, "left_anti")
    return untouched.unionByName(stay).select("doc.*")


def _scored(docs: DataFrame, weights: Weights):
    """Scores of all rows, written once, and the key of the last one sampled."""
    scores = written(weighed(docs, weights), new_folder(docs.sparkSession, "importance"))
    k = scores.where("log_weight >= 0").count()
    return scores, F.lit(kth_largest(scores, "sample_key", k))
