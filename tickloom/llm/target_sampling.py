"""Importance resampling towards the distribution of a target set of texts.

Features are the runs of one and two neighbouring words, hashed to a fixed
number of buckets by CRC-32. Counting the buckets of all documents and of all
target texts gives each bucket an integer gain, the floored thousandfold log
ratio of its smoothed shares. The gains are one array; a document's weight is
the floored mean of the array's entries at its features.

A Gumbel draw that only the seed and the id decide is added to the weight, and
the highest ``percent`` of the documents of at least ``shortest`` words are
drawn. Scores are written once. Exact counts over that table, one job a step,
halve the range of scores until the cut is known, then the range of ids among
the rows that tie at the cut. Only drawn rows are sorted, by range, for ranks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import new_folder, written
from tickloom.llm.ranking import numbered, ordered

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FLAT = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))
_CHUNK = 1 << 20
_SLICE = 256


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    seed: int = 7
    percent: int = 25
    shortest: int = 20


def bucket_parts(text: bytes | None, buckets: int):
    """Yields (words, buckets of their features) for parts of a text.

    A pair counts with its second word, also across parts, so memory is that
    of a part however long the text is.
    """
    flat = (text or b"").translate(_FLAT)
    at, before = 0, None
    while at < len(flat):
        cut = flat.find(b" ", at + _CHUNK)
        cut = len(flat) if cut < 0 else cut
        words = flat[at:cut].split()
        at = cut
        if not words:
            continue
        ones = list(map(crc32, words))
        firsts = ones[:-1] if before is None else [before, *ones[:-1]]
        seconds = words[1:] if before is None else words
        twos = map(crc32, seconds, map(crc32, repeat(b" "), firsts))
        before = ones[-1]
        found = np.fromiter((*ones, *twos), np.int64, len(ones) + len(firsts))
        yield len(words), found % buckets


def _slices(batch):
    """Columns of a batch as lists, a few rows at a time."""
    for start in range(0, batch.num_rows, _SLICE):
        yield batch.slice(start, _SLICE)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket over all rows of the column ``text``."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in _slices(batch):
                for text in some.column(0).to_pylist():
                    for _, found in bucket_parts(text, buckets):
                        counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["bucket", "n"])

    each = texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket int, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares, by bucket."""
    buckets, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_raw + buckets) / ((s + 1) * (all_target + buckets))))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    buckets = len(gain)
    table = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        gain = table.value
        for batch in batches:
            for some in _slices(batch):
                rows = []
                for text in some.column(1).to_pylist():
                    words = features = total = 0
                    for n, found in bucket_parts(text, buckets):
                        words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                    rows.append((words, features, total // features if features else 0))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"]
                )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"))
    return chosen.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def scored(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``score``: the weight plus the floored thousandfold Gumbel draw of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    gumbel = -1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))
    return rows.withColumn("score", F.col("weight") + F.floor(gumbel))


def _bisected(rows: DataFrame, value, low: int, high: int, wanted: int) -> int:
    """The smallest number that at least ``wanted`` rows do not exceed.

    One exact count a step over a written table; ``high`` must be enough.
    """
    while low < high:
        middle = (low + high) // 2
        if rows.where(value <= middle).count() >= wanted:
            high = middle
        else:
            low = middle + 1
    return low


def cutoff(scores: DataFrame, k: int):
    """(score, id): the ``k``-th row by falling score, then rising id; nulls last.

    The id is None where that row's id is null; the whole is None for k below 1.
    """
    if k < 1:
        return None
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    last = -_bisected(scores, -F.col("score"), -high, -low, k)
    tied = scores.where(F.col("score") == last)
    left = k - scores.where(F.col("score") > last).count()
    first, end, named = tied.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if left > named:
        return last, None
    return last, _bisected(tied, F.col("doc_id"), first, end, left)


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row.

    ``rank`` counts the drawn rows from 1 by falling score; of rows that tie the
    smaller id comes first, a null id last. It is null for rows not drawn.
    Null, empty and wordless texts have no feature and weight 0; a null id
    draws as the empty string does. Repeated rows are rows of their own; of
    rows with one score and one id as many are drawn as there is room for. An
    empty table gives no row, an empty target makes all gains equal ratios to
    the smoothing. Other columns are not read.
    """
    folder = new_folder(docs.sparkSession, "target-sampling")
    gain = gains(bucket_counts(docs, settings.buckets), bucket_counts(target, settings.buckets))
    scores = written(scored(weighed(docs, gain), settings.seed), f"{folder}/scores")
    able = scores.where(F.col("n_words") >= settings.shortest)
    k = settings.percent * able.count() // 100
    cut = cutoff(able, k)
    none = F.lit(None).cast("bigint")
    if cut is None:
        return scores.withColumn("rank", none)
    score, doc_id = F.col("score"), F.col("doc_id")
    at_cut = score == cut[0] if cut[1] is None else (score == cut[0]) & (doc_id <= cut[1])
    chosen = (F.col("n_words") >= settings.shortest) & ((score > cut[0]) | F.coalesce(at_cut, F.lit(False)))
    drawn = ordered(scores.where(chosen), f"{folder}/drawn", F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = numbered(drawn, "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scores.where(~chosen).withColumn("rank", none))
