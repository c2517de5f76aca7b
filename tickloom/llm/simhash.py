"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints at most two bits apart have one 32-bit half in which
they differ by one bit at most. So each half is indexed as it is and once for
each bit left out: halves that are equal meet under the plain key, halves that
differ in bit ``i`` meet under the key without bit ``i``, where only unlike
values of that bit are paired. An equality join finds all such pairs, and the
count of differing bits decides.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import new_folder, split_by, written
from tickloom.llm.components import connected_components

SEED = 42
MAX_BITS = 2
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    starts, ends = starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        parts = map(joined.__getitem__, map(slice, starts[at : at + _CHUNK], ends[at : at + _CHUNK]))
        digests = b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    value = np.packbits(2 * ones > len(starts)).tobytes()
    return int.from_bytes(value, "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` of every document; null or blank text gives zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = [fingerprint(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"]
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"))
    return chosen.mapInArrow(run, "doc_id bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """Rows (``key``, ``bit``, ``fp``): both halves, plain and without each bit.

    ``bit`` is the value left out, null under a plain key. The key packs the
    half, the bit left out and what remains of the half.
    """
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("value")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("value")),
    )
    each = fps.select("fp", F.explode(halves).alias("h")).select(
        "fp", "h.half", "h.value", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("out")
    )
    mask = F.expr("shiftleft(1L, greatest(out, 0))")
    plain = F.col("out") < 0
    left = F.when(plain, F.col("value")).otherwise(F.col("value").bitwiseAND(F.bitwise_not(mask)))
    place = (F.col("half") * 33 + F.col("out") + 1).cast("bigint")
    return each.select(
        F.shiftleft(place, 32).bitwiseOR(left).alias("key"),
        F.when(~plain, F.col("value").bitwiseAND(mask) != 0).alias("bit"),
        "fp",
    )


def linked_pairs(fps: DataFrame) -> DataFrame:
    """Pairs of distinct fingerprints that differ in one or two bits.

    Each fingerprint becomes 66 rows, which the planner's size estimate of the
    join's sides leaves out; the hint keeps it from broadcasting one of them.
    """
    rows = variants(fps)
    a = rows.where("bit IS NULL OR NOT bit").select("key", F.col("bit").alias("bit_a"), F.col("fp").alias("a"))
    b = rows.where("bit IS NULL OR bit").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return a.join(b.hint("merge"), "key").where(near & (F.col("bit_a").isNotNull() | (F.col("a") < F.col("b")))).select("a", "b")


def classes(fps: DataFrame) -> DataFrame:
    """``fp`` and ``component`` (its smallest fingerprint) of distinct fingerprints."""
    parts = connected_components(linked_pairs(fps.select("fp")))
    joined = fps.join(parts, fps["fp"] == parts["node"], "left")
    return joined.select(*fps.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    Documents whose fingerprints differ by at most two bits are linked; a
    component is what links reach, named by its smallest document id. Rows with
    a null id keep their row and give no name: a component of such rows alone
    has a null name. Documents without a word share fingerprint zero.
    """
    folder = new_folder(docs.sparkSession, "simhash")
    marked = written(fingerprints(docs, size), f"{folder}/fingerprints")
    distinct = written(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{folder}/distinct"
    )
    placed = written(classes(distinct), f"{folder}/placed")
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = written(placed.join(named, "component").select("fp", "component_id"), f"{folder}/classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of ``docs`` from each component: the one with the smallest id.

    Null ids come last; of rows that tie, also of repeated ones, the first one
    stays. Null and empty texts are one component, as in :func:`near_duplicates`;
    an empty table gives no row and all columns stay as they are. Only row
    numbers and texts go to Python. Rows that stay anyway are not moved: only
    those in the hash buckets of rows to drop are.
    """
    folder = new_folder(docs.sparkSession, "simhash")
    numbered = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    marked = written(numbered, f"{folder}/documents")
    texts = marked.select(F.col("row").alias("doc_id"), "doc.text")
    prints = written(fingerprints(texts, size), f"{folder}/fingerprints").select(F.col("doc_id").alias("row_"), "fp")
    known = written(classes(prints.select("fp").distinct()), f"{folder}/classes")
    ids = marked.select("row", F.col("doc.doc_id").cast("bigint").alias("doc_id"))
    rows = ids.join(prints, F.col("row") == F.col("row_")).join(known, "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    rows = written(rows.select("component", "row", rank.alias("rank")), f"{folder}/ranked")
    kept = written(rows.groupBy("component").agg(F.min("rank").alias("best")), f"{folder}/kept")
    dropped = written(
        rows.join(kept.select(F.col("best.row").alias("kept_row")), F.col("row") == F.col("kept_row"), "left_anti")
        .select(F.col("row").alias("gone")),
        f"{folder}/dropped",
    )
    touched, untouched = split_by(marked, "row", dropped, "gone")
    stay = touched.join(dropped, F.col("row") == F.col("gone"), "left_anti")
    return untouched.unionByName(stay).select("doc.*")
