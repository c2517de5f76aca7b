"""Substring dedup: windows that repeat across documents, behind a count-min sketch.

A window is ``window`` consecutive words. Its anchor is the smallest hash among
the word runs of length ``gram`` inside it, so equal windows have equal anchors,
and a text has about one anchor for every twenty windows.

First pass: each task counts the anchors of its documents in a count-min sketch,
once for each document; the sketches are added up. A sketch can only overstate,
so a window whose anchor it counts once starts in one document only. Second
pass: only what is estimated repeated is grouped exactly. First whole texts, as
a copy of a document with a smaller id loses every word; then the anchors of the
texts that are left, a twentieth of the rows of their windows; then the windows
with a shared anchor, by a 96-bit hash of their words. None that repeats is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import new_folder, written

DEPTH = 2
_BLOCK = 1 << 16
# Odd multipliers of the rolling hashes and of the mixing.
_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

DIGEST = "row bigint, doc_id bigint, n_words bigint, kept_sha256 string, text binary, text_hash binary, anchors array<bigint>"
WINDOWS = "row bigint, doc_id bigint, start int, h1 bigint, h2 int"


@dataclass(frozen=True)
class Settings:
    """``cells_per_anchor`` cells of the sketch for each anchor expected, as a
    power of two up to ``2 ** most_bits``: that many bits in each of its rows
    are what the driver broadcasts, 64 MB at most. A fuller sketch passes more
    windows on to the exact grouping and changes nothing else.
    """

    window: int = 50
    gram: int = 10
    cells_per_anchor: int = 8
    least_bits: int = 16
    most_bits: int = 28


def _mixed(values: np.ndarray, multiplier: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(multiplier)
    return values ^ (values >> np.uint64(29))


def rolling(hashes: np.ndarray, size: int, step: int) -> np.ndarray:
    """Hash of each run of ``size`` values: a polynomial modulo 2 ** 64."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up = np.full(n + 1, step, np.uint64)
    down = np.full(n + 1, pow(step, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * down[:n])))
    return (sums[size:] - sums[: n + 1 - size]) * up[: n + 1 - size]


def lowest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def word_hashes(words: list[bytes]) -> np.ndarray:
    digests = b"".join(map(xxhash.xxh3_128_digest, words))
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def anchors(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """The anchor of each window."""
    runs = _mixed(rolling(np.ascontiguousarray(hashes[:, 0]), settings.gram, _STEP[0]), _MIX[0])
    return lowest(runs, settings.window - settings.gram + 1)


def cells(values: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return (_mixed(values, _MIX[depth]) * np.uint64(_STEP[depth]) >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(settings: Settings, bits: int):
    """One task's sketch, sparse: rows (depth, block, cells, each as often as counted)."""

    def run(batches):
        seen = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or b"").split()
                if len(words) >= settings.window:
                    seen.append(np.unique(anchors(word_hashes(words), settings)))
        if not seen:
            return
        seen = np.concatenate(seen)
        for depth in range(DEPTH):
            at = np.sort(cells(seen, depth, bits))
            blocks, starts = np.unique(at >> 16, return_index=True)
            parts = [part.astype("<u2").tobytes() for part in np.split(at & (_BLOCK - 1), starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([depth] * len(parts), pa.int32()), pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())],
                names=["depth", "block", "cells"],
            )

    return run


def _added(batches):
    """Sum of the sketches' blocks, as one bit a cell: counted twice or more."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for depth, block, at in zip(*(c.to_pylist() for c in batch.columns)):
            total = sums.setdefault((depth, block), np.zeros(_BLOCK, np.uint8))
            at, times = np.unique(np.frombuffer(at, "<u2"), return_counts=True)
            total[at] = np.minimum(2, total[at] + np.minimum(2, times))
    for (depth, block), total in sums.items():
        bits = np.packbits(total >= 2, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([depth], pa.int32()), pa.array([block], pa.int32()), pa.array([bits], pa.binary())],
            names=["depth", "block", "bits"],
        )


def repeated_cells(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """Bit maps of the cells counted twice or more, and the bits of a cell number."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = settings.cells_per_anchor * chars // 6 * 2 // (settings.window - settings.gram + 2)
    bits = min(settings.most_bits, max(settings.least_bits, int(expected).bit_length()))
    sums = (
        texts.select("text").mapInArrow(_sketched(settings, bits), "depth int, block int, cells binary")
        .repartition(64, "depth", "block")
        .mapInArrow(_added, "depth int, block int, bits binary")
    )
    maps = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    for row in sums.toLocalIterator():
        at = row["block"] * _BLOCK // 8
        maps[row["depth"], at : at + _BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return maps, bits


def estimated_repeated(values: np.ndarray, maps: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(values), bool)
    for depth in range(DEPTH):
        at = cells(values, depth, bits)
        found &= (maps[depth][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _digested(maps, bits: int, settings: Settings):
    """Second pass: a digest of each text, or the text and its repeated anchors."""

    def run(batches):
        first, number = (TaskContext.get().partitionId() << 33), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found = (text or b"").split(), ()
                if len(words) >= settings.window and doc_id is not None:
                    found = np.unique(anchors(word_hashes(words), settings))
                    found = found[estimated_repeated(found, maps.value, bits)].view(np.int64)
                if len(found):
                    rows.append((first + number, doc_id, len(words), None, text, xxhash.xxh3_128_digest(text), found))
                else:
                    digest = sha256(b" ".join(words)).hexdigest()
                    rows.append((first + number, doc_id, len(words), digest, None, None, None))
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [()] * len(kinds)
            names = [column.split()[0] for column in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _windowed(settings: Settings, batch_rows: int = 1 << 16):
    """The windows of a text that have one of its shared anchors."""
    names = [column.split()[0] for column in WINDOWS.split(", ")]

    def of_text(row, doc_id, text, shared):
        hashes = word_hashes(text.split())
        hit = np.isin(anchors(hashes, settings).view(np.int64), np.array(shared, np.int64))
        start = np.flatnonzero(hit)
        h1, h2 = (
            _mixed(rolling(np.ascontiguousarray(hashes[:, i]), settings.window, _STEP[i]), _MIX[i])[start]
            for i in range(2)
        )
        owner, doc = np.full(len(start), row, np.int64), np.full(len(start), doc_id, np.int64)
        return owner, doc, start.astype(np.int32), h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run(batches):
        ready, rows = [], 0
        for batch in batches:
            for found in map(of_text, *(c.to_pylist() for c in batch.columns)):
                ready.append(found)
                rows += len(found[0])
                if rows >= batch_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names=names)
                    ready, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names=names)

    return run


def _shared(rows: DataFrame, key: list[str], path: str) -> DataFrame:
    """``key`` and the smallest ``doc_id`` as ``first``, of keys of several documents.

    Written, so that a join with it exchanges both sides and a key that very
    many rows have can be split.
    """
    found = rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return written(found.where("first < last").select(*key, "first"), path)


def dedup_substrings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row.

    A word is removed if a window that covers it also starts in a document with
    a smaller id; windows are judged on the input. ``kept_sha256`` digests the
    kept words, joined by one space. Null and blank texts have no word. Rows
    with a null id neither remove words nor lose any; rows with equal ids do not
    remove each other's words.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "substrings")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    maps, bits = repeated_cells(texts, settings)
    digest = written(
        texts.mapInArrow(_digested(spark.sparkContext.broadcast(maps), bits, settings), DIGEST), f"{folder}/digest"
    )
    clear = digest.where("kept_sha256 IS NOT NULL")
    listed = digest.where("kept_sha256 IS NULL")

    copies = _shared(listed.select("text_hash", "doc_id"), ["text_hash"], f"{folder}/copies")
    marked = listed.select("row", "doc_id", "n_words", "text_hash", "anchors").join(copies, "text_hash", "left")
    marked = written(
        marked.select("row", "doc_id", "n_words", "anchors", F.expr("coalesce(first < doc_id, false)").alias("copy")),
        f"{folder}/marked",
    )
    points = marked.where("NOT copy").select("row", "doc_id", F.explode("anchors").alias("anchor"))
    common = _shared(points, ["anchor"], f"{folder}/anchors")
    shared = points.join(common, "anchor").groupBy(F.col("row").alias("owner")).agg(F.collect_list("anchor").alias("shared"))
    live = written(
        listed.select("row", "doc_id", "n_words", "text")
        .join(marked.where("NOT copy").select(F.col("row").alias("kept_row")), F.col("row") == F.col("kept_row"))
        .join(shared, F.col("row") == F.col("owner"), "left")
        .select("row", "doc_id", "n_words", "text", "shared"),
        f"{folder}/live",
    )
    windows = live.where("shared IS NOT NULL").select("row", "doc_id", "text", "shared").mapInArrow(_windowed(settings), WINDOWS)
    firsts = _shared(windows, ["h1", "h2"], f"{folder}/windows")
    hits = windows.join(firsts, ["h1", "h2"]).where("doc_id > first")
    starts = hits.groupBy(F.col("row").alias("owner")).agg(F.collect_list("start").alias("starts"))

    @pandas_udf("n_removed bigint, kept_sha256 string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, starts):
            words = text.split()
            change = np.zeros(len(words) + 1, np.int64)
            if at is not None and len(at):
                np.add.at(change, at, 1)
                np.add.at(change, np.asarray(at) + settings.window, -1)
            kept = [w for w, covered in zip(words, np.cumsum(change).tolist()) if not covered]
            rows.append((len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "kept_sha256"])

    judged = live.join(starts, live["row"] == starts["owner"], "left")
    copied = marked.where("copy").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256")
    )
    return (
        judged.select("doc_id", "n_words", cut("text", "starts").alias("cut"))
        .select("doc_id", "n_words", "cut.*")
        .unionByName(copied)
        .unionByName(clear.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256"))
    )
