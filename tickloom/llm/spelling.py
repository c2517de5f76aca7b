"""Spelling variants: words one edit apart, through k-d trees of letter counts.

A word's letters are counted in 32 dimensions. One edit adds at most one to one
count and takes at most one from another, so near words lie at L1 distance two
or less, and of neighbouring lengths at distance one. Words of one length share
a tree that splits boxes of count vectors. A search for a word visits the boxes
that it can reach so, in the tree of its own length and in that of the next.

The upper part of each tree is fitted on a bounded sample of the words and is
the same on all machines. Its leaves are the groups that Spark deals out: every
word lies in one leaf and is sent to the other leaves that its search reaches.
Within a leaf a tree of its points goes on; bit sets of counts drop most of
what remains there, and the order of the letters decides.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import discard, new_folder, written

DIMENSIONS = 32
_BREAK = re.compile("[^a-zÀ-ÿ]")
_CHUNK = 1 << 20
_HELD = 200_000
_PAIRS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``sample`` words at most, in expectation, fit the trees; all words are indexed.

    A leaf of the upper trees is meant to hold ``leaf`` words, and none is
    split that has fewer than ``least`` words of the sample. ``bucket`` words
    are a leaf of the lower trees. The rest is the contract of the words.
    """

    shortest: int = 5
    seldom: int = 3
    every: int = 97
    factor: int = 2
    sample: int = 1 << 18
    leaf: int = 16_384
    least: int = 16
    bucket: int = 24


def _text_parts(text: str):
    """A long text in parts that end outside a run of letters."""
    at = 0
    while len(text) - at > _CHUNK:
        found = _BREAK.search(text, at + _CHUNK)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def word_counts(doc_id, text: bytes | None, settings: Settings) -> Counter:
    """Words of one document with their occurrences.

    A run of letters loses one of them if the checksum of id and run is a
    multiple of ``every``; a null id counts as the empty string.
    """
    found: Counter = Counter()
    least = settings.shortest
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    for part in _text_parts((text or b"").lower().decode("utf-8", "replace")):  # on bytes ASCII only
        found.update(runs.findall(part))
    begun = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    whole: Counter = Counter()
    for run, n in found.items():
        h = crc32(run.encode(), begun)
        if h % settings.every == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
            if len(run) < least:
                continue
        whole[run] += n
    return whole


def words(docs: DataFrame, settings: Settings) -> DataFrame:
    """``word`` and ``n`` of every word with ``seldom`` occurrences or more."""

    def batch_of(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    held.update(word_counts(doc_id, text, settings))
                    if len(held) > _HELD:
                        yield batch_of(held)
                        held = Counter()
        yield batch_of(held)

    chosen = docs.select("doc_id", F.col("text").cast("binary"))
    counts = chosen.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= settings.seldom)


def letters(texts) -> np.ndarray:
    """Code points of words of one length, a row each; all are below 256."""
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts: one dimension a letter a to z, six for the others."""
    place = np.where(codes < 0xC0, codes - 0x61, 26 + codes % 6).astype(np.int64)
    rows = np.arange(len(codes))[:, None] * DIMENSIONS
    flat = np.bincount((rows + place).ravel(), minlength=len(codes) * DIMENSIONS)
    return flat.reshape(len(codes), DIMENSIONS).astype(np.int32)


@dataclass
class Node:
    """A split of counts up to ``most`` from those above, or a leaf."""

    leaf: int = -1
    dimension: int = 0
    most: int = 0
    low: "Node | None" = None
    high: "Node | None" = None


def grown(points: np.ndarray, size: float) -> tuple[Node, int]:
    """A tree with leaves of at most ``size`` points, if they can be told apart."""
    leaves = 0

    def split(rows: np.ndarray) -> Node:
        nonlocal leaves
        best = (0, 0, 0)
        if len(rows) > size:
            own = points[rows]
            for most in (0, 1, 2):
                above = np.count_nonzero(own > most, axis=0)
                balance = np.minimum(above, len(rows) - above)
                best = max(best, (int(balance.max()), int(balance.argmax()), most))
            if not best[0]:  # counts beyond two: the widest dimension, at its middle
                width = own.max(axis=0) - own.min(axis=0)
                if width.max():
                    at = int(width.argmax())
                    best = (1, at, int(own[:, at].min() + own[:, at].max()) // 2)
        if not best[0]:
            leaves += 1
            return Node(leaf=leaves - 1)
        above = points[rows, best[1]] > best[2]
        return Node(-1, best[1], best[2], split(rows[~above]), split(rows[above]))

    return split(np.arange(len(points))), leaves


def reached(tree: Node, points: np.ndarray, up: int, down: int):
    """Yields (leaf, rows of ``points``) for every box within reach.

    In reach is what differs by at most ``up`` added and ``down`` removed
    letters. A box's need of a row grows only by what a split adds to what its
    dimension needed before.
    """
    bounds = np.zeros(DIMENSIONS, np.int64), np.full(DIMENSIONS, 1 << 30)

    def visit(node: Node, rows, ups, downs):
        if node.leaf >= 0:
            yield node.leaf, rows
            return
        at, (least, most) = node.dimension, bounds
        own = points[rows, at]
        before_low, before_high = least[at], most[at]
        more = ups + np.maximum(node.most + 1 - own, 0) - np.maximum(before_low - own, 0)
        less = downs + np.maximum(own - node.most, 0) - np.maximum(own - before_high, 0)
        stay = less <= down
        if stay.any():
            most[at] = node.most
            yield from visit(node.low, rows[stay], ups[stay], less[stay])
            most[at] = before_high
        stay = more <= up
        if stay.any():
            least[at] = node.most + 1
            yield from visit(node.high, rows[stay], more[stay], downs[stay])
            least[at] = before_low

    zero = np.zeros(len(points), np.int64)
    if len(points):
        yield from visit(tree, np.arange(len(points)), zero, zero)


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits a row: counts of one or more, counts of two or more.

    An added or removed letter changes one bit at most.
    """
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one edit; ``right`` is as long or one longer."""
    size = left.shape[1]
    if right.shape[1] == size:
        return np.count_nonzero(left != right, axis=1) == 1
    ahead, behind = left == right[:, :-1], (left == right[:, 1:])[:, ::-1]
    prefix = np.where(ahead.all(axis=1), size, ahead.argmin(axis=1))
    suffix = np.where(behind.all(axis=1), size, behind.argmin(axis=1))
    return prefix + suffix >= size


def _searched(queries: np.ndarray, points: np.ndarray, tree: Node, order: dict, up: int, down: int, within: bool):
    """Yields arrays (query, point) of pairs one edit apart; ``within``: query below point."""
    query_counts, other = vectors(queries), signatures(vectors(points))
    own = signatures(query_counts)
    held, total = [], 0

    def settle():
        a, b = (np.concatenate(x) for x in zip(*held))
        near = one_edit(queries[a], points[b])
        return a[near], b[near]

    step = max(1, _PAIRS // max(1, max((len(x) for x in order.values()), default=1)))
    for leaf, rows in reached(tree, query_counts, up, down):
        there = order[leaf]
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            a, b = np.nonzero(np.bitwise_count(own[some][:, None] ^ other[there][None, :]) <= up + down)
            a, b = some[a], there[b]
            if within:
                a, b = a[a < b], b[a < b]
            held.append((a, b))
            total += len(a)
            if total * queries.shape[1] > 16 * _PAIRS:
                yield settle()
                held, total = [], 0
    if held:
        yield settle()


def _leaf_search(bucket: int):
    """All near pairs of one leaf, in both directions."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        roles = {role: part for role, part in group.groupby("role")}
        empty = pd.DataFrame({"word": [], "other": [], "n": []}).astype({"word": str, "other": str, "n": "int64"})
        if 0 not in roles:
            return empty
        points = roles[0]
        there = letters(points["word"].tolist())
        tree, _ = grown(counts := vectors(there), bucket)
        order = dict(reached(tree, counts, 0, 0))
        found = []
        for role, up, down in ((0, 1, 1), (1, 1, 1), (2, 1, 0)):
            if role not in roles:
                continue
            asked = roles[role]
            names, ns = asked["word"].to_numpy(), asked["n"].to_numpy()
            own_names, own_ns = points["word"].to_numpy(), points["n"].to_numpy()
            for a, b in _searched(letters(names.tolist()), there, tree, order, up, down, role == 0):
                found.append(pd.DataFrame({"word": names[a], "other": own_names[b], "n": own_ns[b]}))
                found.append(pd.DataFrame({"word": own_names[b], "other": names[a], "n": ns[a]}))
        return pd.concat(found) if found else empty

    return run


def upper_trees(sample: list[str], total: int, settings: Settings) -> dict[int, Node]:
    """By length: the tree fitted on the sample; other lengths are one leaf."""
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    size = max(settings.least, settings.leaf * len(sample) / max(1, total))
    return {n: grown(vectors(letters(some)), size)[0] for n, some in by_length.items()}


def _routed(trees):
    """Rows (length, leaf, role, word, n): where each word lies, and where it searches.

    Role 0 lies there, 1 looks for words of its length, 2 for longer ones. Of
    two leaves of one length only the lower one's words search the other.
    """

    def run(batches):
        known = trees.value
        single = Node(leaf=0)
        for batch in batches:
            texts = np.array(batch.column(0).to_pylist(), object)
            ns = batch.column(1).to_numpy()
            sizes = np.array([len(w) for w in texts], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                counts = vectors(letters(texts[at].tolist()))
                own = np.zeros(len(at), np.int64)
                for leaf, rows in reached(known.get(size, single), counts, 0, 0):
                    own[rows] = leaf
                targets = [(size, 0, own, np.arange(len(at)))]
                for leaf, rows in reached(known.get(size, single), counts, 1, 1):
                    rows = rows[own[rows] < leaf]
                    targets.append((size, 1, np.full(len(rows), leaf), rows))
                for leaf, rows in reached(known.get(size + 1, single), counts, 1, 0):
                    targets.append((size + 1, 2, np.full(len(rows), leaf), rows))
                for length, role, leaves, rows in targets:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows), length), pa.int32()),
                                pa.array(leaves, pa.int32()),
                                pa.array(np.full(len(rows), role), pa.int32()),
                                pa.array(texts[at[rows]], pa.string()),
                                pa.array(ns[at[rows]], pa.int64()),
                            ],
                            names=["length", "leaf", "role", "word", "n"],
                        )

    return run


def near_pairs(known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``, ``other`` and its ``n`` for every ordered pair one edit apart.

    ``known`` is a written table of different words with their ``n``.
    """
    spark, total = known.sparkSession, known.count()
    share = min(1.0, settings.sample / max(1, total))
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = [r["word"] for r in known.where(part).select("word").collect()]  # about ``sample`` words
    trees = spark.sparkContext.broadcast(upper_trees(sample, total, settings))
    routed = known.select("word", "n").mapInArrow(_routed(trees), "length int, leaf int, role int, word string, n bigint")
    return routed.groupBy("length", "leaf").applyInPandas(
        _leaf_search(settings.bucket), "word string, other string, n bigint"
    )


def roots(links: DataFrame, folder: str) -> DataFrame:
    """``word`` and ``root`` from (word, form): forms followed to the last.

    Every form is at least twice as frequent as its word, so there are no
    cycles and a chain has at most 63 steps; each round halves what is left.
    """
    spark = links.sparkSession
    now = written(links.select("word", F.col("form").alias("root")), f"{folder}/roots-0")
    for round_ in range(1, 8):
        next_ = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        jumped = now.join(next_, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")
        )
        jumped = written(jumped, f"{folder}/roots-{round_}")
        discard(spark, f"{folder}/roots-{round_ - 1}")
        moved = jumped.where("moved").limit(1).count()
        now = jumped.select("word", "root")
        if not moved:
            break
    return now


def variants(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word.

    A word's form is its most frequent near word (of equals the smallest), if
    that is ``factor`` times as frequent; its root is where forms end. Null and
    empty texts have no words; rows with a null id count like others, with an
    empty id in the checksum; repeated rows count again. An empty table gives
    no row, a run of any length is a word. Other columns are not read.
    """
    folder = new_folder(docs.sparkSession, "spelling")
    known = written(words(docs, settings), f"{folder}/words")
    best = F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best")
    near = near_pairs(known, settings).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select(F.col("word").alias("near_word"), "n_near", "best")
    joined = known.join(near, F.col("word") == F.col("near_word"), "left")
    much = -F.col("best.n") >= settings.factor * F.col("n")
    forms = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(much, F.col("best.other")).alias("form"),
        F.when(much, -F.col("best.n")).alias("form_n"),
    )
    forms = written(forms, f"{folder}/forms")
    ends = roots(forms.where("form IS NOT NULL").select("word", "form"), folder)
    ends = ends.select(F.col("word").alias("end_word"), "root")
    return forms.join(ends, F.col("word") == F.col("end_word"), "left").select(
        *forms.columns, F.coalesce("root", "word").alias("root")
    )
