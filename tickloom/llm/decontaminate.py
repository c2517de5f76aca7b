"""Benchmark decontamination by pigeonhole edit matching.

A passage within ``budget`` edits of a test item keeps at least one of the
item's ``budget + 1`` pieces unchanged. One automaton over the pieces of all
items finds every exact piece hit in a text; around each hit, Myers'
bit-parallel algorithm computes the smallest edit distance between the item and
any stretch of the text there.

Texts are compared in lower case, with each run of white space as one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

FOUND = "doc_id bigint, item_id bigint, distance int, start int, stop int"


@dataclass(frozen=True)
class Settings:
    """``piece`` code points per piece at least: an item of ``n`` has a budget
    of ``n // piece - 1`` edits, however long it is. Items shorter than
    ``shortest`` are matched exactly, as whole words. Items travel to the tasks
    in blocks of at most ``block_chars`` code points and ``block_items`` items.
    """

    piece: int = 20
    shortest: int = 40
    block_chars: int = 4_000_000
    block_items: int = 20_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str, settings: Settings) -> int:
    if len(item) < settings.shortest:
        return 0
    return max(0, len(item) // settings.piece - 1)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, text) of ``budget + 1`` even pieces that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def closest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` nearest to ``item``.

    Myers' bit-parallel search: one machine step a character of the text, the
    item's characters being the bits of a number. The first of several equal
    ends wins; end 0 stands for the empty stretch.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score < best:
            best, end = score, j
    return best, end


def start_of(item: str, text: str, end: int) -> int:
    """Start of the nearest stretch that ends at ``end``: the search, reversed."""
    _, back = closest(item[::-1], text[:end][::-1])
    return end - back


class Matcher:
    """Exact pieces of a block of items, in one automaton."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.items = [(i, t, budget_of(t, settings)) for i, t in items if t]
        self.shortest = settings.shortest
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                owners.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def found(self, text: str):
        """(item_id, distance, start, stop) of the best match of every item."""
        if not self.any:
            return
        spots: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                spots.setdefault(number, set()).add(last + 1 - length - offset)
        for number in sorted(spots):
            item_id, item, budget = self.items[number]
            best = None
            for low, high in _stretches(sorted(spots[number]), budget, len(item), len(text)):
                part = text[low:high]
                at = part.find(item)
                distance, end = (0, at + len(item)) if at >= 0 else closest(item, part)
                if distance > budget or best and distance >= best[0]:
                    continue
                start = end - len(item) if distance == 0 else start_of(item, part, end)
                if len(item) < self.shortest and not _apart(text, low + start, low + end):
                    continue
                best = (distance, low + start, low + end)
                if distance == 0:
                    break
            if best:
                yield (item_id, *best)


def _stretches(starts: list[int], budget: int, length: int, size: int):
    """Stretches of the text to search, near starts joined into one."""
    low = high = None
    for start in starts:
        a, b = max(0, start - budget), min(size, start + length + budget)
        if low is None:
            low, high = a, b
        elif a <= low + 2 * budget:
            high = b
        else:
            yield low, high
            low, high = a, b
    if low is not None:
        yield low, high


def _apart(text: str, start: int, stop: int) -> bool:
    """No letter or digit touches the stretch."""
    return not (start and text[start - 1].isalnum()) and not (stop < len(text) and text[stop].isalnum())


def blocks(benchmark: DataFrame, settings: Settings):
    """The items, normalised and without repeats, in blocks of a bounded size.

    The items are the query set: they stream through the driver a block at a
    time, and each block is matched against all documents.
    """
    block, chars = [], 0
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    for row in items.distinct().toLocalIterator():
        text = normal(row["text"])
        if block and (chars + len(text) > settings.block_chars or len(block) >= settings.block_items):
            yield block
            block, chars = [], 0
        block.append((row["item_id"], text))
        chars += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and item that it contains within the item's budget.

    ``distance`` is the smallest one, ``start`` and ``stop`` are code points of
    the normalised text. Null and blank texts match nothing; a row of ``docs``
    that is there twice matches twice; null ids stay null.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = None
    for block in blocks(benchmark, settings):
        run = _matched(spark.sparkContext.broadcast(block), settings)
        part = texts.mapInArrow(run, FOUND)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], FOUND) if result is None else result


def _matched(items, settings: Settings):
    def run(batches):
        matcher = Matcher(items.value, settings)
        for batch in batches:
            rows = [
                (doc_id, *found)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for found in matcher.found(normal(text))
            ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "distance", "start", "stop"],
            )

    return run


def contaminated(text: str, items, settings: Settings) -> Column:
    """True where a text contains an item of the broadcast block ``items``."""
    state: dict[str, Matcher] = {}

    @pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        if "matcher" not in state:
            state["matcher"] = Matcher(items.value, settings)
        matcher = state["matcher"]
        return pd.Series([next(matcher.found(normal(t)), None) is not None for t in texts], dtype=bool)

    return run(F.col(text).cast("string"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns as they are."""
    context = docs.sparkSession.sparkContext
    for block in blocks(benchmark, settings):
        docs = docs.where(~contaminated("text", context.broadcast(block), settings))
    return docs
