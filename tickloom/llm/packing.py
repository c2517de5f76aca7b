"""Packing of tokenized documents into sequences by minimum bin slack.

A document's tokens end with an end id. One that is longer than a sequence is
cut from its end, so that only its first piece may be shorter. What is packed
are pieces, and only their lengths matter: the driver sees how many pieces have
each length, at most ``capacity`` numbers whatever the data.

Minimum bin slack fills one sequence at a time. A bit set holds the sums that
combinations of the lengths still there can reach; the fullest sum that fits
gives the combination, which is removed. A combination is removed as often as
the counts allow, so the number of steps depends on the lengths alone. In the
order of lengths two variants are tried, one that seeds each sequence with the
longest piece left and one that does not; the plan with fewer sequences wins.

Pieces are then sorted by length over all partitions. Each gets its place among
those of its length, and the plan says which sequence and which slot that is.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import new_folder, written
from tickloom.llm.ranking import PLACE, ordered, runs

# Fixed value: how byte-level vocabularies of this kind split a text before merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# All but characters that are letters, digits, spaces or none in every version of Unicode.
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-ſ‐-‧€]")
# White space as long as this is more than the rank file's pattern matcher can hold.
GAP = 10_000
LONG_GAP = re.compile(rf"\s{{{GAP}}}")
# A space with no white space next to it.
_CUT = re.compile(r"[^\s\x1c-\x1f] (?=[^\s\x1c-\x1f])")
_CHUNK = 1 << 19
_ROWS = 256


@dataclass(frozen=True)
class Settings:
    """``vocabulary`` names a file of the ``tokenizers`` library, on every machine.

    ``ranks``, if given, names the same vocabulary as a rank file.
    """

    vocabulary: str
    ranks: str | None = None
    capacity: int = 2048
    end: int = 0


def vocabulary_path(name: str) -> str:
    """Place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


@lru_cache(maxsize=1)
def encoder(vocabulary: str, ranks: str | None) -> "Encoder":
    """One for each Python worker."""
    return Encoder(vocabulary, ranks)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers.

    The ids are those that the ``tokenizers`` library gives the whole text.
    With ``ranks``, the same vocabulary as a rank file, text of plain characters
    goes through ``tiktoken``, which gives the same ids in a third of the time.
    Parts with a character of ``OTHER``, where versions of Unicode might differ
    between the two, or a ``LONG_GAP``, and texts with the string of a special
    token do not.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("plain", pat_str=WORDS, mergeable_ranks=table, special_tokens={})

    def direct(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        whole = self.fast is None or any(token in text for token in self.special)
        done = []
        for part in parts(text):
            if whole or OTHER.search(part) or (len(part) >= GAP and LONG_GAP.search(part)):
                done.append(self.direct(part))
            else:
                done.append(_packed(self.fast.encode_ordinary(part)))
        return b"".join(done)


def parts(text: str) -> Iterator[str]:
    """A long text in parts that are encoded alone with the same ids.

    Cuts lie before one space between characters that are no white space,
    where no word of the vocabulary's pattern crosses; a text without such a
    place stays whole.
    """
    at = 0
    while len(text) - at > _CHUNK:
        found = _CUT.search(text, at + _CHUNK)
        if found is None:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def pieces(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` of every piece.

    ``ids`` are little-endian unsigned 32-bit numbers. A null text is empty and
    has one piece, the end id.
    """
    files = settings.vocabulary, settings.ranks
    room, end = settings.capacity, settings.end.to_bytes(4, "little")

    def run(batches):
        encode = encoder(*files).encode
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                rows, owners = [], []
                for owner, text in enumerate(some.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    stop = total % room or room
                    start = piece = 0
                    while start < total:
                        rows.append((piece, start, stop - start, ids[4 * start : 4 * stop]))
                        owners.append(owner)
                        piece, start, stop = piece + 1, stop, stop + room
                number, starts, lengths, found = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(owners)),
                        pa.array(number, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(found, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths with the largest sum up to ``room``.

    Subset sums as one bit set: lengths come longest first, each in bundles of
    1, 2, 4 ... pieces as far as there are any, and the search ends once
    ``room`` itself is reached.
    """
    reach, steps, inside = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        size = 1
        while left > 0:
            size = min(size, left)
            grown = (reach | (reach << (size * length))) & inside
            if grown != reach:
                steps.append((reach, length, size))
                reach = grown
            left -= size
            size *= 2
        if reach >> room:
            break
    rest, found = reach.bit_length() - 1, {}
    for before, length, size in reversed(steps):
        if not before >> rest & 1:
            found[length] = found.get(length, 0) + size
            rest -= size * length
    return found


def plan(counts: dict[int, int], capacity: int, seeded: bool) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no piece is left."""
    left = {length: n for length, n in counts.items() if n}
    done = []
    while left:
        if seeded:
            seed = max(left)
            others = {x: n - (x == seed) for x, n in left.items() if x <= capacity - seed and n > (x == seed)}
            found = fullest(others, capacity - seed)
            found[seed] = found.get(seed, 0) + 1
        else:
            found = fullest(left, capacity)
        times = min(left[x] // k for x, k in found.items())
        for x, k in found.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        done.append((times, dict(sorted(found.items(), reverse=True))))
    return done


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    plans = [plan(counts, capacity, seeded) for seeded in (True, False)]
    return min(plans, key=lambda steps: sum(times for times, _ in steps))


def slots(steps) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first place, end place, first sequence, times, offset).

    Of the pieces of one length, those from the first place to the end fill one
    slot of ``times`` sequences in a row.
    """
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, combination in steps:
        offset = 0
        for length, k in combination.items():
            for _ in range(k):
                first = used.get(length, 0)
                used[length] = first + times
                found.setdefault(length, []).append((first, first + times, sequence, times, offset))
                offset += length
        sequence += times
    return found


_SLOTS = "part_ bigint, of_length_ bigint, from_ bigint, to_ bigint, sequence_ bigint, offset_ bigint"


def placed(rows: DataFrame, capacity: int, *keys: str | Column) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``, from their column ``length``.

    ``keys`` break ties among equal lengths; the more they tell rows apart, the
    better a common length spreads. The driver gets a row for each length and
    partition, and sends back the slots: at most as many as those plus the
    slots of the plan, which the lengths bound.
    """
    folder = new_folder(rows.sparkSession, "packing")
    rows = written(rows, f"{folder}/pieces")  # as the sort reads them twice
    dealt = ordered(rows, f"{folder}/ordered", "length", *keys)
    found = runs(dealt, "length")
    counts: dict[int, int] = {}
    for run in found:
        counts[run["length"]] = counts.get(run["length"], 0) + run["n"]
    by_length = slots(best_plan(counts, capacity))
    table, seen = [], {}
    for run in found:
        length, base = run["length"], seen.get(run["length"], 0)
        shift = run["first"] - base
        while by_length[length] and base < seen.get(length, 0) + run["n"]:
            first, end, sequence, _, offset = by_length[length][0]
            stop = min(end, seen.get(length, 0) + run["n"])
            table.append((run["part"], length, base + shift, stop + shift, sequence + base - first, offset))
            if stop == end:
                by_length[length].pop(0)
            base = stop
        seen[length] = base
    plan_rows = rows.sparkSession.createDataFrame(table, _SLOTS)
    joined = dealt.join(
        F.broadcast(plan_rows),
        (F.shiftright(PLACE, 33) == F.col("part_"))
        & (F.col("length") == F.col("of_length_"))
        & (F.col(PLACE) >= F.col("from_"))
        & (F.col(PLACE) < F.col("to_")),
    )
    return joined.select(
        *rows.columns,
        (F.col("sequence_") + F.col(PLACE) - F.col("from_")).alias("sequence_id"),
        F.col("offset_").alias("offset"),
    )


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """Every piece of ``docs`` with its ids and its place.

    Columns are those of :func:`pieces`, ``sequence_id`` and ``offset``. Null
    and empty texts have one piece, the end id. Null ids and repeated rows are
    documents like others; very long texts give many pieces; an empty table
    gives no row. Other columns are not read.
    """
    made = pieces(docs, settings)
    return placed(made, settings.capacity, F.xxhash64("doc_id", "piece", "ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_ids`` and ``ids`` of every packed sequence.

    One group is one sequence, so it holds at most ``capacity`` ids.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(inside, F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["ids"]))
    found = packed.groupBy("sequence_id").agg(ids.alias("ids"))
    return found.select("sequence_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), "ids")
