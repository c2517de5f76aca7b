"""Line dedup: lines at most one edit apart, found by a segment-partition join.

With a threshold of one edit a line is split into two segments, and a line one
edit away keeps one of them. Every distinct line is entered under both segments
with its length, and looks up, for its own length and for lines shorter by one,
the substrings that can be such a segment: the head, and the tail moved by the
difference in length. What meets there is verified by banded bit-parallel edit
distance. Lines linked this way, directly or in steps, form a class, and the
first occurrence of a class stays.

Very many lines may share a segment: near copies of one line. Pairs of them all
would grow with the square of their number, so segments with more than ``pairs``
lines take a way that grows with their number only. What is left of such lines
beside the segment differs in one place, in one block of ``block`` characters;
lines are grouped by the rest without the block, then, where that groups any, by
the block without one character. Lines that agree in all but the same character
are one edit apart from each other, so each is paired with the smallest of them;
a line that equals another without one character is paired with that one.

Shorter lines are judged too, but only for exact repeats: they are grouped like
the others and have no segments. Blank lines are not judged.

SQL expressions only. The first occurrence of a line is by document id, nulls
last, then by hash of the text, then by line number. Rows with equal id and text
are judged alike and do not remove each other's lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import let, maybe_in, new_folder, split_by, written
from tickloom.llm.components import connected_components

EDITS = 1
# Fixed value: what a line or text that is not blank has.
WRITTEN = r"[^\x20\x09-\x0D]"
_OWN, _LONGER = 0, 1


@dataclass(frozen=True)
class Settings:
    """Lines of fewer than ``shortest`` code points must repeat without an edit."""

    shortest: int = 20
    pairs: int = 32
    block: int = 64


# --- banded bit-parallel edit distance -------------------------------------


def edit_distance(a: Column, b: Column, band: int = EDITS) -> Column:
    """Edit distance of two texts if it is at most ``band``, else more than that.

    The band around the main diagonal is ``2 * band + 1`` cells high. One number
    holds, a bit for each of its cells, where the distance grows downwards and
    one where it falls; a column is a few operations on them. The score follows
    the diagonal that ends in the last cell: a step along it costs one unless
    the cell's diagonal bit says that it is free.
    """
    width = 2 * band + 1
    full = (1 << width) - 1

    def matches(longer: Column, shorter: Column) -> Column:
        def of(c: Column, j: Column) -> Column:
            bits = [
                F.when(F.coalesce(F.get(longer, j + (i - band)) == c, F.lit(False)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for i in range(width)
            ]
            total = bits[0]
            for bit in bits[1:]:
                total = total + bit
            return total

        return F.transform(shorter, of)

    def invert(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(full)

    def column(state: Column, same: Column) -> Column:
        down, up = state["down"], state["up"]
        free = ((same.bitwiseAND(down) + down).bitwiseXOR(down)).bitwiseOR(same).bitwiseOR(up).bitwiseAND(full)

        def following(d: Column) -> Column:
            right = up.bitwiseOR(invert(d.bitwiseOR(down)))
            left = d.bitwiseAND(down)
            moved = F.shiftright(d, 1)
            return F.struct(
                left.bitwiseOR(invert(moved.bitwiseOR(right))).alias("down"),
                moved.bitwiseAND(right).alias("up"),
                (state["score"] + 1 - F.call_function("shiftright", d, state["place"]).bitwiseAND(1).cast("int")).alias("score"),
                state["place"].alias("place"),
            )

        return let(free, following)

    def distance(longer: Column, shorter: Column) -> Column:
        gap = F.size(longer) - F.size(shorter)
        start = F.struct(
            F.lit((full >> band) << band).cast("bigint").alias("down"),
            F.lit(0).cast("bigint").alias("up"),
            gap.alias("score"),
            (gap + band).alias("place"),
        )
        counted = F.aggregate(matches(longer, shorter), start, column, lambda s: s["score"])
        return F.when(gap > band, F.lit(band + 1)).otherwise(counted)

    first_longer = F.length(a) >= F.length(b)
    longer, shorter = F.when(first_longer, a).otherwise(b), F.when(first_longer, b).otherwise(a)
    letters = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ""))
    return let(letters(longer), lambda x: let(letters(shorter), lambda y: distance(x, y)))


# --- entries ----------------------------------------------------------------


def _from(text: Column, start: Column) -> Column:
    """Text from a zero-based position on."""
    return F.substring(text, start + 1, F.greatest(F.length(text), F.lit(1)))


def _keys(line: Column, n: Column) -> Column:
    """Own entries under both segments, and look-ups among lines shorter by one."""
    half, below = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array(
        F.xxhash64(n, F.lit(0), F.substring(line, F.lit(1), half)),
        F.xxhash64(n, F.lit(1), _from(line, half)),
        F.xxhash64(n - 1, F.lit(0), F.substring(line, F.lit(1), below)),
        F.xxhash64(n - 1, F.lit(1), _from(line, below + 1)),
    )


def _lines(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row per document: its number of lines, and the hashes of those not blank."""
    text = F.col("text").cast("string")
    none = F.array().cast("array<bigint>")

    def judged(line: Column, at: Column) -> Column:
        return let(
            F.length(line),
            lambda n: F.when(
                line.rlike(WRITTEN),
                F.struct(
                    at.alias("at"),
                    F.xxhash64(line).alias("a"),
                    F.xxhash64(F.lit(1), line).alias("b"),
                    F.when(n >= settings.shortest, _keys(line, n)).otherwise(none).alias("keys"),
                ),
            ),
        )

    split = F.split(text, "\n")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.array_compact(F.transform(split, judged)), F.array().cast("array<struct<at:int,a:bigint,b:bigint,keys:array<bigint>>>")).alias("lines"),
    )


def _meeting(distinct: DataFrame, folder: str) -> DataFrame:
    """Entries (key, a, place) whose key several lines have, and how many."""
    entries = distinct.select("a", F.posexplode("keys").alias("place", "key"))
    met = written(
        entries.groupBy("key")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("place") < 2).alias("own"))
        .where("lines > 1 AND own > 0")
        .select(F.col("key").alias("met_key"), "lines"),
        f"{folder}/met",
    )
    near = maybe_in(entries, "key", met, "met_key")
    return written(near.join(met, F.col("key") == F.col("met_key")).drop("met_key"), f"{folder}/entries")


def _texts(docs: DataFrame, distinct: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """``a`` and ``line`` of every distinct line among ``entries``.

    Taken from the document of its first occurrence, so a document is read
    once whatever the number of its copies.
    """
    wanted = entries.select(F.col("a").alias("wanted")).distinct()
    where = distinct.join(wanted, F.col("a") == F.col("wanted")).select("first.*", "a")
    where = where.select(F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_text"), "at", "a")
    each = where.groupBy("in_doc", "in_text").agg(F.collect_list(F.struct("at", "a")).alias("places"))
    each = written(each, f"{folder}/places")
    text = F.col("text").cast("string")
    all_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    holders = maybe_in(all_, "text_hash", each, "in_text")
    joined = holders.join(each, (F.col("text_hash") == F.col("in_text")) & F.col("doc_id").eqNullSafe(F.col("in_doc")))
    lines = let(
        F.split("text", "\n"),
        lambda x: F.transform(F.col("places"), lambda p: F.struct(p["a"].alias("a"), F.get(x, p["at"]).alias("line"))),
    )
    return written(joined.select(F.inline(lines)).distinct(), f"{folder}/texts")


# --- pairs -------------------------------------------------------------------


def _few(entries: DataFrame, settings: Settings) -> DataFrame:
    """Pairs under segments that at most ``pairs`` lines have."""
    small = entries.where(F.col("lines") <= settings.pairs)
    x = small.where("place < 2").select("key", F.col("a").alias("a1"))
    y = small.select("key", F.col("a").alias("a2"), "place")
    return x.join(y, "key").where("place >= 2 OR a1 < a2").select("a1", "a2")


def _parts(entries: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """For lines under crowded segments: (kind, group, a, side, piece).

    ``rest`` is the line without the segment. For each block of it, the group is
    the key with the rest outside the block, the piece is the block. ``same``
    groups lines of one length; ``more`` groups lines with those longer by one,
    where the shorter line's block is shorter by one, too.
    """
    size = settings.block
    named = texts.select(F.col("a").alias("text_a"), "line")
    crowd = entries.where(F.col("lines") > settings.pairs).join(named, F.col("a") == F.col("text_a"))
    n = F.length("line")
    half = F.floor((n - F.when(F.col("place") < 2, 0).otherwise(1)) / 2).cast("int")
    ahead = F.col("place") % 2 == 0
    rest = F.when(ahead, _from(F.col("line"), half)).otherwise(
        F.substring("line", F.lit(1), half + F.when(F.col("place") < 2, 0).otherwise(1))
    )
    side = F.when(F.col("place") < 2, _OWN).otherwise(_LONGER)
    lines = crowd.select("key", "a", side.alias("side"), rest.alias("rest"))

    def block(kind: str, at: Column, length: int) -> Column:
        start = at * size
        return F.struct(
            F.lit(kind).alias("kind"),
            F.xxhash64("key", F.lit(kind), at, F.substring("rest", F.lit(1), start), _from(F.col("rest"), start + length)).alias("group"),
            F.substring("rest", start + 1, F.lit(length)).alias("piece"),
        )

    own = F.col("side") == _OWN
    last = F.floor((F.length("rest") - F.when(own, 0).otherwise(1)) / size).cast("int")
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    parts = F.when(
        own, F.concat(F.transform(places, lambda i: block("same", i, size)), F.transform(places, lambda i: block("more", i, size - 1)))
    ).otherwise(F.transform(places, lambda i: block("more", i, size)))
    return lines.select("a", "side", F.inline(parts))


def _many(entries: DataFrame, texts: DataFrame, settings: Settings, folder: str) -> DataFrame:
    """Pairs under crowded segments: as many as lines and characters of a block."""
    parts = written(_parts(entries, texts, settings), f"{folder}/parts")
    groups = written(
        parts.groupBy("group")
        .agg(F.count_if(F.col("side") == _OWN).alias("own"), F.count(F.lit(1)).alias("all"))
        .where("own > 0 AND all > 1")
        .select(F.col("group").alias("met_group")),
        f"{folder}/groups",
    )
    rows = parts.join(groups, F.col("group") == F.col("met_group"))
    without = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("piece") - 1, F.lit(0))),
        lambda q: F.struct(q.alias("q"), F.concat(F.substring("piece", F.lit(1), q), _from(F.col("piece"), q + 1)).alias("left")),
    )
    cut = rows.where("kind = 'same' OR side = 1").select("kind", "side", "group", "a", F.inline(without))
    same = cut.where("kind = 'same'").select(F.xxhash64("group", "q", "left").alias("code"), "a")
    same = written(same, f"{folder}/same")
    pivots = written(
        same.groupBy("code")
        .agg(F.min("a").alias("a1"), F.max("a").alias("last"))
        .where("a1 < last")
        .select(F.col("code").alias("pivot_code"), "a1"),
        f"{folder}/pivots",
    )
    alike = same.join(pivots, F.col("code") == F.col("pivot_code")).where("a != a1").select("a1", F.col("a").alias("a2"))
    whole = rows.where("kind = 'more' AND side = 0").select(F.xxhash64("group", "piece").alias("whole"), F.col("a").alias("a1"))
    shorter = cut.where("kind = 'more'").select(F.xxhash64("group", "left").alias("code"), F.col("a").alias("a2")).distinct()
    longer = shorter.join(whole, F.col("code") == F.col("whole")).select("a1", "a2")
    return alike.unionByName(longer)


def linked_lines(docs: DataFrame, distinct: DataFrame, settings: Settings, folder: str) -> DataFrame:
    """Pairs (a1, a2) of different lines at most one edit apart.

    Complete under small segments; under crowded ones, enough pairs that lines
    one edit apart are in one class.
    """
    entries = _meeting(distinct, folder)
    texts = _texts(docs, distinct, entries, folder)
    pairs = _few(entries, settings).unionByName(_many(entries, texts, settings, folder)).distinct()
    pairs = written(pairs, f"{folder}/pairs")
    one = texts.select(F.col("a").alias("x"), F.col("line").alias("line1"))
    two = texts.select(F.col("a").alias("y"), F.col("line").alias("line2"))
    read = pairs.join(one, F.col("a1") == F.col("x")).join(two, F.col("a2") == F.col("y"))
    return read.where(edit_distance(F.col("line1"), F.col("line2")) <= EDITS).select("a1", "a2")


# --- result ------------------------------------------------------------------


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_lines``, ``n_removed`` and ``removed``.

    One row for each row of ``docs``. ``removed`` are the numbers, from 0, of
    the lines that are not the first occurrence of their class, in order. Null
    texts have no line. Lines are what ``\\n`` separates, and compared whole.
    """
    folder = new_folder(docs.sparkSession, "lines")
    base = written(_lines(docs, settings), f"{folder}/base")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", F.col("line.at").alias("at"))
    lines = base.select("doc_id", "text_hash", F.explode("lines").alias("line")).select("line.*", order.alias("place"))
    distinct = written(
        lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.first("keys").alias("keys")), f"{folder}/distinct"
    )
    classes = connected_components(linked_lines(docs, distinct, settings, folder))
    known = distinct.select("a", "b", "first").join(classes, F.col("a") == F.col("node"), "left")
    leads = written(
        known.where("component IS NOT NULL").groupBy(F.col("component").alias("led")).agg(F.min("first").alias("lead")),
        f"{folder}/leads",
    )
    kept = written(
        known.join(leads, F.col("component") == F.col("led"), "left").select(
            F.col("a").alias("kept_a"), F.col("b").alias("kept_b"), F.coalesce("lead", "first").alias("kept")
        ),
        f"{folder}/kept",
    )
    gone = (
        lines.join(kept, (F.col("a") == F.col("kept_a")) & (F.col("b") == F.col("kept_b")))
        .where("place > kept")
        .select(F.col("place.doc_id").alias("from_doc"), F.col("place.text_hash").alias("from_text"), "at")
    )
    each = gone.groupBy("from_doc", "from_text").agg(F.sort_array(F.collect_set("at")).alias("removed"))
    counted = base.select("doc_id", "text_hash", "n_lines")
    joined = counted.join(
        each, (F.col("text_hash") == F.col("from_text")) & F.col("doc_id").eqNullSafe(F.col("from_doc")), "left"
    )
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "text_hash", F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"),
    )


def dedup_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the removed lines; texts that lose all their words go.

    Documents without removed lines pass as they are and are not moved. The
    other columns stay; ``n_chars``, where there is one, is set to the new length.
    """
    spark = docs.sparkSession
    names = docs.columns
    found = judge(docs, settings).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias("cut_doc"), F.col("text_hash").alias("cut_hash"), "removed").distinct()
    found = written(found, new_folder(spark, "cut-lines"))
    text = F.col("text").cast("string")
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text).alias("hash"))
    touched, untouched = split_by(marked, "hash", found, "cut_hash")
    cut = touched.join(
        found, (F.col("hash") == F.col("cut_hash")) & F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("cut_doc")), "left"
    )
    lines = F.split(F.col("doc.text").cast("string"), "\n")
    left = F.when(
        F.col("removed").isNull(), F.col("doc.text")
    ).otherwise(F.array_join(F.array_compact(F.transform(lines, lambda x, i: F.when(~F.array_contains("removed", i), x))), "\n"))
    cut = cut.select("doc", F.col("removed").isNotNull().alias("shortened"), left.alias("left"))
    cut = cut.where(~F.col("shortened") | F.col("left").rlike(WRITTEN))
    columns = [
        F.col("left").alias(c) if c == "text"
        else F.when(F.col("shortened"), F.length("left").cast("bigint")).otherwise(F.col("doc.n_chars")).alias(c) if c == "n_chars"
        else F.col("doc").getField(c).alias(c)
        for c in names
    ]
    return untouched.select("doc.*").unionByName(cut.select(*columns))
