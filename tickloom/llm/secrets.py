"""Secrets: fixed patterns, and formats inferred from what they find.

The patterns find credentials with a kind. Those are the labelled examples: for
each kind a probabilistic automaton, with the lengths beside it, is inferred from
a bounded sample of them. Every other run of a credential's characters, from the
patterns' shortest length on, is then scored: the log likelihood of the whole
string under the format less that under a chain of symbols, which is counted over
all those runs. What a finding must score comes from examples that the inference
had not seen and from how much rarer credentials are than runs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import new_folder, written
from tickloom.llm.grammar import Format, Ordinary

# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST_ASSIGNED = 8
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PART = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

CLASSES = {name: re.compile(f"[{name}]") for name in ("a-z", "A-Z", "0-9", "+/_.=-")}

# Texts whose spans are Python objects at a time; the rest of a batch is still Arrow.
SLICE = 256

SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"


@dataclass(frozen=True)
class Settings:
    """``examples`` bounds the distinct credentials of a kind that are looked
    at, those of at most ``longest`` characters. Fewer than ``fewest`` of one
    alphabet teach nothing. ``level`` is the quantile of held-out examples that
    the least score of a finding is drawn from.
    """

    examples: int = 1000
    longest: int = 128
    fewest: int = 6
    alpha: float = 0.05
    level: float = 0.02


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, credential) by start, then kind; code points."""
    found = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST_ASSIGNED:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(KINDS[kind], start, stop, value) for start, kind, stop, value in sorted(found)]


def candidates(text: str, taken) -> list[tuple[str, int, int, str]]:
    """Runs of a credential's characters and length that touch no span of ``taken``.

    A run with dots comes first as a whole, then without those at its ends, then
    in its parts.
    """
    found = []
    for m in RUN.finditer(text):
        run, at = m[0], m.start()
        options = [(at, run)]
        if "." in run:
            left = run.lstrip(".")
            options.append((m.end() - len(left), left.rstrip(".")))
            options += [(at + p.start(), p[0]) for p in PART.finditer(run)]
        for start, value in dict.fromkeys(options):
            stop = start + len(value)
            if len(value) >= SHORTEST_ASSIGNED and not any(a < stop and start < b for _, a, b, _ in taken):
                found.append(("", start, stop, value))
    return found


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base spans and the candidates of every text, in one pass."""

    def run(batches):
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])
        )
        named = lambda spans: [dict(zip(("kind", "start", "stop", "value"), s)) for s in spans]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                rest = [candidates(t, b) for t, b in zip(texts, base)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(map(named, base), kind), pa.array(map(named, rest), kind)],
                    names=["doc_id", "base", "candidates"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id bigint, base {SPANS}, candidates {SPANS}")


def examples(spans: DataFrame, kind: str, settings: Settings) -> list[str]:
    """Distinct credentials of a kind, in an order that hashing fixes."""
    values = spans.select(F.explode("base").alias("s")).where(F.col("s.kind") == kind).select("s.value")
    short = values.where(F.length("value") <= settings.longest).distinct()
    rows = short.orderBy(F.xxhash64("value"), "value").limit(settings.examples).collect()
    return [r["value"] for r in rows]


def ordinary_runs(spans: DataFrame) -> Ordinary:
    """The chain of symbols of all candidates, by their occurrences.

    Occurrences are counted by value first, which combines before the shuffle;
    what is collected has a row for each pair of symbols, 68 * 68 at most.
    """
    each = spans.select(F.explode("candidates.value").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    symbols = F.filter(F.split("value", ""), lambda c: c != "")
    edge = F.array(F.lit(""))
    pair = F.explode(F.zip_with(F.concat(edge, symbols), F.concat(symbols, edge), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = each.select("n", pair.alias("pair")).groupBy("pair.a", "pair.b").agg(F.sum("n").alias("n"))
    return Ordinary([(r["a"], r["b"], r["n"]) for r in pairs.collect()])


def alphabet(value: str) -> str:
    """The classes of symbols a credential is made of."""
    return "".join(name for name, pattern in CLASSES.items() if pattern.search(value))


def infer(spans: DataFrame, settings: Settings = Settings()) -> tuple[list[tuple[str, Format, float]], Ordinary | None]:
    """(kind, format, least score of a finding) for each format, and the ordinary runs.

    Examples of a kind make a format for each alphabet that enough of them have.
    Two halves of them are scored by the format of the other half, so all are
    held out once; the format itself has all. A run that is as likely a
    credential as not has as score the log of how many runs there are for each
    credential. The least score lies midway between that and the held-out
    examples', as bare credentials count among the ordinary runs and so score
    less than examples do, and never below the former.
    """
    known = {}
    for kind in KINDS:
        for value in examples(spans, kind, settings):
            known.setdefault((kind, alphabet(value)), []).append(value)
    sizes = Counter()
    for (kind, _), values in known.items():
        sizes[kind] += len(values)
    known = {key: values for key, values in known.items() if len(values) >= settings.fewest}
    if not known:
        return [], None
    counts = spans.select(F.explode("base.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    there, ordinary = {r["kind"]: r["n"] for r in counts}, ordinary_runs(spans)
    models = []
    for (kind, _), values in sorted(known.items()):
        held = []
        for half in (0, 1):
            format = Format(values[half::2], settings.alpha)
            held += [format.likelihood(v) - ordinary.likelihood(v) for v in values[1 - half :: 2]]
        level = sorted(held)[int(settings.level * len(held))]
        even = log(max(ordinary.runs, 1) * sizes[kind] / (there[kind] * len(values)))
        models.append((kind, Format(values, settings.alpha), max(even, (even + level) / 2)))
    return models, ordinary


def find_secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every row of ``docs``.

    ``base`` are the patterns' spans; ``spans`` adds the inferred ones, of kinds
    ``like_assign`` and so on, and is in order of start, then kind. An inferred
    span never touches a base span and names the kind that likes it best. Null
    texts have no span. A null id stays null.
    """
    spark = docs.sparkSession
    spans = written(scanned(docs), new_folder(spark, "secrets"))
    models = spark.sparkContext.broadcast(infer(spans, settings))

    @pandas_udf("array<string>")
    def liked(starts: pd.Series, stops: pd.Series, values: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}

        formats, ordinary = models.value

        def best(value):
            if value not in known:
                against = ordinary.likelihood(value, counted=True) if formats else 0.0
                # A likelihood's log is never above zero: most runs are too ordinary for any format.
                open_to = [(kind, m, against + least) for kind, m, least in formats if against + least <= 0]
                ratings = [(m.likelihood(value) - needed, kind) for kind, m, needed in open_to]
                margin, kind = max(ratings, default=(-1.0, ""))
                known[value] = f"like_{kind}" if margin >= 0 else None
            return known[value]

        def row(starts, stops, values):
            """Of options for one run the first one liked counts."""
            out, reached = [], -1
            for start, stop, value in zip(starts, stops, values):
                kind = best(value) if start >= reached else None
                reached = stop if kind else reached
                out.append(kind)
            return out

        return pd.Series(list(map(row, starts, stops, values)), dtype=object)

    each = F.col("candidates")
    judged = spans.withColumn("liked", liked(each["start"], each["stop"], each["value"]))
    added = F.filter(
        F.zip_with("candidates", "liked", lambda c, kind: c.withField("kind", kind)), lambda c: c["kind"].isNotNull()
    )
    ranks = {kind: i for i, kind in enumerate(KINDS)}
    rank = lambda s: F.coalesce(
        *[F.when(s["kind"] == kind, i) for kind, i in ranks.items()], F.lit(len(ranks))
    )
    ordered = F.array_sort(
        F.transform(
            F.concat("base", added),
            lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")),
        )
    )
    spans_ = F.transform(
        ordered,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")),
    )
    return judged.select("doc_id", "base", spans_.alias("spans"))
