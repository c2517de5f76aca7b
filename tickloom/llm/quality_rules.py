"""Quality rules: decision lists learned by sequential covering.

Statistics of every text are computed in SQL expressions. On a bounded sample of
labelled rows, rules against low quality are learned one after the other: a
rule grows by the threshold condition with the highest gain until it is pure,
its tail is pruned on rows kept apart, and the rows it covers are taken out. The
list comes out as one conditional expression. Each growing step is one
aggregation: counts by statistic and bin reach the driver, rows never do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import SPACE, let, new_folder, words_of, written

# Fixed value: the characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled rows. A rule needs ``support`` covered
    rows to grow, and on the rows kept apart ``precision`` of its rows to be of
    low quality."""

    fit_rows: int = 40_000
    bins: int = 32
    rules: int = 8
    conditions: int = 3
    support: int = 8
    precision: float = 0.95


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self):
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the text."""
    pairs = lambda w, at: F.slice(w, at, F.size(w) - 2)
    hashes = lambda w: F.transform(
        F.arrays_zip(pairs(w, F.lit(1)).alias("a"), pairs(w, F.lit(2)).alias("b"), pairs(w, F.lit(3)).alias("c")),
        lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
    )

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda s: let(_equal_neighbours(s), lambda e: _span(_places(s, e))))

    def _equal_neighbours(s: Column) -> Column:
        return F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: a["x"] == b["x"]
        )

    def _places(s: Column, equal: Column) -> Column:
        edge = F.array(F.lit(False))
        either = F.zip_with(F.concat(edge, equal), F.concat(equal, edge), lambda a, b: a | b)
        return F.array_sort(F.array_compact(F.zip_with(s, either, lambda a, hit: F.when(hit, a["i"]))))

    def _span(places: Column) -> Column:
        return let(
            places,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
                F.lit(0),
                lambda total, part: total + part,
            ),
        )

    counted = let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) >= 3, counted).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and the statistics that rules may use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeats")),
    )
    of_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            F.size(F.array_distinct(w)).alias("distinct"),
            _repeated_words(w).alias("repeats"),
        ),
    )
    counted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(text).alias("length"),
        F.regexp_count(text, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digits"),
    )
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return counted.select(
        "doc_id",
        F.col("w.n").cast("bigint").alias("n_words"),
        F.col("w.chars").cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        F.col("l.repeats").cast("bigint").alias("n_dup_lines"),
        F.col("w.repeats").cast("bigint").alias("n_repeat_words"),
        F.col("w.n").cast("double").alias("words"),
        share("w.chars", "w.n").alias("mean_word"),
        share("w.distinct", "w.n").alias("distinct_share"),
        share("w.repeats", "w.n").alias("repeat_share"),
        share("l.repeats", "l.n").alias("dup_line_share"),
        share("symbols", "length").alias("symbol_share"),
        share("upper", "length").alias("upper_share"),
        share("digits", "length").alias("digit_share"),
    )


STATISTICS = (
    "words", "mean_word", "distinct_share", "repeat_share",
    "dup_line_share", "symbol_share", "upper_share", "digit_share",
)


def labelled(stats: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Statistics of at most ``fit_rows`` labelled documents, ``low`` and ``apart``.

    Chosen by hash of the id; a third is kept apart for pruning. A document with
    several label rows is of low quality if one of them says so.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy(F.col("doc_id").alias("labelled_id")).agg((F.min("quality") == 0).alias("low"))
    chosen = each.orderBy(F.xxhash64("labelled_id", F.lit("rules")), "labelled_id").limit(settings.fit_rows)
    apart = F.pmod(F.xxhash64("labelled_id", F.lit("apart")), F.lit(3)) == 0
    rows = stats.join(F.broadcast(chosen), stats["doc_id"] == F.col("labelled_id"))
    return rows.select(*STATISTICS, "low", apart.alias("apart"))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _bin(statistic: str, cuts: list[float]) -> Column:
    """How many of the cuts the statistic is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col(statistic) > cut))


def _entropy(p: int, n: int) -> float:
    return log2(p / (p + n))


def grow(rows: DataFrame, edges: dict[str, list[float]], settings: Settings) -> Rule:
    """The rule that greedy growth finds on ``rows``; empty if nothing gains."""
    rule: Rule = ()
    while len(rule) < settings.conditions:
        bins = [F.struct(F.lit(s).alias("statistic"), _bin(s, cuts).alias("bin")) for s, cuts in edges.items() if cuts]
        if not bins:
            return rule
        counts = (
            rows.where(_holds(rule))
            .select("low", F.explode(F.array(*bins)).alias("b"))
            .groupBy("b.statistic", "b.bin")
            .agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n"))
            .collect()
        )
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            table.setdefault(r["statistic"], {})[r["bin"]] = r["p"], r["n"]
        best, condition = 0.0, None
        for name in sorted(table):
            found = table[name]
            p0, n0 = (sum(v[i] for v in found.values()) for i in (0, 1))
            if not p0 or not n0:
                return rule
            for at, cut in enumerate(edges[name]):
                low = [sum(v[i] for b, v in found.items() if b <= at) for i in (0, 1)]
                for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                    if p + n >= settings.support and p:
                        gain = p * (_entropy(p, n) - _entropy(p0, n0))
                        if gain > best + 1e-9:
                            best, condition = gain, Condition(name, above, cut)
        if condition is None:
            return rule
        rule += (condition,)
    return rule


def prune(rows: DataFrame, rule: Rule, settings: Settings) -> Rule:
    """The shortest of the best heads of ``rule`` on rows kept apart; may be empty."""
    heads = [rule[: i + 1] for i in range(len(rule))]
    counts = rows.agg(
        *[F.count_if(_holds(h) & F.col("low")).alias(f"p{i}") for i, h in enumerate(heads)],
        *[F.count_if(_holds(h) & ~F.col("low")).alias(f"n{i}") for i, h in enumerate(heads)],
    ).first()
    best, chosen = settings.precision, ()
    for i, head in enumerate(heads):
        p, n = counts[f"p{i}"], counts[f"n{i}"]
        if p and (p / (p + n) > best or not chosen and p / (p + n) >= best):
            best, chosen = p / (p + n), head
    return chosen


def learn(rows: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """The decision list, in order; ``rows`` as :func:`labelled` makes them."""
    points = [i / settings.bins for i in range(1, settings.bins)]
    found = rows.agg(*[F.percentile_approx(s, points, 10_000).alias(s) for s in STATISTICS]).first()
    edges = {s: sorted(set(found[s] or ())) for s in STATISTICS}
    growing, pruning = rows.where("NOT apart"), rows.where("apart")
    rules: list[Rule] = []
    while len(rules) < settings.rules:
        rule = grow(growing, edges, settings)
        rule = prune(pruning, rule, settings) if rule else ()
        if not rule:
            break
        rules.append(rule)
        growing, pruning = growing.where(~_holds(rule)), pruning.where(~_holds(rule))
    return rules


def decision(rules: list[Rule]) -> Column:
    """Text of the first rule that holds, null if none does."""
    column = F.lit(None).cast("string")
    for rule in reversed(rules):
        column = F.when(_holds(rule), " and ".join(map(str, rule))).otherwise(column)
    return column


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The base counts, ``base_failed``, ``kept`` and ``rule`` of every row of ``docs``.

    Null and blank texts have no word and fail; null ids keep their row. With no
    labelled rows the list is empty and the base rules decide alone.
    """
    stats = written(statistics(docs), new_folder(docs.sparkSession, "quality-rules"))
    sample = labelled(stats, labels, settings)
    sample = written(sample, new_folder(docs.sparkSession, "quality-labels"))
    rule = decision(learn(sample, settings))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": rule}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )
