"""Probabilistic automata inferred from examples by state merging, and what speaks against them."""

from __future__ import annotations

from collections import Counter
from math import log, sqrt
from operator import add

SYMBOLS = 96
LENGTHS = 4096
EDGE = "\n"
_BLUR = 0.01
_TRUST = 2.0
_COMMON = 20.0


class Automaton:
    """States with counts of passes, ends and steps; ``steps[state][symbol]``.

    Starts as the prefix tree of the examples. :meth:`merge_all` then walks it
    from the root: a state whose end and step frequencies agree with those of a
    state already kept, and whose successors agree in turn, is merged into it.
    """

    def __init__(self, examples):
        self.passes, self.ends = [0], [0]
        self.steps: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.symbols: Counter[str] = Counter()
        for example in examples:
            state = 0
            self.symbols.update(example)
            for symbol in example:
                self.passes[state] += 1
                following = self.steps[state].get(symbol)
                if following is None:
                    following = self._new()
                    self.steps[state][symbol] = following
                self.counts[state][symbol] = self.counts[state].get(symbol, 0) + 1
                state = following
            self.passes[state] += 1
            self.ends[state] += 1

    def _new(self) -> int:
        self.passes.append(0)
        self.ends.append(0)
        self.steps.append({})
        self.counts.append({})
        return len(self.passes) - 1

    def _agree(self, a: int, b: int, width: float) -> bool:
        """Whether two states, and what follows them, look like one state."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            n, m = self.passes[a], self.passes[b]
            if not n or not m:
                continue
            bound = width * (1 / sqrt(n) + 1 / sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.counts[a].keys() | self.counts[b].keys():
                if abs(self.counts[a].get(symbol, 0) / n - self.counts[b].get(symbol, 0) / m) > bound:
                    return False
                if symbol in self.steps[a] and symbol in self.steps[b]:
                    pending.append((self.steps[a][symbol], self.steps[b][symbol]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state and what follows it."""
        pending = [(into, tree)]
        while pending:
            into, tree = pending.pop()
            self.passes[into] += self.passes[tree]
            self.ends[into] += self.ends[tree]
            for symbol, following in self.steps[tree].items():
                self.counts[into][symbol] = self.counts[into].get(symbol, 0) + self.counts[tree][symbol]
                if symbol in self.steps[into]:
                    pending.append((self.steps[into][symbol], following))
                else:
                    self.steps[into][symbol] = following

    def merge_all(self, alpha: float = 0.05) -> Automaton:
        """Merge what ``alpha`` cannot tell apart; states are tried in order."""
        width = sqrt(0.5 * log(2 / alpha))
        kept, known = [0], {0}
        while True:
            edge = next(
                ((a, s, b) for a in kept for s, b in sorted(self.steps[a].items()) if b not in known), None
            )
            if edge is None:
                return self
            a, symbol, b = edge
            same = next((k for k in kept if self._agree(k, b, width)), None)
            if same is None:
                kept.append(b)
                known.add(b)
            else:
                self.steps[a][symbol] = same
                self._fold(same, b)

    def steps_likelihood(self, text: str) -> float:
        """Log likelihood of a text's symbols, given that it does not end before its last one.

        A state knows its steps as far as it was passed; for the rest, and once
        the text has left the automaton, the examples' symbols count at large.
        """
        state, total, at_large = 0, 0.0, sum(self.symbols.values())
        for symbol in text:
            share = (self.symbols[symbol] + 1 / SYMBOLS) / (at_large + 1)
            if state is not None:
                known = self.passes[state] - self.ends[state]
                share = (self.counts[state].get(symbol, 0) + _TRUST * share) / (known + _TRUST)
                state = self.steps[state].get(symbol)
            total += log(share)
        return total

    def likelihood(self, text: str) -> float:
        """Log likelihood of a text for each of its symbols and its end.

        Steps never seen have a small share of the probability, evenly spread;
        from the first of them on the automaton knows no better.
        """
        state, total = 0, 0.0
        for symbol in text:
            share = 0.0
            if state is not None and self.passes[state]:
                share = self.counts[state].get(symbol, 0) / self.passes[state]
            total += log((1 - _BLUR) * share + _BLUR / SYMBOLS)
            state = None if state is None else self.steps[state].get(symbol)
        ended = 0.0 if state is None or not self.passes[state] else self.ends[state] / self.passes[state]
        return (total + log((1 - _BLUR) * ended + _BLUR / SYMBOLS)) / (len(text) + 1)


class Lengths:
    """Log likelihood of a length: as often as examples have it or lie around it, and once for all others."""

    def __init__(self, examples):
        self.seen = Counter(map(len, examples))
        self.low, self.high = min(self.seen), max(self.seen)
        self.total = sum(self.seen.values())

    def likelihood(self, length: int) -> float:
        share = 0.9 * self.seen[length]
        if self.low <= length <= self.high:
            share += 0.1 * self.total / (self.high - self.low + 1)
        return log((share + 1 / LENGTHS) / (self.total + 1))


class Format:
    """A format inferred from examples: an automaton for the symbols, and their lengths.

    The likelihood is that of the whole string. States that were merged into a
    loop have forgotten how long a string was, so length counts by itself.
    """

    def __init__(self, examples, alpha: float = 0.05):
        examples = list(examples)
        self.automaton = Automaton(examples).merge_all(alpha)
        self.lengths = Lengths(examples)

    def likelihood(self, text: str) -> float:
        return self.lengths.likelihood(len(text)) + self.automaton.steps_likelihood(text)


class Ordinary:
    """What ordinary runs look like: a chain of symbols, from counts of neighbours.

    ``pairs`` are (symbol, next one, count); an empty symbol is the start or the
    end. After a symbol that is rare, what follows is judged by symbols at large.
    """

    def __init__(self, pairs):
        steps = {(a or EDGE) + (b or EDGE): n for a, b, n in pairs}
        leaving, entering = Counter(), Counter()
        for pair, n in steps.items():
            leaving[pair[0]] += n
            entering[pair[1]] += n
        self.runs = leaving[EDGE]
        self.logs = _Logs(steps, leaving, entering, 0), _Logs(steps, leaving, entering, 1)

    def likelihood(self, text: str, counted: bool = False) -> float:
        """Of the whole string. ``counted``: it is one of the runs, and its steps do not count for themselves."""
        whole = EDGE + text + EDGE
        return sum(map(self.logs[counted].__getitem__, map(add, whole, whole[1:])))


class _Logs(dict):
    """Logs of the steps' shares, a pair of symbols each, with ``own`` steps left out; filled as asked for."""

    def __init__(self, steps, leaving, entering, own):
        super().__init__()
        self.counts, self.own = (steps, leaving, entering), own

    def __missing__(self, pair: str) -> float:
        steps, leaving, entering = self.counts
        at_large = (entering[pair[1]] + 1 / SYMBOLS) / (sum(entering.values()) + 1)
        step, left = (max(n - self.own, 0) for n in (steps.get(pair, 0), leaving[pair[0]]))
        self[pair] = log((step + _COMMON * at_large) / (left + _COMMON))
        return self[pair]

    def __reduce__(self):
        return _Logs, (*self.counts, self.own)
