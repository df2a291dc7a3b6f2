"""Small weighted finite-state transducers over token classes, and their composition."""

from __future__ import annotations

from dataclasses import dataclass, field


class Lexical:
    """A transducer of one state over words: an arc for each word or word beginning ("begin*") writes `symbol`.

    Of several arcs that fit the heaviest is taken; a word without an arc passes unchanged, with weight 0.  Weights are
    above 0.
    """

    def __init__(self, symbol: str, arcs: dict[str, float]):
        self.symbol = symbol
        self.words = {k: v for k, v in arcs.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in arcs.items() if k.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})

    def step(self, word: str) -> tuple[str, float]:
        found = max(0.0, self.words.get(word, 0.0))
        for n in self.lengths:
            if len(word) > n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return (self.symbol, found) if found else (word, 0.0)


@dataclass
class Transducer:
    """Deterministic: arcs maps (state, symbol) to (next state, output symbol, factor, addend).

    An arc takes the weight w that its symbol comes with to factor * w + addend.  A symbol without an arc is passed
    through unchanged, with its weight, and leaves the state as `rest` says: None keeps it, a number moves there.
    """

    arcs: dict[tuple[int, str], tuple[int, str, float, float]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float, float]:
        if (arc := self.arcs.get((state, symbol))) is not None:
            return arc
        return self.rest.get(state, state), symbol, 1.0, 0.0


class Composed:
    """The composition of transducers in order: each reads what the one before it writes, and its weight.

    Product states are built when first reached and then kept, so the machine stays as small as its input needs.
    """

    def __init__(self, *machines: Transducer):
        self.machines = machines
        self.start = (0,) * len(machines)
        self.memo: dict = {}

    def step(self, state: tuple, symbol: str):
        if (known := self.memo.get((state, symbol))) is None:
            nexts, factor, addend, out = [], 1.0, 0.0, symbol
            for machine, at in zip(self.machines, state, strict=True):
                to, out, f, a = machine.step(at, out)
                nexts.append(to)
                factor, addend = f * factor, f * addend + a
            known = self.memo[state, symbol] = (tuple(nexts), out, factor, addend)
        return known

    def run(self, symbols, weights):
        """Outputs and the sum of composed weights of symbols that come with weights, from the start state."""
        state, total, outs = self.start, 0.0, []
        for s, w in zip(symbols, weights, strict=True):
            state, out, factor, addend = self.step(state, s)
            outs.append(out)
            total += factor * w + addend
        return outs, total
