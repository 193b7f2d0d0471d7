"""Weighted finite-state transducers over a small alphabet, their composition, and best paths.

An arc reads a symbol, writes a symbol and has a factor. A token is a symbol with a weight; a path gives each token's weight
times the factors of the arcs that read it, and its value is the sum of what it writes as matches. Composing two transducers
lets the second read what the first writes; factors multiply. Where several paths accept an input the greatest value counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

Arc = tuple[str, float, int]


class Transducer:
    """States are numbers, 0 is the start; arcs: state -> symbol -> [(written symbol, factor, next state)]."""

    def __init__(self, arcs: dict[int, dict[str, list[Arc]]], final: Iterable[int]):
        self.arcs, self.final = arcs, frozenset(final)

    def paths(self, word: Sequence[str]) -> dict[tuple[str, ...], float]:
        """Everything that may be written for a word, with the product of factors (the greatest); for small words."""
        now: dict[tuple[int, tuple[str, ...]], float] = {(0, ()): 1.0}
        for symbol in word:
            following: dict[tuple[int, tuple[str, ...]], float] = {}
            for (state, out), f in now.items():
                for written, g, target in self.arcs.get(state, {}).get(symbol, ()):
                    key = target, (*out, written)
                    following[key] = max(following.get(key, 0.0), f * g)
            now = following
        done: dict[tuple[str, ...], float] = {}
        for (state, out), f in now.items():
            if state in self.final:
                done[out] = max(done.get(out, 0.0), f)
        return done

    def best(self, tokens: Sequence[tuple[str, float]], matches: dict[str, int]) -> tuple[float, ...] | None:
        """Sums of the weights written as each match (its place in `matches`) on the path with the greatest sum of all;
        None if no path accepts."""
        zero = (0.0,) * len(matches)
        now: dict[int, tuple[float, tuple[float, ...]]] = {0: (0.0, zero)}
        for symbol, weight in tokens:
            following: dict[int, tuple[float, tuple[float, ...]]] = {}
            for state, (value, sums) in now.items():
                for written, factor, target in self.arcs[state].get(symbol, ()):
                    at, total, own = matches.get(written), value, sums
                    if at is not None:
                        x = weight * factor
                        total, own = value + x, (*sums[:at], sums[at] + x, *sums[at + 1 :])
                    if target not in following or total > following[target][0]:
                        following[target] = total, own
            now = following
        ends = [x for state, x in now.items() if state in self.final]
        return max(ends, key=lambda x: x[0])[1] if ends else None


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What the first writes is read by the second. Only states on a way from the start to an end are kept."""
    number, queue = {(0, 0): 0}, [(0, 0)]
    arcs: dict[int, dict[str, list[Arc]]] = {}
    for s, t in queue:
        own: dict[str, list[Arc]] = defaultdict(list)
        for symbol, ways in first.arcs.get(s, {}).items():
            for middle, f, s_next in ways:
                for written, g, t_next in second.arcs.get(t, {}).get(middle, ()):
                    pair = s_next, t_next
                    if pair not in number:
                        number[pair] = len(number)
                        queue.append(pair)
                    own[symbol].append((written, f * g, number[pair]))
        arcs[number[s, t]] = dict(own)
    final = {k for (s, t), k in number.items() if s in first.final and t in second.final}
    before = defaultdict(set)
    for k, own in arcs.items():
        for ways in own.values():
            for *_, target in ways:
                before[target].add(k)
    useful, todo = set(final), list(final)
    for k in todo:
        fresh = before[k] - useful
        useful |= fresh
        todo += fresh
    useful.add(0)
    kept = {k: {symbol: [a for a in ways if a[2] in useful] for symbol, ways in own.items()} for k, own in arcs.items() if k in useful}
    return Transducer(kept, final)


def scope(opener: str, reach: int, factor: float, inside: dict[str, str], alphabet: Iterable[str]) -> Transducer:
    """After `opener`, for `reach` tokens, the symbols of `inside` are written as their values, damped by the factor.

    State k: so many tokens of the scope are left."""
    arcs: dict[int, dict[str, list[Arc]]] = {}
    for left in range(reach + 1):
        own = {}
        for symbol in alphabet:
            following = reach if symbol == opener else max(left - 1, 0)
            own[symbol] = [(inside[symbol], factor, following)] if left and symbol in inside else [(symbol, 1.0, following)]
        arcs[left] = own
    return Transducer(arcs, range(reach + 1))


def nearby(target: str, reach: int, near: dict[str, tuple[str, float]], far: dict[str, tuple[str, float]], alphabet: Iterable[str]) -> Transducer:
    """Symbols within `reach` tokens of a target, before or after it, are written as `near` says, others as `far` says.

    A target that is still to come is guessed, and the path ends if it doesn't come in time. State (a, b): the last target's
    reach goes on for a tokens; one must come within b tokens (0: none is owed)."""
    number = lambda a, b: a * (reach + 1) + b
    arcs: dict[int, dict[str, list[Arc]]] = {}
    for a in range(reach + 1):
        for b in range(reach + 1):
            own: dict[str, list[Arc]] = {}
            for symbol in alphabet:
                if symbol == target:
                    own[symbol] = [(symbol, 1.0, number(reach, 0))]
                elif b != 1:  # else the target had to come here
                    left, owed = max(a - 1, 0), max(b - 1, 0)
                    if symbol not in near:
                        own[symbol] = [(symbol, 1.0, number(left, owed))]
                    elif a:
                        own[symbol] = [(*near[symbol], number(left, owed))]
                    else:
                        own[symbol] = [(*far[symbol], number(left, owed)), (*near[symbol], number(left, owed or reach))]
            arcs[number(a, b)] = own
    return Transducer(arcs, {number(a, 0) for a in range(reach + 1)})
