"""Whether one glob covers another, from their automata.

A glob is a small automaton over characters. One pattern covers another if every path that the second matches is matched
by the first: a walk over pairs (a state of the second, the set of states the first can be in) meets no pair in which the
second accepts and the first does not. Characters that neither pattern names behave alike and are one symbol.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = re.compile(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]+")
OTHER = "\0"  # stands for all characters that no pattern names
MAX_PAIRS = 200_000


class Automaton:
    """States are numbers; `moves` has (from, what, to), where what is a character, 'any' (but a slash), 'all' or None."""

    def __init__(self, pattern: str):
        self.moves: dict[int, list[tuple[str | None, int]]] = {}
        self.last = 0
        for token in TOKENS.findall(pattern.replace("\\", "/").lstrip("/").lower()):
            self._add(token)

    def _move(self, a: int, what: str | None, b: int) -> None:
        self.moves.setdefault(a, []).append((what, b))

    def _next(self) -> int:
        self.last += 1
        return self.last

    def _add(self, token: str) -> None:
        at = self.last
        if token == "**/":  # any number of folders
            inside, done = self._next(), self._next()
            self._move(at, None, done)
            self._move(at, "any", inside)
            self._move(inside, "any", inside)
            self._move(inside, "/", at)
        elif token == "/**":  # something below
            below, done = self._next(), self._next()
            self._move(at, "/", below)
            self._move(below, "all", done)
            self._move(done, "all", done)
        elif token in ("**", "*"):
            self._move(at, "all" if token == "**" else "any", at)
            self._move(at, None, self._next())
        elif token == "?":
            self._move(at, "any", self._next())
        else:
            for c in token:
                self._move(at, c, self._next())
                at = self.last

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        found, waiting = set(states), list(states)
        while waiting:
            for what, b in self.moves.get(waiting.pop(), []):
                if what is None and b not in found:
                    found.add(b)
                    waiting.append(b)
        return frozenset(found)

    def step(self, states: frozenset[int], c: str) -> frozenset[int]:
        to = {b for a in states for what, b in self.moves.get(a, []) if what == c or what == "all" or what == "any" and c != "/"}
        return self.closure(frozenset(to))

    def letters(self) -> set[str]:
        return {what for moves in self.moves.values() for what, _ in moves if what and len(what) == 1}


@lru_cache(maxsize=1 << 14)
def covers(wide: str, narrow: str) -> bool:
    """Whether every path that `narrow` matches is matched by `wide`; both are compared without case."""
    a, b = Automaton(wide), Automaton(narrow)
    letters = sorted(a.letters() | b.letters() | {"/"}) + [OTHER]
    first = (b.closure(frozenset([0])), a.closure(frozenset([0])))
    seen, waiting = {first}, [first]
    while waiting:
        inner, outer = waiting.pop()
        for c in letters:
            pair = (b.step(inner, c), a.step(outer, c))
            if c != "/" and b.last in pair[0] and a.last not in pair[1]:  # no path is empty or ends with a slash
                return False
            if pair[0] and pair not in seen:
                if len(seen) >= MAX_PAIRS:
                    return False  # not shown to be covered
                seen.add(pair)
                waiting.append(pair)
    return True


def covered_by(narrow: Column, wide: Column) -> Column:
    """True where the glob `wide` covers the glob `narrow`; NULL patterns give NULL. Meant for distinct pairs."""

    @F.pandas_udf("boolean")
    def judge(narrows, wides):
        import pandas as pd

        return pd.Series([None if n is None or w is None else covers(w, n) for n, w in zip(narrows, wides)], dtype=object)

    return judge(narrow, wide)
