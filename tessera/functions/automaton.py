"""A pattern automaton over code points: a trie whose nodes fall back to their longest proper suffix in it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

try:
    import ahocorasick as native
except ImportError:  # the form below is slower
    native = None


class Automaton:
    """Finds every occurrence of many patterns in one pass over a text; empty patterns are nowhere."""

    def __init__(self, patterns: dict[str, int]):
        self.known = {p: k for p, k in patterns.items() if p}
        self.built = None
        if native is not None and self.known:
            self.built = native.Automaton()
            for p, k in self.known.items():
                self.built.add_word(p, (k, len(p)))
            self.built.make_automaton()
        elif self.known:
            self._build()

    def _build(self) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for p, k in self.known.items():
            at = 0
            for c in p:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append([])
                at = self.step[at][c]
            self.ends[at].append((k, len(p)))
        self.fall = [0] * len(self.step)
        todo = deque(self.step[0].values())
        while todo:
            at = todo.popleft()
            for c, child in self.step[at].items():
                todo.append(child)
                back = self.fall[at]
                while back and c not in self.step[back]:
                    back = self.fall[back]
                self.fall[child] = self.step[back].get(c, 0) if self.step[back].get(c, 0) != child else 0
                # Its own pattern is the longest that ends here; those of the suffix follow.
                self.ends[child] = self.ends[child] + self.ends[self.fall[child]]

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(end, id, length) of every occurrence, by inclusive end, the longest first."""
        if not self.known:
            return
        if self.built is not None:
            for end, (k, n) in self.built.iter(text):
                yield end, k, n
            return
        at = 0
        for end, c in enumerate(text):
            while at and c not in self.step[at]:
                at = self.fall[at]
            at = self.step[at].get(c, 0)
            for k, n in self.ends[at]:
                yield end, k, n
