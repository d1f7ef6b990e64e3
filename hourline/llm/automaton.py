"""Deterministic tokenization automaton of a byte-pair vocabulary.

The automaton reads tokens: a token sequence is accepted exactly if it is the one that applying the
merge rules, best rank first, gives for its text (Berglund, Martens and van der Merwe, "Constructing
a BPE tokenization DFA", 2024). Construction starts from one state that loops over the base symbols.
The gadget of a rule (u, v) -> uv does three things:

* the state that u-arcs lead to is copied, and the copy loses its v-arc (u v would have merged),
* all u-arcs are led to the copy,
* every state with a u-arc gets an arc uv to the state that v-arcs lead to just then.

So the state after an arc depends on the arc's label alone, and a copy differs from its original by
one missing arc. States are therefore kept copy-on-write, as the history of each token: which piece
stood at its left and its right border after each merge on the way to it, and at which rank. Whether
the state after a token has an arc is read off the two histories side by side: the arc is lost if a
rule merges the two pieces at the common border before either is swallowed. ``step`` keeps the
answers in a table, which stands for the arcs in use. The full table would have vocabulary squared
entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: (rank, piece at the left border, piece at the right border) after each merge, in merge order.
History = list[tuple[int, int, int]]
_NEVER = 1 << 60


class TokenAutomaton:
    """Arcs between tokens, built by one gadget for each rule.

    ``rules`` gives (rank, left, right, merged), halves before what they merge into. Several rules may
    make one token; the one whose halves an accepted path spells counts. ``rank_of(left, right)`` is
    the rank at which the two merge, or None. A token that no accepted path spells is ``dead``.
    """

    def __init__(self, rules: Iterable[tuple[int, int, int, int]], rank_of: Callable[[int, int], int | None], table_size: int = 400_000) -> None:
        self.rank_of = rank_of
        self.dead: set[int] = set()
        self.table: dict[int, bool] = {}
        self._table_size = table_size
        self._histories: dict[int, History] = {}
        self._first: dict[int, tuple[int, int]] = {}  # the base symbols at a token's borders
        for rank, left, right, merged in rules:
            if merged in self._histories:
                continue
            path = None if left in self.dead or right in self.dead else self._side_by_side(left, right)
            if path is None:
                self.dead.add(merged)
            else:
                self._histories[merged] = [*path, (rank, merged, merged)]
                self._first[merged] = (self._first.get(left, (left, left))[0], self._first.get(right, (right, right))[1])
                self.dead.discard(merged)

    @property
    def made(self) -> set[int]:
        """Tokens that some rule makes on an accepted path."""
        return set(self._histories)

    def _side_by_side(self, left: int, right: int) -> History | None:
        """The merges of both tokens in the order in which they happen next to each other, or None if
        a rule merges over their border first. At equal rank the leftmost merge comes first."""
        ones, twos = self._histories.get(left, ()), self._histories.get(right, ())
        outer_left, inner_left = self._first.get(left, (left, left))
        inner_right, outer_right = self._first.get(right, (right, right))
        path: History = []
        i = j = 0
        while i < len(ones) or j < len(twos):
            one = ones[i][0] if i < len(ones) else _NEVER
            two = twos[j][0] if j < len(twos) else _NEVER
            over = self.rank_of(inner_left, inner_right)
            if over is not None and over < one and over <= two:
                return None
            if one <= two:
                rank, outer_left, inner_left = ones[i]
                i += 1
            else:
                rank, inner_right, outer_right = twos[j]
                j += 1
            path.append((rank, outer_left, outer_right))
        return path

    def step(self, token: int, label: int) -> bool:
        """Whether the automaton has the arc ``label`` after ``token``."""
        key = token << 20 | label
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= self._table_size:
                self.table.clear()
            found = self.table[key] = self.rank_of(token, label) is None and self._side_by_side(token, label) is not None
        return found


class Encoder:
    """The accepted path of a symbol string: longest arcs first, back over dead ends.

    Any accepted path is the only one, and every prefix of it is the only path to its end, so an end
    that was left without a way on is never tried again: time is linear in the string.
    """

    def __init__(self, automaton: TokenAutomaton, ids: dict[str, int]) -> None:
        self.automaton = automaton
        alive = {t: i for t, i in ids.items() if i not in automaton.dead}
        self.length = {i: len(t) for t, i in alive.items()}
        #: Every beginning of a token, and the longest token that it begins with (-1: none).
        self.beginnings: dict[str, int] = {}
        #: The next shorter token that a token begins with (-1: none).
        self.shorter: dict[int, int] = {}
        for token in sorted(alive, key=len):
            longest = -1
            for n in range(1, len(token)):
                longest = self.beginnings.setdefault(token[:n], alive.get(token[:n], longest))
            self.shorter[alive[token]] = longest
            self.beginnings[token] = alive[token]

    def path(self, symbols: str) -> list[int] | None:
        """Labels of the accepted path, or None if no path spells the string."""
        beginning, shorter, length = self.beginnings.get, self.shorter, self.length
        known, step, end = self.automaton.table.get, self.automaton.step, len(symbols)
        tokens: list[int] = []
        seen: set[int] = set()
        at, last, label = 0, -1, None
        while True:
            if label is None:  # a new place: the longest arc
                label, stop = -1, at + 1
                while stop <= end:
                    found = beginning(symbols[at:stop])
                    if found is None:
                        break
                    label = found
                    stop += 1
            while label >= 0:
                if last < 0:
                    arc = True
                else:
                    arc = known(last << 20 | label)
                    if arc is None:
                        arc = step(last, label)
                if arc and at + length[label] not in seen:
                    break
                label = shorter[label]
            if label >= 0:
                tokens.append(label)
                at += length[label]
                if at == end:
                    return tokens
                seen.add(at)
                last, label = label, None
            elif tokens:
                label = tokens.pop()
                at -= length[label]
                label = shorter[label]
                last = tokens[-1] if tokens else -1
            else:
                return None
