"""Probabilistic automata inferred from examples by merging prefix-tree states (ALERGIA).

``infer`` builds the prefix tree of the examples with visit counts and, state by state in breadth-first
order, merges it into the first earlier state that is compatible: the two states' frequencies of ending
and of each next symbol, and recursively their successors', differ by no more than Hoeffding's bound.
The number of examples is bounded by the caller, so inference runs on the driver on a bounded tree.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

def symbols(text: str) -> str:
    """The text with letters and digits replaced by their class: digit, hexadecimal or other letter,
    each of either case; other characters stand for themselves."""
    return text.translate(_CLASSES)


_CLASSES = str.maketrans({c: s for chars, s in (
    ("0123456789", "0"), ("abcdef", "a"), ("ghijklmnopqrstuvwxyz", "z"), ("ABCDEF", "A"),
    ("GHIJKLMNOPQRSTUVWXYZ", "Z")) for c in chars})


class _State:
    __slots__ = ("n", "end", "next", "count")

    def __init__(self):
        self.n = self.end = 0
        self.next: dict[str, int] = {}
        self.count: dict[str, int] = {}


def prefix_tree(examples: Iterable[tuple[str, int]]) -> list[_State]:
    states = [_State()]
    for text, weight in examples:
        at = 0
        states[0].n += weight
        for c in text:
            s = states[at]
            if c not in s.next:
                s.next[c] = len(states)
                states.append(_State())
            s.count[c] = s.count.get(c, 0) + weight
            at = s.next[c]
            states[at].n += weight
        states[at].end += weight
    return states


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(t: list[_State], a: int, b: int, bound: float) -> bool:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = t[a], t[b]
        if _differ(x.end, x.n, y.end, y.n, bound):
            return False
        for c in x.count.keys() | y.count.keys():
            if _differ(x.count.get(c, 0), x.n, y.count.get(c, 0), y.n, bound):
                return False
            if c in x.next and c in y.next:
                todo.append((x.next[c], y.next[c]))
    return True


def _fold(t: list[_State], a: int, b: int) -> None:
    """Adds the tree below b to the automaton at a."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = t[a], t[b]
        x.n += y.n
        x.end += y.end
        for c, to in y.next.items():
            x.count[c] = x.count.get(c, 0) + y.count[c]
            if c in x.next:
                todo.append((x.next[c], to))
            else:
                x.next[c] = to


class Automaton:
    """Transition log-probabilities with a floor for what the examples never did."""

    def __init__(self, states: list[_State], reach: list[int], alphabet: int, smoothing: float = 0.1):
        number = {old: new for new, old in enumerate(reach)}
        self.next: list[dict[str, int]] = []
        self.log: list[dict[str, float]] = []
        self.log_end: list[float] = []
        self.log_other: list[float] = []
        for old in reach:
            s = states[old]
            total = s.n + smoothing * (alphabet + 1)
            self.next.append({c: number[to] for c, to in s.next.items()})
            self.log.append({c: math.log((k + smoothing) / total) for c, k in s.count.items()})
            self.log_end.append(math.log((s.end + smoothing) / total))
            self.log_other.append(math.log(smoothing / total))

    def log_likelihood(self, text: str) -> float:
        """Natural logarithm of the text's probability; a symbol never seen in a state costs that
        state's floor and leaves the state as it is."""
        at, total = 0, 0.0
        for c in text:
            if c in self.next[at]:
                total += self.log[at][c]
                at = self.next[at][c]
            else:
                total += self.log_other[at]
        return total + self.log_end[at]


def infer(examples: Iterable[tuple[str, int]], alpha: float = 0.05, alphabet: int = 8,
          smoothing: float = 0.1) -> Automaton:
    """``examples``: (symbols, how often). A smaller alpha merges more; ``smoothing`` is what each state's symbols
    count beforehand."""
    t = prefix_tree(examples)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red: list[int] = []
    blue = deque([(-1, "", 0)])
    while blue:
        parent, symbol, state = blue.popleft()
        if parent >= 0 and t[parent].next.get(symbol) != state:
            continue
        if state in red:
            continue
        for r in red:
            if _compatible(t, r, state, bound):
                t[parent].next[symbol] = r
                _fold(t, r, state)
                for q in red:  # folding may hang new subtrees on any red state
                    blue.extend((q, c, to) for c, to in t[q].next.items() if to not in red)
                break
        else:
            red.append(state)
            blue.extend((state, c, to) for c, to in t[state].next.items())
    return Automaton(t, red, alphabet, smoothing)
