"""Many byte patterns compiled to one minimal deterministic automaton, and a scan of a whole buffer in one pass.

Patterns are a small part of the usual notation: literals, `\\xHH` and `\\` before a mark, classes with ranges, groups, `|`, and
`? * + {n} {n,} {n,m}`. A leading `(?i)` makes ASCII letters match in either case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: A byte that never occurs in UTF-8; it stands between texts.
BETWEEN = 0xFF
#: Texts are scanned in so many places at once, at most.
LANES = 8192


class _Reader:
    """Pattern text to nested ("set", bytes) / ("seq", parts) / ("alt", parts) / ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.text, self.at = pattern.removeprefix("(?i)"), 0

    def more(self, stops: str = "") -> bool:
        return self.at < len(self.text) and self.text[self.at] not in stops

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2:self.at], 16)
        return ord(c)

    def bytes_of(self, found: set[int]) -> tuple:
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return "set", frozenset(found)

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self.more() and self.text[self.at] == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.more("|)"):
            parts.append(self.repeated())
        return "seq", parts

    def repeated(self) -> tuple:
        part = self.single()
        while self.more() and self.text[self.at] in "?*+{":
            mark = self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark, (0, 0))
            if mark == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:end].partition(",")
                least, most, self.at = int(low), (int(high) if high else None) if comma else int(low), end + 1
            part = "rep", part, least, most
        return part

    def single(self) -> tuple:
        if self.text[self.at] == "(":
            self.take()
            inner = self.either()
            self.take()
            return inner
        if self.text[self.at] == "[":
            self.take()
            found: set[int] = set()
            while self.text[self.at] != "]":
                low = self.byte()
                high = low
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.byte()
                found |= set(range(low, high + 1))
            self.take()
            return self.bytes_of(found)
        return self.bytes_of({self.byte()})


class _Graph:
    """Nondeterministic graph: silent steps and steps on a set of bytes."""

    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.silent.append([])
        self.steps.append([])
        return len(self.silent) - 1

    def add(self, part: tuple, start: int) -> int:
        """Append the part after start; the node where it ends."""
        kind = part[0]
        if kind == "set":
            end = self.node()
            self.steps[start].append((part[1], end))
            return end
        if kind == "seq":
            for inner in part[1]:
                start = self.add(inner, start)
            return start
        end = self.node()
        if kind == "alt":
            for inner in part[1]:
                self.silent[self.add(inner, start)].append(end)
            return end
        _, inner, least, most = part
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.node()
            self.silent[start].append(loop)
            self.silent[self.add(inner, loop)].append(loop)
            self.silent[loop].append(end)
        else:
            self.silent[start].append(end)
            for _ in range(most - least):
                start = self.add(inner, start)
                self.silent[start].append(end)
        return end

    def closure(self, nodes: set[int]) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for to in self.silent[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _reversed(part: tuple) -> tuple:
    if part[0] == "seq":
        return "seq", [_reversed(p) for p in reversed(part[1])]
    if part[0] == "alt":
        return "alt", [_reversed(p) for p in part[1]]
    return part if part[0] == "set" else ("rep", _reversed(part[1]), *part[2:])


@dataclass(frozen=True)
class Automaton:
    """classes: class of each byte; table: next state of (state, class), states times the number of classes; state 0 starts.

    accepts: a bit per pattern for each state. States that accept come last, from `hot` on (times the number of classes).
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    hot: int

    @property
    def width(self) -> int:
        return self.table.shape[1]

    @cached_property
    def dead(self) -> int:
        """The state that is never left and accepts nothing, times the number of classes; -1 if there is none."""
        stuck = (self.table == np.arange(len(self.table))[:, None] * self.width).all(1) & (self.accepts == 0)
        return int(np.flatnonzero(stuck)[0]) * self.width if stuck.any() else -1


def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart, by refining the split into equal accepts until it stands."""
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    # start first, accepting states last
    heads = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
    order = sorted(range(len(heads)), key=lambda g: (g != group[0], accepts[heads[g]] != 0, g))
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    return place[group[table[heads[order]]]], accepts[heads[order]]


def compiled(patterns: list[str], anywhere: bool = True, backward: bool = False) -> Automaton:
    """One automaton for all patterns by subset construction. anywhere: matches may start at every byte; else only at the first."""
    graph = _Graph()
    root = graph.node()
    ends: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        parsed = _Reader(pattern).either()
        ends[graph.add(_reversed(parsed) if backward else parsed, root)] = 1 << k
    # bytes that every step treats alike are one class
    marks = sorted({s for steps in graph.steps for s, _ in steps}, key=sorted)
    names: dict[tuple, int] = {}
    classes = np.array([names.setdefault(tuple(b in s for s in marks), len(names)) for b in range(256)])
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(names))]
    start = graph.closure({root})
    states, rows, todo = {start: 0}, [], [start]
    for now in todo:
        row = []
        for b in sample:
            to = {t for n in now for s, t in graph.steps[n] if b in s}
            new = graph.closure(to) | (start if anywhere else frozenset())
            if new not in states:
                states[new] = len(states)
                todo.append(new)
            row.append(states[new])
        rows.append(row)
    accepts = np.array([sum(ends.get(n, 0) for n in s) for s in todo], np.int64)
    table, accepts = _minimal(np.array(rows), accepts)
    hot = len(accepts) - int((accepts != 0).sum())
    width = len(sample)
    return Automaton(classes.astype(np.uint8), (table * width).astype(np.int32), accepts, hot * width)


def scan(data: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(end, bits) of all places where patterns accept; end is exclusive. data: bytes of texts with BETWEEN between them.

    The buffer is cut into lanes that are stepped together, each from the start state. A lane that ends in the midst of a match is
    followed beyond its end until a run from the start state is in the same state; from there on the next lane has seen the same.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = max(1, min(LANES, size // 64))
    length = -(-size // lanes)
    padded = np.full(lanes * length, BETWEEN, np.uint8)
    padded[:size] = data
    steps = np.ascontiguousarray(machine.classes[padded].reshape(lanes, length).T).astype(np.int32)
    table, accepts = machine.table.ravel(), machine.accepts
    state, ends, bits = np.zeros(lanes, np.int32), [], []
    for k in range(length):
        np.take(table, state + steps[k], out=state)
        met = state >= machine.hot
        if met.any():
            lane = np.flatnonzero(met)
            ends.append(lane * length + k + 1)
            bits.append(accepts[state[lane] // machine.width])
    for lane in np.flatnonzero(state[:-1]):
        now, fresh, at = int(state[lane]), 0, (int(lane) + 1) * length
        while now != fresh and at < size:
            c = int(machine.classes[data[at]])
            now, fresh, at = int(table[now + c]), int(table[fresh + c]), at + 1
            if now >= machine.hot:
                ends.append(np.array([at]))
                bits.append(np.array([accepts[now // machine.width]]))
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, bits = np.concatenate(ends), np.concatenate(bits)
    keep = ends <= size
    ends, which = np.unique(ends[keep], return_inverse=True)
    joined = np.zeros(len(ends), np.int64)
    np.bitwise_or.at(joined, which, bits[keep])
    return ends, joined


def begin(data: bytes, end: int, least: int, backward: Automaton) -> int:
    """Leftmost start, not before `least`, of a match that ends at `end`; -1 if there is none. backward: one pattern, reversed, anchored."""
    table, state, found = backward.table.ravel(), 0, -1
    for at in range(end - 1, least - 1, -1):
        state = int(table[state + int(backward.classes[data[at]])])
        if state == backward.dead:
            break
        if state >= backward.hot:
            found = at
    return found
