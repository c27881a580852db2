"""Finite automata over bytes: construction from patterns, and a scan of whole buffers in array steps.

The scan cuts a buffer into lanes and moves all lanes one byte at a time, so a step is
one array lookup. A lane first runs from the root state; where its neighbour arrives
in another state, its beginning is run again from there until both agree. The states
are those of a plain pass from the first byte to the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROOT = 0
SEPARATOR = 0xFF  # never a byte of UTF-8


@dataclass(frozen=True)
class Automaton:
    """``table[state * width + classes[byte]]`` is the next state times ``width``; the root is 0."""

    table: np.ndarray
    classes: np.ndarray
    width: int
    accepts: tuple[int, ...]  # per state: bit set of the rules that end here

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        state, end, steps, classes = 0, -1, self.table, self.classes
        if self.accepts[0]:
            end = start
        for i in range(start, len(data)):
            state = steps[state + classes[data[i]]]
            if state < 0:
                break
            if self.accepts[state // self.width]:
                end = i + 1
        return end


# Patterns: literals, [classes], (a|b), ? * + {m} {m,} {m,n}, \x escapes and escaped signs.


def parse(pattern: str):
    tree, at = _alternatives(pattern, 0)
    if at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} at {at}")
    return tree


def _alternatives(p: str, at: int):
    options = []
    while True:
        items = []
        while at < len(p) and p[at] not in "|)":
            item, at = _repeated(p, at)
            items.append(item)
        options.append(("seq", items))
        if at < len(p) and p[at] == "|":
            at += 1
            continue
        return ("alt", options), at


def _repeated(p: str, at: int):
    item, at = _atom(p, at)
    while at < len(p) and p[at] in "?*+{":
        if p[at] == "{":
            close = p.index("}", at)
            low, _, high = p[at + 1 : close].partition(",")
            bounds = (int(low), int(high) if high else (None if "," in p[at:close] else int(low)))
            at = close
        else:
            bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[at]]
        item, at = ("rep", item, *bounds), at + 1
    return item, at


def _atom(p: str, at: int):
    if p[at] == "(":
        tree, at = _alternatives(p, at + 1)
        if p[at] != ")":
            raise ValueError(f"open group in {p!r}")
        return tree, at + 1
    if p[at] == "[":
        return _class(p, at + 1)
    byte, at = _byte(p, at)
    return ("set", frozenset([byte])), at


def _class(p: str, at: int):
    negated = p[at] == "^"
    at += negated
    members: set[int] = set()
    while p[at] != "]":
        low, at = _byte(p, at)
        high = low
        if p[at] == "-" and p[at + 1] != "]":
            high, at = _byte(p, at + 1)
        members.update(range(low, high + 1))
    return ("set", frozenset(set(range(SEPARATOR)) - members if negated else members)), at + 1


def _byte(p: str, at: int):
    if p[at] == "\\":
        if p[at + 1] == "x":
            return int(p[at + 2 : at + 4], 16), at + 4
        return ord(p[at + 1]), at + 2
    return ord(p[at]), at + 1


def either_case(tree):
    """The pattern with letters in either case."""
    kind = tree[0]
    if kind == "set":
        more = {ord(chr(b).swapcase()) for b in tree[1] if chr(b).isalpha() and b < 128}
        return ("set", tree[1] | more)
    if kind == "rep":
        return ("rep", either_case(tree[1]), *tree[2:])
    return (kind, [either_case(t) for t in tree[1]])


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Build ``tree`` after node ``start``; the node it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            middle = self.node()
            self.empty[start].append(middle)
            self.moves[middle] = (tree[1], end)
            return end
        if kind == "seq":
            for t in tree[1]:
                start = self.add(t, start)
            return start
        if kind == "alt":
            end = self.node()
            for t in tree[1]:
                first = self.node()
                self.empty[start].append(first)
                self.empty[self.add(t, first)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.node()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.node()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def compile_rules(trees: list, anchored: bool = False) -> Automaton:
    """One minimal automaton for all rules; unless ``anchored``, matches may begin at any byte.

    Subset construction over classes of bytes that no rule tells apart, then
    minimisation by refining a partition of the states.
    """
    nfa = _Nfa()
    starts, rule_of = [], {}
    for k, tree in enumerate(trees):
        first = nfa.node()
        starts.append(first)
        rule_of[nfa.add(tree, first)] = k
    sets = [m[0] for m in nfa.moves if m]
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, dtype=np.int64)
    for b in range(256):
        classes[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
    width = len(signature)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(width)]
    begin = nfa.closure(starts)
    known, order, rows = {begin: 0}, [begin], []
    for state in order:
        row = []
        moves = [nfa.moves[n] for n in state if nfa.moves[n]]
        for b in sample:
            reached = {end for members, end in moves if b in members}
            target = nfa.closure(reached | set(() if anchored else starts))
            if not target:
                row.append(-1)
                continue
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        rows.append(row)
    accepts = [sum({1 << rule_of[n] for n in state if n in rule_of}) for state in order]
    return _minimal(np.array(rows), accepts, classes, width)


def _minimal(rows: np.ndarray, accepts: list[int], classes: np.ndarray, width: int) -> Automaton:
    _, block = np.unique(np.array(accepts, dtype=object).astype(str), return_inverse=True)
    count = 0
    while True:
        # A missing move is a block of its own.
        view = np.column_stack([block, np.where(rows >= 0, block[rows], -1)])
        _, first, block = np.unique(view, axis=0, return_index=True, return_inverse=True)
        block = block.ravel()
        if len(first) == count:
            break
        count = len(first)
    # The root comes first.
    rank = np.argsort(np.argsort(np.where(np.arange(count) == block[0], -1, np.arange(count))))
    table = np.full((count, width), -1, dtype=np.int64)
    ends = [0] * count
    for b, at in enumerate(first):
        moved = rows[at]
        table[rank[b]] = np.where(moved >= 0, rank[block[moved]] * width, -1)
        ends[rank[b]] = accepts[at]
    return Automaton(table.ravel().astype(np.int32), classes, width, tuple(ends))


def run(table: np.ndarray, classes: np.ndarray, data: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """State after each byte of ``data``, from the root; ``table`` as in :class:`Automaton`."""
    size = len(data)
    lanes = max(1, min(lanes, size // 512))
    width = -(-size // lanes)
    padded = np.full(lanes * width, SEPARATOR, dtype=np.uint8)
    padded[:size] = data
    steps = np.ascontiguousarray(classes.astype(np.uint8)[padded].reshape(lanes, width).T)
    out = np.empty((width, lanes), dtype=np.int32)
    state = np.zeros(lanes, dtype=np.int32)
    for t in range(width):
        np.take(table, state + steps[t], out=out[t], mode="clip")
        state = out[t]
    # Lanes whose neighbour does not arrive at the root begin anew from its state.
    begun = np.zeros(lanes, dtype=np.int32)
    while True:
        arrive = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
        active = np.flatnonzero(arrive != begun)
        if not len(active):
            break
        begun[active] = arrive[active]
        state = arrive[active]
        for t in range(width):
            state = table[state + steps[t, active]]
            differ = state != out[t, active]
            active, state = active[differ], state[differ]
            if not len(active):
                break
            out[t, active] = state
    return out.T.reshape(-1)[:size]
