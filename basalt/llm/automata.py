"""A small regular-expression compiler to one minimal deterministic automaton over bytes.

Syntax: literals, ``\\xHH`` and escaped characters, classes, groups,
alternation, ``? * +`` and ``{n}``.  Several rules share one automaton; a state
says, as a bit mask, which rules accept there.  Classes of bytes that no rule
tells apart share a column during construction; the finished transition array
has 256 entries a state.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np


class _Parser:
    """A tree of ('set', bytes), ('cat', parts), ('alt', parts), ('opt'|'star'|'plus', part)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i}")
        return tree

    def alt(self):
        parts = [self.cat()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            part = self.atom()
            while self.p[self.i : self.i + 1] in ("?", "*", "+", "{") and self.i < len(self.p):
                sign = self.p[self.i]
                if sign == "{":
                    m = re.compile(r"\{(\d+)\}").match(self.p, self.i)
                    part, self.i = ("cat", [part] * int(m[1])), m.end()
                else:
                    part, self.i = ({"?": "opt", "*": "star", "+": "plus"}[sign], part), self.i + 1
            parts.append(part)
        return ("cat", parts)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            tree = self.alt()
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.chars())
        if c == ".":
            self.i += 1
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset({self.char()}))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def chars(self) -> frozenset[int]:
        self.i += 1
        negate = self.p[self.i] == "^"
        self.i += negate
        out: set[int] = set()
        while self.p[self.i] != "]":
            lo = hi = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                hi = self.char()
            out |= set(range(lo, hi + 1))
        self.i += 1
        return frozenset(range(256)) - out if negate else frozenset(out)


def _mirror(tree):
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "cat":
        return (kind, [_mirror(p) for p in reversed(x)])
    return (kind, [_mirror(p) for p in x] if kind == "alt" else _mirror(x))


def any_case(pattern: str) -> str:
    """Each letter outside a class in either case."""
    return re.sub(r"\[[^]]*\]|\\.|[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]" if len(m[0]) == 1 else m[0], pattern)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        kind, x = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((x, end))
            return end
        if kind == "cat":
            for part in x:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in x:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        first, end = self.state(), self.state()
        self.empty[start].append(first)
        last = self.build(x, first)
        self.empty[last].append(end)
        if kind != "plus":
            self.empty[start].append(end)
        if kind != "opt":
            self.empty[last].append(first)
        return end


class Dfa:
    """``table[256 * state + byte]`` is the next state; ``accepts[state]`` the mask of rules; state 0 starts."""

    def __init__(self, patterns: list[str], anywhere: bool, mirrored: bool = False):
        nfa, start, ends = _Nfa(), 0, []
        nfa.state()
        if anywhere:
            nfa.moves[0].append((frozenset(range(256)), 0))
        for p in patterns:
            tree = _Parser(p).parse()
            first = nfa.state()
            nfa.empty[start].append(first)
            ends.append(nfa.build(_mirror(tree) if mirrored else tree, first))
        rows, masks = self._subsets(nfa, ends)
        self.table, self.accepts = self._minimal(rows, masks)
        #: No rule can match any more: all moves lead back and nothing accepts.
        self.dead = next((s for s in range(len(self.accepts)) if not self.accepts[s] and (self.table[256 * s : 256 * s + 256] == s).all()), -1)

    @staticmethod
    def _subsets(nfa: _Nfa, ends: list[int]) -> tuple[np.ndarray, list[int]]:
        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        sets = {chars for moves in nfa.moves for chars, _ in moves}
        kinds: dict[tuple, list[int]] = defaultdict(list)
        for b in range(256):
            kinds[tuple(b in s for s in sets)].append(b)
        groups = list(kinds.values())
        first = closed([0])
        number, todo, rows = {first: 0}, [first], []
        while todo:
            now = todo.pop(0)
            row = np.empty(256, np.int64)
            for group in groups:
                after = closed([t for s in now for chars, t in nfa.moves[s] if group[0] in chars])
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row[group] = number[after]
            rows.append(row)
        return np.array(rows), [sum(1 << k for k, e in enumerate(ends) if e in s) for s in number]

    @staticmethod
    def _minimal(rows: np.ndarray, masks: list[int]) -> tuple[np.ndarray, list[int]]:
        """Moore's refinement: states stay together while their moves lead to the same classes."""
        kind = np.unique(np.array(masks), return_inverse=True)[1]
        while True:
            after = np.unique(np.concatenate([kind[:, None], kind[rows]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            if after.max() == kind.max():
                break
            kind = after
        order: dict[int, int] = {}
        for k in [kind[0], *kind]:
            order.setdefault(int(k), len(order))
        new = np.array([order[int(k)] for k in kind])
        table, accepts = np.empty((len(order), 256), np.int64), [0] * len(order)
        for s in range(len(rows)):
            table[new[s]], accepts[new[s]] = new[rows[s]], masks[s]
        return table.reshape(-1), accepts
