"""Memoised parsing with derivatives.

The derivative of a language by a token is the language of what may follow.  A grammar in EBNF is read into nodes; what is
left to parse is a set of continuations, each a linked list of nodes; lists and sets are hash-consed, and the derivative of
a set by a token is remembered at the set.  After a few files nearly every step is one dictionary look-up.

An empty derivative marks the failing token; a derivative at the end that doesn't contain the empty word marks truncation.
"""

from __future__ import annotations

import re

#: States that one grammar keeps; beyond it the memory is dropped and built anew.
MEMORY = 400_000
_SYMBOL = re.compile(r"\s*(?:'([^']+)'|([A-Z_]+)|([a-z_0-9]+)|([()|*?+=;]))")


class _Cell:
    """A continuation: a node, and what follows it."""

    __slots__ = ("node", "rest", "memo")

    def __init__(self, node: tuple, rest: _Cell | None) -> None:
        self.node, self.rest, self.memo = node, rest, {}


class State(dict):
    """A set of continuations; as a dictionary, its derivatives by token kind."""

    __slots__ = ("cells", "nullable", "grammar")

    def __missing__(self, kind: str) -> State:
        out = self.grammar.step(self, kind)
        self[kind] = out
        return out


class Grammar:
    """``text`` holds rules ``name = alternatives ;`` with 'literals', TOKEN classes, rules, groups, and the suffixes * ? +.

    ``soft`` is the kind that may stand where a line ends or a bracket closes (automatic semicolons), or None; ``close`` is
    the kind before which it is implied, ``line`` the kind of a line end that counts as nothing else.
    """

    def __init__(self, text: str, start: str, soft: str | None = None, close: str | None = None, line: str | None = None) -> None:
        self.rules: dict[str, tuple] = {}
        self.soft, self.close, self.line = soft, close, line
        self._read(text)
        self._analyse()
        self.start = start
        self.reset()

    def reset(self) -> None:
        self.cells: dict[tuple[int, int], _Cell] = {}
        self.states: dict[frozenset[int], State] = {}
        self.kept: dict[int, _Cell] = {}
        self.end = _Cell(("end",), None)
        self.kept[id(self.end)] = self.end
        self.dead = self._state(frozenset())
        self.initial = self._state(frozenset([id(self._cell(("ref", self.start), self.end))]))

    # --- reading -------------------------------------------------------------------------------------------

    def _read(self, text: str) -> None:
        tokens = [m.groups() for m in _SYMBOL.finditer(text)]
        at = 0
        interned: dict[tuple, tuple] = {}

        def intern(node: tuple) -> tuple:
            return interned.setdefault(node, node)

        def alternatives() -> tuple:
            nonlocal at
            options = [sequence()]
            while at < len(tokens) and tokens[at][3] == "|":
                at += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else intern(("alt", *options))

        def sequence() -> tuple:
            nonlocal at
            items = []
            while at < len(tokens) and tokens[at][3] not in ("|", ")", ";"):
                literal, kind, rule, mark = tokens[at]
                at += 1
                if mark == "(":
                    item = alternatives()
                    at += 1
                else:
                    item = intern(("tok", literal or kind)) if not rule else intern(("ref", rule))
                while at < len(tokens) and tokens[at][3] in ("*", "?", "+"):
                    suffix = tokens[at][3]
                    at += 1
                    item = intern(("star", item)) if suffix == "*" else intern(("opt", item)) if suffix == "?" else intern(("seq", item, intern(("star", item))))
                items.append(item)
            return items[0] if len(items) == 1 else intern(("seq", *items))

        while at < len(tokens):
            name = tokens[at][2]
            at += 2  # the name and =
            self.rules[name] = alternatives()
            at += 1  # ;
        self.intern = intern

    def _analyse(self) -> None:
        """Nullability and first kinds of every rule, by iteration to a fixed point."""
        self.null = dict.fromkeys(self.rules, False)
        self.first: dict[str, frozenset[str]] = dict.fromkeys(self.rules, frozenset())
        changed = True
        while changed:
            changed = False
            for name, node in self.rules.items():
                null, first = self._nullable(node), self._first(node)
                if null != self.null[name] or first != self.first[name]:
                    self.null[name], self.first[name], changed = null, first, True
        self._firsts: dict[int, frozenset[str]] = {}

    def _nullable(self, node: tuple) -> bool:
        op = node[0]
        if op == "ref":
            return self.null[node[1]]
        if op == "seq":
            return all(map(self._nullable, node[1:]))
        if op == "alt":
            return any(map(self._nullable, node[1:]))
        return op in ("star", "opt")

    def _first(self, node: tuple) -> frozenset[str]:
        op = node[0]
        if op == "tok":
            return frozenset([node[1]])
        if op == "ref":
            return self.first[node[1]]
        if op in ("star", "opt"):
            return self._first(node[1])
        out: frozenset[str] = frozenset()
        for x in node[1:]:
            out |= self._first(x)
            if op == "seq" and not self._nullable(x):
                break
        return out

    def _starts(self, node: tuple, kind: str) -> bool:
        first = self._firsts.get(id(node))
        if first is None:
            first = self._firsts[id(node)] = self._first(node)
        return kind in first

    # --- derivatives -----------------------------------------------------------------------------------------

    def _cell(self, node: tuple, rest: _Cell) -> _Cell:
        node = self.intern(node)
        key = (id(node), id(rest))
        cell = self.cells.get(key)
        if cell is None:
            cell = self.cells[key] = _Cell(node, rest)
            self.kept[id(cell)] = cell
        return cell

    def _state(self, ids: frozenset[int]) -> State:
        state = self.states.get(ids)
        if state is None:
            state = self.states[ids] = State()
            state.cells = [self.kept[i] for i in ids]
            state.grammar = self
            state.nullable = any(map(self._ends, state.cells))
        return state

    def _ends(self, cell: _Cell) -> bool:
        while cell.node[0] != "end":
            if not self._nullable(cell.node):
                return False
            cell = cell.rest
        return True

    def derive(self, cell: _Cell, kind: str) -> frozenset[int]:
        """The continuations after one token of ``kind``."""
        known = cell.memo.get(kind)
        if known is not None:
            return known
        node, rest = cell.node, cell.rest
        op = node[0]
        if op == "end":
            out: frozenset[int] = frozenset()
        elif op == "tok":
            out = frozenset([id(rest)]) if node[1] == kind else frozenset()
        else:
            out = frozenset()
            if self._starts(node, kind):
                if op == "ref":
                    out = self.derive(self._cell(self.rules[node[1]], rest), kind)
                elif op == "alt":
                    for x in node[1:]:
                        if self._starts(x, kind):
                            out |= self.derive(self._cell(x, rest), kind)
                elif op == "star":
                    out = self.derive(self._cell(node[1], cell), kind)
                elif op == "opt":
                    out = self.derive(self._cell(node[1], rest), kind)
                else:
                    tail = node[2:]
                    after = self._cell(tail[0] if len(tail) == 1 else ("seq", *tail), rest) if tail else rest
                    out = self.derive(self._cell(node[1], after), kind)
            if self._nullable(node):  # what follows may begin with the token, too
                out |= self.derive(rest, kind)
        cell.memo[kind] = out
        return out

    def step(self, state: State, kind: str) -> State:
        ids: frozenset[int] = frozenset()
        if kind == self.line:
            ids = frozenset(map(id, state.cells))
            kind = self.soft
        for cell in state.cells:
            ids |= self.derive(cell, kind)
        if kind == self.close and self.soft:
            for i in set().union(*(self.derive(c, self.soft) for c in state.cells)) if state.cells else ():
                ids |= self.derive(self.kept[i], kind)
        return self._state(ids)

    def ends(self, state: State) -> bool:
        """Whether the text may end in this state."""
        return state.nullable or bool(self.soft) and state[self.soft].nullable

    def failure(self, kinds: list[str]) -> tuple[int, bool] | None:
        """None if the kinds are a text of the language; else (index of the failing token, whether it was the end)."""
        if len(self.states) > MEMORY:
            self.reset()
        state = self.initial
        for k in kinds:
            state = state[k]
        if state is not self.dead and self.ends(state):
            return None
        if state is not self.dead:
            return len(kinds), True
        state = self.initial
        for i, k in enumerate(kinds):
            state = state[k]
            if state is self.dead:
                return i, False
        return len(kinds), True
