"""Regular expressions over bytes to one minimal deterministic automaton.

A small rule notation (literals, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``) is parsed to
an NFA; subset construction gives a DFA whose states know which rules they accept; partition
refinement minimises it; the result is one flat transition array for all rules together.
"""

from __future__ import annotations

from array import array

CLASSES = {"d": set(range(48, 58)), "s": {9, 10, 11, 12, 13, 32}, "w": {*range(48, 58), *range(65, 91), 95, *range(97, 123)}}


class Nfa:
    """Thompson fragments: ``eps`` by state, ``moves`` by state as (byte set, target)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def step(self, bytes_: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a] = (bytes_, b)
        return a, b

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Rule:
    """The syntax tree of one pattern; a leaf is a set of bytes."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.text, self.at, self.ignore_case = pattern, 0, ignore_case
        self.tree = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unbalanced pattern at {self.at}: {pattern}")

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self._take()
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def _sequence(self):
        parts = []
        while self._peek() and self._peek() not in "|)":
            part = self._atom()
            while self._peek() and self._peek() in "?*+{":
                sign = self._take()
                if sign == "{":
                    end = self.text.index("}", self.at)
                    low, comma, high = self.text[self.at : end].partition(",")
                    self.at = end + 1
                    least, most = int(low), int(high) if high else None if comma else int(low)
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
                part = ("repeat", part, least, most)
            parts.append(part)
        return ("and", parts)

    def _atom(self):
        c = self._take()
        if c == "(":
            inner = self._either()
            if self._take() != ")":
                raise ValueError(self.text)
            return inner
        if c == "[":
            return self._class()
        if c == "\\":
            return self._leaf(self._escape())
        if c == ".":
            return self._leaf(set(range(256)) - {10})
        return self._leaf({ord(c)})

    def _escape(self) -> set[int]:
        c = self._take()
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2 : self.at], 16)}
        return set(CLASSES.get(c) or {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))})

    def _class(self):
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            c = self._take()
            low = self._escape() if c == "\\" else {ord(c)}
            if self._peek() == "-" and self.text[self.at + 1] != "]" and len(low) == 1:
                self._take()
                high = self._take()
                end = self._escape() if high == "\\" else {ord(high)}
                low = set(range(min(low), min(end) + 1))
            found |= low
        self._take()
        return self._leaf(set(range(256)) - found if negated else found)

    def _leaf(self, found: set[int]):
        if self.ignore_case:
            found = found | {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return frozenset(found)

    def build(self, nfa: Nfa, node=None, backward: bool = False) -> tuple[int, int]:
        node = self.tree if node is None else node
        if isinstance(node, frozenset):
            return nfa.step(node)
        a = b = nfa.state()
        if node[0] == "and":
            for part in reversed(node[1]) if backward else node[1]:
                s, e = self.build(nfa, part, backward)
                nfa.eps[b].append(s)
                b = e
        elif node[0] == "or":
            b = nfa.state()
            for part in node[1]:
                s, e = self.build(nfa, part, backward)
                nfa.eps[a].append(s)
                nfa.eps[e].append(b)
        else:
            _, part, least, most = node
            for _ in range(least):
                s, e = self.build(nfa, part, backward)
                nfa.eps[b].append(s)
                b = e
            if most is None:
                s, e = self.build(nfa, part, backward)
                nfa.eps[b].append(s)
                nfa.eps[e].append(s)
                end = nfa.state()
                nfa.eps[b].append(end)
                nfa.eps[e].append(end)
                b = end
            else:
                end = nfa.state()
                for _ in range(most - least):
                    nfa.eps[b].append(end)
                    s, e = self.build(nfa, part, backward)
                    nfa.eps[b].append(s)
                    b = e
                nfa.eps[b].append(end)
                b = end
        return a, b


class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` holds rule numbers.

    States are numbered so that every state from ``accepting`` on accepts some rule. State 0 is
    the start; ``dead`` (times 256) accepts nothing and has no way out, or is -1.
    """

    def __init__(self, table: array, accepts: list[tuple[int, ...]], accepting: int, dead: int):
        self.table, self.accepts, self.accepting, self.dead = table, accepts, accepting, dead


def compile_rules(rules: list[Rule], anywhere: bool, backward: bool = False) -> Dfa:
    """One minimal DFA of all rules. ``anywhere``: matches may begin at any byte, as if ``.*`` stood before each."""
    nfa = Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for k, rule in enumerate(rules):
        s, e = rule.build(nfa, backward=backward)
        nfa.eps[start].append(s)
        ends[e] = k
    # Bytes that no rule tells apart share a column while the sets are made.
    kinds: dict[tuple[bool, ...], list[int]] = {}
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    columns = list(kinds.values())
    first = nfa.closure([start])
    numbers, order, rows = {first: 0}, [first], []
    for state in order:
        row = []
        for column in columns:
            moved = [m[1] for q in state if (m := nfa.moves[q]) and column[0] in m[0]]
            to = nfa.closure(moved + [start] if anywhere else moved)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        rows.append(row)
    accepts = [tuple(sorted(ends[q] for q in state if q in ends)) for state in order]
    # Minimisation: split blocks until states of one block move to the same blocks.
    labels = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block, count = [labels[a] for a in accepts], len(labels)
    while True:
        signs: dict[tuple, int] = {}
        finer = [signs.setdefault((block[i], *(block[t] for t in rows[i])), len(signs)) for i in range(len(rows))]
        block = finer
        if len(signs) == count:
            break
        count = len(signs)
    of = {b: i for i, b in reversed(list(enumerate(block)))}
    plain = sorted((b for b in of if not accepts[of[b]]), key=lambda b: b != block[0])
    places = {b: i for i, b in enumerate(plain + [b for b in of if accepts[of[b]]])}
    table = array("i", [0]) * (256 * len(places))
    for b, place in places.items():
        for column, to in zip(columns, rows[of[b]], strict=True):
            for c in column:
                table[place * 256 + c] = places[block[to]] * 256
    dead = next((p * 256 for b, p in places.items() if not accepts[of[b]] and all(places[block[t]] == p for t in rows[of[b]])), -1)
    return Dfa(table, [accepts[of[b]] for b in places], len(plain), dead)
