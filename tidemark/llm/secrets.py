"""Secret scan: all rules as one minimal deterministic automaton, run over the bytes of each text once.

The automaton tells at which byte some rule first matches. For that rule alone, a backward automaton
then finds the leftmost start after the rule's previous match, and a forward one the longest end;
so each rule yields its leftmost, longest, non-overlapping matches. Texts are taken as
UTF-8; spans are given in code points of the original text, end exclusive.

Base kinds: ``assign``, ``access``, ``hex``; further rules add spans of their own kinds and never replace
base ones. A null or empty text has no spans.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.automaton import Rule, compile_rules
from tidemark.llm.common import add_columns, utf8

#: Kind, pattern, whether letters match in either case. The order is that of the listing.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True),
    ("access", r"AKIA[A-Z0-9]+", False),
    ("hex", r"[0-9a-f]{8,}", False),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False),
    ("forge", r"gh[opsur]_[A-Za-z0-9]+", False),
    ("chat", r"xox[abprs]-[A-Za-z0-9\-]+", False),
]
BASE = ("assign", "access", "hex")
KINDS = [kind for kind, _, _ in RULES]
#: Fewest characters of a match; shorter ones are dropped after the scan, so that the automaton need not count.
LEAST = {"access": 16, "hex": 32, "jwt": 40, "forge": 40, "chat": 24}
LEAST_VALUE = 8
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))


class Scanner:
    def __init__(self, rules=RULES):
        parsed = [Rule(pattern, ignore_case) for _, pattern, ignore_case in rules]
        self.kinds = [kind for kind, _, _ in rules]
        self.all = compile_rules(parsed, anywhere=True)
        self.forward = [compile_rules([r], anywhere=False) for r in parsed]
        self.backward = [compile_rules([r], anywhere=False, backward=True) for r in parsed]

    def _start(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The leftmost place from ``least`` on from which the rule matches up to ``end``."""
        dfa, state, found = self.backward[rule], 0, -1
        for i in range(end - 1, least - 1, -1):
            state = dfa.table[state + data[i]]
            if state >> 8 >= dfa.accepting:
                found = i
            elif state == dfa.dead:
                break
        return found

    def _end(self, rule: int, data: bytes, start: int) -> int:
        dfa, state, found = self.forward[rule], 0, -1
        for i in range(start, len(data)):
            state = dfa.table[state + data[i]]
            if state >> 8 >= dfa.accepting:
                found = i + 1
            elif state == dfa.dead:
                break
        return found

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes: leftmost, longest, non-overlapping within each rule."""
        table, accepting, accepts = self.all.table, self.all.accepting << 8, self.all.accepts
        free = [0] * len(self.kinds)  # from where each rule may match again
        found, state = [], 0
        for i, byte in enumerate(data):
            state = table[state + byte]
            if state >= accepting:
                for rule in accepts[state >> 8]:
                    if i >= free[rule]:
                        start = self._start(rule, data, i + 1, free[rule])
                        if start >= 0:
                            free[rule] = self._end(rule, data, start)
                            found.append((rule, start, free[rule]))
        return found

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then kind, after the checks of each kind."""
        kept = [(start, rule, end) for rule, start, end in self.matches(data) if self._holds(rule, data[start:end])]
        if not kept:
            return []
        places, at, points = {}, 0, 0
        for place in sorted({p for start, _, end in kept for p in (start, end)}):
            points += len(data[at:place].decode())
            at, places[place] = place, points
        return [(self.kinds[rule], places[start], places[end]) for start, rule, end in sorted(kept)]

    def _holds(self, rule: int, match: bytes) -> bool:
        kind = self.kinds[rule]
        if kind == "assign":
            return len(value_of(match)) >= LEAST_VALUE
        return len(match) >= LEAST.get(kind, 0)


def value_of(match: bytes) -> bytes:
    """What is assigned: all after the first sign and an optional space or quote."""
    sign = re.search(rb"[:=]", match)
    return match[sign.end() :].lstrip(b" ").lstrip(b"\"'") if sign else b""


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """Add ``spans_col``: an array of (kind, start, end), by start and then kind. All other columns stay."""

    held = docs.sparkSession.sparkContext.broadcast(scanner())  # a few MB, fixed by the rules

    def start():
        scan = held.value.spans
        names = ("kind", "start", "end")
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in scan(t)] if t else [] for t in utf8(texts)]]

    return add_columns(docs, [text_col], [T.StructField(spans_col, SPANS)], start)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace each union of overlapping secret spans by ``mark``; texts without any stay as they are, nulls too."""

    held = docs.sparkSession.sparkContext.broadcast(scanner())

    def start():
        scan = held.value.spans

        def clean(data: bytes | None) -> str | None:
            if data is None:
                return None
            text, found = data.decode(), scan(data)
            out, at = [], 0
            for _, a, b in sorted(found, key=lambda s: s[1:]):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return lambda texts: [[clean(x) for x in texts.cast(pa.binary()).to_pylist()]]

    order = docs.columns
    return add_columns(docs, [text_col], [T.StructField(text_col, T.StringType())], start).select(*[f"`{c}`" for c in order])


def listed(spans_col: str, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans, comma-joined, in their order."""
    spans = F.col(spans_col) if kinds is None else F.filter(spans_col, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
