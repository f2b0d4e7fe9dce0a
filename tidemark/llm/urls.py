"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A rule names a host, with all its subdomains, and the start of a path; of the rules that fit a URL the longest
decides. Elsewhere the automaton finds the terms of a weighted table that stand between characters other than letters and digits.
A term of the weight ``LIMIT`` or more is strict and blocks alone; lighter, soft ones block where distinct terms reach ``LIMIT`` together.
A term counts once, however often it occurs.

A null URL, or one without ``://``, has an empty host and an empty path, fits no rule, and is judged by its terms. URLs are judged one by
one, so repeated rows have equal verdicts; of rules of equal length, which can't differ in host or path, the first counts.
"""

from __future__ import annotations

import csv
import os
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

#: Fixed values: (host, path start, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: The weight at which a URL is blocked.
LIMIT = 4
VOCABULARY = os.path.join(os.path.dirname(__file__), "url_terms.csv")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
FIELDS = [
    T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("verdict", T.StringType()), T.StructField("strict_terms", T.ArrayType(T.StringType())),
    T.StructField("soft_terms", T.ArrayType(T.StringType())), T.StructField("weight", T.LongType()),
]


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def read_terms(path: str = VOCABULARY) -> tuple[tuple[str, int], ...]:
    """(term, weight) of a CSV table with these columns."""
    with open(path, newline="") as f:
        return tuple((row["term"], int(row["weight"])) for row in csv.DictReader(f))


@lru_cache(maxsize=4)
def vocabulary(weighted: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term, weight in weighted:
        built.add_word(term, (weight, term))
    if weighted:
        built.make_automaton()
    return built


def terms(url: str, built: ahocorasick.Automaton) -> dict[str, int]:
    """Weights by distinct term that no letter or digit touches."""
    low = url.translate(ASCII_LOWER)
    found: dict[str, int] = {}
    for last, (weight, term) in built.iter(low) if len(built) else ():
        first = last - len(term) + 1
        if (first == 0 or not low[first - 1].isalnum()) and (last + 1 == len(low) or not low[last + 1].isalnum()):
            found[term] = weight
    return found


def rule_of(host: str, path: str, held: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict; rules are looked up by each suffix of the host."""
    best, suffix = None, host
    while suffix:
        for start, verdict in held.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best[0])):
                best = (suffix + start, verdict)
        suffix = suffix.partition(".")[2]
    return best


def judge(
    pages: DataFrame, url_col: str = "url", rules=RULES, weighted: tuple[tuple[str, int], ...] | None = None, limit: int = LIMIT
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``strict_terms``, ``soft_terms``, ``weight`` to each URL.

    ``weighted`` are the terms and weights, by default those of the file beside this module.
    """
    chosen = tuple(read_terms() if weighted is None else weighted)
    held: dict[str, list[tuple[str, str]]] = {}
    for host, start, verdict in rules:
        held.setdefault(host, []).append((start, verdict))

    def start():
        built = vocabulary(chosen)

        def apply(urls: pa.Array) -> list:
            rows = []
            for url in urls.to_pylist():
                host, path = parts(url)
                rule = rule_of(host, path, held)
                found = terms(url or "", built)
                weight = sum(found.values())
                hard, soft = sorted(t for t, w in found.items() if w >= limit), sorted(t for t, w in found.items() if w < limit)
                method = "block" if weight >= limit else "allow"
                rows.append((host, path, rule and rule[0], rule[1] if rule else method, hard, soft, weight))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

        return apply

    return add_columns(pages, [url_col], FIELDS, start)
