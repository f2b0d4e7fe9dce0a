"""Personal data: base patterns, and a semi-Markov conditional random field for what they don't reach.

The field scores whole segments of up to ``LONGEST`` tokens: how many digits, in which groups, between
which signs, whether a checksum or an address holds, which word stands before. Dynamic programming over
segments of bounded length chooses boundaries and types together. Segments can only be entities if they hold an ``@``, or
seven to ``MOST_DIGITS`` digits without other letters between, so the chain falls apart between such regions; deciding each region alone
is the same as deciding the whole text.

The field is fitted here, on sentences written out from the patterns below. Base spans always stay; of the field's
segments those are added that overlap no base span. A null or empty text has no spans. Rows are judged one by one, so repeated
rows have equal spans; of covers with equal scores the one with fewer and later segments is taken.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
#: More digits than any entity has; longer segments are none.
MOST_DIGITS = 24
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()),
]))

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, and takes whole runs, so no digit is looked at twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    parts = text.split(".", 4)
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() for p in parts):
        return False
    return all(len(value := p.lstrip("0")) <= 3 and int(value or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    # A local part can only end at an @, so each @ is looked at instead of each letter.
    at, free = text.find("@"), 0
    while at >= 0:
        low = at
        while low > free and text[low - 1] in LOCAL_CHARS:
            low -= 1
        match = DOMAIN.match(text, at) if low < at else None
        if match:
            found.append(("email", low, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


# The field.

TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\S")
REGION = re.compile(r"[+(]?[0-9][0-9\x20().+-]*")
CUE = re.compile(r"([^\W\d_]+)[^\w]{0,3}\Z")
#: Words that announce a number.
CUES = {
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp telefon téléphone teléfono handy".split()),
    "card": frozenset("card visa mastercard amex kreditkarte carte tarjeta".split()),
    "ip": frozenset("ip host server address".split()),
    "email": frozenset("mail email contact".split()),
}
FEATURES = (
    ["bias", "at", "domain", "plus", "paren", "dots3", "octets", "luhn", "not_luhn", "gap", "dash", "dot", "one_group", "edge", "tokens"]
    + [f"digits_{k}" for k in ("0_6", "7_8", "9_11", "12", "13_15", "16", "17_19", "20")]
    + [f"groups_{k}" for k in ("3_3_4", "4_4_4_4", "4_6_5", "other")]
    + [f"cue_{k}" for k in KINDS] + ["no_cue"]
)
PLACE = {name: i for i, name in enumerate(FEATURES)}


def segment_features(segment: str, before: str, tokens: int, open_left: bool, open_right: bool) -> list[int]:
    """Active features of a whole candidate segment; ``open`` sides touch a further letter, digit or digit-joining sign."""
    digits, groups = digits_of(segment), [len(g) for g in re.findall(r"[0-9]+", segment)]
    n = len(digits)
    on = ["bias"]
    if "@" in segment:
        on.append("at")
        if re.fullmatch(r"[^\s@]+@[\w-]+(?:\.[\w-]+)+", segment):
            on.append("domain")
    if segment[0] == "+":
        on.append("plus")
    if re.match(r"(?:\+[0-9]{1,3} ?)?\([0-9]{2,4}\)", segment):
        on.append("paren")
    if segment.count(".") == 3 and len(groups) == 4:
        on.append("dots3")
    if octets(segment):
        on.append("octets")
    if 13 <= n <= 19:
        on.append("luhn" if luhn(digits) else "not_luhn")
    on += [name for sign, name in ((" ", "gap"), ("-", "dash"), (".", "dot")) if sign in segment]
    if len(groups) == 1:
        on.append("one_group")
    if open_left or open_right:
        on.append("edge")
    if tokens > 8:
        on.append("tokens")
    for name, low, high in (("0_6", 0, 6), ("7_8", 7, 8), ("9_11", 9, 11), ("12", 12, 12), ("13_15", 13, 15), ("16", 16, 16), ("17_19", 17, 19)):
        if low <= n <= high:
            on.append(f"digits_{name}")
    if n >= 20:
        on.append("digits_20")
    tail = tuple(groups[-3:])
    on.append(
        "groups_3_3_4" if tail == (3, 3, 4) else "groups_4_4_4_4" if groups == [4] * 4 else "groups_4_6_5" if groups == [4, 6, 5] else "groups_other"
    )
    cues = [f"cue_{kind}" for kind in KINDS if before.lower() in CUES[kind]]
    return [PLACE[name] for name in on + (cues or ["no_cue"])]


BLANK = re.compile(r"\s")


def regions(text: str) -> list[tuple[int, int]]:
    """Where entities can be: what stands about each @ up to white space, and runs of seven digits at least and their signs.

    Regions that overlap are one region.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and not text[low - 1].isspace():
            low -= 1
        blank = BLANK.search(text, at)
        done = blank.start() if blank else len(text)
        found.append((low, done))
        at = text.find("@", done)
    found += [(m.start(), m.end()) for m in REGION.finditer(text) if m.end() - m.start() >= 7 and len(digits_of(m[0])) >= 7]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def candidates(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Tokens of a region, and (first token, last token, features) of each segment that can be an entity."""
    tokens = [(m.start(), m.end()) for m in TOKENS.finditer(text, low, high)]
    digits, groups, ats, letters = [0], [0], [0], [0]  # before each token
    for start, end in tokens:
        first = text[start]
        number = "0" <= first <= "9"
        digits.append(digits[-1] + (end - start if number else 0))
        groups.append(groups[-1] + number)
        ats.append(ats[-1] + (first == "@"))
        letters.append(letters[-1] + first.isalpha())
    made = []
    for i, (start, _) in enumerate(tokens):
        most = min(len(tokens), i + LONGEST)
        if ats[most] == ats[i] and digits[most] - digits[i] < 7 or not (text[start].isalnum() or text[start] in "+("):
            continue
        cue = None
        for j in range(i, most):
            end = tokens[j][1]
            if j > i and tokens[j][0] - tokens[j - 1][1] > 1:
                break
            mail, n = ats[j + 1] > ats[i], digits[j + 1] - digits[i]
            if n > MOST_DIGITS and not mail or mail and end - start > j - i + 1 and " " in text[start:end]:
                break
            if ats[j + 1] - ats[i] > 1 or not text[end - 1].isalnum():
                continue
            # A number has no letters, and its groups have one and a half digits on average at least.
            if not mail and (n < 7 or letters[j + 1] > letters[i] or 2 * n < 3 * (groups[j + 1] - groups[i])):
                continue
            if cue is None:
                before = CUE.search(text, max(0, start - 24), start)
                cue = before[1] if before else ""
            left = start > 0 and (text[start - 1].isalnum() or text[start - 1] in "+-." and start > 1 and text[start - 2].isalnum())
            right = end < len(text) and (text[end].isalnum() or text[end] in "-.@" and end + 1 < len(text) and text[end + 1].isalnum())
            made.append((i, j, segment_features(text[start:end], cue, j - i + 1, left, right)))
    return tokens, made


def decode(n: int, made: list[tuple[int, int, list[int]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best cover of ``n`` tokens by entities (first, last, kind) and single other tokens, which score 0."""
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, on in made:
        scores = weights[on].sum(axis=0)
        kind = int(scores.argmax())
        ending.setdefault(j, []).append((i, kind, float(scores[kind])))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(n):
        best[j + 1] = best[j]
        for i, kind, value in ending.get(j, ()):
            if best[i] + value > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + value, (i, j, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = back[j][0]
    return out[::-1]


def _card(rnd: random.Random, n: int = 16, valid: bool = True) -> str:
    while True:
        digits = "".join(str(rnd.randrange(10)) for _ in range(n))
        if luhn(digits) == valid:
            return digits


def _examples(count: int = 420, seed: int = 17) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with one entity or one number that is none, from fixed patterns."""
    rnd = random.Random(seed)
    d = lambda n: "".join(str(rnd.randrange(10)) for _ in range(n))
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    octet = lambda: str(rnd.randrange(256))
    makers = [
        lambda: ("email", "", f"{word()}.{d(2)}@{word()}.{rnd.choice(('com', 'org', 'de'))}"),
        lambda: ("email", rnd.choice(("", "mail")), f"{word()}@{word()}{d(1)}.{word()}.com"),
        lambda: ("ip", rnd.choice(("", "ip", "host")), ".".join(octet() for _ in range(4))),
        lambda: ("card", rnd.choice(("", "", "card")), _card(rnd)),
        lambda: ("card", rnd.choice(("", "visa")), "-".join(re.findall("....", _card(rnd)))),
        lambda: ("card", "", " ".join(re.findall("....", _card(rnd)))),
        lambda: ("phone", rnd.choice(("", "tel", "call")), f"+1 ({d(3)}) {d(3)}-{d(4)}"),
        lambda: ("phone", rnd.choice(("", "phone")), f"+{rnd.choice(('33', '44', '49'))} {d(3)} {d(7)}"),
        lambda: ("phone", rnd.choice(("call", "tel", "phone", "")), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: ("phone", rnd.choice(("tel", "fax", "mobile")), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (None, rnd.choice(("", "card", "tel")), _card(rnd, valid=False)),
        lambda: (None, "", d(rnd.randint(7, 12))),
        lambda: (None, "", d(rnd.randint(20, 30))),
        lambda: (None, rnd.choice(("", "host")), f"{rnd.randrange(256, 999)}.{d(3)}.{octet()}.{octet()}"),
        lambda: (None, "", f"20{d(2)}-0{rnd.randint(1, 9)}-1{d(1)} 1{d(1)}.{d(2)}"),
        lambda: (None, "", f"{d(4)} {d(4)}"),
        lambda: (None, "", f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (None, "", f"{d(2)}.{d(3)}.{d(3)}.{d(2)}.{d(1)}"),
        lambda: (None, "", f"@{word()}"),
        lambda: (None, "", f"{word()}@{word()}"),
        lambda: (None, "", f"{word()}{d(8)}"),
    ]
    out = []
    for k in range(count):
        kind, cue, said = makers[k % len(makers)]()
        head = f"{word()} {cue + rnd.choice((' ', ': ')) if cue else word() + ' '}"
        out.append((f"{head}{said} {word()}.", [(kind, len(head), len(head) + len(said))] if kind else []))
    return out


@lru_cache(maxsize=1)
def fitted(steps: int = 120, rate: float = 0.4, ridge: float = 0.02) -> np.ndarray:
    """Weights by feature and kind: penalised maximum likelihood of the field over the example sentences."""
    chains = []
    for text, gold in _examples():
        for low, high in regions(text):
            tokens, made = candidates(text, low, high)
            right = {(s, e): KINDS.index(kind) for kind, s, e in gold}
            truth = [right.get((tokens[i][0], tokens[j][1]), -1) for i, j, _ in made]
            if made:
                x = np.zeros((len(made), len(FEATURES)))
                for row, (_, _, on) in enumerate(made):
                    x[row, on] = 1
                chains.append((len(tokens), [(i, j) for i, j, _ in made], x, truth))
    w = np.zeros((len(FEATURES), len(KINDS)))
    seen = np.full_like(w, 1e-8)
    for _ in range(steps):
        slope = -ridge * w
        for n, ends, x, truth in chains:
            scores = np.clip(x @ w, -30, 30)
            total = np.exp(scores).sum(axis=1)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)  # sums over covers of a head and of a tail
            ahead[0] = behind[n] = 1.0
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for k, (i, j) in enumerate(ends):
                by_end.setdefault(j, []).append(k)
                by_start.setdefault(i, []).append(k)
            for j in range(n):
                ahead[j + 1] = ahead[j] + sum(ahead[ends[k][0]] * total[k] for k in by_end.get(j, ()))
            for i in range(n - 1, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[ends[k][1] + 1] * total[k] for k in by_start.get(i, ()))
            share = np.array([ahead[i] * behind[j + 1] for i, j in ends]) / ahead[n]
            expected = -np.exp(scores) * share[:, None]
            for k, kind in enumerate(truth):
                if kind >= 0:
                    expected[k, kind] += 1
            slope += x.T @ expected / len(chains) * 20
        seen += slope**2
        w += rate * slope / np.sqrt(seen)
    return w


def spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether base), by kind as listed, then start."""
    base = base_spans(text)
    found = [(kind, s, e, True) for kind, s, e in base]
    taken = sorted(((s, e) for _, s, e in base), reverse=True)
    for low, high in regions(text):
        while taken and taken[-1][1] <= low:  # base spans in descending order; those behind are done with
            taken.pop()
        starts, ends = [], []  # of the base spans from here on, united
        k = len(taken) - 1
        while k >= 0 and taken[k][0] < high:
            s, e = taken[k]
            if ends and s < ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
            k -= 1
        tokens, made = candidates(text, low, high)
        # Base spans stay, so only segments clear of them compete.
        made = [m for m in made if not starts or (at := bisect_left(starts, tokens[m[1]][1])) == 0 or ends[at - 1] <= tokens[m[0]][0]]
        if made:
            found += [(KINDS[kind], tokens[i][0], tokens[j][1], False) for i, j, kind in decode(len(tokens), made, weights)]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "personal") -> DataFrame:
    """Add ``spans_col``: an array of (kind, start, end, base) in code points, by kind, then start. All other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted())  # a small matrix
    names = ("kind", "start", "end", "base")

    def start():
        weights = sent.value
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in spans(t, weights)] if t else [] for t in texts.to_pylist()]]

    return add_columns(docs, [text_col], [T.StructField(spans_col, SPANS)], start)


def listed(spans_col: str, base_only: bool = False):
    """``kind:start:end`` of the spans, comma-joined, in their order."""
    held = F.filter(spans_col, lambda s: s["base"]) if base_only else F.col(spans_col)
    return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
