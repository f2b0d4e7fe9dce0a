"""Letters without their marks, for all scripts, as JVM expressions: compatibility decomposition with the combining marks left out."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import once

#: Fixed values of the Unicode standard: where the Korean syllables and the three kinds of their parts begin, and how many of the latter two there are.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
VOWEL_COUNT, TAIL_COUNT = 21, 28
LAST = 0xD7A3


@lru_cache(1)
def decompositions() -> tuple[str, str, dict[str, str]]:
    """(letters, what they become, longer ones): letters that become one, or none (behind the end), and those that become several."""
    one, none, several = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or SYLLABLES <= code <= LAST:
            continue
        sign = chr(code)
        made = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))
        if not made:
            none.append(sign)
        elif len(made) > 1:
            several[sign] = made
        elif made != sign:
            one[sign] = made
    return "".join(one) + "".join(none), "".join(one.values()), several


def _syllable(sign: Column) -> Column:
    """The parts of a Korean syllable."""
    place = F.ascii(sign) - SYLLABLES
    part = lambda first, count, at: F.substring(F.lit("".join(chr(first + i) for i in range(count))), at, F.lit(1))
    lead = part(LEADS, (LAST - SYLLABLES) // (VOWEL_COUNT * TAIL_COUNT) + 1, (F.floor(place / (VOWEL_COUNT * TAIL_COUNT)) + 1).cast("int"))
    vowel = part(VOWELS, VOWEL_COUNT, (F.floor(place % (VOWEL_COUNT * TAIL_COUNT) / TAIL_COUNT) + 1).cast("int"))
    tail = F.when(place % TAIL_COUNT > 0, part(TAILS, TAIL_COUNT, (place % TAIL_COUNT + 1).cast("int"))).otherwise("")
    return F.concat(lead, vowel, tail)


def unaccented(text: Column) -> Column:
    """The text with each letter decomposed and its marks dropped. ASCII texts pass as they are; signs that become several are looked up only where one occurs."""
    letters, plain, several = decompositions()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    syllable = lambda c: (c >= chr(SYLLABLES)) & (c <= chr(LAST))
    rare = "".join(several) + "".join(chr(c) for c in range(SYLLABLES, LAST + 1))
    ascii_only = lambda t: F.octet_length(t) == F.length(t)

    def rest(short: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(short, ""), lambda c: F.when(syllable(c), _syllable(c)).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
        # A look into a table for each character; a pattern would try all the signs one after the other.
        return F.when(F.length(F.translate(short, rare, "")) < F.length(short), spelled).otherwise(short)

    # The text and what its letters become are worked out once each.
    return once(text, lambda t: F.when(ascii_only(t), t).otherwise(once(F.translate(t, letters, plain), rest)))
