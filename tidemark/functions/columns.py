"""Column expressions: text, dates, guarded ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The federal units of Brazil.
UNITS = (
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
)
#: The level of a missing value, the level of rare ones, and the form of a mark in a text.
UNKNOWN = "UNKNOWN"
RARE = "RARE_OR_UNSEEN"
MARKER = r"(\[[A-ZÀ-Ü_]+\])"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it: an array of one."""
    return F.transform(F.array(value), use)[0]


def one_space(text: Column) -> Column:
    """Runs of ASCII white space to one blank."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def trimmed(text: Column) -> Column:
    """Without blanks and other Unicode spaces at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\p{Zs}+", ""), r"\p{Zs}+$", "")


def cleaned(text: Column) -> Column:
    return trimmed(one_space(F.coalesce(text, F.lit(""))))


def word_count(text: Column) -> Column:
    """Blank-separated parts; an empty text has one, as a split gives."""
    return F.size(F.split(text, " ")).cast("long")


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def times(text: Column, sign: str) -> Column:
    """How often a character occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("long")


def markers(text: Column) -> Column:
    """How many bracketed upper-case marks stand in the text."""
    return F.size(F.regexp_extract_all(text, F.lit(MARKER), 1)).cast("long")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


def unit(location: Column) -> Column:
    """The two capitals that end a location, if they are a known unit."""
    found = F.upper(F.regexp_extract(location, r"([A-Z]{2})\s*$", 1))
    return F.when(found.isin(*UNITS), found).otherwise(UNKNOWN)


def or_unknown(value: Column) -> Column:
    """Blank or missing values to UNKNOWN."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(UNKNOWN))


def parsed_date(text: Column) -> Column:
    """Year first with dashes or slashes, or day/month/year; null if it is no date."""
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.expr("1"))
    return F.coalesce(
        F.when(iso.isNotNull(), text.try_cast("date")),
        F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy/M/d")).cast("date")),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date")),
    )


def weekday(day: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(day) - 1).cast("long")


def first_of_month(day: Column) -> Column:
    return F.trunc(day, "month")


def turn(value: Column, period: int, wave) -> Column:
    """``wave`` (sine or cosine) of a cyclic value."""
    return wave(F.lit(2.0) * F.pi() * value / F.lit(float(period)))


def ln1(n: Column) -> Column:
    return F.ln(F.lit(1.0) + n)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b in doubles; ``otherwise`` where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(otherwise).cast("double"))


def logit(p: Column, edge: float = 1e-6) -> Column:
    held = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.ln(held / (1 - held))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
